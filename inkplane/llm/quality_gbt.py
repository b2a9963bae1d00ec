"""A quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown on binned statistics of a bounded sample of labelled documents, and flattened into arrays that score a
whole batch level by level. Statistics cover whole texts.

Defined results: a null text is empty; a null doc_id is held out of learning and scored; repeated rows score alike; a
document with several labels is learned with each; with labels of one value only, every score is that value's share;
without labels every score is 0.5; an empty table gives no rows; other columns of the documents are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkplane.llm.common import held_out

#: Labelled documents that a model is fitted on at most, those whose ids hash lowest: the bound on what the driver gets.
SAMPLE = 3000
#: Score from which a document is predicted to be of quality.
THRESHOLD = 0.3
TREES, DEPTH, RATE, BINS, LEAST_LEAF, RIDGE = 120, 4, 0.1, 64, 8, 1.0

STATISTICS = (
    "chars", "words", "lines", "mean_word", "long_words", "upper", "digit", "space", "punctuation", "other_signs", "pipes", "bangs", "non_ascii",
    "distinct_words", "top_word", "repeats_before", "distinct_lines", "sentence_ends", "signed_words", "upper_words", "mean_line", "deflated", "distinct_pairs", "vowels",
)
_SENTENCE = re.compile(rb"[.!?](?=\s|$)")


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a text; shares are of its bytes, words or lines, and 0 where there are none."""
    data = (text or "").encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n, w, m = max(len(data), 1), max(len(words), 1), max(len(lines), 1)
    kinds: dict[bytes, int] = {}
    for x in words:
        kinds[x] = kinds.get(x, 0) + 1
    upper, digit = counts[65:91].sum(), counts[48:58].sum()
    space = counts[9:14].sum() + counts[32]
    signs = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    plain = counts[[44, 46, 39, 45, 63, 58, 59]].sum()
    again = sum(map(bytes.__eq__, words, words[1:]))
    letters = max(counts[65:91].sum() + counts[97:123].sum(), 1)
    low = counts[97:123] + counts[65:91]
    return [
        np.log1p(len(data)), np.log1p(len(words)), np.log1p(len(lines)), len(data) / w, sum(1 for x in words if len(x) > 15) / w, upper / n, digit / n, space / n, plain / n, (signs - plain) / n, counts[124] / n, counts[33] / n, counts[128:].sum() / n,
        len(kinds) / w, max(kinds.values(), default=0) / w, again / w, len(set(lines)) / m, len(_SENTENCE.findall(data)) / w, sum(1 for x in words if x[-1] in b"!#$%&*|<>") / w, sum(1 for x in words if x.isupper()) / w, np.log1p(len(data) / m), len(zlib.compress(data, 1)) / n, len(set(zip(words, words[1:]))) / w, low[[0, 4, 8, 14, 20]].sum() / letters,
    ]


@dataclass
class Trees:
    """Complete binary trees of one depth, node k of a level with children 2k and 2k + 1, as arrays over the trees."""

    base: float
    feature: np.ndarray  # trees x inner nodes, level after level
    cut: np.ndarray  # the same; a row goes right where its value is above
    leaf: np.ndarray  # trees x 2 ** depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row: every level of a tree is one step over all rows."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(leaf.size.bit_length() - 1):
                at = node + (1 << level) - 1
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            total += leaf[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Grow trees on the gradients of the logistic loss, by histograms of BINS quantile bins."""
    n, m = x.shape
    share = float(y.mean()) if n else 0.5
    none = Trees(np.log(min(max(share, 1e-6), 1 - 1e-6) / (1 - min(max(share, 1e-6), 1 - 1e-6))), np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)))
    if not n or share in (0, 1):
        return none
    cuts = np.quantile(x, np.arange(1, BINS) / BINS, axis=0, method="lower")  # BINS - 1 x m
    binned = np.stack([np.searchsorted(cuts[:, f], x[:, f], side="left") for f in range(m)], axis=1)
    flat, total = binned + np.arange(m) * BINS, np.full(n, none.base)
    features, edges, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node, feature, edge = np.zeros(n, np.int64), np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            k = 1 << level
            at = (node[:, None] * (m * BINS) + flat).ravel()
            sums = [np.bincount(at, np.repeat(v, m), k * m * BINS).reshape(k, m, BINS).cumsum(axis=2) for v in (g, h, np.ones(n))]
            left, every = [s[:, :, :-1] for s in sums], [s[:, :1, -1:] for s in sums]
            gain = left[0] ** 2 / (left[1] + RIDGE) + (every[0] - left[0]) ** 2 / (every[1] - left[1] + RIDGE) - every[0] ** 2 / (every[1] + RIDGE)
            gain[(left[2] < LEAST_LEAF) | (every[2] - left[2] < LEAST_LEAF)] = -1
            best = gain.reshape(k, -1).argmax(axis=1)
            good = gain.reshape(k, -1)[np.arange(k), best] > 1e-9
            f, b = best // (BINS - 1), best % (BINS - 1)
            feature[k - 1 : 2 * k - 1] = np.where(good, f, 0)
            edge[k - 1 : 2 * k - 1] = np.where(good, cuts[b, f], np.inf)
            node = 2 * node + (x[np.arange(n), feature[node + k - 1]] > edge[node + k - 1])
        leaf = -RATE * np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + RIDGE)
        total += leaf[node]
        features.append(feature), edges.append(edge), leaves.append(leaf)
    return Trees(none.base, np.array(features), np.array(edges), np.array(leaves))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees fitted on at most ``sample`` labelled documents that are not held out."""
    marks = labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
    known = docs.select("doc_id").join(marks, F.col("doc_id") == F.col("_id"), "left_semi").distinct()
    ids = [r.doc_id for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    if not ids:
        return fit(np.empty((0, len(STATISTICS))), np.empty(0))
    chosen = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], "_id bigint"))
    stats = F.pandas_udf(_statistics, "array<double>")
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id")).select("doc_id", stats("text").alias("x"))
    x = {}
    for r in rows.orderBy("doc_id", "x").toLocalIterator():
        x.setdefault(r.doc_id, []).append(r.x)
    y = marks.join(chosen, "_id").orderBy("_id", "_y").collect()
    pairs = [(v, r._y) for r in y for v in x.get(r._id, [])]
    return fit(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], float))


def _statistics(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in texts])


def score(model: Trees) -> Column:
    """The score of the column text."""

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([statistics(t) for t in texts], float).reshape(-1, len(STATISTICS))
            yield pd.Series(model.score(x))

    scores.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(scores, "double")("text")


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score below the threshold."""
    model = learn(docs, labels)
    return docs.select(F.struct("*").alias("_row"), score(model).alias("_score")).filter(F.col("_score") >= threshold).select("_row.*")
