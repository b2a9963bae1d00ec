"""Language identification by a linear-chain conditional random field over words.

Words are runs of letters. Each word has hashed features: its first and last one to three letters, its letter bigrams
and trigrams, and itself as a lexicon entry. Labels of neighbouring words depend on each other by learned transitions,
so a word of two languages is told by its neighbours, and a text that changes language is labelled word by word.
Forward-backward over the whole text gives each word's label probabilities; a document's are their mean.

All documents of a batch are walked in step, longest first, so each step of the recursion is one step for all.

Defined results: a text that is null or has no letter is ``und`` with score 0; null and repeated ids are documents like
any other, a null id is held out of learning; if nothing can be learned from, all is ``und``; an empty table gives no
rows; other columns than doc_id, text and, for learning, lang are not looked at.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkplane.llm.common import held_out, worker_cache

#: Documents of each language, and in all, that a model is fitted on at most: the bound on what the driver gets.
PER_LANG, SAMPLE = 200, 2000
UNKNOWN = "und"
BUCKETS = 1 << 18
EPOCHS, RATE, DECAY, SEQUENCE, BATCH_WORDS = 2, 0.2, 1e-4, 40, 6000
#: Characters handled at a time, but for a longer text.
CHARS = 2_000_000
_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint64)


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    cache = worker_cache()
    if "letters" not in cache:
        cache["letters"] = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return cache["letters"]


@dataclass
class Words:
    """Words of some texts: ptr into the letters, two hashed features a letter, seven a word, and their document."""

    ptr: np.ndarray
    chars: np.ndarray  # letters x 2
    whole: np.ndarray  # words x 7
    doc: np.ndarray

    def take(self, at: np.ndarray) -> Words:
        sizes = np.diff(self.ptr)[at]
        ptr = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.repeat(self.ptr[at] - ptr[:-1], sizes) + np.arange(ptr[-1])
        return Words(ptr, self.chars[flat], self.whole[at], self.doc[at])


def _bucket(kind: int, *codes: np.ndarray) -> np.ndarray:
    h = np.full(len(codes[0]), (kind + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k, c in enumerate(codes):
        h = (h ^ c * _PRIMES[k]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(20) & np.uint64(BUCKETS - 1)).astype(np.uint32)


def words_of(texts: list[str]) -> Words:
    low = [t.lower() for t in texts]
    codes = np.frombuffer("\0".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    doc_end = np.cumsum([len(t) + 1 for t in low])
    is_letter = letters()[codes]
    at = np.flatnonzero(is_letter)
    first = np.ones(len(at), bool)
    first[1:] = np.diff(at) > 1
    start = np.flatnonzero(first)
    ptr = np.append(start, len(at))
    c = codes[at].astype(np.uint64)
    last = np.zeros(len(at) + 2, bool)
    last[ptr[1:] - 1] = True
    ahead = np.append(c, [0, 0]).astype(np.uint64)
    one = np.where(last[: len(at)], np.uint64(0), ahead[1 : len(at) + 1])
    two = np.where(last[: len(at)] | last[1 : len(at) + 1], np.uint64(0), ahead[2 : len(at) + 2])
    chars = np.stack([_bucket(0, c, one), _bucket(1, c, one, two)], axis=1)
    end, size = ptr[1:] - 1, np.diff(ptr)
    b1, b2 = np.where(size > 1, c[np.maximum(end - 1, 0)], 0).astype(np.uint64), np.where(size > 2, c[np.maximum(end - 2, 0)], 0).astype(np.uint64)
    powers = np.cumprod(np.full(64, 0x100000001B3, np.uint64))
    place = np.minimum(np.arange(len(at)) - np.repeat(start, size), 63)
    lexicon = np.add.reduceat(c * powers[place], start) if len(start) else np.empty(0, np.uint64)
    s = c[start]
    whole = np.stack([_bucket(2, s), _bucket(3, s, one[start]), _bucket(4, s, one[start], two[start]), _bucket(5, c[end]), _bucket(6, c[end], b1), _bucket(7, c[end], b1, b2), _bucket(8, lexicon)], axis=1)
    return Words(ptr, chars, whole, np.searchsorted(doc_end, at[start], side="right"))


@dataclass
class Chain:
    """Labels, feature weights (buckets x labels), log transitions (from x to) and log starts."""

    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray
    starts: np.ndarray

    def emissions(self, w: Words) -> np.ndarray:
        if not len(w.whole):
            return np.zeros((0, len(self.labels)), np.float32)
        out = self.weights[w.whole[:, 0]]
        for k in range(1, w.whole.shape[1]):
            out += self.weights[w.whole[:, k]]
        return out + np.add.reduceat(self.weights[w.chars[:, 0]] + self.weights[w.chars[:, 1]], w.ptr[:-1], axis=0)

    def marginals(self, emissions: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words of sequences of these sizes, which stand one after the other, their label probabilities; and what
        came from the left, with the word, and from the right, without it, each up to a factor."""
        seen = np.exp(emissions - emissions.max(axis=1, keepdims=True)) if len(emissions) else emissions
        left, right = np.empty_like(seen), np.ones_like(seen)
        order = np.argsort(-sizes, kind="stable")
        first, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
        most = int(size[0]) if len(size) else 0
        active = len(size) - np.searchsorted(size[::-1], np.arange(most), side="right")  # sequences with a word at each step
        move = np.exp(self.moves).astype(seen.dtype)
        state = None
        for t in range(most):
            at = first[: active[t]] + t
            state = seen[at] * (np.exp(self.starts).astype(seen.dtype) if t == 0 else state[: active[t]] @ move)
            state /= state.sum(axis=1, keepdims=True)
            left[at] = state
        back = move.T.copy()
        for t in range(most - 2, -1, -1):
            at = first[: active[t + 1]] + t
            state = (seen[at + 1] * right[at + 1]) @ back
            right[at] = state / state.sum(axis=1, keepdims=True)
        both = left * right
        return both / both.sum(axis=1, keepdims=True), left, seen * right


def fit(texts: list[str], langs: list[str], epochs: int = EPOCHS, seed: int = 3) -> Chain:
    """Maximise the likelihood of the word labels, each text's language, by stochastic gradients.

    Sequences are made of stretches of one to three texts, so that changes of language occur.
    """
    labels = sorted(set(langs))
    n = len(labels)
    chain = Chain(labels, np.zeros((BUCKETS, n), np.float32), np.zeros((n, n)), np.zeros(n))
    w = words_of(texts)
    if n < 2 or not len(w.doc):
        return chain
    label = np.array([labels.index(x) for x in langs])[w.doc]
    rng = np.random.default_rng(seed)
    cut = np.flatnonzero(np.concatenate([[True], w.doc[1:] != w.doc[:-1]]))
    edges = np.unique(np.concatenate([cut, np.arange(0, len(w.doc), SEQUENCE), [len(w.doc)]]))
    stretches = [np.arange(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    squares, move_squares = np.full_like(chain.weights, 1e-6), np.full((n + 1, n), 1e-6)
    for _ in range(epochs):
        order, at = rng.permutation(len(stretches)), 0
        batch, sizes = [], []
        while at < len(order):
            k = int(rng.choice([1, 2, 3], p=[0.6, 0.3, 0.1]))
            part = [stretches[i] for i in order[at : at + k]]
            batch += part
            sizes.append(sum(map(len, part)))
            at += k
            if sum(sizes) < BATCH_WORDS and at < len(order):
                continue
            index, size = np.concatenate(batch), np.array(sizes)
            these, truth = w.take(index), label[index]
            probability, left, right = chain.marginals(chain.emissions(these), size)
            slope = probability.astype(np.float32)
            slope[np.arange(len(truth)), truth] -= 1
            starts = np.cumsum(size) - size
            inner = np.ones(len(truth), bool)
            inner[starts] = False
            b = np.flatnonzero(inner)
            pairs = left[b - 1][:, :, None] * np.exp(chain.moves)[None] * right[b][:, None, :]
            pairs = (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            np.subtract.at(pairs, (truth[b - 1], truth[b]), 1)
            move_slope = np.vstack([pairs, slope[starts].sum(axis=0)[None]]) / len(size)
            move_squares += move_slope**2
            step = RATE * move_slope / np.sqrt(move_squares)
            chain.moves -= step[:n]
            chain.starts -= step[n]
            by_letter = np.repeat(slope, np.diff(these.ptr), axis=0)
            ids = np.concatenate([these.chars.ravel(order="F"), these.whole.ravel(order="F")])
            parts = np.concatenate([by_letter, by_letter, *[slope] * these.whole.shape[1]])
            touched, where = np.unique(ids, return_inverse=True)
            grad = np.stack([np.bincount(where, parts[:, j], len(touched)) for j in range(n)], axis=1).astype(np.float32) / len(size)
            grad += DECAY * chain.weights[touched]
            squares[touched] += grad**2
            chain.weights[touched] -= RATE * grad / np.sqrt(squares[touched])
            batch, sizes = [], []
    return chain


def learn(docs: DataFrame, per_lang: int = PER_LANG, sample: int = SAMPLE) -> Chain:
    """A chain fitted on whole texts of a bounded number of documents that are not held out and have a language."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang")
    ranked = known.withColumn("_nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))).filter(F.col("_nth") <= per_lang)
    ids = ranked.orderBy("_nth", "lang").limit(sample).select("doc_id").collect()
    if not ids:
        return Chain([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    chosen = F.broadcast(docs.sparkSession.createDataFrame([(r.doc_id,) for r in ids], "_id bigint").distinct())
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).join(chosen, F.col("doc_id") == F.col("_id"), "left_semi")
    rows = sorted((r.doc_id, r.lang, r.text) for r in rows.select("doc_id", "lang", "text").toLocalIterator())
    return fit([r[2] for r in rows], [r[1] for r in rows])


def word_labels(chain: Chain, text: str) -> list[tuple[str, str, float]]:
    """(word, label, probability) of each word of a text, code-switched or not."""
    low = text.lower()
    is_letter = letters()
    w = words_of([text])
    found, word = [], ""
    for ch in low + "\0":
        if is_letter[ord(ch)]:
            word += ch
        elif word:
            found.append(word)
            word = ""
    p = chain.marginals(chain.emissions(w), np.array([len(w.doc)]))[0]
    return [(x, chain.labels[int(q.argmax())], float(q.max())) for x, q in zip(found, p, strict=True)]


def label_texts(chain: Chain, texts: list[str]) -> list[tuple[str, float]]:
    """The label of each text and its mean probability over the words."""
    w = words_of(texts)
    if not len(w.doc) or not chain.labels:
        return [(UNKNOWN, 0.0)] * len(texts)
    docs, sizes = np.unique(w.doc, return_counts=True)
    p = chain.marginals(chain.emissions(w), sizes)[0]
    means = np.add.reduceat(p.astype(np.float64), np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
    out = [(UNKNOWN, 0.0)] * len(texts)
    for d, m in zip(docs.tolist(), means, strict=True):
        out[d] = (chain.labels[int(m.argmax())], min(float(m.max()), 1.0))
    return out


def labelled(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, lang_pred, score) of every row. The chain is shipped once to each executor."""
    model = docs.sparkSession.sparkContext.broadcast(chain)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids = batch["text"].tolist(), batch["doc_id"].tolist()
            start = size = 0
            for i, t in enumerate([*texts, None]):
                if t is None or i > start and size + len(t) > CHARS:
                    if i > start:
                        out = label_texts(model.value, texts[start:i])
                        keys = pd.array([None if k == "" else int(k) for k in ids[start:i]], dtype="Int64")
                        yield pd.DataFrame({"doc_id": keys, "lang_pred": [x[0] for x in out], "score": [x[1] for x in out]})
                    start, size = i, 0
                size += len(t or "")

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(label, "doc_id long, lang_pred string, score double")
