"""Near-duplicates by the Jaccard similarity of shingle sets, without loss.

Two texts are alike if their sets of shingles have a Jaccard similarity of LEAST or more; groups are the components of
alike pairs. SimHash keys propose pairs first, which are verified on the sets and join most of what is alike. What they
miss is found by prefixes: with the shingles of all sets in one order, sets of that similarity share a shingle among
the first n - ceil(LEAST * n) + 1 of each. Members of a prefix shingle that do not hang together yet, and whose sizes,
places and parity bitmaps allow the similarity, are verified too. A bitmap has a bit for each class of hashes, set if
the set has an odd number of them; where two differ in d bits, the sets differ in d shingles at least, which rules out
nearly all pairs that are not alike, and never one that is. The order puts frequent shingles last, so that few sets
meet that are not alike; how often a shingle occurs is looked up in a sample, and any order finds the same pairs.

Defined results: null texts and texts without words are one group; a text of fewer words than a shingle is one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkplane.llm import simhash_pivot as P
from inkplane.llm.common import row_key, stored
from inkplane.llm.components import components

#: LEAST as a fraction.
OVER, UNDER = 4, 5
#: About so many documents, and so many shingles at most, tell which shingles are frequent; they bear on the order only.
SAMPLE, FREQUENT = 20_000, 200_000
#: Texts whose sets are handed to Spark at a time.
ROWS = 256
#: Bits of a parity bitmap at least, and at most; in between as many as shingles, rounded up to a power of two.
LEAST_BITS, MOST_BITS = 256, 1 << 16
#: Words of bitmaps compared at a time.
BITMAP_WORDS = 1 << 22


def prefix(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones first: sets of similarity LEAST share one of them."""
    if not len(shingles):
        return shingles
    rank = np.zeros(len(shingles), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        rank = np.where(common[at] == shingles, counts[at], 0)
    order = np.lexsort((shingles, rank))
    return shingles[order[: len(shingles) - -(-OVER * len(shingles) // UNDER) + 1]]


def bitmap(shingles: np.ndarray) -> bytes:
    """The parity bitmap of a set."""
    n = min(max(LEAST_BITS, 1 << (len(shingles) - 1).bit_length() if len(shingles) else 0), MOST_BITS)
    counts = np.bincount((shingles & np.uint64(n - 1)).astype(np.int64), minlength=n)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


class Bitmaps:
    """Parity bitmaps of many sets, those of one length as a matrix. A long one is folded to compare it with a shorter."""

    def __init__(self, maps: list[bytes]):
        self.words = np.array([len(b) // 8 for b in maps], np.int64)
        self.place, self.rows = np.empty(len(maps), np.int64), {}
        for w in np.unique(self.words).tolist():
            at = np.flatnonzero(self.words == w)
            self.place[at] = np.arange(len(at))
            self.rows[w] = np.frombuffer(b"".join([maps[k] for k in at]), "<u8").reshape(len(at), w)

    def of(self, at: np.ndarray, words: int) -> np.ndarray:
        out = np.empty((len(at), words), np.uint64)
        for w in np.unique(self.words[at]).tolist():
            here = self.words[at] == w
            some = self.rows[w][self.place[at[here]]]
            while some.shape[1] > words:
                half = some.shape[1] // 2
                some = some[:, :half] ^ some[:, half:]
            out[here] = some
        return out

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of rows in how many shingles they differ at least."""
        out, words = np.zeros(len(i), np.int64), np.minimum(self.words[i], self.words[j])
        for w in np.unique(words).tolist():
            every, step = np.flatnonzero(words == w), max(1, BITMAP_WORDS // w)
            for k in range(0, len(every), step):
                at = every[k : k + step]
                out[at] = np.bitwise_count(self.of(i[at], w) ^ self.of(j[at], w)).sum(axis=1, dtype=np.int64)
        return out


def frequent(docs: DataFrame, scheme: P.Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample have, ascending, and in how many."""
    texts = docs.select("text", row_key(F.col("text")).alias("key"))
    texts = texts.filter(F.pmod("key", F.lit(max(1, texts.count() // SAMPLE))) == 0).select("text")

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                yield pd.DataFrame({"s": P.shingle_set(text, scheme).view(np.int64)})

    found = texts.mapInPandas(shingles, "s long").groupBy("s").count().filter("count > 3").orderBy(F.desc("count"), "s").limit(FREQUENT).toPandas()
    s, n = found["s"].to_numpy(np.int64).view(np.uint64), found["count"].to_numpy(np.int64)
    order = np.argsort(s)
    return s[order], n[order]


def sets(docs: DataFrame, scheme: P.Scheme) -> DataFrame:
    """(doc_id, key, rid, fp, print, node, size, bits, first): node tells sets apart, print fingerprints."""
    common, counts = frequent(docs, scheme)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                both = [P.printed(t, scheme) for t in batch.column("text").to_pylist()]
                fps, own = np.array([p for p, _ in both], dtype=np.uint64).reshape(-1, scheme.words), [s for _, s in both]
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in own], dtype=np.uint64).view(np.int64)
                lists = [pa.array([x.view(np.int64) for x in xs], pa.list_(pa.int64())) for xs in (fps, [prefix(s, common, counts) for s in own])]
                columns = [batch.column("doc_id"), batch.column("key"), lists[0], pa.array(P.node_of(fps)), pa.array(nodes), pa.array([len(s) for s in own], pa.int32()), pa.array([bitmap(s) for s in own], pa.binary()), *lists[1:]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "fp", "print", "node", "size", "bits", "first"])

    rows = docs.select("doc_id", row_key(F.col("text")).alias("key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInArrow(make, f"doc_id {kind}, key long, fp array<bigint>, print long, node long, size int, bits binary, first array<bigint>")
    return rows.withColumn("rid", F.monotonically_increasing_id())


def alike(pairs: DataFrame, distinct: DataFrame, docs: DataFrame, scheme: P.Scheme) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets have a similarity of LEAST or more.

    Sets are made again from the texts of nodes in pairs, as texts are smaller on disk than hashes of their shingles.
    """
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct(), "pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    named = stored(distinct.join(nodes, "node", "left_semi").select("node", "key"), "named")
    texts = docs.select(row_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text")).join(named, "key").groupBy("node").agg(F.first("text").alias("text"))
    texts = stored(texts, "members")
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def judge(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for t, u in zip(x, y, strict=True):
            a, b = P.shingle_set(t, scheme), P.shingle_set(u, scheme)
            out.append((OVER + UNDER) * len(np.intersect1d(a, b, assume_unique=True)) >= OVER * (len(a) + len(b)))
        return pd.Series(out, dtype=bool)

    return both.filter(F.pandas_udf(judge, "boolean")("ta", "tb")).select("a", "b")


def met(groups: np.ndarray, node: np.ndarray, root: np.ndarray, size: np.ndarray, place: np.ndarray, maps: Bitmaps) -> Iterator[pd.DataFrame]:
    """Pairs (a, b) of rows, which stand by groups and sizes, that share a group, have other roots and may be alike."""
    cut = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    sizes = np.diff(np.append(cut, len(groups)))

    def pairs(i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        # Shared shingles from this one on; it is an upper bound of all of them where it is the first one shared.
        most = np.minimum(size[i] - place[i], size[j] - place[j])
        ok = (root[i] != root[j]) & ((OVER + UNDER) * most >= OVER * (size[i] + size[j]))
        i, j = i[ok], j[ok]
        ok = (OVER + UNDER) * maps.apart(i, j) <= (UNDER - OVER) * (size[i] + size[j])
        return pd.DataFrame({"a": node[i[ok]], "b": node[j[ok]]})

    few = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= P.SMALL), sizes))
    for step in range(1, P.SMALL):
        at = np.flatnonzero(groups[few[step:]] == groups[few[:-step]])
        if not len(at):
            break
        yield pairs(few[at], few[at + step])
    for g in np.flatnonzero(sizes > P.SMALL):
        stop = cut[g] + sizes[g]
        last = cut[g] + np.searchsorted(size[cut[g] : stop], size[cut[g] : stop] * UNDER // OVER, side="right")  # sizes within the least similarity
        for i in range(cut[g], stop - 1):
            others = np.arange(i + 1, last[i - cut[g]])
            found = pairs(np.full(len(others), i), others)
            if len(found):
                yield found


def prefix_pairs(rows: DataFrame, roots: DataFrame, distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of unlike roots(rid, root) that share a shingle of their prefixes and may be alike."""
    some = rows.select("rid", "node", "size", "first").join(roots, "rid")
    some = some.select("node", "root", F.col("size").cast("long").alias("size"), F.posexplode("first").alias("place", "shingle"))
    # Size and place in one number, as rows of the shuffle have eight bytes a column.
    some = some.select("shingle", "node", "root", (F.shiftleft("size", 32) + F.col("place")).alias("at"))
    # Most shingles of prefixes are one set's own, or one root's: only what unlike roots share goes on, with bitmaps.
    mine = Window.partitionBy("shingle")
    some = some.withColumn("lo", F.min("root").over(mine)).withColumn("hi", F.max("root").over(mine)).filter("lo <> hi").drop("lo", "hi")
    some = stored(some, "shared-shingles").join(distinct.select("node", "bits"), "node")
    some = some.select("shingle", "node", "root", "at", "bits").repartition("shingle").sortWithinPartitions("shingle", "at")

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows of the last shingle, which may go on in the next batch

        def close() -> Iterator[pd.DataFrame]:
            part = pd.concat(held, ignore_index=True)
            at = part["at"].to_numpy()
            return met(part["shingle"].to_numpy(), part["node"].to_numpy(), part["root"].to_numpy(), at >> 32, at & 0xFFFFFFFF, Bitmaps(part["bits"].tolist()))

        for part in batches:
            if not len(part):
                continue
            start = int(np.argmax((part["shingle"] == part["shingle"].iloc[-1]).to_numpy()))
            if start or held and held[-1]["shingle"].iloc[-1] != part["shingle"].iloc[0]:
                held.append(part.iloc[:start])
                yield from close()
                held = []
            held.append(part.iloc[start:])
        if held:
            yield from close()

    return some.mapInPandas(links, "a long, b long")


def classes(docs: DataFrame, scheme: P.Scheme = P.WIDE) -> DataFrame:
    """(doc_id, key, root): rows of one root, and only they, hang together by pairs of similarity LEAST or more."""
    rows = stored(sets(docs, scheme), "sets")
    distinct = stored(rows.groupBy("node").agg(F.min_by("fp", "rid").alias("fp"), F.min_by("print", "rid").alias("print"), F.min_by("bits", "rid").alias("bits"), F.min("rid").alias("rid"), F.min("key").alias("key")), "distinct-sets")
    heads = stored(distinct.groupBy("print").agg(F.first("fp").alias("fp"), F.min("node").alias("head")), "distinct-fingerprints")
    near = P.linked(heads.select("fp"), heads.count(), scheme)
    at_a, at_b = heads.select(F.col("print").alias("a"), F.col("head").alias("ha")), heads.select(F.col("print").alias("b"), F.col("head").alias("hb"))
    near = near.join(at_a, "a").join(at_b, "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    near = near.unionByName(distinct.join(heads, "print").filter("node != head").select(F.col("head").alias("a"), F.col("node").alias("b")))
    links = stored(alike(near, distinct, docs, scheme), "near-links")
    roots = distinct.select("node", "rid").join(components(links, "near"), "node", "left").select("rid", F.coalesce("root", "node").alias("root"))
    rest = alike(prefix_pairs(rows, stored(roots, "near-roots"), distinct), distinct, docs, scheme)
    roots = components(links.unionByName(rest), "alike")
    return rows.select("doc_id", "key", "node").join(roots, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root"))
