"""SimHash near-duplicates by pivot distance tables.

A fingerprint's row in the table holds its Hamming distances to many reference fingerprints. Distances obey the triangle
inequality: no pair within the radius differs in a coordinate by more than the radius. Over all bits the distances of
unlike fingerprints are much the same, so coordinates alone would leave a share of all pairs; the table therefore keeps
each distance in parts, one for each block of bits, and the inequality holds for each part too.

EXACT has 64 bits and a radius of 4, and radius + r blocks. A pair within the radius has a distance of 0 over r of them
at least, so its coordinates over some choice of r blocks differ by 0: fingerprints are joined on their coordinates over
each choice, and no link is lost. Of the pairs that meet, those whose coordinates over all bits differ by more than the
radius are discarded, and survivors are verified bit by bit.

WIDE, for pipelines, has 256 bits over shingles of five words, which tell a similarity of 0.8 from chance in short
documents too; its radius is the distance expected at 0.8 and one standard error of it. Its blocks are single bits, on
which a distance is the bit itself, and its choices are drawn at random, as many as find all but MISS of the pairs at
the expected distance; like_sets verifies what they find by true similarity and finds without loss what they miss.

Only distinct fingerprints are compared, and only until a group is known to hang together, so no group is expanded
into its pairs. Links form components, by rounds over tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkplane.llm.common import row_key, stored
from inkplane.llm.components import components

SEED = 42
#: Pairs at the expected distance of WIDE that its keys may miss.
MISS = 0.02
#: Shingles hashed and counted at a time.
STEP = 1 << 15
#: References whose distances over a block are joined on: a distance has four bits, as a block has 15 bits at most.
JOINED = 16
#: Groups of a key up to this size are compared pair by pair, all groups of a batch at once.
SMALL = 32


@dataclass(frozen=True)
class Scheme:
    """words: 64-bit words of a fingerprint."""

    words: int
    radius: int
    shingle: int
    pivots: int

    @property
    def references(self) -> np.ndarray:
        """Reference fingerprints, drawn once: pivots x words."""
        return np.random.default_rng(7).integers(0, 2**64, (self.pivots, self.words), dtype=np.uint64)


#: A Jaccard similarity of 0.8 is a cosine of 0.89, at which 0.151 of the bits differ: 38.7 of 256, give or take 5.7.
EXACT, WIDE = Scheme(1, 4, 4, 32), Scheme(4, 44, 5, 16)
EXPECTED = 38.7 / 256


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Further hashes from a hash, by a finaliser of multiplications and shifts."""
    h = h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def fingerprint(text: str | None, scheme: Scheme = EXACT) -> list[int]:
    """The SimHash of the text's word shingles, a 64-bit word each: A-Z lower-cased, repeats count; without words 0.

    A bit is 1 if it is set in over half of the shingles' hashes; a text of fewer words is one shingle.
    """
    return _simhash(_shingles(text, scheme), scheme)


def printed(text: str | None, scheme: Scheme) -> tuple[list[int], np.ndarray]:
    """The fingerprint, and the distinct hashes of the shingles in ascending order."""
    steps = list(_shingles(text, scheme))
    return _simhash(iter(steps), scheme), _distinct(steps)


def shingle_set(text: str | None, scheme: Scheme) -> np.ndarray:
    return _distinct(list(_shingles(text, scheme)))


def _distinct(steps: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([np.empty(0, np.uint64), *steps]))


def _shingles(text: str | None, scheme: Scheme) -> Iterator[np.ndarray]:
    """Hashes of the text's shingles, STEP at a time."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return
    flat, size = b" ".join(parts), scheme.shingle
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate([[0], ends[:-1]])
    if len(parts) < size:
        a, b = [0], [len(flat)]
    else:
        a, b = starts[: len(parts) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(a), STEP):
        yield np.array([digest(flat[x:y], SEED) for x, y in zip(a[i : i + STEP], b[i : i + STEP], strict=True)], dtype="<u8")


def _simhash(steps: Iterator[np.ndarray], scheme: Scheme) -> list[int]:
    counts, n = np.zeros((scheme.words, 64), np.int64), 0
    for h in steps:
        n += len(h)
        for k in range(scheme.words):
            bits = np.unpackbits((_mixed(h, k) if k else h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[k] += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > n, axis=1, bitorder="little").view("<u8").ravel().tolist()


def node_of(fps: np.ndarray) -> np.ndarray:
    """A long for each fingerprint: itself if it is one word, else a hash of its words."""
    out = fps[:, 0]
    for k in range(1, fps.shape[1]):
        out = _mixed(out, k) ^ fps[:, k]
    return out.view(np.int64)


def fingerprints(docs: DataFrame, scheme: Scheme = EXACT) -> DataFrame:
    """(doc_id, key, fp, node): fp as an array of signed longs."""

    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            fps = np.array([fingerprint(t, scheme) for t in texts], dtype=np.uint64).reshape(-1, scheme.words)
            yield pd.DataFrame({"fp": list(fps.view(np.int64)), "node": node_of(fps)})

    prints.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    simhash = F.pandas_udf(prints, "fp array<bigint>, node bigint")
    return docs.select("doc_id", row_key(F.col("text")).alias("key"), simhash("text").alias("p")).select("doc_id", "key", "p.fp", "p.node")


def exact_blocks(n: int, scheme: Scheme) -> tuple[list[list[int]], list[tuple[int, ...]]]:
    """Blocks, as lists of bits, and choices of them for n fingerprints: pairs within the radius agree on some choice.

    More blocks make longer keys, so that chance leaves few pairs in a key however many there are, for more choices.
    """
    bits = 64 * scheme.words
    for agree in range(1, 5):
        total = scheme.radius + agree
        edges = [round(bits * k / total) for k in range(total + 1)]
        blocks, choices = [list(range(edges[k], edges[k + 1])) for k in range(total)], list(combinations(range(total), agree))
        if n <= 2 ** (min(sum(len(blocks[k]) for k in pick) for pick in choices) + 1):
            break
    return blocks, choices


def coordinates(fp: Column, bits: list[int], references: np.ndarray) -> Column:
    """The distances of a word to the first JOINED references over a block of bits, four bits each, as one long."""

    def signed(x: int) -> Column:
        return F.lit(x - (1 << 64) if x >> 63 else x)

    mask = sum(1 << b for b in bits)
    out = F.lit(0).cast("long")
    for k, r in enumerate(references[:JOINED, 0].tolist()):
        out = out.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseAND(signed(mask)).bitwiseXOR(signed(r & mask))).cast("long"), 4 * k))
    return out


def drawn_choices(n: int, scheme: Scheme) -> list[list[int]]:
    """Random choices of bits: keys as long as tell n fingerprints about apart, as many as miss MISS of the pairs."""
    size = max(8, min(40, round(math.log2(max(n, 2))) - 2))
    number = math.ceil(math.log(MISS) / math.log(1 - (1 - EXPECTED) ** size))
    rng = np.random.default_rng(13)
    return [sorted(rng.choice(64 * scheme.words, size, replace=False).tolist()) for _ in range(number)]


def block_key(fp: Column, bits: list[int], words: int) -> Column:
    """The coordinates over single bits: the bits in place, hashed over all words."""

    def part(k: int) -> Column:
        mask = sum(1 << b - 64 * k for b in bits if 64 * k <= b < 64 * k + 64)
        return F.get(fp, F.lit(k)).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))

    return F.xxhash64(*[part(k) for k in range(words)])


def distances(fps: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The pivot distance table: Hamming distances of fps to the references, a row for each fingerprint."""
    return np.stack([hamming(fps, r) for r in references], axis=1)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def group_links(fps: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same fingerprints of one key as all links within the radius would.

    Fingerprints are visited breadth first: each takes what it reaches among those not reached yet and hands it on, so
    a pair is looked at unless both are already known to hang together. Memory follows the group, as does the time of
    a dense group, which its first members exhaust.
    """
    a, b = [], []
    left, rows = fps, distances(fps, scheme.references)
    queue: list[tuple[np.ndarray, np.ndarray]] = []
    while len(left):
        if not queue:
            queue.append((left[0], rows[0]))
            left, rows = left[1:], rows[1:]
            continue
        fp, row = queue.pop()
        at = np.flatnonzero((np.abs(rows[:, :4] - row[:4]) <= scheme.radius).all(axis=1))
        at = at[(np.abs(rows[at, 4:] - row[4:]) <= scheme.radius).all(axis=1)]
        at = at[hamming(left[at], fp) <= scheme.radius]
        if len(at):
            a.append(np.repeat(fp[None], len(at), axis=0)), b.append(left[at])
            queue += list(zip(left[at], rows[at], strict=True))
            keep = np.ones(len(left), bool)
            keep[at] = False
            left, rows = left[keep], rows[keep]
    none = np.empty((0, scheme.words), np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def key_links(choice: np.ndarray, block: np.ndarray, fps: np.ndarray, scheme: Scheme) -> pd.DataFrame:
    """Links (a, b) within the keys of rows that stand by choice and block."""
    cut = np.flatnonzero(np.concatenate([[True], (choice[1:] != choice[:-1]) | (block[1:] != block[:-1])]))
    sizes = np.diff(np.append(cut, len(choice)))
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    inside = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    group, some = np.repeat(np.arange(len(cut)), sizes)[inside], fps[inside]
    rows = distances(some, scheme.references)
    for step in range(1, SMALL):
        at = np.flatnonzero(group[step:] == group[:-step])
        if not len(at):
            break
        at = at[(np.abs(rows[at] - rows[at + step]) <= scheme.radius).all(axis=1)]
        at = at[hamming(some[at], some[at + step]) <= scheme.radius]
        a.append(node_of(some[at])), b.append(node_of(some[at + step]))
    for g in np.flatnonzero(sizes > SMALL):
        x, y = group_links(fps[cut[g] : cut[g] + sizes[g]], scheme)
        a.append(node_of(x)), b.append(node_of(y))
    return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})


def linked(prints: DataFrame, n: int, scheme: Scheme = EXACT) -> DataFrame:
    """Links (a, b) between nodes of the distinct fingerprints prints(fp) that span what all links would join."""
    if scheme.words == 1:
        blocks, choices = exact_blocks(n, scheme)
        rows = prints.select("fp", *[coordinates(F.get("fp", F.lit(0)), bits, scheme.references).alias(f"c{k}") for k, bits in enumerate(blocks)])
        values = [F.col(f"c{pick[0]}") if len(pick) == 1 else F.xxhash64(*[f"c{k}" for k in pick]) for pick in choices]
    else:
        rows, values = prints, [block_key(F.col("fp"), bits, scheme.words) for bits in drawn_choices(n, scheme)]
    keys = F.array(*[F.struct(F.lit(k).alias("choice"), v.alias("block")) for k, v in enumerate(values)])
    words = [F.get("fp", F.lit(k)).alias(f"f{k}") for k in range(scheme.words)]
    rows = rows.select("fp", F.explode(keys).alias("k")).select("k.choice", "k.block", *words)
    # A key's fingerprints go to one task: they are distinct, a few longs each, and copies count once.
    rows = rows.repartition("choice", "block").sortWithinPartitions("choice", "block", *[f"f{k}" for k in range(scheme.words)])

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows of the last key, which may go on in the next batch

        def close() -> pd.DataFrame:
            part = pd.concat(held, ignore_index=True)
            return key_links(part["choice"].to_numpy(), part["block"].to_numpy(), np.ascontiguousarray(part.iloc[:, 2:].to_numpy()).view(np.uint64), scheme)

        for part in batches:
            if not len(part):
                continue
            last = ((part["choice"] == part["choice"].iloc[-1]) & (part["block"] == part["block"].iloc[-1])).to_numpy()
            start = int(np.argmax(last))
            if start or held and (held[-1]["choice"].iloc[-1], held[-1]["block"].iloc[-1]) != (part["choice"].iloc[0], part["block"].iloc[0]):
                held.append(part.iloc[:start])
                yield close()
                held = []
            held.append(part.iloc[start:])
        if held:
            yield close()

    return rows.mapInPandas(links, "a long, b long")


def classes(docs: DataFrame, scheme: Scheme = EXACT) -> DataFrame:
    """(doc_id, key, fp, root, component_id): component_id is the smallest doc_id whose fingerprint is reachable.

    Defined results: null and empty texts have a fingerprint of zeros, linked like any other; a null doc_id is the
    component's only if it has no other; repeated rows are members like any; an empty table gives no rows; other
    columns than doc_id and text are not looked at.
    """
    prints = stored(fingerprints(docs, scheme), "fingerprints")
    distinct = stored(prints.groupBy("node").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(linked(distinct, distinct.count(), scheme))
    named = distinct.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Written, so that both sides of each join are plain tables, of which large classes are split.
    best = stored(named.groupBy("root").agg(F.min("least").alias("component_id")), "least-ids")
    members = stored(named.join(best, "root").select("node", "root", "component_id"), "members")
    return prints.join(members, "node").select("doc_id", "key", "fp", "root", "component_id")


def representatives(docs: DataFrame, scheme: Scheme = WIDE) -> DataFrame:
    """docs with one row of each group of alike texts: that of the smallest doc_id, of the smallest text hash on ties."""
    from inkplane.llm import like_sets

    found = stored(like_sets.classes(docs, scheme), "classes")
    # One row a component is kept by a minimum, which tasks take before the shuffle.
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "key")).alias("best"), F.count(F.lit(1)).alias("n"))
    # Written, so that both sides of the join are plain tables, of which large classes are split.
    best = stored(best.filter("n > 1").drop("n"), "best-rows")
    other = ~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key")))
    gone = found.join(best, "root").filter(other).select(F.col("doc_id").alias("_id"), F.col("key").alias("_k"))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), row_key(F.col("text")).alias("_key"))
    kept = rows.join(gone, rows["_doc"].eqNullSafe(gone["_id"]) & (rows["_key"] == gone["_k"]), "left_anti")
    if not found.groupBy("doc_id", "key").count().filter("count > 1").isEmpty():  # rows equal in id and text are one document
        kept = kept.withColumn("_nth", F.row_number().over(Window.partitionBy("_doc", "_key").orderBy("_key"))).filter("_nth = 1")
    return kept.select("_row.*")
