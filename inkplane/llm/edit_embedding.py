"""Document fingerprints by a randomised edit embedding.

A walk reads a text's characters in order. At each time it writes the character it stands on, and a random bit for the
time and the character, shared by all texts, tells whether it steps on. Texts within few edits walk in step again soon
after each edit, so edit distance turns into Hamming distance of what is written. The written text is sampled at times
that are multiples of a power of two, chosen so that there are SAMPLES / 2 to SAMPLES of them; samples of a coarser
grid are samples of each finer one, so texts of unlike length still compare. A fingerprint is the exponent and a hex
digit for each sample. Bands of sampled digits find candidate pairs, which are verified on all digits.

Defined results: null and empty texts have a fingerprint without samples, alike to one another (1.0) and to nothing
else (0.0); the last document is followed by the first, so a lone one follows itself; rows stand in the order of
doc_id, null first, and of a hash of the text within an id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkplane.llm.common import row_key, stored
from inkplane.llm.components import components

SAMPLES, PERIOD, CLASSES = 256, 256, 256
#: Characters walked at a time.
STEP = 1 << 16


def _walk_table(seed: int = 11) -> list[bytes]:
    """For each class of characters and each time modulo PERIOD, how long the walk stands on such a character."""
    bits = np.random.default_rng(seed).integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
    bits[:, -1] = 1  # a step at the end of each period at the latest
    stay = np.empty_like(bits)
    for t in range(PERIOD - 1, -1, -1):
        stay[:, t] = np.where(bits[:, t] == 1, 1, stay[:, (t + 1) % PERIOD] + 1)
    return [row.tobytes() for row in stay]


WALK = _walk_table()


def classes_of(text: str) -> bytes:
    """A byte for each code point."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return ((codes ^ codes >> 8 ^ codes >> 16) & 0xFF).astype(np.uint8).tobytes()


class Walk:
    """A walk over characters that come piece by piece, with the samples of what it writes."""

    def __init__(self):
        self.time, self.exponent, self.samples = 0, 0, np.empty(0, np.uint8)

    def copy(self) -> Walk:
        out = Walk()
        out.time, out.exponent, out.samples = self.time, self.exponent, self.samples
        return out

    def read(self, chars: bytes) -> Walk:
        table, last = WALK, PERIOD - 1
        for i in range(0, len(chars), STEP):
            piece, t = chars[i : i + STEP], self.time
            ends = np.array([t := t + table[c][t & last] for c in piece])
            grid, at = 1 << self.exponent, len(self.samples)
            times = np.arange(at * grid, t, grid)  # those not sampled yet
            here = np.frombuffer(piece, np.uint8)[np.searchsorted(ends, times, side="right")]
            # The digit depends on the time too, as a plain one would match wherever the texts share frequent letters.
            self.samples = np.concatenate([self.samples, here])
            self.time = t
            while len(self.samples) > SAMPLES:
                self.samples, self.exponent = self.samples[::2], self.exponent + 1
        return self

    def fingerprint(self) -> str:
        times = (np.arange(len(self.samples), dtype=np.uint32) << np.uint32(self.exponent)) * np.uint32(2654435761)
        mixed = (self.samples.astype(np.uint32) * np.uint32(40503) ^ times >> np.uint32(16)) * np.uint32(2246822519)
        return f"{self.exponent:02d}:" + "".join(map("0123456789abcdef".__getitem__, (mixed >> np.uint32(28)).tolist()))


def fingerprint(text: str | None) -> str:
    return Walk().read(classes_of(text or "")).fingerprint()


def likeness(a: str, b: str) -> float:
    """Share of equal digits among the sample times of the coarser grid that either text reaches."""
    x, y = np.frombuffer(a[3:].encode(), np.uint8), np.frombuffer(b[3:].encode(), np.uint8)
    most = max(int(a[:2]), int(b[:2]))
    x, y = x[:: 1 << most - int(a[:2])], y[:: 1 << most - int(b[:2])]
    n = max(len(x), len(y))
    return 1.0 if not n else float((x[: len(y)] == y[: len(x)]).sum()) / n


#: Ranges of ids hold about so many rows at least, and there are so many ranges at most.
RANGE_ROWS, RANGES = 500, 100_000
#: Rows of a task about, so that tasks grow in number with the table, not in size.
TASK_ROWS = 8_000


def range_of(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are at the value or below, -1 for null: found among every so many, then near there."""
    if not cuts:
        return F.when(value.isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long")
    step = math.isqrt(len(cuts)) + 1
    every, coarse = F.lit(cuts).cast("array<bigint>"), F.lit(cuts[::step]).cast("array<bigint>")
    first = F.greatest(F.size(F.filter(coarse, lambda c: c <= value)) - 1, F.lit(0)) * step
    near = F.size(F.filter(F.slice(every, first + 1, F.lit(step)), lambda c: c <= value))
    return F.when(value.isNull(), F.lit(-1)).otherwise(first + near).cast("long")


def in_order(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, text, _key, _block), _block ascending by doc_id; the text that follows each block, (_for, _after); tasks.

    Ids are cut into ranges at their quantiles, so ranges hold about as many rows each whatever the ids are. Each range's
    first row is looked up and handed to the range before it, so no task orders the whole table. The lookup is
    broadcast: it has RANGES + 2 rows of some 50 bytes at most.
    """
    n = docs.agg(F.count("doc_id")).first()[0]
    ranges = min(max(n // RANGE_ROWS, 1), RANGES)
    cuts = docs.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], max(10_000, 10 * ranges))).first()[0] if ranges > 1 and n else []
    block = range_of(F.col("doc_id"), sorted(set(cuts)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), row_key(F.col("text")).alias("_key"), block.alias("_block"))
    heads = rows.groupBy("_block").agg(F.min(F.struct("doc_id", "_key")).alias("_head"))
    ahead = Window.orderBy("_block")  # one row a range
    first = F.first("_head").over(ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    want = stored(heads.select(F.col("_block").alias("_for"), F.coalesce(F.lead("_head").over(ahead), first).alias("_next")), "heads")
    same = rows["doc_id"].eqNullSafe(want["_next.doc_id"]) & (rows["_key"] == want["_next._key"])
    after = rows.join(F.broadcast(want), same).groupBy("_for").agg(F.first("text").alias("_after"))
    return rows, after, min(ranges, n // TASK_ROWS)


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row."""
    rows, after, tasks = in_order(docs)
    # The text that follows a range travels as a last row of it.
    tail = after.select(F.lit(None).cast("long").alias("doc_id"), F.col("_after").alias("text"), F.lit(0).cast("long").alias("_key"), F.col("_for").alias("_block"), F.lit(1).alias("_end"))
    all_rows = rows.withColumn("_end", F.lit(0)).unionByName(tail)
    tasks = max(tasks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    all_rows = all_rows.repartition(tasks, "_block").sortWithinPartitions("_block", "_end", "doc_id", "_key")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[str, str, Walk, Walk] | None = None  # id, text, walk over the kept half, whole walk
        for batch in batches:
            out = []
            for doc_id, text, end in zip(batch["doc_id"], batch["text"], batch["_end"], strict=True):
                half = len(text) - len(text) // 2
                chars = classes_of(text)
                kept = Walk().read(chars[:half])
                whole = kept.copy().read(chars[half:])
                if held is not None:
                    old_id, old, old_kept, old_whole = held
                    n = len(old) // 2
                    edited = old[: len(old) - n] + text[:n]
                    a, b, c = old_whole.fingerprint(), old_kept.read(chars[:n]).fingerprint(), whole.fingerprint()
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((None if old_id == "" else int(old_id), len(old), sha, a, b, likeness(a, b), likeness(a, c)))
                held = None if end else (doc_id, text, kept, whole)
            if out:
                table = pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])
                yield table.assign(doc_id=pd.array([x[0] for x in out], dtype="Int64"))  # not by way of floats

    rows = all_rows.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text", "_end")
    return rows.mapInPandas(compare, schema)


def near_classes(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, component_id) by fingerprints of likeness ``least`` or more that share a band of sampled digits.

    Bands are drawn for each class of lengths within the samples that its texts have, as many as miss a pair at the very
    limit with a chance of MISS, wherever its unlike digits stand. All distinct fingerprints of a bucket are compared
    until they hang together; large buckets are cut into chunks, and each pair of chunks is a group of its own, of some
    2 * CHUNK rows. Copies share a fingerprint and are compared once. Fingerprints are told apart by 64-bit hashes.

    Defined results: null and empty texts are one class; a null doc_id is the component's only if it has no other;
    repeated rows are members like any; an empty table gives no rows; other columns are not read.
    """
    make = F.pandas_udf(_fingerprints, "string")
    prints = stored(docs.select("doc_id", make(F.coalesce("text", F.lit(""))).alias("print")), "prints")
    distinct = stored(prints.groupBy("print").agg(F.min("doc_id").alias("least")).withColumn("node", F.xxhash64("print")), "distinct-prints")
    size = band_size(distinct.count())

    def keys(batch: pd.Series) -> pd.Series:
        return batch.map(lambda p: band_keys(p, size, least))

    keys_of = F.pandas_udf(keys, "array<long>")
    bands = stored(distinct.select("node", F.explode(keys_of("print")).alias("band")), "bands")
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = bands.join(stored(shared, "shared-bands"), "band").withColumn("chunks", F.ceil(F.col("n") / CHUNK))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("chunks")))
    other = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda c: (c != F.col("chunk")) | (F.col("chunks") == 1)))
    rows = rows.select("band", "node", "chunk", other.alias("other"))
    rows = rows.select("band", "node", F.least("chunk", "other").alias("p"), F.greatest("chunk", "other").alias("q"))
    groups = rows.join(distinct.select("node", "print"), "node").groupBy("band", "p", "q")
    links = groups.applyInPandas(lambda group: bucket_links(group["node"].to_numpy(), group["print"].tolist(), least), "a long, b long")
    roots = components(links, "edit-components")
    named = distinct.join(roots, "node", "left").select("print", "least", F.coalesce("root", "node").alias("root"))
    best = stored(named.groupBy("root").agg(F.min("least").alias("component_id")), "least-ids")
    members = stored(named.join(best, "root").select("print", "component_id"), "members")
    return prints.join(members, "print").select("doc_id", "component_id")


#: Chance that no band shows a pair at the limit; fingerprints of a bucket compared in one group, about half as many.
MISS, CHUNK = 0.02, 4096


def band_size(n: int) -> int:
    """Digits of a band: unlike texts agree on about a tenth of them, so a bucket holds few of n unlike fingerprints."""
    return max(4, min(12, math.ceil(math.log10(max(n, 1))) + 1))


def length_classes(longest: int) -> list[int]:
    """Least lengths of the classes, in characters of written text: alike texts are in one class or in neighbours."""
    out = [1]
    while out[-1] <= longest:
        out.append(max(out[-1] + 1, out[-1] * 13 // 10))
    return out


@cache
def bands_of(lowest: int, above: int, size: int, least: float) -> tuple[int, np.ndarray]:
    """The grid that all texts of a class and the next have, and the samples of each band among those all of them have.

    ``lowest`` and ``above`` are the least lengths of the class and of the second after it. The bands tell pairs at the
    limit whose unlike digits all stand among those samples.
    """
    exponent = 0
    while above - 1 > SAMPLES << exponent:
        exponent += 1
    have = max(lowest >> exponent, 1)
    # The shorter text of a pair may reach the next class; what it has beyond the samples in common counts as alike.
    unlike = math.floor((1 - least) * (have * 13 / 10) + 1e-9)
    alike = max(have - unlike, 1)
    size = min(size, alike)
    chance = math.comb(alike, size) / math.comb(have, size)
    number = 1 if chance == 1 else math.ceil(math.log(MISS) / math.log(1 - chance))
    rng = np.random.default_rng([17, lowest])
    return exponent, np.stack([np.sort(rng.choice(have, size, replace=False)) for _ in range(number)])


def band_keys(print_: str, size: int, least: float) -> list[int]:
    """Keys of the bands of a fingerprint: those of its class of lengths, and of the class before it."""
    exponent, digits = int(print_[:2]), np.frombuffer(print_[3:].encode(), np.uint8).astype(np.uint64)
    length, out = len(digits) << exponent, []
    lows = length_classes(max(length, 1) * 2)
    own = bisect.bisect_right(lows, length) - 1
    for k in range(max(own - 1, 0), own + 1):  # none for the empty text
        grid, picks = bands_of(lows[k], lows[k + 2], size, least)
        key = np.full(len(picks), lows[k], np.uint64) << np.uint64(20) | np.arange(len(picks), dtype=np.uint64)
        for column in digits[:: 1 << grid - exponent][picks].T:
            key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out += key.view(np.int64).tolist()
    return out


def bucket_links(nodes: np.ndarray, prints: list[str], least: float) -> pd.DataFrame:
    """Links (a, b) that join the fingerprints of a bucket as all pairs of likeness ``least`` or more would.

    Breadth first: each takes what it reaches among those not reached yet, so dense buckets are soon done.
    """
    exponents = np.array([int(p[:2]) for p in prints])
    sizes = np.array([len(p) - 3 for p in prints])
    digits = np.frombuffer("".join(p[3:].ljust(SAMPLES, "\0") for p in prints).encode(), np.uint8).reshape(len(prints), SAMPLES)
    a, b, left, queue = [], [], np.arange(len(prints)), []
    while len(left):
        if not queue:
            queue.append(left[0])
            left = left[1:]
            continue
        at = queue.pop()
        near = np.zeros(len(left), bool)
        for e in np.unique(exponents[left]):
            some = np.flatnonzero(exponents[left] == e)
            mine, its = 1 << max(e - exponents[at], 0), 1 << max(exponents[at] - e, 0)
            x, y = digits[at, ::mine], digits[left[some], ::its]
            width = min(len(x), y.shape[1])
            same = ((x[:width] == y[:, :width]) & (x[:width] != 0)).sum(axis=1)
            near[some] = same >= least * np.maximum(-(-sizes[at] // mine), -(-sizes[left[some]] // its)) - 1e-9
        found = left[near]
        a += [nodes[at]] * len(found)
        b += nodes[found].tolist()
        queue += found.tolist()
        left = left[~near]
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _fingerprints(texts: pd.Series) -> pd.Series:
    return texts.map(fingerprint)
