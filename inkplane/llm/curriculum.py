"""Mixing sources to target weights along a time-varying curriculum.

Every source gets a target number of words and a weight schedule over training time, time running from 0 to 1. The
schedule is integrated once; a document's place in its source's stream of words, as a share of the target, is then
inverted to a training position, and documents are sorted by position. All of it is built-in functions.

Defined results: a null text has size 0; a null source is a source of its own, ranked last; a null id is an id like
any other; rows that share an id are ordered by a hash of their text, and equal rows by nothing, as they cannot be told
apart; an empty table gives an empty mix; further columns are kept by ``mixed`` and do not clash with working columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkplane.llm.common import count_words, row_key, stored

#: Weights by rank of the source, repeating.
WEIGHTS = (1, 2, 3)
#: A source gives at most this many times its words.
MAX_REPEATS = 3
#: Knots (time, relative weight) of the schedules, by rank of the source like WEIGHTS: early, even, late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source of ``sizes(_skey, source, _size)`` with its weight, target and rank.

    Targets share the sum of all sizes by weight. What a source cannot give within its cap is shared again by weight,
    which ends at min(weight * level, cap) for one level: the first, by rising cap per weight, at which no cap is hit.
    The windows without partitions see one pre-aggregated row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    out = sizes.groupBy("_skey").agg(F.first("source").alias("source"), F.sum("_size").alias("source_size"))
    out = out.withColumn("_rank", (F.row_number().over(by_name) - 1) % len(weights))
    out = out.withColumn("_weight", F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("_rank") + 1))
    out = out.withColumn("_cap", F.col("source_size") * float(max_repeats)).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    before = F.coalesce(F.sum("_cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = out.withColumn("_level", (F.sum("source_size").over(every) - before) / left)
    fits = F.when(F.col("_ratio") >= F.col("_level"), F.col("_level"))
    out = out.withColumn("_level", F.first(fits, ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return out.withColumn("target", F.least(F.col("_weight") * F.col("_level"), F.col("_cap"))).select("_skey", "source_size", "target", "_rank")


def time_of(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Inverse of the integral of a piecewise linear schedule: the time at which this share of the demand is met."""
    parts, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        parts.append((t0, t1, w0, (w1 - w0) / (t1 - t0), total))
        total += (w0 + w1) / 2 * (t1 - t0)
    out = F.lit(float(knots[-1][0]))
    for t0, t1, w0, slope, done in reversed(parts):
        need = F.greatest(share * total - done, F.lit(0.0))
        root = F.sqrt(F.greatest(w0 * w0 + 2 * slope * need, F.lit(0.0)))
        here = t0 + F.coalesce(F.try_divide(2 * need, w0 + root), F.lit(0.0))
        end = done + (w0 + w0 + slope * (t1 - t0)) / 2 * (t1 - t0)
        out = F.when(share * total <= end, F.least(here, F.lit(t1))).otherwise(out)
    return out


def assigned(docs: DataFrame, keep: Sequence[str] = (), weights: Sequence[float] = WEIGHTS, schedules=SCHEDULES, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """doc_id, the columns of ``keep`` as ``_k_<name>``, size, source_size, target, taken and _positions."""
    return _placed(_sized(docs, keep), keep, weights, schedules, max_repeats).drop("_row")


def _sized(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The rows of ``docs`` with their words, keys and hash; without ``keep`` stored, each with a number of its own."""
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    base = docs.select(
        F.col("doc_id"), F.col("source"), *[F.col(f"`{c}`").alias(f"_k_{c}") for c in keep],
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_skey"),
        count_words(F.col("text")).alias("_size"), F.md5(doc_id).alias("_hash"), row_key(F.col("text")).alias("_tie"),
    ).withColumn("_bucket", F.substring("_hash", 1, 3))
    if keep:
        return base.withColumn("_row", F.lit(None).cast("long"))
    # A row of a few bytes for each text, which is then read once instead of three times.
    return stored(base.withColumn("_row", F.monotonically_increasing_id()), "sizes")


def _placed(base: DataFrame, keep: Sequence[str] = (), weights: Sequence[float] = WEIGHTS, schedules=SCHEDULES, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """What ``assigned`` returns, and _row.

    Within a source documents stand in the order of a hash of the id. Bucket sums of the hash give each document its
    offset without a window over a whole source, so a source with a third of all rows is dealt like the others. A
    repeat of a document is taken where its middle word lies before the source's target.
    """
    sums = base.groupBy("_skey", "_bucket").agg(F.first("source").alias("source"), F.sum("_size").alias("_size"))
    earlier = Window.partitionBy("_skey").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).select("_skey", "_bucket", "_offset")
    offsets = offsets.join(source_targets(sums, weights, max_repeats), "_skey")
    within = Window.partitionBy("_skey", "_bucket").orderBy("_hash", "doc_id", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = base.withColumn("_end", F.sum("_size").over(within)).join(offsets, ["_skey", "_bucket"])
    middle = F.col("_offset") + F.col("_end") - F.col("_size") / 2
    passes = F.array(*[middle + F.col("source_size") * float(k) for k in range(max_repeats)])
    taken = F.filter(passes, lambda x: (F.col("_size") > 0) & (x < F.col("target")))

    def time(x: Column) -> Column:
        out = time_of(x / F.col("target"), schedules[0])
        for k in range(1, len(schedules)):
            out = F.when(F.col("_rank") == k, time_of(x / F.col("target"), schedules[k])).otherwise(out)
        return out

    rows = rows.withColumn("_taken", taken)
    return rows.select(
        "_row", "doc_id", *[f"`_k_{c}`" for c in keep], F.col("_size").alias("size"), "source_size", "target",
        (F.size("_taken") * F.col("_size")).cast("long").alias("taken"), F.transform("_taken", time).alias("_positions"),
    )


def _slot(position: Column, slots: int) -> Column:
    return F.least(F.floor(position * slots), F.lit(slots - 1)).cast("int")


def dealt(docs: DataFrame, slots: int | None = None, **kwargs) -> DataFrame:
    """doc_id, size, source_size, target, taken and first_position of each row, from the mix as it stands in training order.

    Every copy is a row of a few bytes, written in the order of training positions, in a file for each slot as by
    ``mixed``, and read back: ``taken`` counts a document's copies there, and ``first_position`` is that of the copy met
    first. Rows that the mix leaves out are written behind it, dealt over as many files.
    """
    base = _sized(docs)
    slots = slots or slots_for(base.agg(F.sum("_size")).first()[0] or 0)
    out = _placed(base, **kwargs).select("_row", "doc_id", "size", "source_size", "target", F.explode_outer("_positions").alias("_position"))
    slot = F.coalesce(_slot(F.col("_position"), slots), (slots + F.pmod(F.xxhash64("_row"), F.lit(slots))).cast("int"))
    out = stored(out.repartitionById(2 * slots, slot).sortWithinPartitions("_position", "doc_id", "_row"), "mix")
    place = F.struct(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("slot"), F.col("_metadata.row_index").alias("row"))
    rows = out.select("*", place.alias("_place")).groupBy("_row").agg(
        *[F.any_value(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.count("_position").alias("_n"), F.min_by("_position", "_place").alias("first_position")
    )
    return rows.select("doc_id", "size", "source_size", "target", (F.col("_n") * F.col("size")).alias("taken"), "first_position")


def mixed(docs: DataFrame, slots: int = 64, **kwargs) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, repeats included, sorted by training position.

    Time is cut into ``slots`` equal parts, each a partition sorted by position: positions spread evenly over time, so
    no sampling pass is needed and partitions, and the files written from them, stand in training order.
    """
    columns = docs.columns
    out = assigned(docs, keep=columns, **kwargs)
    out = out.select(*[F.col(f"`_k_{c}`") for c in columns], F.explode("_positions").alias("_position"), row_key(F.col("_k_text")).alias("_tie"))
    slot = _slot(F.col("_position"), slots)
    out = out.repartitionById(slots, slot).sortWithinPartitions("_position", "_k_doc_id", "_tie")
    return out.select(*[F.col(f"`_k_{c}`").alias(c) for c in columns])


def slots_for(words: int, words_per_slot: int = 50_000_000, least: int = 24) -> int:
    """Number of slots for a mix of so many words."""
    return max(least, math.ceil(words / words_per_slot))
