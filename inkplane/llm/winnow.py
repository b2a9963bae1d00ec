"""Benchmark decontamination by winnowing.

A window is WINDOW consecutive words of a benchmark item. Of every window the smallest hash of its K-grams is kept, the
leftmost on ties. A document is cut into overlapping segments, so that its length bounds nothing, and keeps the minima
of all its windows, each minimum once however many windows share it. Both sides choose alike, so every window that a
document shares with an item meets it in the join on the minimum, at the right place: no shared window is lost. Hits
are then extended: each window that the minimum stands for is compared word for word. All of it is built-in functions.

Defined results: null and empty texts have no words, as documents and as items; an item of fewer words than a window
is one window; items without words never occur; repeated items with one id count once; rows that share a doc_id are
told apart by their text, and each repeated row is answered; empty tables give no rows or no hits; further columns
may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkplane.llm.common import ascii_lower, row_key, stored

WINDOW, K = 10, 5
#: Starts of a segment; a power of two, as places share a 64-bit word with hashes.
SEGMENT = 4096
#: Windows of the benchmark up to which it is broadcast, about 150 bytes each; a larger one is joined by shuffles.
BROADCAST_WINDOWS = 50_000
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LETTER = r"[0-9A-Za-z]|[^\x00-\x7F]"


def words(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; breaks at the ends make empty pieces, which are taken off."""
    pieces = F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BREAK, -1)
    return F.filter(pieces, lambda w: w != "")


def _runs(values: Column, k: int, join: Callable[[Column, Column], Column]) -> Column:
    """At each place the values of the ``k`` places from there joined, in passes that each join what stands apart by a step.

    Steps double, and the last overlaps. Places within the last ``k`` - 1 join what is left.
    """
    done = 1
    while done < k:
        step = min(done, k - done)
        # A lambda of one value names the array, which would be worked out twice otherwise.
        values = F.get(F.transform(F.array(values), lambda v: F.zip_with(v, F.slice(v, F.lit(step + 1), F.size(v)), join)), F.lit(0))  # noqa: B023
        done += step
    return values


def _keys(ws: Column, last: Column) -> Column:
    """For each K-gram start up to ``last`` its hash, of the hashes of its words, with the place in the low bits."""
    grams = F.slice(_runs(F.transform(ws, lambda w: F.xxhash64(w)), K, lambda a, b: F.xxhash64(a, b)), F.lit(1), last + 1)
    return F.transform(grams, lambda g, i: g.bitwiseAND(F.lit(-SEGMENT * 2)).bitwiseOR(i.cast("long")))


def windows_of(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (n, win, words, fp, off), fp and off null for those of short items; and (win, item_id)."""
    rows = items.select("item_id", words(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - window + 1, F.lit(1)))
    rows = rows.select("item_id", F.explode(F.transform(starts, lambda s: F.slice(F.col("ws"), s, F.lit(window)))).alias("words"))
    rows = rows.withColumn("win", F.sha2(F.array_join("words", " ").cast("binary"), 256)).withColumn("n", F.size("words"))
    least = F.array_min(_keys(F.col("words"), F.lit(window - K)))
    distinct = rows.groupBy("win").agg(F.first("words").alias("words"), F.first("n").alias("n")).withColumn("_m", F.when(F.col("n") == window, least))
    # The bits that hold the place are cut off on both sides, so the place within a window is left apart.
    distinct = distinct.select("n", "win", "words", F.shiftright("_m", 13).alias("fp"), F.col("_m").bitwiseAND(F.lit(SEGMENT * 2 - 1)).cast("int").alias("off"))
    return distinct, rows.select("win", "item_id").distinct()


def segments(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, key, seg, ws, n): the words from seg * SEGMENT on, with those that the last windows reach beyond."""
    # Texts without words are told by their letters, as a filter on the words would split each text a second time.
    rows = docs.filter(F.col("text").rlike(_LETTER)).select("doc_id", row_key(F.col("text")).alias("key"), words(F.col("text")).alias("all"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / SEGMENT).cast("int")), lambda g: F.slice(F.col("all"), g * SEGMENT + 1, F.lit(SEGMENT + window - 1)))
    rows = rows.select("doc_id", "key", F.posexplode(pieces).alias("seg", "ws"))
    return rows.withColumn("n", F.size("ws"))


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Where windows occur: (doc_id, key, start, n, win), and the windows' items (win, item_id)."""
    wins, members = windows_of(items, window)
    wins = wins.cache()
    try:
        lengths = [r.n for r in wins.filter(F.col("n") < window).select("n").distinct().collect()]  # below the window: nine at most
        small = wins.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    finally:
        wins.unpersist()
    wins = windows_of(items, window)[0]
    segs = segments(docs, window)
    found = []
    full, near = wins.filter(F.col("n") == window), segs.filter(F.col("n") >= window)
    keys = near.withColumn("ks", _keys(F.col("ws"), F.col("n") - K))
    minima = F.slice(_runs(F.col("ks"), window - K + 1, lambda a, b: F.least(a, b)), F.lit(1), F.col("n") - window + 1)
    marks = keys.select("doc_id", "key", "seg", "ws", F.explode(F.array_distinct(minima)).alias("m"))
    marks = marks.select("doc_id", "key", "seg", "ws", F.shiftright("m", 13).alias("fp"), F.col("m").bitwiseAND(F.lit(SEGMENT * 2 - 1)).cast("int").alias("at"))
    found.append((marks, full, "fp", F.col("at") - F.col("off")))
    for n in lengths:
        short = wins.filter(F.col("n") == n).withColumn("gram", F.xxhash64("words"))
        grams = _grams(n)
        marks = segs.filter(F.col("n") >= n).select("doc_id", "key", "seg", "ws", F.explode(grams).alias("g")).select("doc_id", "key", "seg", "ws", "g.gram", "g.at")
        found.append((marks, short, "gram", F.col("at")))
    out = None
    for marks, side, on, start in found:
        if small:
            both = marks.join(F.broadcast(side), on)
        else:  # without the words, which join again where a mark was met
            texts = segs.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.col("seg").alias("_g"), "ws")
            same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")) & (F.col("seg") == F.col("_g"))
            both = marks.drop("ws").join(side, on).join(texts, same).drop("_d", "_k", "_g")
        both = both.withColumn("_s", start).filter((F.col("_s") >= 0) & (F.slice(F.col("ws"), F.greatest(F.col("_s"), F.lit(0)) + 1, side["n"]) == F.col("words")))
        both = both.select("doc_id", "key", (F.col("seg") * SEGMENT + F.col("_s")).alias("start"), side["n"].alias("n"), "win").distinct()
        out = both if out is None else out.unionByName(both)
    return out, members


def _grams(n: int) -> Column:
    def gram(s: Column) -> Column:
        return F.struct(s.alias("at"), F.xxhash64(F.slice(F.col("ws"), s + 1, F.lit(n))).alias("gram"))

    return F.transform(F.sequence(F.lit(0), F.col("n") - n), gram)


def summaries(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, key, n_hit, items) of the documents in which windows occur; items as sorted strings."""
    found, members = hits(docs, items, window)
    found = stored(found, "hits")  # read twice below, and texts are not
    before = Window.partitionBy("doc_id", "key").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    reach = F.greatest(F.coalesce(F.max(end).over(before), F.lit(0)), F.col("start"))
    counts = found.withColumn("fresh", F.greatest(end - reach, F.lit(0))).groupBy("doc_id", "key").agg(F.sum("fresh").cast("long").alias("n_hit"))
    named = found.select("doc_id", "key", "win").distinct().join(members, "win").select("doc_id", "key", F.col("item_id").cast("string").alias("item"))
    named = named.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    same = counts["doc_id"].eqNullSafe(named["doc_id"]) & (counts["key"] == named["key"])
    return counts.join(named, same, "left").select(counts["doc_id"], counts["key"], "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _keyed(docs: DataFrame) -> DataFrame:
    """_row, _doc and _key, so that no column of docs clashes with working columns."""
    return docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), row_key(F.col("text")).alias("_key"))


def with_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_row, _n_hit, _items): the rows of docs as structs; a null item_id makes hits but has no name."""
    rows, found = _keyed(docs), summaries(docs, items, window)
    out = rows.join(found, rows["_doc"].eqNullSafe(found["doc_id"]) & (rows["_key"] == found["key"]), "left")
    return out.select("_row", F.coalesce("n_hit", F.lit(0)).cast("long").alias("_n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("_items"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without those in which a window occurs."""
    rows, found = _keyed(docs), hits(docs, items, window)[0].select("doc_id", "key").distinct()
    return rows.join(found, rows["_doc"].eqNullSafe(found["doc_id"]) & (rows["_key"] == found["key"]), "left_anti").select("_row.*")
