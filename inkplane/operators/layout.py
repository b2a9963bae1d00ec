"""Rows, segments and zones of positioned words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visual_rows(words: DataFrame, page: str = "doc_id", seq: str = "word_idx") -> DataFrame:
    """words with row_no and row_pos: rows by vertical middle, in each row by x.

    A word starts a new row where its middle lies more than 0.6 of its height, 4 at least, below that of the word
    before it, in the order of middles and x.
    """
    order = Window.partitionBy(page).orderBy("_mid", "x", seq)
    out = words.withColumn("_mid", F.col("y") + F.col("h") / 2.0)
    gap = F.col("_mid") - F.lag("_mid").over(order)
    out = out.withColumn("_new", F.coalesce((gap > F.greatest(F.lit(4.0), 0.6 * F.col("h"))).cast("int"), F.lit(0)))
    out = out.withColumn("row_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int"))
    in_row = Window.partitionBy(page, "row_no").orderBy("x", seq)
    return out.withColumn("row_pos", (F.row_number().over(in_row) - 1).cast("int")).drop("_mid", "_new")


def gap_segments(rows: DataFrame, page: str = "doc_id") -> DataFrame:
    """Rows cut where the gap between words exceeds four upper-median heights, 40 at least: adds segment."""
    in_row = Window.partitionBy(page, "row_no").orderBy("row_pos")
    whole = in_row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heights = F.array_sort(F.collect_list("h").over(whole))
    limit = F.greatest(4 * F.get(heights, F.floor(F.size(heights) / 2).cast("int")), F.lit(40))
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(in_row)
    out = rows.withColumn("_cut", F.coalesce((gap > limit).cast("int"), F.lit(0)))
    return out.withColumn("segment", F.sum("_cut").over(in_row.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")).drop("_cut")


def union_box(prefix: str = "") -> list[Column]:
    """Aggregates of the box around the boxes of a group: x, y, w, h."""
    x, y, w, h = (F.col(f"{prefix}{k}") for k in "xywh")
    return [F.min(x).alias("x"), F.min(y).alias("y"), (F.max(x + w) - F.min(x)).alias("w"), (F.max(y + h) - F.min(y)).alias("h")]


def following(col: str, n: int, page: str = "doc_id", seq: str = "word_idx") -> Column:
    """The next n values as an array, in the order of seq."""
    return F.collect_list(col).over(Window.partitionBy(page).orderBy(seq).rowsBetween(1, n))


def prose_names(words: DataFrame, markers: dict[str, str | None], sides: dict[str, str], ahead: int = 8, back: int = 15, page: str = "doc_id", seq: str = "word_idx") -> DataFrame:
    """(page, seq, marker, name_text, field_role, confidence): names after a marker in running text.

    A name is up to ``ahead`` words to the end of a clause, or to a word that starts with a digit. Its role is that of
    its marker; where the marker has none, that of the nearest of the ``sides`` among the ``back`` words before, else a
    counterparty's. Words are compared in lower case by their letters, digits and slashes. Null words match nothing;
    a marker at a page's end has no name.
    """
    bare = F.lower(F.regexp_replace("text", "[^A-Za-z0-9/]", ""))
    before = Window.partitionBy(page).orderBy(seq).rowsBetween(-back, -1)
    looked = words.select(page, seq, "text", bare.alias("_t")).withColumn("_ahead", following("text", ahead, page, seq))
    looked = looked.withColumn("_side", F.last(F.when(F.col("_t").isin(*sides), F.col("_t")), ignorenulls=True).over(before))
    looked = looked.filter(F.col("_t").isin(*markers) & (F.size("_ahead") > 0))

    def take(state: Column, w: Column) -> Column:
        number, ends = w.rlike("^[0-9]"), w.rlike("[.,;:]$")
        out = F.when(~state["done"] & ~number, F.array_append(state["out"], w)).otherwise(state["out"])
        return F.struct((state["done"] | number | ends).alias("done"), out.alias("out"))

    names = F.aggregate("_ahead", F.struct(F.lit(False).alias("done"), F.array().cast("array<string>").alias("out")), take, lambda s: s["out"])
    own = F.coalesce(*[F.when(F.col("_t") == m, F.lit(r)) for m, r in markers.items() if r], F.lit(None).cast("string"))
    side = F.coalesce(*[F.when(F.col("_side") == w, F.lit(r)) for w, r in sides.items()], F.lit(None).cast("string"))
    return looked.select(page, seq, F.col("_t").alias("marker"), F.array_join(names, " ").alias("name_text"), F.coalesce(own, side, F.lit("counterparty_org")).alias("field_role"), F.lit(0.75).alias("confidence"))


def sections(words: DataFrame, labels: dict[str, tuple[str, ...]], most: int = 6, page: str = "doc_id", line: str = "line_no") -> DataFrame:
    """(page, line, n_words, section): the section each line stands in, none above the first label.

    A line of ``most`` words at most in which all words of a label stand sets the section for itself and those below;
    of several sections the first in ``labels`` counts. Words are compared in lower case by their letters and digits.
    """
    bare = F.lower(F.regexp_replace("text", "[^A-Za-z0-9]", ""))
    lines = words.groupBy(page, line).agg(F.collect_set(bare).alias("_set"), F.count(F.lit(1)).alias("n_words"))

    def stands(label: str) -> Column:
        return F.size(F.array_except(F.array(*map(F.lit, label.split())), F.col("_set"))) == 0

    def any_of(phrases: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for p in phrases:
            out = out | stands(p)
        return out

    here = F.when(F.col("n_words") <= most, F.coalesce(*[F.when(any_of(p), F.lit(s)) for s, p in labels.items()]))
    carried = F.last(here, ignorenulls=True).over(Window.partitionBy(page).orderBy(line).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return lines.select(page, line, "n_words", F.coalesce(carried, F.lit("none")).alias("section"))
