"""Operators on the words, zones and spans of pages.

Relations have page_id and boxes x, y, w, h; a page has a few dozen boxes, so that relations meet by page. Null sizes make
a box that nothing meets; pages without rows on one side give none; ties go to the smaller key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkplane.functions import geometry as G
from inkplane.functions import text as T
from inkplane.functions import vocab as V


def valid_words(words: DataFrame) -> DataFrame:
    """words(text, x, y, w, h as read) whose text is not blank, whose numbers are numbers, and whose sides are above 0."""
    n = {c: F.expr(f"try_cast({c} AS double)") for c in "xywh"}
    some = n["x"].isNotNull() & n["y"].isNotNull() & (n["w"] > 0) & (n["h"] > 0)
    return words.filter(F.coalesce((F.trim("text") != "") & some, F.lit(False)))


def in_zones(words: DataFrame, zones: DataFrame, key: str, zone: str, least: float = 0.7) -> DataFrame:
    """(page_id, zone, key) of the words that share ``least`` of their width with a zone's."""
    met = _met(words.select("page_id", key, "x", "w"), zones.select("page_id", zone, "x", "w"))
    share = F.least(F.col("a_x") + F.col("a_w"), F.col("b_x") + F.col("b_w")) - F.greatest("a_x", "b_x")
    return met.filter((F.col("a_w") > 0) & (share >= least * F.col("a_w"))).select("page_id", F.col(f"b_{zone}").alias(zone), F.col(f"a_{key}").alias(key))


def cell_words(words: DataFrame, cells: DataFrame, key: str, cell: str) -> DataFrame:
    """(page_id, cell, key): for each cell the page's words whose center it holds, or all of them if it holds none."""
    met = _met(words.select("page_id", key, *"xywh"), cells.select("page_id", cell, *"xywh"))
    met = met.withColumn("_in", G.holds_center(G.box("b_"), G.box("a_")))
    held = F.max("_in").over(Window.partitionBy("page_id", f"b_{cell}"))
    return met.withColumn("_some", held).filter("_in OR NOT _some").select("page_id", F.col(f"b_{cell}").alias(cell), F.col(f"a_{key}").alias(key))


def plausible_graphic(b: G.Box, page_w: Column, page_h: Column) -> Column:
    """A box in the lowest 30 % of a page that is neither speck nor background."""
    share = b.area / (page_w * page_h)
    return (b.bottom > 0.7 * page_h) & (b.w >= 24) & (b.h >= 12) & (share >= 0.0008) & (share < 0.4)


def in_tables(words: DataFrame, tables: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """The words that some table covers by ``least`` of their area."""
    met = _met(words.select("page_id", key, *"xywh"), tables.select("page_id", *"xywh"))
    inside = met.filter(G.coverage(G.box("a_"), G.box("b_")) >= least).select("page_id", F.col(f"a_{key}").alias(key)).distinct()
    return words.join(inside, ["page_id", key], "left_semi")


def deep_inside(picture: G.Box, word: G.Box) -> Column:
    """Whether the word's center lies in the picture by more than an edge of 15 % of its sides, 8 px at least."""
    dx, dy = F.greatest(F.lit(8), F.floor(picture.w * 0.15)), F.greatest(F.lit(8), F.floor(picture.h * 0.15))
    cx, cy = word.x + word.w / 2.0, word.y + word.h / 2.0
    return cx.between(picture.x + dx, picture.right - dx) & cy.between(picture.y + dy, picture.bottom - dy)


def fitted_size(text: Column, w: Column, h: Column, cap: Column, unit: float = 0.5) -> Column:
    """The font size at which a text fits a box: 0.7 of the height, the cap at most, less where the text is too wide, null below 4.

    A character of width 1 is ``unit`` of the size wide.
    """
    widest = F.floor((w - 2) / (T.text_width(text) * unit))
    size = F.least(F.floor(0.7 * h), cap, F.coalesce(F.when(T.text_width(text) > 0, widest), cap)).cast("int")
    return F.when(size >= 4, size)


def region_fonts(regions: DataFrame, spans: DataFrame, key: str, span: str) -> DataFrame:
    """regions with the family and size of the span (family, size) that overlaps each most; null where none does."""
    met = _met(regions.select("page_id", key, *"xywh"), spans.select("page_id", span, "family", "size", *"xywh")).withColumn("_shared", G.overlap(G.box("a_"), G.box("b_"))).filter("_shared > 0")
    best = met.groupBy("page_id", F.col(f"a_{key}").alias(key)).agg(F.max_by(F.struct(F.col("b_family").alias("family"), F.col("b_size").alias("size")), F.struct("_shared", -F.col(f"b_{span}"))).alias("_best"))
    return regions.join(best, ["page_id", key], "left").withColumns({"family": F.col("_best.family"), "size": F.col("_best.size")}).drop("_best")


def page_fonts(spans: DataFrame) -> DataFrame:
    """(page_id, family): serif where more characters of spans(page_id, font, text) stand in serif fonts than in others."""
    serif = F.lit(False)
    for hint in V.SERIF_HINTS:
        serif = serif | F.lower("font").contains(hint)
    chars = F.length(F.trim("text"))
    count = lambda c: F.sum(F.when(c, chars).otherwise(0))
    return spans.groupBy("page_id").agg(F.when(count(F.coalesce(serif, F.lit(False))) > count(~F.coalesce(serif, F.lit(False))), "serif").otherwise("sans").alias("family"))


def number_columns(heads: DataFrame, key: str) -> DataFrame:
    """(page_id, key, number): for each name header of heads(page_id, key, kind, x) the first number header from it to the next name header."""
    names = heads.filter("kind = 'name'").withColumn("_next", F.lead("x").over(Window.partitionBy("page_id").orderBy("x", key)))
    met = _met(names.select("page_id", key, "x", "_next"), heads.filter("kind = 'number'").select("page_id", key, "x"))
    met = met.filter((F.col("b_x") >= F.col("a_x")) & (F.col("b_x") < F.coalesce("a__next", F.lit(1 << 30))))
    return met.groupBy("page_id", F.col(f"a_{key}").alias(key)).agg(F.min_by(f"b_{key}", F.struct("b_x", f"b_{key}")).alias("number"))


def header_rows(rows: DataFrame, page: str, row: str, most: int = 40) -> DataFrame:
    """(page, row, n_hits): of rows(page, row, n_words, name_hits, n_hits) the header of each page, that of most hits.

    A header has ``most`` words at most, two labels or more, and a name label among them.
    """
    fit = rows.filter((F.col("n_words") <= most) & (F.col("name_hits") >= 1) & (F.col("n_hits") >= 2))
    return fit.groupBy(page).agg(F.max_by(F.struct(row, "n_hits"), F.struct("n_hits", -F.col(row))).alias("h")).select(page, f"h.{row}", "h.n_hits")


def claims(rows: DataFrame, order: list[Column], start: str, stop: str, key: str) -> DataFrame:
    """(page_id, key, start, stop) that stay when, in order, each is dropped that overlaps one taken before."""
    item = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], key, start, stop)
    pages = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("_all"))

    def keep(acc: Column, s: Column) -> Column:
        return F.when(F.exists(acc, lambda o: (o[start] < s[stop]) & (o[stop] > s[start])), acc).otherwise(F.array_append(acc, s))

    return pages.select("page_id", F.explode(F.aggregate("_all", F.slice("_all", 1, 0), keep)).alias("s")).select("page_id", f"s.{key}", f"s.{start}", f"s.{stop}")


def preferred_tables(bordered: DataFrame, implied: DataFrame, key: str, least: float = 0.3, collapsed: float = 0.5) -> DataFrame:
    """(page_id, origin, key) of the tables to go on with, of those found by borders and those found by line spacing.

    Bordered tables have their tallest row's height as ``tallest``. In order of their keys each claims the first implied
    table not claimed yet that it overlaps by ``least``. The claimed one stands for a bordered table whose rows collapsed
    (the tallest takes ``collapsed`` of its height, or nothing is known of rows or height); otherwise the bordered one
    stays. Tables of either side without a counterpart stay. Keys are told apart within a page.
    """
    near = _met(bordered, implied).filter(G.iou(G.box("a_"), G.box("b_")) >= least)
    near = near.groupBy("page_id", F.col(f"a_{key}").alias("a")).agg(F.array_sort(F.collect_list(f"b_{key}")).alias("bs"))
    near = near.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("a", "bs"))).alias("claims"))
    none = F.array().cast(f"array<struct<a:{bordered.schema[key].dataType.simpleString()},b:{implied.schema[key].dataType.simpleString()}>>")

    def claim(taken: Column, row: Column) -> Column:
        free = F.array_except(row["bs"], taken["b"])
        return F.when(F.size(free) > 0, F.concat(taken, F.array(F.struct(row["a"].alias("a"), F.get(free, F.lit(0)).alias("b"))))).otherwise(taken)

    taken = near.select("page_id", F.inline(F.aggregate("claims", none, claim)))
    fell = F.coalesce(F.col("tallest") / F.when(F.col("h") > 0, F.col("h")) >= collapsed, F.lit(True)) | (F.col("tallest") <= 0)
    swap = fell & F.col("b").isNotNull()
    kept = bordered.withColumnRenamed(key, "a").join(taken, ["page_id", "a"], "left")
    kept = kept.select("page_id", F.when(swap, "implied").otherwise("bordered").alias("origin"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias(key))
    left = implied.join(taken.select("page_id", F.col("b").alias(key)), ["page_id", key], "left_anti")
    return kept.unionByName(left.select("page_id", F.lit("implied").alias("origin"), key))


def text_source(kind: Column, n_read: Column, n_native: Column, blank_pages: bool = True) -> Column:
    """Where a page's words come from: recognition, else the page's own text on digital pages, else it is blank or failed."""
    return F.when(F.coalesce(n_read, F.lit(0)) > 0, "ocr").when((kind == "digital") & (F.coalesce(n_native, F.lit(0)) > 0), "native").otherwise("blank" if blank_pages else "failed")


def engine_list(text: Column, default: str) -> Column:
    """Names of a comma-separated list, trimmed, in lower case, each once; the default's where there are none."""
    some = F.array_distinct(F.filter(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), ","), lambda x: F.trim(x)), lambda x: x != ""))
    return F.when(F.size(some) > 0, some).otherwise(F.split(F.lit(default), ","))


def error_body(code: Column, message: Column, request_id: Column) -> Column:
    """An error as JSON; no key is left out."""
    return F.to_json(F.struct(F.struct(code.alias("code"), message.alias("message"), request_id.alias("request_id")).alias("error")), {"ignoreNullFields": "false"})


def log_line(level: Column, name: Column, message: Column, extras: dict[str, Column], as_json: bool = True) -> Column:
    """A log record as JSON or as plain text, its further fields inlined."""
    if as_json:
        return F.to_json(F.struct(level.alias("level"), name.alias("logger"), message.alias("message"), *[c.alias(k) for k, c in extras.items()]))
    return F.concat_ws(" ", level, F.concat(name, F.lit(":")), message, *[F.concat(F.lit(f"{k}="), c.cast("string")) for k, c in extras.items()])


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    sides = [d.select("page_id", *[F.col(c).alias(f"{p}_{c}") for c in d.columns if c != "page_id"]) for p, d in (("a", a), ("b", b))]
    return sides[0].join(sides[1], "page_id")
