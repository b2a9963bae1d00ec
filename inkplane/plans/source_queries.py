"""Queries of page sources and structure: page kinds, line boxes, block kinds, columns, pairs and groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkplane.functions import geometry as G
from inkplane.plans.geometry_queries import PAGE_H, PAGE_W, pairs
from inkplane.plans.registry import query, table
from inkplane.sources.fixtures import BOXES, DOC_WORDS, box_words, boxes, doc_words


@query(
    f"""
WITH {BOXES}, c AS (SELECT page_id, least(sum(CASE WHEN block_type = 'paragraph' THEN w * h ELSE 0 END) / {PAGE_W * PAGE_H}.0, 1.0) AS cover FROM boxes GROUP BY page_id
), n AS (SELECT page_id, count(*) FILTER (WHERE conf >= 0.5 + (page_id % 3) * 0.01) AS n FROM words GROUP BY page_id)
SELECT page_id, n AS n_words, round(cover, 6)::DOUBLE AS coverage, CASE WHEN n >= 20 AND cover >= 0.02 THEN 'digital' ELSE 'scanned' END AS page_kind FROM c JOIN n USING (page_id)
"""
)
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digital pages have twenty native words and enough of the page under text blocks."""
    area = F.when(F.col("block_type") == "paragraph", F.col("w") * F.col("h")).otherwise(0)
    cover = boxes(spark, sf_dir).groupBy("page_id").agg(F.least(F.sum(area) / F.lit(float(PAGE_W * PAGE_H)), F.lit(1.0)).alias("coverage"))
    n = box_words(spark, sf_dir).groupBy("page_id").agg(F.count_if(F.col("conf") >= 0.5 + (F.col("page_id") % 3) * 0.01).alias("n_words"))
    kind = F.when((F.col("n_words") >= 20) & (F.col("coverage") >= 0.02), "digital").otherwise("scanned")
    return cover.join(n, "page_id").select("page_id", "n_words", F.round("coverage", 6).alias("coverage"), kind.alias("page_kind"))


@query(
    f"""
WITH {BOXES}, lines AS (SELECT *, min(y) OVER l AS y0, max(y + h) OVER l AS y1 FROM words WINDOW l AS (PARTITION BY page_id, k // 5))
SELECT page_id, k, round_even(x * 200 / 72.0, 0)::INT AS x, round_even(y0 * 200 / 72.0, 0)::INT AS y, greatest(1, round_even(w * 200 / 72.0, 0)::INT) AS w, greatest(1, round_even((y1 - y0) * 200 / 72.0, 0)::INT) AS h FROM lines
"""
)
def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native words in pixels: each takes the height of its line and keeps its own width."""
    line = Window.partitionBy("page_id", F.floor(F.col("k") / 5))
    px = lambda c: F.bround(c * 200 / 72.0, 0).cast("int")
    w = box_words(spark, sf_dir).withColumn("y0", F.min("y").over(line)).withColumn("y1", F.max(F.col("y") + F.col("h")).over(line))
    one = F.lit(1)
    return w.select("page_id", "k", px(F.col("x")).alias("x"), px(F.col("y0")).alias("y"), F.greatest(one, px(F.col("w"))).alias("w"), F.greatest(one, px(F.col("y1") - F.col("y0"))).alias("h"))


_LABELS = ("Page_Header", "page_footer", "Picture ", "figure-image", "table_cell", "Table", "section label", "Text", "list_item", "footer in table")
#: Kinds in the order in which they are tried, with the words that a label of the kind holds.
_KINDS = (("header", ("header",)), ("footer", ("footer",)), ("picture", ("picture", "figure", "image")), ("cell", ("cell",)), ("table", ("table",)), ("label", ("label",)))


@query(
    f"SELECT page_id, label, CASE {' '.join('WHEN ' + ' OR '.join(f'contains(lower(trim(label)), {w!r})' for w in ws) + f' THEN {k!r}' for k, ws in _KINDS)} ELSE 'paragraph' END AS block_type, "
    "l AS x, CASE WHEN t > b THEN 1100 - t ELSE t END AS y, greatest(1, r - l) AS w, greatest(1, abs(b - t)) AS h "
    f"FROM (SELECT page_id, [{', '.join(repr(x) for x in _LABELS)}][page_id % {len(_LABELS)} + 1] AS label, page_id * 37 % 600 AS l, page_id * 37 % 600 + page_id * 7 % 90 AS r, "
    "CASE WHEN page_id % 2 = 0 THEN 200 + page_id % 100 ELSE 100 END AS t, CASE WHEN page_id % 2 = 0 THEN 100 ELSE 120 + page_id % 60 END AS b FROM pages)"
)
def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds and boxes of layout items: labels by ordered words, edges from either origin."""
    p = F.col("page_id")
    low = F.lower(F.trim("label"))
    kind = F.coalesce(*[F.when(_any(low, ws), F.lit(k)) for k, ws in _KINDS], F.lit("paragraph"))
    items = table(spark, sf_dir, "pages").select(
        "page_id", F.get(F.array(*map(F.lit, _LABELS)), (p % len(_LABELS)).cast("int")).alias("label"), (p * 37 % 600).alias("l"), (p * 37 % 600 + p * 7 % 90).alias("r"),
        F.when(p % 2 == 0, 200 + p % 100).otherwise(100).alias("t"), F.when(p % 2 == 0, 100).otherwise(120 + p % 60).alias("b"),
    )
    y = F.when(F.col("t") > F.col("b"), PAGE_H - F.col("t")).otherwise(F.col("t"))
    return items.select("page_id", "label", kind.alias("block_type"), F.col("l").alias("x"), y.alias("y"), F.greatest(F.lit(1), F.col("r") - F.col("l")).alias("w"), F.greatest(F.lit(1), F.abs(F.col("b") - F.col("t"))).alias("h"))


def _any(low, words):
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


@query(
    """
WITH cells AS (SELECT o_custkey AS table_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) AS n, o_orderpriority AS text FROM orders), grid AS (SELECT table_id, n // 3 AS r, n % 3 AS c, text FROM cells)
SELECT g.table_id, g.r AS table_row, g.c AS col, g.text, CASE WHEN g.c = 2 THEN 'explicit' ELSE h.text END AS table_column FROM grid g JOIN grid h ON h.table_id = g.table_id AND h.r = 0 AND h.c = g.c
"""
)
def cell_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column name of each cell: its own, or the text of its column's cell in the first row."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    cells = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("table_id"), n.alias("n"), F.col("o_orderpriority").alias("text"))
    grid = cells.select("table_id", F.floor(F.col("n") / 3).alias("table_row"), (F.col("n") % 3).alias("col"), "text")
    # The first row is in the same partition as its table: a window, not a join.
    head = F.first(F.when(F.col("table_row") == 0, F.col("text")), ignorenulls=True).over(Window.partitionBy("table_id", "col").orderBy("table_row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return grid.withColumn("table_column", F.when(F.col("col") == 2, "explicit").otherwise(head))


@query(
    f"""
WITH {BOXES}, heads AS (SELECT page_id, k, x + w / 2.0 AS cx FROM words WHERE k % 4 = 0), near AS (
  SELECT *, lag(cx) OVER p AS prev, lead(cx) OVER p AS next FROM heads WINDOW p AS (PARTITION BY page_id ORDER BY cx, k)
), gaps AS (SELECT *, min(next - cx) OVER (PARTITION BY page_id) AS g FROM near)
SELECT page_id, k, coalesce((prev + cx) / 2, cx - least(greatest(g / 2, 15.0), 250.0)) AS zone_left, coalesce((cx + next) / 2, cx + least(greatest(g / 2, 15.0), 250.0)) AS zone_right FROM gaps
"""
)
def column_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone of each header: middles between neighbours, and outside half the least gap, of 15 to 250 px."""
    page = Window.partitionBy("page_id")
    heads = box_words(spark, sf_dir).filter("k % 4 = 0").select("page_id", "k", (F.col("x") + F.col("w") / 2.0).alias("cx"))
    o = page.orderBy("cx", "k")
    heads = heads.withColumn("prev", F.lag("cx").over(o)).withColumn("next", F.lead("cx").over(o))
    outer = F.least(F.greatest(F.min(F.col("next") - F.col("cx")).over(page) / 2, F.lit(15.0)), F.lit(250.0))
    heads = heads.withColumn("outer", outer)
    return heads.select("page_id", "k", F.coalesce((F.col("prev") + F.col("cx")) / 2, F.col("cx") - F.col("outer")).alias("zone_left"), F.coalesce((F.col("cx") + F.col("next")) / 2, F.col("cx") + F.col("outer")).alias("zone_right"))


@query(
    f"""
WITH {BOXES}, names AS (SELECT page_id, k, y // 40 AS row, x >= 360 AS right_side FROM words WHERE k % 3 <> 0), numbers AS (SELECT page_id, k, y // 40 AS row, x >= 360 AS right_side FROM words WHERE k % 3 = 0)
SELECT a.page_id, a.k, arg_min(b.k, abs(a.row - b.row) * 1e6 + b.row * 1e3 + b.k) AS number_k, min(abs(a.row - b.row)) AS distance FROM names a JOIN numbers b ON a.page_id = b.page_id AND a.right_side = b.right_side AND abs(a.row - b.row) <= 3 GROUP BY a.page_id, a.k
"""
)
def number_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number that goes with each name: nearest by row in the same section within three rows, the earlier on ties."""
    w = box_words(spark, sf_dir).select("page_id", "k", F.floor(F.col("y") / 40).alias("row"), (F.col("x") >= 360).alias("side"))
    near = pairs(w.filter("k % 3 <> 0"), w.filter("k % 3 = 0")).filter((F.col("a_side") == F.col("b_side")) & (F.abs(F.col("a_row") - F.col("b_row")) <= 3))
    distance = F.abs(F.col("a_row") - F.col("b_row"))
    return near.groupBy("page_id", F.col("a_k").alias("k")).agg(F.min_by("b_k", F.struct(distance.alias("d"), "b_row", "b_k")).alias("number_k"), F.min(distance).alias("distance"))


@query(
    f"""
WITH {BOXES}, a AS (SELECT *, greatest(20, 0.6 * w) AS m FROM words WHERE k % 5 = 0)
SELECT a.page_id, a.k, least(coalesce(min(CASE WHEN b.y + b.h <= a.y THEN a.y - b.y - b.h END), 1e9), 6 * a.h)::DOUBLE AS gap_above, least(coalesce(min(CASE WHEN b.y >= a.y + a.h THEN b.y - a.y - a.h END), 1e9), 6 * a.h)::DOUBLE AS gap_below
FROM a JOIN words b ON a.page_id = b.page_id AND a.k <> b.k AND least(a.x + a.w + a.m, b.x + b.w) > greatest(a.x - a.m, b.x) GROUP BY a.page_id, a.k, a.h
"""
)
def ink_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free height above and below each signature's anchor to the nearest word of its band, six heights at most."""
    w = box_words(spark, sf_dir)
    a, b = G.box("a_"), G.box("b_")
    m = F.greatest(F.lit(20), 0.6 * a.w)
    near = pairs(w.filter("k % 5 = 0"), w).filter((F.col("a_k") != F.col("b_k")) & (F.least(a.right + m, b.right) > F.greatest(a.x - m, b.x)))
    up, down = F.when(b.bottom <= a.y, a.y - b.bottom), F.when(b.y >= a.bottom, b.y - a.bottom)
    gap = lambda c: F.least(F.coalesce(F.min(c), F.lit(1e9)), 6 * F.first("a_h")).cast("double")
    return near.groupBy("page_id", F.col("a_k").alias("k")).agg(gap(up).alias("gap_above"), gap(down).alias("gap_below"))


@query(
    f"""
WITH RECURSIVE {BOXES}, grown AS (SELECT page_id, k, x - 20 AS x, y - 20 AS y, w + 40 AS w, h + 40 AS h FROM words
), links AS (SELECT a.page_id, a.k AS a, b.k AS b FROM grown a JOIN grown b ON a.page_id = b.page_id AND least(a.x + a.w, b.x + b.w) > greatest(a.x, b.x) AND least(a.y + a.h, b.y + b.h) > greatest(a.y, b.y)
), reach AS (SELECT page_id, a, b FROM links UNION SELECT r.page_id, r.a, l.b FROM reach r JOIN links l ON l.page_id = r.page_id AND l.a = r.b)
SELECT page_id, a AS k, min(b) AS group_k FROM reach GROUP BY page_id, a
"""
)
def touching_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words joined into groups where their boxes, grown by 20 px, touch, directly or by way of others."""

    def groups(pdf: pd.DataFrame) -> pd.DataFrame:
        root = {k: k for k in pdf["k"]}

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        rows = list(pdf.sort_values("k").itertuples())
        for i, a in enumerate(rows):
            for b in rows[:i]:
                if min(a.x + a.w, b.x + b.w) + 40 > max(a.x, b.x) and min(a.y + a.h, b.y + b.h) + 40 > max(a.y, b.y):
                    x, y = find(a.k), find(b.k)
                    root[max(x, y)] = min(x, y)
        return pd.DataFrame({"page_id": pdf["page_id"], "k": pdf["k"], "group_k": [find(k) for k in pdf["k"]]})

    return box_words(spark, sf_dir).groupBy("page_id").applyInPandas(groups, "page_id long, k int, group_k int")


@query(
    f"""
WITH {DOC_WORDS}, sums AS (SELECT doc_id, line_no, sum(length(text)) AS chars, count(*) AS n, min(x) AS x FROM doc_words GROUP BY ALL)
SELECT doc_id, line_no, chars::BIGINT AS chars, row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, line_no) = 1 AS is_primary FROM sums
"""
)
def primary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of each page with the most characters, which carries the label; the first on ties."""
    lines = doc_words(spark, sf_dir).groupBy("doc_id", "line_no").agg(F.sum(F.length("text")).alias("chars"))
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("chars"), "line_no")) == 1
    return lines.select("doc_id", "line_no", "chars", best.alias("is_primary"))


@query(
    """
WITH t AS (SELECT conv_id, turn, text, length(text) AS n FROM conversations)
SELECT conv_id, CASE WHEN max(n) > 1.1 * coalesce(max(CASE WHEN turn = 0 THEN n END), 0) THEN max(n) ELSE max(CASE WHEN turn = 0 THEN n END) END::INT AS merged_length, arg_max(turn, n * 1000 - turn) AS longest_turn, round(avg(n), 4) AS mean_length FROM t GROUP BY conv_id
"""
)
def merged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of several readings is kept: the first, unless the longest is over a tenth longer."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    first, most = F.max(F.when(F.col("turn") == 0, F.col("n"))), F.max("n")
    return t.groupBy("conv_id").agg(F.when(most > 1.1 * F.coalesce(first, F.lit(0)), most).otherwise(first).alias("merged_length"), F.max_by("turn", F.struct("n", -F.col("turn"))).alias("longest_turn"), F.round(F.avg("n"), 4).alias("mean_length"))


@query(
    f"""
WITH {BOXES}, z AS (SELECT page_id, j, CASE block_type WHEN 'footer' THEN 'BRAND_FOOTER' WHEN 'picture' THEN 'BRAND_IMAGE' ELSE 'SIGNATURE' END AS entity_type, x, y, w, h FROM boxes WHERE block_type IN ('footer', 'picture', 'header'))
SELECT page_id, j, entity_type, greatest(x, 0) AS x, greatest(y, 0) AS y, least(x + w, {PAGE_W}) - greatest(x, 0) AS w, least(y + h, {PAGE_H}) - greatest(y, 0) AS h, 0.0 AS confidence, 'brand' AS assignment_source FROM z WHERE least(x + w, {PAGE_W}) > x AND least(y + h, {PAGE_H}) > y
"""
)
def brand_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones as regions without scores, held to the page."""
    kind = F.when(F.col("block_type") == "footer", "BRAND_FOOTER").when(F.col("block_type") == "picture", "BRAND_IMAGE").otherwise("SIGNATURE")
    b = G.box()
    z = boxes(spark, sf_dir).filter(F.col("block_type").isin("footer", "picture", "header"))
    x, y, r, d = F.greatest(b.x, F.lit(0)), F.greatest(b.y, F.lit(0)), F.least(b.right, F.lit(PAGE_W)), F.least(b.bottom, F.lit(PAGE_H))
    return z.filter((r > x) & (d > y)).select("page_id", "j", kind.alias("entity_type"), x.alias("x"), y.alias("y"), (r - x).alias("w"), (d - y).alias("h"), F.lit(0.0).alias("confidence"), F.lit("brand").alias("assignment_source"))
