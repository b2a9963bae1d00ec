"""Queries over boxes: spatial joins, neighbours, padding and zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkplane.functions import geometry as G
from inkplane.operators import layout as L
from inkplane.plans.registry import query
from inkplane.sources.fixtures import BOXES, box_words, boxes

PAGE_W, PAGE_H = 720, 1100
_OVER = "greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"


def _shared(a: str, b: str) -> str:
    return "(" + _OVER.format(a=a, b=b) + ")"


def pairs(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Rows of two relations on the same page, columns prefixed by a name each. A page has a few dozen boxes."""
    a, b = names
    left = left.select("page_id", *[F.col(c).alias(f"{a}_{c}") for c in left.columns if c != "page_id"])
    right = right.select("page_id", *[F.col(c).alias(f"{b}_{c}") for c in right.columns if c != "page_id"])
    return left.join(right, "page_id")


@query(
    f"""
WITH {BOXES}, met AS (SELECT w.page_id, w.k, b.j, b.block_type, {_shared("w", "b")} AS shared, w.w * w.h + b.w * b.h - {_shared("w", "b")} AS total FROM words w JOIN boxes b USING (page_id)
), best AS (SELECT *, row_number() OVER (PARTITION BY page_id, k ORDER BY shared / total DESC, j) AS r FROM met WHERE shared > 0)
SELECT w.page_id, w.k, coalesce(j, -1) AS j, block_type, round(shared / total, 4) AS join_iou FROM words w LEFT JOIN best ON best.page_id = w.page_id AND best.k = w.k AND r = 1
"""
)
def best_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block with the greatest overlap of each word, the first on ties; words without one stay."""
    words = box_words(spark, sf_dir)
    near = pairs(words, boxes(spark, sf_dir), ("w", "b")).withColumn("iou", G.iou(G.box("w_"), G.box("b_"))).filter("iou > 0")
    best = near.groupBy("page_id", F.col("w_k").alias("k")).agg(F.max_by(F.struct("b_j", "b_block_type", "iou"), F.struct("iou", -F.col("b_j"))).alias("b"))
    out = words.select("page_id", "k").join(best, ["page_id", "k"], "left")
    return out.select("page_id", "k", F.coalesce("b.b_j", F.lit(-1)).alias("j"), F.col("b.b_block_type").alias("block_type"), F.round("b.iou", 4).alias("join_iou"))


@query(
    f"""
WITH {BOXES}, met AS (SELECT w.page_id, w.k, b.j, {_shared("w", "b")}::DOUBLE / (w.w * w.h) AS share FROM words w JOIN boxes b USING (page_id))
SELECT page_id, k, arg_max(j, share * 1000 - j * 1e-6) AS cell, round(max(share), 4) AS covered FROM met WHERE share >= 0.6 GROUP BY page_id, k
"""
)
def word_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block that covers most of each word, where that is 0.6 or more."""
    near = pairs(box_words(spark, sf_dir), boxes(spark, sf_dir), ("w", "b")).withColumn("share", G.coverage(G.box("w_"), G.box("b_"))).filter("share >= 0.6")
    return near.groupBy("page_id", F.col("w_k").alias("k")).agg(F.max_by("b_j", F.struct("share", -F.col("b_j"))).alias("cell"), F.round(F.max("share"), 4).alias("covered"))


@query(
    f"""
WITH {BOXES}, spans AS (SELECT page_id, k // 4 AS span, k, x, y, w, h FROM words
), votes AS (SELECT s.page_id, s.span, s.k, arg_min(b.j, b.w * b.h + b.j * 1e-6) AS j FROM spans s JOIN boxes b ON b.page_id = s.page_id AND s.x + s.w / 2.0 BETWEEN b.x AND b.x + b.w AND s.y + s.h / 2.0 BETWEEN b.y AND b.y + b.h GROUP BY ALL
), counted AS (SELECT page_id, span, j, count(*) AS n, min(k) AS first FROM votes GROUP BY ALL
), chosen AS (SELECT *, row_number() OVER (PARTITION BY page_id, span ORDER BY n DESC, first) AS r FROM counted)
SELECT page_id, span, j AS cell, n AS votes FROM chosen WHERE r = 1
"""
)
def enclosing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell of each span of four words, by vote: each word names the smallest block that holds its center."""
    words = box_words(spark, sf_dir).withColumn("span", F.floor(F.col("k") / 4))
    held = pairs(words, boxes(spark, sf_dir), ("w", "b")).filter(G.holds_center(G.box("b_"), G.box("w_")))
    votes = held.groupBy("page_id", F.col("w_span").alias("span"), F.col("w_k").alias("k")).agg(F.min_by("b_j", F.struct(F.col("b_w") * F.col("b_h"), "b_j")).alias("cell"))
    counted = votes.groupBy("page_id", "span", "cell").agg(F.count(F.lit(1)).alias("votes"), F.min("k").alias("first"))
    best = counted.groupBy("page_id", "span").agg(F.max_by(F.struct("cell", "votes"), F.struct("votes", -F.col("first"))).alias("c"))
    return best.select("page_id", "span", "c.cell", "c.votes")


@query(
    f"""
WITH {BOXES} SELECT a.page_id, a.k,
  max(CASE WHEN b.x + b.w <= a.x THEN (b.x + b.w + a.x) / 2.0 END) AS left_edge, min(CASE WHEN b.x >= a.x + a.w THEN (a.x + a.w + b.x) / 2.0 END) AS right_edge
FROM words a JOIN words b ON a.page_id = b.page_id AND a.k <> b.k AND least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) > 0.5 * least(a.h, b.h) GROUP BY a.page_id, a.k
"""
)
def neighbour_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each word may grow sideways: halfway to the nearest word on either side of its row."""
    words = box_words(spark, sf_dir)
    a, b = G.box("a_"), G.box("b_")
    near = pairs(words, words).filter((F.col("a_k") != F.col("b_k")) & G.same_row(a, b))
    left, right = F.when(b.right <= a.x, (b.right + a.x) / 2.0), F.when(b.x >= a.right, (a.right + b.x) / 2.0)
    return near.groupBy("page_id", F.col("a_k").alias("k")).agg(F.max(left).alias("left_edge"), F.min(right).alias("right_edge"))


@query(
    f"""
WITH {BOXES}, near AS (
  SELECT a.page_id, a.k, b.k AS other, CASE WHEN least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) > 0.5 * least(a.h, b.h) AND b.x >= a.x + a.w THEN 0
      WHEN b.y >= a.y + a.h AND least(a.x + a.w, b.x + b.w) > greatest(a.x, b.x) THEN 1 END AS kind,
    CASE WHEN least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) > 0.5 * least(a.h, b.h) AND b.x >= a.x + a.w THEN b.x - a.x - a.w ELSE b.y - a.y - a.h END AS gap, a.h
  FROM words a JOIN words b ON a.page_id = b.page_id AND a.k <> b.k)
SELECT page_id, k, arg_min(other, kind * 1e6 + gap + other * 1e-4) AS next_word, arg_min(kind, kind * 1e6 + gap + other * 1e-4) AS kind FROM near WHERE kind IS NOT NULL AND gap <= 1.5 * h GROUP BY page_id, k
"""
)
def extension_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word a span would grow to: nearest to the right on its row, else nearest below, within 1.5 heights."""
    words = box_words(spark, sf_dir)
    a, b = G.box("a_"), G.box("b_")
    right = G.same_row(a, b) & (b.x >= a.right)
    below = (b.y >= a.bottom) & (F.least(a.right, b.right) > F.greatest(a.x, b.x))
    near = pairs(words, words).filter(F.col("a_k") != F.col("b_k")).withColumn("kind", F.when(right, 0).when(below, 1)).withColumn("gap", F.when(right, b.x - a.right).otherwise(b.y - a.bottom))
    near = near.filter(F.col("kind").isNotNull() & (F.col("gap") <= 1.5 * F.col("a_h")))
    return near.groupBy("page_id", F.col("a_k").alias("k")).agg(F.min_by("b_k", F.struct("kind", "gap", "b_k")).alias("next_word"), F.min_by("kind", F.struct("kind", "gap", "b_k")).alias("kind"))


_PADDED_SQL = f"""
WITH {BOXES}, joined AS (
  SELECT w.page_id, w.k, w.x, w.y, w.w, w.h, ['good', 'mild', 'severe'][w.k % 3 + 1] AS tier, w.k % 5 = 0 AS multi, b.x AS cx, b.y AS cy, b.w AS cw, b.h AS ch, CASE WHEN w.k % 2 = 0 THEN w.x - 5.5 END AS l, CASE WHEN w.k % 3 = 0 THEN w.x + w.w + 2.5 END AS r
  FROM words w LEFT JOIN boxes b ON b.page_id = w.page_id AND b.j = w.k % 7
), grown AS (
  SELECT *, CASE tier WHEN 'good' THEN 4 WHEN 'mild' THEN 8 ELSE 12 END AS p, CASE WHEN cw > 6 AND ch > 6 THEN 3 ELSE 0 END AS m, cx IS NOT NULL AND x >= cx - 3 AND x + w <= cx + cw + 3 AS fits FROM joined
), sides AS (
  SELECT *, x - p AS x1, x + w + p AS x2, CASE WHEN multi THEN y ELSE y - p END AS y1, CASE WHEN multi THEN y + h ELSE y + h + p END AS y2 FROM grown
), clipped AS (
  SELECT *, CASE WHEN fits THEN least(greatest(x1, cx + m), x) ELSE greatest(x1, cx + m) END AS cx1, CASE WHEN fits THEN greatest(least(x2, cx + cw - m), x + w) ELSE least(x2, cx + cw - m) END AS cx2,
    least(greatest(y1, cy + m), y) AS cy1, greatest(least(y2, cy + ch - m), y + h) AS cy2,
    cx IS NOT NULL AND coalesce(least(x + w, cx + cw) > greatest(x, cx) AND least(y + h, cy + ch) > greatest(y, cy), false) AS hits FROM sides
), used AS (SELECT *, hits AND cx2 > cx1 AND cy2 > cy1 AS u FROM clipped
), edges AS (
  SELECT *, greatest(0, CASE WHEN u THEN cx1 ELSE least(greatest(x1, coalesce(l, x1)), x) END) AS e1, greatest(0, CASE WHEN u THEN cy1 ELSE least(y1, y) END) AS f1,
    least({PAGE_W}, CASE WHEN u THEN cx2 ELSE greatest(least(x2, coalesce(r, x2)), x + w) END) AS e2, least({PAGE_H}, CASE WHEN u THEN cy2 ELSE greatest(y2, y + h) END) AS f2 FROM used)
SELECT page_id, k, trunc(e1)::INT AS px, trunc(f1)::INT AS py, greatest(1, trunc(e2 - e1)::INT) AS pw, greatest(1, trunc(f2 - f1)::INT) AS ph, u AS cell_clip,
  greatest(1, trunc(e2 - e1)::INT) * greatest(1, trunc(f2 - f1)::INT) >= 25 * w * h OR greatest(1, trunc(e2 - e1)::INT) * greatest(1, trunc(f2 - f1)::INT) >= 0.1 * {PAGE_W * PAGE_H} AS oversize FROM edges
"""


@query(_PADDED_SQL)
def padded_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word's box, grown by blur tier and held in by a cell, by neighbours or by the page; and whether it got too large."""
    words = box_words(spark, sf_dir)
    cells = boxes(spark, sf_dir).select("page_id", F.col("j").alias("_j"), *[F.col(k).alias(f"c_{k}") for k in "xywh"])
    rows = words.withColumn("_j", F.col("k") % 7).join(cells, ["page_id", "_j"], "left")
    k = F.col("k")
    tier = F.get(F.array(*map(F.lit, ("good", "mild", "severe"))), (k % 3).cast("int"))
    left, right = F.when(k % 2 == 0, F.col("x") - 5.5), F.when(k % 3 == 0, F.col("x") + F.col("w") + 2.5)
    out = G.padded(G.box(), tier, F.lit(PAGE_W), F.lit(PAGE_H), k % 5 == 0, G.box("c_"), left, right)
    rows = rows.select("page_id", "k", "w", "h", *[v.alias(n) for n, v in out.items()])
    area = F.col("pw") * F.col("ph")
    return rows.select("page_id", "k", "px", "py", "pw", "ph", "cell_clip", ((area >= 25 * F.col("w") * F.col("h")) | (area >= 0.1 * PAGE_W * PAGE_H)).alias("oversize"))


@query(
    f"""
WITH RECURSIVE {BOXES}, todo AS (SELECT page_id, j, x, y, w, h, row_number() OVER (PARTITION BY page_id ORDER BY j) AS n FROM boxes WHERE block_type IN ('footer', 'picture')
), grow AS (
  SELECT DISTINCT page_id, 0::BIGINT AS n, 0 AS x1, {PAGE_H} - round_even({PAGE_H} * 0.12, 0)::INT AS y1, {PAGE_W} AS x2, {PAGE_H} AS y2 FROM boxes
  UNION ALL
  SELECT g.page_id, t.n, CASE WHEN hit THEN least(x1, t.x) ELSE x1 END, CASE WHEN hit THEN least(y1, t.y) ELSE y1 END, CASE WHEN hit THEN greatest(x2, t.x + t.w) ELSE x2 END, CASE WHEN hit THEN greatest(y2, t.y + t.h) ELSE y2 END
  FROM grow g JOIN todo t ON t.page_id = g.page_id AND t.n = g.n + 1, LATERAL (SELECT least(x2, t.x + t.w) > greatest(x1, t.x) AND least(y2, t.y + t.h) > greatest(y1, t.y) AS hit))
SELECT page_id, greatest(x1, 0)::INT AS x, greatest(y1, 0)::INT AS y, (least(x2, {PAGE_W}) - greatest(x1, 0))::INT AS w, (least(y2, {PAGE_H}) - greatest(y1, 0))::INT AS h FROM grow
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC) = 1
"""
)
def footer_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bottom 12 % of each page, grown by the footer and picture blocks that it meets, in block order."""
    blocks = boxes(spark, sf_dir)
    mine = F.when(F.col("block_type").isin("footer", "picture"), F.struct("j", "x", "y", "w", "h"))
    pages = blocks.groupBy("page_id").agg(F.array_sort(F.collect_list(mine)).alias("bs"))
    top = PAGE_H - round(PAGE_H * 0.12)

    def grow(z, b):
        hit = (F.least(z["x2"], b["x"] + b["w"]) > F.greatest(z["x1"], b["x"])) & (F.least(z["y2"], b["y"] + b["h"]) > F.greatest(z["y1"], b["y"]))
        return F.struct(
            F.when(hit, F.least(z["x1"], b["x"])).otherwise(z["x1"]).alias("x1"), F.when(hit, F.least(z["y1"], b["y"])).otherwise(z["y1"]).alias("y1"),
            F.when(hit, F.greatest(z["x2"], b["x"] + b["w"])).otherwise(z["x2"]).alias("x2"), F.when(hit, F.greatest(z["y2"], b["y"] + b["h"])).otherwise(z["y2"]).alias("y2"),
        )

    seed = F.struct(F.lit(0).alias("x1"), F.lit(top).alias("y1"), F.lit(PAGE_W).alias("x2"), F.lit(PAGE_H).alias("y2"))
    z = pages.select("page_id", F.aggregate("bs", seed, grow).alias("z"))
    x, y = F.greatest(F.col("z.x1"), F.lit(0)), F.greatest(F.col("z.y1"), F.lit(0))
    return z.select("page_id", x.alias("x"), y.alias("y"), (F.least(F.col("z.x2"), F.lit(PAGE_W)) - x).alias("w"), (F.least(F.col("z.y2"), F.lit(PAGE_H)) - y).alias("h"))


@query(
    f"""
WITH {BOXES}, cells AS (SELECT * FROM boxes WHERE block_type = 'cell'), pics AS (SELECT * FROM boxes WHERE block_type = 'picture' AND w * h >= 0.0015 * {PAGE_W * PAGE_H})
SELECT p.page_id, p.j, p.x, p.y, p.w, p.h FROM pics p WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.page_id = p.page_id AND p.x + p.w / 2.0 BETWEEN c.x AND c.x + c.w AND p.y + p.h / 2.0 BETWEEN c.y AND c.y + c.h
  AND p.w * p.h <= 0.5 * c.w * c.h) AND greatest(0, least(p.y + p.h, {PAGE_H}) - greatest(p.y, {PAGE_H - 132})) * greatest(0, least(p.x + p.w, {PAGE_W}) - p.x) < 0.6 * p.w * p.h
"""
)
def picture_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of 0.15 % of the page or more that are no icon in a cell and not covered by the footer."""
    blocks = boxes(spark, sf_dir)
    pics = blocks.filter((F.col("block_type") == "picture") & (F.col("w") * F.col("h") >= 0.0015 * PAGE_W * PAGE_H))
    cells = blocks.filter("block_type = 'cell'").select("page_id", *[F.col(k).alias(f"c_{k}") for k in "xywh"])
    icon = G.holds_center(G.box("c_"), G.box()) & (F.col("w") * F.col("h") <= 0.5 * F.col("c_w") * F.col("c_h"))
    footer = G.Box(F.lit(0), F.lit(PAGE_H - 132), F.lit(PAGE_W), F.lit(132))
    kept = pics.alias("p").join(cells.alias("c"), (F.col("p.page_id") == F.col("c.page_id")) & icon, "left_anti")
    return kept.filter(G.coverage(G.box(), footer) < 0.6).select("page_id", "j", "x", "y", "w", "h")


def _strip(rank: int, x: str, y: str, w: str, h: str) -> str:
    return f"{{'area': (({w}) * ({h}))::BIGINT, 'rank': -{rank}, 'x': ({x})::INT, 'y': ({y})::INT, 'w': ({w})::INT, 'h': ({h})::INT}}"


@query(
    f"""
WITH {BOXES}, met AS (SELECT b.page_id, b.j, w.k, b.x, b.y, b.w, b.h, w.x AS hx, w.y AS hy, w.w AS hw, w.h AS hh FROM boxes b JOIN words w USING (page_id) WHERE b.block_type = 'picture' AND {_shared("b", "w")} > 0
), strips AS (SELECT page_id, j, k, list_sort(list_filter([{_strip(0, "x", "y", "w", "hy - y")}, {_strip(1, "x", "hy + hh", "w", "y + h - hy - hh")}, {_strip(2, "x", "y", "hx - x", "h")}, {_strip(3, "hx + hw", "y", "x + w - hx - hw", "h")}],
  lambda s: s.w > 0 AND s.h > 0), 'DESC') AS ss FROM met)
SELECT page_id, j, k, ss[1].x AS sx, ss[1].y AS sy, ss[1].w AS sw, ss[1].h AS sh FROM strips
"""
)
def shrunk_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each picture beside a word that it meets: the largest strip, null if there is none."""
    pics = boxes(spark, sf_dir).filter("block_type = 'picture'")
    met = pairs(pics, box_words(spark, sf_dir), ("b", "w")).filter(G.overlap(G.box("b_"), G.box("w_")) > 0)
    best = G.slabs(G.box("b_"), G.box("w_"))
    return met.select("page_id", F.col("b_j").alias("j"), F.col("w_k").alias("k"), best.alias("s")).select("page_id", "j", "k", *[F.col(f"s.{c}").alias(f"s{c}") for c in "xywh"])


@query(
    f"""
WITH {BOXES}, all_regions AS (
  SELECT page_id, k AS seq, false AS brand, x, y, w, h, conf FROM words WHERE k % 4 = 0 UNION ALL SELECT page_id, 100 + j, true, x, y, w, h, 0.0 FROM boxes WHERE block_type IN ('footer', 'picture')
), numbered AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY brand, seq) AS draw_order, list_sort(list(CASE WHEN NOT brand AND h >= 4 THEN h END) OVER (PARTITION BY page_id)) AS hs FROM all_regions
), capped AS (SELECT *, list_filter(hs, lambda v: v IS NOT NULL) AS hv FROM numbered)
SELECT page_id, seq, brand, draw_order, 'r-' || lpad(draw_order::VARCHAR, 4, '0') AS region_id, greatest(trunc(trunc(0.7 * hv[len(hv) // 2 + 1]) * 1.3)::INT, 4) AS font_cap, CASE WHEN brand THEN 0.0 ELSE conf END AS confidence FROM capped
"""
)
def draw_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of each page in drawing order, brand zones last, numbered, with the page's largest font size."""
    words = box_words(spark, sf_dir).filter("k % 4 = 0").select("page_id", F.col("k").alias("seq"), F.lit(False).alias("brand"), "h", F.col("conf").alias("confidence"))
    zones = boxes(spark, sf_dir).filter("block_type in ('footer', 'picture')").select("page_id", (F.col("j") + 100).alias("seq"), F.lit(True).alias("brand"), "h", F.lit(0.0).alias("confidence"))
    page = Window.partitionBy("page_id")
    rows = words.unionByName(zones).withColumn("draw_order", F.row_number().over(page.orderBy("brand", "seq")))
    hs = F.array_sort(F.collect_list(F.when(~F.col("brand") & (F.col("h") >= 4), F.col("h"))).over(page))
    mid = F.get(hs, F.floor(F.size(hs) / 2).cast("int"))
    cap = F.greatest(((0.7 * mid).cast("int") * 1.3).cast("int"), F.lit(4))
    return rows.select("page_id", "seq", "brand", "draw_order", F.format_string("r-%04d", "draw_order").alias("region_id"), cap.alias("font_cap"), "confidence")


@query(
    f"""
WITH {BOXES} SELECT page_id, j, CASE WHEN v >= 100 THEN 'good' WHEN v >= 50 THEN 'mild' ELSE 'severe' END AS tier, CASE WHEN v >= 100 THEN 4 WHEN v >= 50 THEN 8 ELSE 12 END AS padding,
  round(least(14.0, greatest(3.0, greatest(w, h) * sin(radians(least(abs(j - 2.5), 5.0))))), 6) AS skew_margin, round_even(x * 72 / 200.0, 2)::DOUBLE AS x_points
FROM (SELECT *, (page_id * 13 + j * 29) % 160 AS v FROM boxes)
"""
)
def blur_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blur tier and padding by variance, the cell margin for a skew, and a coordinate in points."""
    v = (F.col("page_id") * 13 + F.col("j") * 29) % 160
    tier = F.when(v >= 100, "good").when(v >= 50, "mild").otherwise("severe")
    margin = F.least(F.lit(14.0), F.greatest(F.lit(3.0), F.greatest("w", "h") * F.sin(F.radians(F.least(F.abs(F.col("j") - 2.5), F.lit(5.0))))))
    return boxes(spark, sf_dir).select("page_id", "j", tier.alias("tier"), G.padding_px(tier).alias("padding"), F.round(margin, 6).alias("skew_margin"), F.bround(F.col("x") * 72 / 200.0, 2).alias("x_points"))


@query(
    f"""
WITH {BOXES} SELECT page_id, k // 4 AS span, min(x) AS x, min(y) AS y, (max(x + w) - min(x)) AS w, (max(y + h) - min(y)) AS h, count(*) AS n_words, round(avg(conf), 4) AS mean_conf,
  round(0.35::DOUBLE * 0.9::DOUBLE + 0.25 * avg(conf) + 0.25 * 1.0 + 0.15 * CASE (k // 4) % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END, 6)::DOUBLE AS score FROM words GROUP BY page_id, k // 4
"""
)
def span_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around each span's words and its score from detector, recognition, agreement and structure."""
    words = box_words(spark, sf_dir).withColumn("span", F.floor(F.col("k") / 4))
    structure = F.element_at(F.array(F.lit(1.0), F.lit(0.5), F.lit(0.0)), (F.col("span") % 3 + 1).cast("int"))
    out = words.groupBy("page_id", "span").agg(*L.union_box(), F.count(F.lit(1)).alias("n_words"), F.avg("conf").alias("c"))
    return out.select("page_id", "span", "x", "y", "w", "h", "n_words", F.round("c", 4).alias("mean_conf"), F.round(0.35 * 0.9 + 0.25 * F.col("c") + 0.25 * 1.0 + 0.15 * structure, 6).alias("score"))


@query(
    f"""
WITH RECURSIVE {BOXES}, spans AS (SELECT page_id, k, x - 8 AS x, y - 8 AS y, w + 60 AS w, h + 16 AS h, row_number() OVER (PARTITION BY page_id ORDER BY conf DESC, k) AS n FROM words
), fold AS (
  SELECT page_id, 1::BIGINT AS n, [{{'k': k, 'x': x, 'y': y, 'w': w, 'h': h}}] AS kept FROM spans WHERE n = 1
  UNION ALL
  SELECT f.page_id, s.n, CASE WHEN len(list_filter(f.kept, lambda o: {_shared("o", "s")} >= 0.5 * least(s.w * s.h, o.w * o.h))) > 0 THEN f.kept ELSE list_append(f.kept, {{'k': s.k, 'x': s.x, 'y': s.y, 'w': s.w, 'h': s.h}}) END
  FROM fold f JOIN spans s ON s.page_id = f.page_id AND s.n = f.n + 1)
SELECT page_id, unnest(list_transform(kept, lambda o: o.k)) AS k FROM (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC) = 1)
"""
)
def suppressed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The padded boxes that stay when each is dropped that covers, or is covered by, half of one taken before."""
    b = G.box()
    words = box_words(spark, sf_dir).select("page_id", F.struct((-F.col("conf")).alias("o"), "k", (b.x - 8).alias("x"), (b.y - 8).alias("y"), (b.w + 60).alias("w"), (b.h + 16).alias("h")).alias("s"))
    pages = words.groupBy("page_id").agg(F.array_sort(F.collect_list("s")).alias("ss"))
    as_box = lambda s: G.Box(s["x"], s["y"], s["w"], s["h"])

    def keep(acc, s):
        clash = F.exists(acc, lambda o: G.overlap(as_box(o), as_box(s)) >= 0.5 * F.least(as_box(s).area, as_box(o).area))
        return F.when(clash, acc).otherwise(F.array_append(acc, s))

    kept = F.aggregate("ss", F.slice("ss", 1, 0), keep)
    return pages.select("page_id", F.explode(F.transform(kept, lambda s: s["k"])).alias("k"))
