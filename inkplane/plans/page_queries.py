"""Queries of operators on the words, zones and spans of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkplane.functions import geometry as G
from inkplane.operators import layout as L
from inkplane.operators import pages as P
from inkplane.plans.geometry_queries import PAGE_H, PAGE_W, _shared, pairs
from inkplane.plans.layout_queries import _ROWS
from inkplane.plans.registry import query, table
from inkplane.sources.fixtures import BOXES, DOC_WORDS, NAMES, box_words, boxes, doc_words, names

_READ = """read AS (SELECT doc_id, word_idx, CASE WHEN word_idx % 11 = 0 THEN ' ' ELSE text END AS text, CASE WHEN word_idx % 7 = 0 THEN 'n/a' ELSE x::VARCHAR END AS x, y::VARCHAR AS y,
  (CASE WHEN word_idx % 5 = 0 THEN 0 ELSE w END)::VARCHAR AS w, CASE WHEN word_idx % 13 = 0 THEN NULL ELSE h::VARCHAR END AS h FROM doc_words)"""


@query(f"WITH {DOC_WORDS}, {_READ} SELECT doc_id, word_idx FROM read WHERE trim(text) <> '' AND try_cast(x AS DOUBLE) IS NOT NULL AND try_cast(y AS DOUBLE) IS NOT NULL AND try_cast(w AS DOUBLE) > 0 AND try_cast(h AS DOUBLE) > 0")
def valid_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that remain of readings with blanks, texts for numbers, empty boxes and missing heights."""
    k, text = F.col("word_idx"), lambda c: F.col(c).cast("string")
    read = doc_words(spark, sf_dir).select(
        "doc_id", "word_idx", F.when(k % 11 == 0, " ").otherwise(F.col("text")).alias("text"), F.when(k % 7 == 0, "n/a").otherwise(text("x")).alias("x"), text("y").alias("y"),
        F.when(k % 5 == 0, "0").otherwise(text("w")).alias("w"), F.when(k % 13 != 0, text("h")).alias("h"),
    )
    return P.valid_words(read).select("doc_id", "word_idx")


@query(f"WITH {BOXES} SELECT w.page_id, b.j, w.k FROM words w JOIN boxes b USING (page_id) WHERE least(w.x + w.w, b.x + b.w) - greatest(w.x, b.x) >= 0.7::DOUBLE * w.w")
def zone_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that stand in the columns that blocks make, by width."""
    return P.in_zones(box_words(spark, sf_dir), boxes(spark, sf_dir), "k", "j")


@query(
    f"""
WITH {BOXES}, met AS (SELECT w.page_id, b.j, w.k, w.x + w.w / 2.0 BETWEEN b.x AND b.x + b.w AND w.y + w.h / 2.0 BETWEEN b.y AND b.y + b.h AS inside FROM words w JOIN boxes b USING (page_id) WHERE b.block_type = 'cell')
SELECT page_id, j, k FROM (SELECT *, bool_or(inside) OVER (PARTITION BY page_id, j) AS held FROM met) WHERE inside OR NOT held
"""
)
def cell_word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each cell, all of the page's where it holds none."""
    return P.cell_words(box_words(spark, sf_dir), boxes(spark, sf_dir).filter("block_type = 'cell'"), "k", "j")


@query(f"WITH {BOXES} SELECT page_id, j FROM boxes WHERE y + h > 0.7 * {PAGE_H} AND w >= 24 AND h >= 12 AND w * h / ({PAGE_W} * {PAGE_H})::DOUBLE >= 0.0008 AND w * h / ({PAGE_W} * {PAGE_H})::DOUBLE < 0.4")
def graphic_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that may be a stamp or a signature."""
    return boxes(spark, sf_dir).filter(P.plausible_graphic(G.box(), F.lit(float(PAGE_W)), F.lit(float(PAGE_H)))).select("page_id", "j")


@query(f"WITH {BOXES} SELECT DISTINCT w.page_id, w.k FROM words w JOIN boxes b USING (page_id) WHERE b.block_type = 'table' AND {_shared('w', 'b')} >= 0.5 * w.w * w.h")
def table_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that lie in a table by half of their area."""
    return P.in_tables(box_words(spark, sf_dir), boxes(spark, sf_dir).filter("block_type = 'table'"), "k").select("page_id", "k")


@query(
    f"""
WITH {BOXES} SELECT w.page_id, b.j, w.k FROM words w JOIN boxes b USING (page_id) WHERE b.block_type = 'picture'
  AND w.x + w.w / 2.0 BETWEEN b.x + greatest(8, floor(b.w * 0.15)) AND b.x + b.w - greatest(8, floor(b.w * 0.15)) AND w.y + w.h / 2.0 BETWEEN b.y + greatest(8, floor(b.h * 0.15)) AND b.y + b.h - greatest(8, floor(b.h * 0.15))
"""
)
def deep_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words deep inside a picture, which therefore stays whole."""
    met = pairs(box_words(spark, sf_dir), boxes(spark, sf_dir).filter("block_type = 'picture'"), ("w", "b"))
    return met.filter(P.deep_inside(G.box("b_"), G.box("w_"))).select("page_id", F.col("b_j").alias("j"), F.col("w_k").alias("k"))


@query(
    f"""
WITH {NAMES}, sized AS (SELECT ord, (60 + ord * 7 % 240)::INT AS w, (8 + ord * 3 % 24)::INT AS h, list_sum(list_transform(string_split(source_text, ''), lambda c: CASE WHEN regexp_matches(c, '^[0-9]$') THEN 85
  WHEN contains(' .,:;"|!()[]{{}}ijl' || chr(9) || chr(39), c) THEN 45 WHEN contains('MWmw@', c) THEN 150 ELSE 100 END)) / 100.0::DOUBLE AS tw FROM names
), fit AS (SELECT ord, least(floor(0.7::DOUBLE * h), 12, floor((w - 2) / (tw * 0.5)))::INT AS size FROM sized)
SELECT ord, CASE WHEN size >= 4 THEN size END AS size FROM fit
"""
)
def fitted_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The font size at which each name fits its box, of 12 at most."""
    ord_ = F.col("ord")
    return names(spark, sf_dir).select("ord", P.fitted_size(F.col("source_text"), (60 + ord_ * 7 % 240).cast("int"), (8 + ord_ * 3 % 24).cast("int"), F.lit(12)).alias("size"))


_FONTS = ("Times New Roman", "Helvetica", "Courier")


@query(
    f"""
WITH {BOXES}, met AS (SELECT w.page_id, w.k, b.j, {_shared("w", "b")} AS shared FROM words w JOIN boxes b USING (page_id) WHERE w.k % 4 = 0
), best AS (SELECT *, row_number() OVER (PARTITION BY page_id, k ORDER BY shared DESC, j) AS r FROM met WHERE shared > 0)
SELECT w.page_id, w.k, ['Times New Roman', 'Helvetica', 'Courier'][j % 3 + 1] AS family, (8 + j)::INT AS size FROM words w LEFT JOIN best b ON b.page_id = w.page_id AND b.k = w.k AND r = 1 WHERE w.k % 4 = 0
"""
)
def region_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family and size of the span under each region."""
    spans = boxes(spark, sf_dir).withColumn("family", F.get(F.array(*map(F.lit, _FONTS)), F.col("j") % 3)).withColumn("size", (8 + F.col("j")).cast("int"))
    return P.region_fonts(box_words(spark, sf_dir).filter("k % 4 = 0"), spans, "k", "j").select("page_id", "k", "family", "size")


@query(
    f"""
WITH {DOC_WORDS} SELECT doc_id AS page_id, CASE WHEN sum(CASE WHEN word_idx % 3 = 0 THEN length(trim(text)) ELSE 0 END) > sum(CASE WHEN word_idx % 3 <> 0 THEN length(trim(text)) ELSE 0 END) THEN 'serif' ELSE 'sans' END AS family FROM doc_words GROUP BY doc_id
"""
)
def page_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of font that most characters of a page stand in."""
    spans = doc_words(spark, sf_dir).select(F.col("doc_id").alias("page_id"), F.get(F.array(*map(F.lit, _FONTS)), F.col("word_idx") % 3).alias("font"), "text")
    return P.page_fonts(spans)


@query(
    f"""
WITH {BOXES}, a AS (SELECT page_id, k, x, lead(x) OVER (PARTITION BY page_id ORDER BY x, k) AS nx FROM words WHERE k % 3 = 0)
SELECT a.page_id, a.k, arg_min(b.k, b.x * 1000 + b.k) AS number FROM a JOIN words b ON b.page_id = a.page_id AND b.k % 3 = 1 AND b.x >= a.x AND b.x < coalesce(a.nx, 1 << 30) GROUP BY a.page_id, a.k
"""
)
def number_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number column that belongs to each name column."""
    kind = F.when(F.col("k") % 3 == 0, "name").when(F.col("k") % 3 == 1, "number")
    return P.number_columns(box_words(spark, sf_dir).withColumn("kind", kind), "k")


@query(
    f"""
WITH {DOC_WORDS}, {_ROWS}, hits AS (SELECT doc_id, row_no, count(*) AS n_words, count(*) FILTER (WHERE lower(text) = 'the') AS name_hits, count(*) FILTER (WHERE lower(text) IN ('the', 'and', 'of')) AS n_hits FROM visual GROUP BY ALL)
SELECT doc_id, row_no, n_hits FROM hits WHERE n_words <= 40 AND name_hits >= 1 AND n_hits >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n_hits DESC, row_no) = 1
"""
)
def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of each document with most labels, three frequent words standing for labels."""
    low = F.lower("text")
    rows = L.visual_rows(doc_words(spark, sf_dir)).groupBy("doc_id", "row_no").agg(F.count(F.lit(1)).alias("n_words"), F.count_if(low == "the").alias("name_hits"), F.count_if(low.isin("the", "and", "of")).alias("n_hits"))
    return P.header_rows(rows, "doc_id", "row_no")


@query(
    f"""
WITH RECURSIVE {BOXES}, spans AS (SELECT page_id, k, x AS start, x + w AS stop, row_number() OVER (PARTITION BY page_id ORDER BY x, conf DESC, k) AS n FROM words
), fold AS (
  SELECT page_id, 1::BIGINT AS n, [{{'k': k, 'start': start, 'stop': stop}}] AS kept FROM spans WHERE n = 1
  UNION ALL
  SELECT f.page_id, s.n, CASE WHEN len(list_filter(f.kept, lambda o: o.start < s.stop AND o.stop > s.start)) > 0 THEN f.kept ELSE list_append(f.kept, {{'k': s.k, 'start': s.start, 'stop': s.stop}}) END
  FROM fold f JOIN spans s ON s.page_id = f.page_id AND s.n = f.n + 1)
SELECT page_id, c.k AS k, c.start AS start, c.stop AS stop FROM (SELECT page_id, unnest(kept) AS c FROM (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC) = 1))
"""
)
def first_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that stay when, by start and falling confidence, each is dropped that shares place with one taken before."""
    rows = box_words(spark, sf_dir).withColumns({"start": F.col("x"), "stop": F.col("x") + F.col("w")})
    return P.claims(rows, [F.col("x"), -F.col("conf"), F.col("k")], "start", "stop", "k")


@query(
    """
SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN 'ocr' WHEN page_id % 2 = 0 AND page_id % 3 <> 0 THEN 'native' ELSE 'blank' END AS source, CASE WHEN page_id % 5 <> 0 OR (page_id % 2 = 0 AND page_id % 3 <> 0) THEN 'ok' ELSE 'no_regions' END AS strict FROM pages
"""
)
def text_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each page's words come from, and whether a strict run would refuse it for want of any."""
    p = F.col("page_id")
    source = P.text_source(F.when(p % 2 == 0, "digital").otherwise("scanned"), F.when(p % 5 != 0, F.lit(3)), F.when(p % 3 != 0, F.lit(2)).otherwise(0))
    return table(spark, sf_dir, "pages").select("page_id", source.alias("source"), F.when(source == "blank", "no_regions").otherwise("ok").alias("strict"))


@query(
    """
SELECT event_id, ['rapidocr,tesseract', 'easyocr', 'tesseract,rapidocr', 'rapidocr'][event_id % 4 + 1] AS engines FROM events
"""
)
def engine_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engine names of lists as people write them."""
    said = F.get(F.array(*map(F.lit, ("RapidOCR, tesseract", " easyocr ,, EasyOCR", "tesseract,rapidocr,tesseract", " , "))), (F.col("event_id") % 4).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(P.engine_list(said, "rapidocr"), ",").alias("engines"))


@query(
    """
SELECT event_id, '{"error":{"code":"' || event_type || '","message":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '"page ' || event_id || '"' END || ',"request_id":"r-' || user_id || '"}}' AS body,
  '{"level":"INFO","logger":"plan","message":"' || event_type || '","pages":' || event_id % 7 || '}' AS json_line, 'INFO plan: ' || event_type || ' pages=' || event_id % 7 AS plain_line FROM events
"""
)
def message_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and log records as they are written."""
    e, extras = table(spark, sf_dir, "events"), {"pages": F.col("event_id") % 7}
    message = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("page "), F.col("event_id").cast("string")))
    line = lambda as_json: P.log_line(F.lit("INFO"), F.lit("plan"), F.col("event_type"), extras, as_json)
    return e.select("event_id", P.error_body(F.col("event_type"), message, F.concat(F.lit("r-"), F.col("user_id").cast("string"))).alias("body"), line(True).alias("json_line"), line(False).alias("plain_line"))


_TABLES = f"""found AS (SELECT page_id, (2 * j + e)::INT AS j, (x + e * (page_id % 9))::INT AS x, y, w, h, CASE WHEN (page_id + j) % 7 <> 0 THEN (page_id * 3 + j * 5 + e * 11) % (h + 1) END AS tallest FROM boxes, range(2) t(e)
), spaced AS (SELECT page_id, (2 * j + e)::INT AS j, (x + (page_id + (1 + 2 * e) * j) % 60)::INT AS x, y, w, h FROM boxes, range(2) t(e)
), met AS (SELECT a.page_id, a.j AS a, list(b.j ORDER BY b.j) AS bs FROM found a JOIN spaced b USING (page_id) WHERE {_shared('a', 'b')}::DOUBLE / (a.w * a.h + b.w * b.h - {_shared('a', 'b')}) >= 0.3 GROUP BY ALL
), steps AS (
  SELECT DISTINCT page_id, -1 AS a, []::INT[] AS used, NULL::INT AS b FROM found
  UNION ALL
  SELECT page_id, a, CASE WHEN b IS NULL THEN used ELSE list_append(used, b) END, b
  FROM (SELECT s.page_id, s.a + 1 AS a, s.used, list_filter(m.bs, lambda v: NOT list_contains(s.used, v))[1] AS b FROM steps s LEFT JOIN met m ON m.page_id = s.page_id AND m.a = s.a + 1 WHERE s.a < 11)
), kept AS (SELECT f.page_id, f.j, s.b, s.b IS NOT NULL AND (coalesce(f.tallest, 0) = 0 OR f.tallest::DOUBLE / f.h >= 0.5) AS swap FROM found f JOIN steps s ON s.page_id = f.page_id AND s.a = f.j)"""


@query(
    f"""
WITH RECURSIVE {BOXES}, {_TABLES}
SELECT page_id, CASE WHEN swap THEN 'implied' ELSE 'bordered' END AS origin, CASE WHEN swap THEN b ELSE j END AS j FROM kept
UNION ALL SELECT page_id, 'implied', j FROM spaced i WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.page_id = i.page_id AND k.b = i.j)
"""
)
def preferred_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables found by borders and, shifted, by line spacing, two near each other for each block, and which of them stay."""
    pid, j, e = F.col("page_id"), F.col("j"), F.col("e")
    two = boxes(spark, sf_dir).withColumn("e", F.explode(F.array(F.lit(0), F.lit(1))))
    row = F.when((pid + j) % 7 != 0, (pid * 3 + j * 5 + e * 11) % (F.col("h") + 1))
    key, at = (2 * j + e).cast("int").alias("j"), lambda x: (F.col("x") + x).cast("int").alias("x")
    found = two.select("page_id", key, at(e * (pid % 9)), "y", "w", "h", row.alias("tallest"))
    return P.preferred_tables(found, two.select("page_id", key, at((pid + (1 + 2 * e) * j) % 60), "y", "w", "h"), "j")
