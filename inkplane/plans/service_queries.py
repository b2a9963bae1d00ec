"""Queries of guards, logs, settings and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkplane.plans.registry import query, table
from inkplane.sources import files
from inkplane.sources.fixtures import BOXES, DOC_WORDS, NAMES, box_words, boxes, doc_words, names

_IDS = ("r-1", " ", "../x", "a/b", "a\\b", "ok_2", "")


@query(
    """
SELECT page_id, CASE WHEN trim(rid) = '' OR regexp_matches(rid, '[/\\\\]|\\.\\.') THEN 'bad_request_id' WHEN size > 26214400 THEN 'too_large' WHEN dpi < 100 OR dpi > 300 THEN 'bad_dpi' WHEN pages > 50 THEN 'too_many_pages'
  WHEN NOT regexp_matches(url, '^https?://') THEN 'bad_type' ELSE 'ok' END AS verdict
FROM (SELECT page_id, url, ['r-1', ' ', '../x', 'a/b', 'a\\b', 'ok_2', ''][page_id % 7 + 1] AS rid, page_id * 7919 % 40000000 AS size, 90 + page_id * 13 % 230 AS dpi, page_id * 11 % 60 AS pages FROM pages)
"""
)
def request_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which guard, in their order, refuses each request."""
    p = F.col("page_id")
    r = table(spark, sf_dir, "pages").select("page_id", "url", F.get(F.array(*map(F.lit, _IDS)), (p % 7).cast("int")).alias("rid"), (p * 7919 % 40000000).alias("size"), (90 + p * 13 % 230).alias("dpi"), (p * 11 % 60).alias("pages"))
    verdict = (
        F.when(~files.valid_request_id(F.col("rid")), "bad_request_id").when(F.col("size") > 26214400, "too_large").when(~F.col("dpi").between(100, 300), "bad_dpi").when(F.col("pages") > 50, "too_many_pages")
        .when(~F.col("url").rlike("^https?://"), "bad_type").otherwise("ok")
    )
    return r.select("page_id", verdict.alias("verdict"))


@query(
    """
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'k' ELSE 'duration,k' END AS kept_keys FROM events
"""
)
def event_log_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of each event's details that may be logged: none that name text, values or personal data."""
    third = F.get(F.array(*map(F.lit, ("raw_text", "pii_kind", "new_value", "source_text"))), (F.col("event_id") % 4).cast("int"))
    other = F.when(F.col("event_id") % 4 == 3, "TextLength").otherwise("duration")
    details = F.map_from_arrays(F.array(F.lit("k"), third, other), F.array(F.lit("1"), F.lit("2"), F.lit("3")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(files.safe_details(details))), ",").alias("kept_keys"))


@query(
    """
WITH e AS (SELECT user_id, list_distinct(list(['rapidocr', 'tesseract', 'easyocr', 'paddle'][event_id % 4 + 1] ORDER BY event_id)) AS want FROM events GROUP BY user_id)
SELECT user_id, array_to_string(list_sort(list_filter(want, lambda x: x IN ('rapidocr', 'tesseract'))), ',') AS available, array_to_string(list_sort(list_filter(want, lambda x: x = 'easyocr')), ',') AS missing,
  array_to_string(list_sort(list_filter(want, lambda x: x = 'paddle')), ',') AS unknown FROM e
"""
)
def engine_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the engines that each request asks for, those at hand, those missing, and those unknown."""
    engine = F.get(F.array(*map(F.lit, ("rapidocr", "tesseract", "easyocr", "paddle"))), (F.col("event_id") % 4).cast("int"))
    want = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(engine).alias("want"))
    here, known = F.array(F.lit("rapidocr"), F.lit("tesseract")), F.array(F.lit("rapidocr"), F.lit("tesseract"), F.lit("easyocr"))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    w = F.col("want")
    return want.select("user_id", text(F.array_intersect(w, here)).alias("available"), text(F.array_except(F.array_intersect(w, known), here)).alias("missing"), text(F.array_except(w, known)).alias("unknown"))


@query(
    f"""
WITH {BOXES}, b AS (SELECT page_id, count(*) AS n_blocks, count(*) FILTER (WHERE block_type IN ('picture', 'footer')) AS n_zones FROM boxes GROUP BY page_id), w AS (SELECT page_id, count(*) AS n_words, count(*) FILTER (WHERE k % 4 = 0) AS n_regions, round(avg(conf), 4) AS mean_conf FROM words GROUP BY page_id)
SELECT page_id, n_words, n_blocks, n_zones, n_regions, mean_conf FROM b JOIN w USING (page_id)
"""
)
def page_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, blocks, zones and regions of each page."""
    b = boxes(spark, sf_dir).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.count_if(F.col("block_type").isin("picture", "footer")).alias("n_zones"))
    w = box_words(spark, sf_dir).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_words"), F.count_if(F.col("k") % 4 == 0).alias("n_regions"), F.round(F.avg("conf"), 4).alias("mean_conf"))
    return b.join(w, "page_id").select("page_id", "n_words", "n_blocks", "n_zones", "n_regions", "mean_conf")


@query(f"WITH {BOXES} SELECT block_type, count(*) AS n, count(DISTINCT page_id) AS pages, sum(w * h)::BIGINT AS area FROM boxes GROUP BY block_type")
def block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each kind, their pages and their area."""
    return boxes(spark, sf_dir).groupBy("block_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("pages"), F.sum(F.col("w") * F.col("h")).cast("long").alias("area"))


@query(
    f"""
WITH {NAMES}, custom AS (SELECT ord, CASE ord % 3 WHEN 0 THEN 'Custom' WHEN 1 THEN ' ' ELSE 'Label ' || ord END AS label FROM names WHERE ord % 4 = 0)
SELECT n.ord, CASE WHEN c.label IS NOT NULL AND trim(c.label) <> '' AND lower(trim(c.label)) <> 'custom' THEN c.label ELSE n.mock_value END AS mock_value,
  CASE WHEN c.label IS NOT NULL AND trim(c.label) <> '' AND lower(trim(c.label)) <> 'custom' THEN 'user' ELSE n.assignment_source END AS assignment_source FROM names n LEFT JOIN custom c USING (ord)
"""
)
def custom_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary after custom terms with labels of their own have replaced entries."""
    every = names(spark, sf_dir)
    label = F.when(F.col("ord") % 3 == 0, "Custom").when(F.col("ord") % 3 == 1, " ").otherwise(F.concat(F.lit("Label "), F.col("ord").cast("string")))
    custom = every.filter("ord % 4 = 0").select("ord", label.alias("label")).filter((F.trim("label") != "") & (F.lower(F.trim("label")) != "custom"))
    out = every.join(custom, "ord", "left")
    return out.select("ord", F.coalesce("label", "mock_value").alias("mock_value"), F.when(F.col("label").isNotNull(), "user").otherwise(F.col("assignment_source")).alias("assignment_source"))


@query(
    f"""
WITH {DOC_WORDS} SELECT d.doc_id, d.word_idx, w.source FROM doc_words d JOIN documents w USING (doc_id) WHERE d.conf >= 0.98 AND length(d.text) >= 12
"""
)
def confident_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long words read with high confidence, with the source of their page."""
    src = table(spark, sf_dir, "documents").select("doc_id", "source")
    return doc_words(spark, sf_dir).filter((F.col("conf") >= 0.98) & (F.length("text") >= 12)).join(src, "doc_id").select("doc_id", "word_idx", "source")
