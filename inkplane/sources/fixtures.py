"""Relations of positioned words, boxes and names, derived from the plain tables by arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkplane.plans.registry import table


def doc_words(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """Words of each document as a typewriter sets them: doc_id, line_no, k, word_idx, text, x, y, w, h, char_start, char_end, conf.

    The rows of a document meet in one task, by way of one shuffle that its later windows reuse. ``whole`` shuffles the
    texts instead of their words, which is less to write, but leaves more words to a task.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.repartition("doc_id") if whole else docs
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    toks = lines.select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("k", "text"))
    in_line = Window.partitionBy("doc_id").orderBy("line_no", "k")
    before = in_line.rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("text") + 1
    # The offset in the line is the offset in the document less that at the line's first token.
    toks = toks.withColumn("_at", F.coalesce(F.sum(size).over(before), F.lit(0)))
    toks = toks.withColumn("_line", F.max(F.when(F.col("k") == 0, F.col("_at"))).over(in_line)).filter("text <> ''")
    toks = toks.withColumn("word_idx", (F.row_number().over(in_line) - 1).cast("int")).withColumn("char_start", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("int"))
    return toks.select(
        "doc_id", F.col("line_no").cast("int").alias("line_no"), F.col("k").cast("int").alias("k"), "word_idx", "text",
        (10 * (F.col("_at") - F.col("_line"))).cast("int").alias("x"), (20 * F.col("line_no")).cast("int").alias("y"), (10 * F.length("text")).cast("int").alias("w"), F.lit(14).alias("h"),
        "char_start", (F.col("char_start") + F.length("text")).cast("int").alias("char_end"),
        (0.5 + ((F.col("doc_id") * 31 + F.col("word_idx") * 7) % 50) / 100.0).alias("conf"),
    )


#: DuckDB's view of the same relation.
DOC_WORDS = """
lines AS (
  SELECT doc_id, i - 1 AS line_no, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
), toks AS (
  SELECT doc_id, line_no, j - 1 AS k, string_split(line, ' ')[j] AS text
  FROM (SELECT *, unnest(range(1, len(string_split(line, ' ')) + 1)) AS j FROM lines)
), set_out AS (
  SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS co FROM toks
), doc_words AS (
  SELECT doc_id, line_no::INT AS line_no, k::INT AS k, (row_number() OVER o - 1)::INT AS word_idx, text, (10 * co)::INT AS x, (20 * line_no)::INT AS y,
    (10 * length(text))::INT AS w, 14 AS h,
    coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_no, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS char_start,
    0.5 + ((doc_id * 31 + (row_number() OVER o - 1) * 7) % 50) / 100.0::DOUBLE AS conf
  FROM set_out WHERE text <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY line_no, k)
)"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary: ord, source_text, mock_value, assignment_source of customers and suppliers."""
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ord"), F.concat(F.lit("PT "), F.initcap("c_mktsegment"), F.lit(" "), F.replace("c_name", F.lit("#"), F.lit(" "))).alias("source_text"),
        F.concat(F.lit("Client-"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("mock_value"), F.when(F.col("c_custkey") % 2 == 0, "user").otherwise("auto").alias("assignment_source"),
    )
    s = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + 1_000_000_000).alias("ord"), F.concat(F.lit("Bank "), F.replace("s_name", F.lit("#"), F.lit(" ")), F.lit(" Ltd")).alias("source_text"),
        F.concat(F.lit("Vendor-"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("mock_value"), F.lit("user").alias("assignment_source"),
    )
    return c.unionByName(s)


NAMES = """
names AS (
  SELECT c_custkey AS ord, 'PT ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' ' || replace(c_name, '#', ' ') AS source_text,
    'Client-' || lpad(c_custkey::VARCHAR, 6, '0') AS mock_value, CASE WHEN c_custkey % 2 = 0 THEN 'user' ELSE 'auto' END AS assignment_source FROM customer
  UNION ALL
  SELECT s_suppkey + 1000000000, 'Bank ' || replace(s_name, '#', ' ') || ' Ltd', 'Vendor-' || lpad(s_suppkey::VARCHAR, 6, '0'), 'user' FROM supplier
)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six blocks on each page of 720 x 1100: page_id, j, block_type, x, y, w, h."""
    kinds = F.array(*map(F.lit, ("paragraph", "table", "cell", "picture", "footer", "header")))
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("j"))
    pid, j = F.col("page_id"), F.col("j")
    return p.select(
        "page_id", "j", F.element_at(kinds, j + 1).alias("block_type"), ((pid * 37 + j * 113) % 600).cast("int").alias("x"), ((pid * 53 + j * 197) % 1000).cast("int").alias("y"),
        (40 + (pid * 7 + j * 29) % 160).cast("int").alias("w"), (12 + (pid * 11 + j * 17) % 80).cast("int").alias("h"),
    )


def box_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty words on each page: page_id, k, x, y, w, h, conf."""
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"))
    pid, k = F.col("page_id"), F.col("k")
    return p.select(
        "page_id", "k", ((pid * 41 + k * 131) % 660).cast("int").alias("x"), ((pid * 59 + k * 211) % 1060).cast("int").alias("y"), (20 + (pid * 5 + k * 23) % 60).cast("int").alias("w"),
        (10 + (pid * 3 + k * 7) % 12).cast("int").alias("h"), (0.5 + ((pid * 31 + k * 7) % 50) / 100.0).alias("conf"),
    )


BOXES = """
boxes AS (
  SELECT page_id, j::INT AS j, ['paragraph', 'table', 'cell', 'picture', 'footer', 'header'][j + 1] AS block_type, ((page_id * 37 + j * 113) % 600)::INT AS x,
    ((page_id * 53 + j * 197) % 1000)::INT AS y, (40 + (page_id * 7 + j * 29) % 160)::INT AS w, (12 + (page_id * 11 + j * 17) % 80)::INT AS h FROM pages, range(6) t(j)
), words AS (
  SELECT page_id, k::INT AS k, ((page_id * 41 + k * 131) % 660)::INT AS x, ((page_id * 59 + k * 211) % 1060)::INT AS y, (20 + (page_id * 5 + k * 23) % 60)::INT AS w,
    (10 + (page_id * 3 + k * 7) % 12)::INT AS h, 0.5 + ((page_id * 31 + k * 7) % 50) / 100.0::DOUBLE AS conf FROM pages, range(20) t(k)
)"""
