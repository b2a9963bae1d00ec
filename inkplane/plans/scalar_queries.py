"""Queries of string functions, predicates and validators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkplane.functions import text as T
from inkplane.functions import vocab as V
from inkplane.operators import matching as M
from inkplane.plans.registry import query, table
from inkplane.sources.fixtures import DOC_WORDS, NAMES, names

_SAMPLES = ("id 123-45-6789 x", "raw 123456789", "S1234567D", "900101-14-5678", "A123456(7)", "3201234567890123", "a.b@c.com", "call +62 812 3456 7890", "nothing here")
_SAMPLE_ROWS = ", ".join(f"({-i - 1}, '{s}')" for i, s in enumerate(_SAMPLES))
_DENY_CASE = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in V.DENY_PATTERNS) + " END"


@query(f"SELECT id, {_DENY_CASE} AS pattern FROM (SELECT doc_id AS id, text FROM documents UNION ALL SELECT * FROM (VALUES {_SAMPLE_ROWS}) t(id, text)) WHERE text IS NOT NULL")
def policy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First deny pattern in each document, and in samples that show each pattern."""
    samples = spark.createDataFrame([(-i - 1, s) for i, s in enumerate(_SAMPLES)], "id bigint, text string")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(samples).filter("text is not null")
    return rows.select("id", T.first_policy_hit(F.col("text")).alias("pattern"))


def _hits(kind: str, pattern: str, score: float) -> str:
    return f"""SELECT doc_id, '{kind}' AS entity_type, start::INT AS start, (start + length(m))::INT AS stop, {score}::DOUBLE AS score FROM (
      SELECT doc_id, unnest(ms) AS m, unnest(list_transform(range(len(ms)), lambda i: list_sum(list_transform(gaps[1:i + 1], lambda g: length(g)))
        + coalesce(list_sum(list_transform(ms[1:i], lambda g: length(g))), 0))) AS start
      FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gaps FROM documents WHERE regexp_matches(text, '{pattern}')))"""


@query(" UNION ALL ".join(_hits(*r) for r in V.RECOGNIZERS))
def recognizer_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the built-in recognizers in documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    every = F.concat(*[_typed(*r) for r in V.RECOGNIZERS])
    return docs.select("doc_id", F.explode(every).alias("hit")).select("doc_id", "hit.*")


def _typed(kind: str, pattern: str, score: float):
    none = F.array().cast("array<struct<start: int, stop: int>>")
    spans = F.when(F.col("text").rlike(pattern), T.term_spans(F.col("text"), F.lit(pattern))).otherwise(none)

    def typed(s):
        return F.struct(F.lit(kind).alias("entity_type"), s["start"].alias("start"), s["stop"].alias("stop"), F.lit(score).alias("score"))

    return F.transform(spans, typed)


_KINDS = ("US_SSN", "NRIC", "MYKAD", "HKID", "NIK", "EMAIL_ADDRESS", "PHONE_NUMBER", "OTHER")


@query(
    """
WITH made AS (
  SELECT c_custkey AS id, ['US_SSN', 'NRIC', 'MYKAD', 'HKID', 'NIK', 'EMAIL_ADDRESS', 'PHONE_NUMBER', 'OTHER'][c_custkey % 8 + 1] AS kind,
    [lpad((c_custkey * 7919 % 1000000000)::VARCHAR, 9, '0'), 'S' || lpad((c_custkey * 31 % 10000000)::VARCHAR, 7, '0') || 'D', '900101-14-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0'),
     'A' || lpad((c_custkey % 1000000)::VARCHAR, 6, '0') || '(7)', '320' || lpad(c_custkey::VARCHAR, 13, '0'), 'c' || c_custkey || '@example.com', '+62 ' || c_custkey * 104729, 'x']
      [(c_custkey // 8) % 8 + 1] AS value FROM customer)
SELECT id, kind, value, CASE
  WHEN kind = 'US_SSN' THEN length(regexp_replace(value, '[^0-9]', '', 'g')) = 9 AND try_cast(substr(regexp_replace(value, '[^0-9]', '', 'g'), 1, 3) AS INT) NOT IN (0, 666)
    AND try_cast(substr(regexp_replace(value, '[^0-9]', '', 'g'), 1, 3) AS INT) < 900
  WHEN kind = 'NRIC' THEN regexp_full_match(value, '[STFGM][0-9]{7}[A-Z]') WHEN kind = 'MYKAD' THEN regexp_full_match(value, '[0-9]{6}-[0-9]{2}-[0-9]{4}')
  WHEN kind = 'HKID' THEN regexp_full_match(value, '[A-Z]{1,2}[0-9]{6}[(][0-9A][)]') WHEN kind = 'NIK' THEN length(regexp_replace(value, '[^0-9]', '', 'g')) = 16
  WHEN kind = 'EMAIL_ADDRESS' THEN regexp_full_match(value, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}')
  WHEN kind = 'PHONE_NUMBER' THEN length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 8 AND 15 ELSE true END AS valid FROM made
"""
)
def validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format checks of every kind against values of every kind."""
    key = F.col("c_custkey")
    text = lambda c, n: F.lpad(c.cast("string"), n, "0")
    values = F.array(
        text(key * 7919 % 1000000000, 9), F.concat(F.lit("S"), text(key * 31 % 10000000, 7), F.lit("D")), F.concat(F.lit("900101-14-"), text(key % 10000, 4)), F.concat(F.lit("A"), text(key % 1000000, 6), F.lit("(7)")),
        F.concat(F.lit("320"), text(key, 13)), F.concat(F.lit("c"), key.cast("string"), F.lit("@example.com")), F.concat(F.lit("+62 "), (key * 104729).cast("string")), F.lit("x"),
    )
    made = table(spark, sf_dir, "customer").select(key.alias("id"), F.get(F.array(*map(F.lit, _KINDS)), (key % 8).cast("int")).alias("kind"), F.get(values, (F.floor(key / 8) % 8).cast("int")).alias("value"))
    return made.withColumn("valid", T.is_valid(F.col("kind"), F.col("value")))


_MONTH_SQL = " OR ".join(f"contains(lower(text), '{m}')" for m in V.MONTHS)


@query(
    f"""
WITH {DOC_WORDS}, shapes AS (SELECT text, count(*) AS n FROM doc_words GROUP BY text)
SELECT text, n, (regexp_full_match(text, '[0-9\\s\\-.,/:]+') OR (regexp_matches(text, '[0-9]') AND ({_MONTH_SQL}))) AS numeric_or_date,
  regexp_full_match(text, '[A-Za-z][A-Za-z''\\-]+') AND regexp_matches(text, '^[A-Z]') AS name_shaped, regexp_full_match(text, '\\p{{Lu}}[\\p{{L}}''\\-]*') AS name_token FROM shapes
"""
)
def word_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of token each distinct word of the documents is."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \n]")).alias("text")).filter("text <> ''")
    t = F.col("text")
    shapes = words.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return shapes.select(
        "text", "n", T.numeric_or_date(t).alias("numeric_or_date"), (t.rlike(r"\A[A-Za-z][A-Za-z'\-]+\z") & t.rlike("^[A-Z]")).alias("name_shaped"),
        t.rlike(r"\A\p{Lu}[\p{L}'\-]*\z").alias("name_token"),
    )


_FOLD = "replace(lower(source_text), 'ß', 'ss')"


@query(
    f"""
WITH {NAMES}, n AS (SELECT *, trim(regexp_replace({_FOLD}, '\\s+', ' ', 'g')) AS norm FROM names)
SELECT ord, norm, trim(regexp_replace({_FOLD}, '[^a-z0-9]+', ' ', 'g')) AS loose_key, 'MOCK_' || upper(substr(sha256('MOCK' || chr(31) || norm), 1, 6)) AS auto_label,
  CASE WHEN 2 * length(regexp_replace(lower(trim(source_text, ' :.-')), '[^0-9]', '', 'g')) <= length(lower(trim(source_text, ' :.-')))
    THEN translate(lower(trim(source_text, ' :.-')), '0158|', 'olsbl') ELSE lower(trim(source_text, ' :.-')) END AS label_text,
  array_to_string(list_filter(string_split(source_text, ' '), lambda t: t <> '' AND lower(trim(t, '.,')) NOT IN ({", ".join(f"'{g}'" for g in V.GENERIC_ORG_TOKENS)})), ' ') AS stripped,
  CASE WHEN regexp_full_match(regexp_replace(source_text, '[^0-9]', '', 'g'), '[0-9]{{9}}') THEN regexp_replace(regexp_replace(source_text, '[^0-9]', '', 'g'), '^(...)(..)(....)$', '\\1-\\2-\\3') ELSE source_text END AS ssn_text
FROM n
"""
)
def normalized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, labels and reduced forms of every dictionary name."""
    x = F.col("source_text")
    digits = F.regexp_replace(x, "[^0-9]", "")
    ssn = F.when(F.length(digits) == 9, F.regexp_replace(digits, "^(...)(..)(....)$", "$1-$2-$3")).otherwise(x)
    norm = T.normalized(x)
    return names(spark, sf_dir).select("ord", norm.alias("norm"), T.loose_key(x).alias("loose_key"), T.auto_label(norm).alias("auto_label"), T.label_candidate(x).alias("label_text"), T.strip_generic(x).alias("stripped"), ssn.alias("ssn_text"))


@query(
    """
WITH lengths(n) AS (VALUES (6), (8), (12), (16), (32), (64)), cut AS (
  SELECT p_partkey, p_name, n, 'MOCK_' || upper(substr(sha256('MOCK' || chr(31) || trim(lower(p_name))), 1, n)) AS label, trim(lower(p_name)) AS norm FROM part, lengths
), owned AS (SELECT *, min(norm) OVER (PARTITION BY label) <> max(norm) OVER (PARTITION BY label) AS shared FROM cut)
SELECT p_partkey, arg_min(label, n) FILTER (WHERE NOT shared) AS label, min(n) FILTER (WHERE NOT shared) AS n FROM owned GROUP BY p_partkey
"""
)
def auto_label_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest label of each name that no other name has at that length."""
    part = table(spark, sf_dir, "part").select("p_partkey", T.normalized(F.col("p_name")).alias("norm"))
    cut = part.select("p_partkey", "norm", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), T.auto_label(F.col("norm"), n).alias("label")) for n in V.LABEL_LENGTHS])).alias("c")).select("p_partkey", "norm", "c.*")
    w = Window.partitionBy("label")
    free = cut.withColumn("shared", F.min("norm").over(w) != F.max("norm").over(w)).filter("not shared")
    return free.groupBy("p_partkey").agg(F.min_by("label", "n").alias("label"), F.min("n").alias("n"))


@query(
    """
SELECT c_custkey, t.term, t.label, CASE WHEN t.label IS NULL OR trim(t.label) = '' OR lower(trim(t.label)) = 'custom' THEN NULL ELSE trim(t.label) END AS user_mock FROM (
  SELECT c_custkey, CASE WHEN contains(line, '=') THEN trim(string_split(line, '=')[1]) WHEN contains(line, '|') THEN trim(string_split(line, '|')[1]) ELSE trim(line) END AS term,
    CASE WHEN contains(line, '=') THEN trim(line[strpos(line, '=') + 1:]) WHEN contains(line, '|') THEN trim(line[strpos(line, '|') + 1:]) ELSE 'CUSTOM' END AS label
  FROM (SELECT c_custkey, [c_name, c_name || ' = ' || c_mktsegment, c_name || '|' || c_mktsegment || '=x', c_name || ' = '][c_custkey % 4 + 1] AS line FROM customer)) t
"""
)
def parsed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom terms from lines of term = label or term | label."""
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    forms = F.array(name, F.concat(name, F.lit(" = "), seg), F.concat(name, F.lit("|"), seg, F.lit("=x")), F.concat(name, F.lit(" = ")))
    line = F.col("line")
    at = F.when(line.contains("="), F.instr(line, "=")).when(line.contains("|"), F.instr(line, "|"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.get(forms, (F.col("c_custkey") % 4).cast("int")).alias("line")).withColumn("at", at)
    rows = rows.select("c_custkey", F.trim(F.when(F.col("at").isNull(), line).otherwise(F.substr(line, F.lit(1), F.col("at") - 1))).alias("term"), F.when(F.col("at").isNull(), "CUSTOM").otherwise(F.trim(F.substr(line, F.col("at") + 1))).alias("label"))
    blank = (F.col("label") == "") | (F.lower("label") == "custom")
    return rows.withColumn("user_mock", F.when(~blank, F.col("label")))


@query(
    f"""
WITH {NAMES} SELECT ord, round(list_sum(list_transform(string_split(source_text, ''), lambda c: CASE WHEN regexp_matches(c, '^[0-9]$') THEN 85
  WHEN contains(' .,:;"|!()[]{{}}ijl' || chr(9) || chr(39), c) THEN 45 WHEN contains('MWmw@', c) THEN 150 ELSE 100 END)) / 100.0, 2)::DOUBLE AS width FROM names
"""
)
def char_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated width of each name in average characters."""
    return names(spark, sf_dir).select("ord", F.round(T.text_width(F.col("source_text")), 2).alias("width"))


@query(
    """
WITH loc AS (SELECT user_id, event_id, ['sg', 'my', 'hk', 'id', 'us', NULL][event_id % 6 + 1] AS locale, ['en', 'ms', 'id', 'zh-cn', 'fr'][event_id % 5 + 1] AS code FROM events)
SELECT event_id, coalesce(locale, CASE code WHEN 'en' THEN 'sg' WHEN 'ms' THEN 'my' WHEN 'id' THEN 'id' WHEN 'zh-cn' THEN 'hk' ELSE 'sg' END) AS locale,
  CASE coalesce(locale, CASE code WHEN 'en' THEN 'sg' WHEN 'ms' THEN 'my' WHEN 'id' THEN 'id' WHEN 'zh-cn' THEN 'hk' ELSE 'sg' END)
    WHEN 'my' THEN 'eng+msa' WHEN 'hk' THEN 'eng+chi_tra+chi_sim' WHEN 'id' THEN 'eng+ind' ELSE 'eng' END AS ocr_languages FROM loc
"""
)
def language_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locale, given or detected, and its recognition languages."""

    def literal(d: dict):
        return F.create_map(*[F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)) for kv in d.items() for x in kv])

    e = table(spark, sf_dir, "events").select("event_id")
    given = F.get(F.array(*map(F.lit, ("sg", "my", "hk", "id", "us", None))), (F.col("event_id") % 6).cast("int"))
    code = F.get(F.array(*map(F.lit, ("en", "ms", "id", "zh-cn", "fr"))), (F.col("event_id") % 5).cast("int"))
    rows = e.select("event_id", F.coalesce(given, F.try_element_at(literal(V.DETECTED_LOCALES), code), F.lit("sg")).alias("locale"))
    langs = F.try_element_at(literal(V.LOCALE_LANGUAGES), F.col("locale"))
    return rows.withColumn("ocr_languages", F.array_join(F.transform(langs, lambda x: F.coalesce(F.try_element_at(literal(V.OCR_CODES), x), x)), "+"))


@query(
    r"""
WITH f AS (SELECT page_id, regexp_replace(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1), '[^A-Za-z0-9._-]', '_', 'g') AS base FROM pages
), named AS (SELECT page_id, left(CASE WHEN base = '' THEN 'document' ELSE base END, 255) AS base FROM f)
SELECT page_id, base, 'mocked_' || base || CASE WHEN n = 0 THEN '' ELSE '_' || n END || '.pdf' AS output_name, sha256(base) AS name_hash
FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY page_id) - 1 AS n FROM named)
"""
)
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A safe, unique output name for each page's url, and the hash that stands for it in logs."""
    base = F.regexp_replace(F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1), "[^A-Za-z0-9._-]", "_")
    rows = table(spark, sf_dir, "pages").select("page_id", F.left(F.when(base == "", "document").otherwise(base), F.lit(255)).alias("base"))
    n = F.row_number().over(Window.partitionBy("base").orderBy("page_id")) - 1
    rows = rows.withColumn("n", n)
    suffix = F.when(F.col("n") == 0, "").otherwise(F.concat(F.lit("_"), F.col("n").cast("string")))
    return rows.select("page_id", "base", F.concat(F.lit("mocked_"), F.col("base"), suffix, F.lit(".pdf")).alias("output_name"), F.sha2(F.col("base").cast("binary"), 256).alias("name_hash"))


@query(
    """
WITH terms AS (SELECT item_id, array_to_string(string_split(text, ' ')[1:4], ' ') AS term FROM benchmark WHERE text <> ''), met AS (
  SELECT doc_id, item_id, term, text FROM documents JOIN terms ON contains(lower(text), lower(term))
)
SELECT doc_id, item_id, (s - 1)::INT AS start, (s - 1 + length(term))::INT AS stop FROM (
  SELECT doc_id, item_id, term, text, unnest(list_filter(range(1, length(text) + 1), lambda i: lower(substr(text, i, length(term))) = lower(term))) AS s FROM met)
WHERE (s = 1 OR NOT regexp_matches(substr(term, 1, 1), '[A-Za-z0-9]') OR NOT regexp_matches(substr(text, s - 1, 1), '[A-Za-z0-9]'))
  AND (NOT regexp_matches(substr(term, length(term), 1), '[A-Za-z0-9]') OR NOT regexp_matches(substr(text, s + length(term), 1), '[A-Za-z0-9]') OR s + length(term) > length(text))
"""
)
def term_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first four words of each benchmark item stand in the documents, as whole terms."""
    return benchmark_term_spans(spark, sf_dir).select("doc_id", "item_id", "start", "stop")


def benchmark_term_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents meet terms on the term's longest word, so no pair is tried without a shared word."""
    terms = table(spark, sf_dir, "benchmark").filter("text <> ''").select("item_id", F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("term"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cand = M.sharing_a_word(docs, "text", terms)
    met = docs.join(cand, "doc_id")
    spans = T.term_spans(F.col("text"), T.term_pattern(F.col("term")))
    return met.select("doc_id", "item_id", "term", F.explode(spans).alias("s")).select("doc_id", "item_id", "term", "s.start", "s.stop")
