"""Queries over the words of documents as pages: offsets, rows, segments, prose and statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkplane.functions import text as T
from inkplane.functions import vocab as V
from inkplane.operators import layout as L
from inkplane.plans.registry import query, table
from inkplane.sources.fixtures import DOC_WORDS, doc_words

_ROWS = """
mids AS (SELECT *, y + h / 2.0 AS mid FROM doc_words
), marked AS (SELECT *, CASE WHEN mid - lag(mid) OVER (PARTITION BY doc_id ORDER BY mid, x, word_idx) > greatest(4.0, 0.6 * h) THEN 1 ELSE 0 END AS new FROM mids
), numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY mid, x, word_idx ROWS UNBOUNDED PRECEDING)::INT AS row_no FROM marked
), visual AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, row_no ORDER BY x, word_idx) - 1)::INT AS row_pos FROM numbered)"""


@query(f"WITH {DOC_WORDS} SELECT doc_id, word_idx, text, x, y, w, h, char_start, (char_start + length(text))::INT AS char_end FROM doc_words")
def word_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every document with its box and its offsets in the page text."""
    return doc_words(spark, sf_dir).select("doc_id", "word_idx", "text", "x", "y", "w", "h", "char_start", "char_end")


@query(f"WITH {DOC_WORDS}, {_ROWS} SELECT doc_id, row_no, count(*) AS n_words, min(x) AS x, min(y) AS y, (max(x + w) - min(x))::INT AS w, string_agg(text, ' ' ORDER BY row_pos) AS row_text FROM visual GROUP BY doc_id, row_no")
def visual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visual rows of every document, with the box and the text of each."""
    rows = L.visual_rows(doc_words(spark, sf_dir))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row_pos", "text"))), lambda s: s["text"])
    return rows.groupBy("doc_id", "row_no").agg(F.count(F.lit(1)).alias("n_words"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).cast("int").alias("w"), F.array_join(ordered, " ").alias("row_text"))


@query(
    f"""
WITH {DOC_WORDS}, {_ROWS}, spaced AS (SELECT doc_id, row_no, row_pos, text, h, (3 * x)::INT AS x, w FROM visual
), sized AS (SELECT *, list_sort(list(h) OVER (PARTITION BY doc_id, row_no)) AS hs, x - lag(x + w) OVER (PARTITION BY doc_id, row_no ORDER BY row_pos) AS gap FROM spaced
), cut AS (SELECT *, CASE WHEN gap > greatest(4 * hs[len(hs) // 2 + 1], 40) THEN 1 ELSE 0 END AS c FROM sized
), seg AS (SELECT *, sum(c) OVER (PARTITION BY doc_id, row_no ORDER BY row_pos ROWS UNBOUNDED PRECEDING)::INT AS segment FROM cut)
SELECT doc_id, row_no, segment, count(*) AS n_words, min(x)::INT AS x, (max(x + w) - min(x))::INT AS w FROM seg GROUP BY ALL
"""
)
def row_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, set three times as wide, cut at large gaps."""
    rows = L.visual_rows(doc_words(spark, sf_dir)).withColumn("x", F.col("x") * 3)
    segs = L.gap_segments(rows).groupBy("doc_id", "row_no", "segment")
    return segs.agg(F.count(F.lit(1)).alias("n_words"), F.min("x").alias("x"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"))


@query(
    f"""
WITH {DOC_WORDS} SELECT doc_id, string_agg(text, ' ' ORDER BY word_idx) AS merged_text, count(*) AS n_words, round(avg(conf), 4) AS mean_conf,
  list_sort(list(length(text)))[count(*) // 2 + 1]::INT AS upper_median FROM doc_words GROUP BY doc_id
"""
)
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged text of every page with the upper median of its word lengths."""
    parts = F.array_sort(F.collect_list(F.struct("word_idx", "text")))
    sizes = F.array_sort(F.collect_list(F.length("text")))
    out = doc_words(spark, sf_dir).groupBy("doc_id").agg(parts.alias("p"), sizes.alias("s"), F.count(F.lit(1)).alias("n_words"), F.round(F.avg("conf"), 4).alias("mean_conf"))
    return out.select("doc_id", F.array_join(F.transform("p", lambda s: s["text"]), " ").alias("merged_text"), "n_words", "mean_conf", F.get("s", F.floor(F.col("n_words") / 2).cast("int")).alias("upper_median"))


@query(
    f"""
WITH {DOC_WORDS} SELECT doc_id, '[' || string_agg('{{"text":' || to_json(text) || ',"x":' || x || ',"y":' || y || ',"w":' || w || ',"h":' || h || '}}', ',' ORDER BY word_idx) || ']' AS words_json
FROM doc_words GROUP BY doc_id
"""
)
def ocr_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every page as JSON, letters beyond ASCII kept."""
    items = F.array_sort(F.collect_list(F.struct("word_idx", F.struct("text", "x", "y", "w", "h").alias("word"))))
    return doc_words(spark, sf_dir).groupBy("doc_id").agg(F.to_json(F.transform(items, lambda s: s["word"])).alias("words_json"))


#: Prose in which tokens stand for the markers: the words of two languages that are frequent in these texts.
_MARK, _DEBIT, _CREDIT = "of", "and", "the"


@query(
    f"""
WITH {DOC_WORDS}, low AS MATERIALIZED (SELECT doc_id, word_idx, text, lower(regexp_replace(text, '[^A-Za-z0-9/]', '', 'g')) AS t FROM doc_words
), marks AS MATERIALIZED (SELECT doc_id, word_idx FROM low WHERE t = '{_MARK}'
), after AS (
  SELECT m.doc_id, m.word_idx, list(l.text ORDER BY l.word_idx) AS ahead
  FROM (SELECT doc_id, word_idx, word_idx + unnest(range(1, 9)) AS at FROM marks) m JOIN low l ON l.doc_id = m.doc_id AND l.word_idx = m.at GROUP BY ALL
), before AS (
  SELECT m.doc_id, m.word_idx, arg_max(l.t, l.word_idx) AS back
  FROM (SELECT doc_id, word_idx, word_idx - unnest(range(1, 16)) AS at FROM marks) m JOIN low l ON l.doc_id = m.doc_id AND l.word_idx = m.at WHERE l.t IN ('{_DEBIT}', '{_CREDIT}') GROUP BY ALL
), marked AS (SELECT doc_id, word_idx, ahead, back FROM after LEFT JOIN before USING (doc_id, word_idx)
), ended AS (SELECT *, coalesce(list_min(list_filter(range(1, len(ahead) + 1), lambda i: regexp_matches(ahead[i], '[.,;:]$') OR regexp_matches(ahead[i], '^[0-9]'))), len(ahead) + 1) AS stop FROM marked)
SELECT doc_id, word_idx, array_to_string(ahead[1:CASE WHEN stop <= len(ahead) AND NOT regexp_matches(ahead[stop], '^[0-9]') THEN stop ELSE stop - 1 END], ' ') AS name_text,
  CASE back WHEN '{_DEBIT}' THEN 'debit_account_name' WHEN '{_CREDIT}' THEN 'credit_account_name' ELSE 'counterparty_org' END AS field_role, 0.75 AS confidence
FROM ended WHERE len(ahead) > 0
"""
)
def prose_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names after a marker in prose: up to eight tokens to the end of a clause; the role from the nearest word before."""
    return L.prose_names(doc_words(spark, sf_dir), {_MARK: None}, {_DEBIT: "debit_account_name", _CREDIT: "credit_account_name"}).drop("marker")


_JOB = " OR ".join(f"contains(lower(row_text), '{w}')" for w in (*V.JOB_TITLE_WORDS, *V.SIGNATURE_CLOSERS))


@query(
    f"""
WITH {DOC_WORDS}, {_ROWS}, page AS (SELECT doc_id, max(y + h) AS page_h FROM doc_words GROUP BY doc_id
), text_rows AS (SELECT doc_id, row_no, row_pos // 2 AS segment, min(y) AS y, list(text ORDER BY row_pos) AS toks, string_agg(text, ' ' ORDER BY row_pos) AS row_text FROM visual GROUP BY ALL)
SELECT doc_id, row_no, segment, row_text, CASE WHEN len(list_filter(toks, lambda t: NOT regexp_full_match(t, '\\p{{Lu}}[\\p{{L}}''\\-]*'))) = 0 AND len(toks) BETWEEN 2 AND 4 THEN 'PERSON' ELSE 'ORGANIZATION' END AS entity_type, 0.7 AS confidence
FROM text_rows JOIN page USING (doc_id) WHERE y >= 0.7 * page_h AND NOT ({_JOB}) AND (
  (len(list_filter(toks, lambda t: NOT regexp_full_match(t, '\\p{{Lu}}[\\p{{L}}''\\-]*'))) = 0 AND len(toks) BETWEEN 2 AND 4 AND len(list_filter(toks, lambda t: lower(t) IN ({", ".join(f"'{w}'" for w in V.ORG_PREFIXES)}))) = 0)
  OR (len(toks) BETWEEN 2 AND 8 AND len(list_filter(toks, lambda t: lower(t) IN ({", ".join(f"'{w}'" for w in V.ORG_PREFIXES)}))) > 0))
"""
)
def signature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of words in the lowest 30 % of a page that read as a person's or an organization's name."""
    words = doc_words(spark, sf_dir)
    page = Window.partitionBy("doc_id")
    rows = L.visual_rows(words.withColumn("page_h", F.max(F.col("y") + F.col("h")).over(page))).groupBy("doc_id", "row_no", F.floor(F.col("row_pos") / 2).alias("segment"))
    rows = rows.agg(F.min("y").alias("y"), F.first("page_h").alias("page_h"), F.transform(F.array_sort(F.collect_list(F.struct("row_pos", "text"))), lambda s: s["text"]).alias("toks"))
    rows = rows.filter(F.col("y") >= 0.7 * F.col("page_h")).withColumn("row_text", F.array_join("toks", " "))
    low = F.lower("row_text")
    other = F.lit(False)
    for w in (*V.JOB_TITLE_WORDS, *V.SIGNATURE_CLOSERS):
        other = other | low.contains(w)
    org = F.exists("toks", lambda t: F.lower(t).isin(*V.ORG_PREFIXES))
    person = F.forall("toks", lambda t: t.rlike(r"\A\p{Lu}[\p{L}'\-]*\z")) & F.size("toks").between(2, 4)
    rows = rows.filter(~other & ((person & ~org) | (org & F.size("toks").between(2, 8))))
    return rows.select("doc_id", "row_no", "segment", "row_text", F.when(person, "PERSON").otherwise("ORGANIZATION").alias("entity_type"), F.lit(0.7).alias("confidence"))


_SHAPES = """
stmt AS (
  SELECT o_custkey AS page_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, o_totalprice, s_name, c_mktsegment
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS ord FROM supplier) s ON s.ord = o_orderkey % (SELECT count(*) FROM supplier)
), body AS (
  SELECT page_id, i, unnest([{'k': 0, 'text': (i + 1)::VARCHAR, 'x': 0}, {'k': 1, 'text': 'PT', 'x': 210}, {'k': 2, 'text': upper(c_mktsegment[1]) || lower(c_mktsegment[2:]), 'x': 255}, {'k': 3, 'text': 'Customer', 'x': 300},
    {'k': 4, 'text': s_name, 'x': 430}, {'k': 5, 'text': lpad(o_orderkey::VARCHAR, 11, '0'), 'x': 700}], recursive := true) FROM stmt
)"""
#: The header row of a statement page: column labels and where they stand.
_HEADER = (("No", 0), ("Jumlah", 50), ("Nama", 235), ("Rekening", 305), ("Bank", 470), ("No", 685), ("Rekening", 755))


def statement_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body words of a statement page for each customer with orders: page_id, i, k, text, x."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    n = sup.count()
    ranked = sup.withColumn("ord", F.row_number().over(Window.orderBy("s_suppkey")) - 1).select("ord", "s_name")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page_id"), "o_orderkey")
    o = o.withColumn("i", F.row_number().over(Window.partitionBy("page_id").orderBy("o_orderkey")) - 1)
    o = o.join(cust, F.col("c_custkey") == F.col("page_id")).withColumn("ord", F.col("o_orderkey") % n).join(ranked, "ord")
    spec = [((F.col("i") + 1).cast("string"), 0), (F.lit("PT"), 210), (F.initcap("c_mktsegment"), 255), (F.lit("Customer"), 300), (F.col("s_name"), 430), (F.lpad(F.col("o_orderkey").cast("string"), 11, "0"), 700)]
    words = F.array(*[F.struct(F.lit(k).alias("k"), t.alias("text"), F.lit(x).alias("x")) for k, (t, x) in enumerate(spec)])
    return o.select("page_id", "i", F.explode(words).alias("s")).select("page_id", "i", "s.*")


#: Zones of the name, bank and account number columns: middles between neighbouring labels, 150 px at the page's edge.
_ZONES = (("debit_account_name", 200, 417), ("bank_name", 418, 607), ("account_number", 608, 905))


@query(
    "WITH "
    + _SHAPES
    + ", zoned AS (SELECT *, CASE "
    + " ".join(f"WHEN x + 30 BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in _ZONES)
    + """ END AS zone FROM body)
SELECT page_id, i, array_to_string(list(text ORDER BY x) FILTER (WHERE zone = 'debit_account_name'), ' ') AS account_name, array_to_string(list(text ORDER BY x) FILTER (WHERE zone = 'bank_name'), ' ') AS bank_name,
  array_to_string(list(text ORDER BY x) FILTER (WHERE zone = 'account_number' AND regexp_full_match(text, '[0-9]+')), ' ') AS account_number, 0.8 AS confidence FROM zoned GROUP BY page_id, i"""
)
def statement_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account name, bank and paired number of each statement row, by the zones of the header's columns."""
    words = statement_words(spark, sf_dir)
    middle = F.col("x") + 30
    zone = F.coalesce(*[F.when(middle.between(a, b), F.lit(n)) for n, a, b in _ZONES])
    words = words.withColumn("zone", zone)

    def column(name: str, cond: Column | None = None) -> Column:
        here = (F.col("zone") == name) if cond is None else (F.col("zone") == name) & cond
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(here, F.struct("x", "text")))), lambda s: s["text"]), " ")

    out = words.groupBy("page_id", "i").agg(column("debit_account_name").alias("account_name"), column("bank_name").alias("bank_name"), column("account_number", F.col("text").rlike("^[0-9]+$")).alias("account_number"))
    return out.withColumn("confidence", F.lit(0.8))


@query(
    "WITH "
    + _SHAPES
    + """, ys AS (SELECT DISTINCT page_id, i, 100 + 40 * i + 13 * (i // 4) + 90 * (i // 9) AS y FROM body), gaps AS (
  SELECT page_id, list(y ORDER BY i) AS ys FROM ys GROUP BY page_id
), folded AS (
  SELECT page_id, list_reduce(list_prepend({'prev': ys[1]::DOUBLE, 'ref': -1.0::DOUBLE, 'n': 1, 'done': false}, list_transform(ys[2:], lambda v: {'prev': v::DOUBLE, 'ref': 0.0::DOUBLE, 'n': 0, 'done': false})), lambda s, v:
    {'prev': v.prev, 'ref': CASE WHEN s.done THEN s.ref WHEN s.ref < 0 THEN greatest(v.prev - s.prev, 4.0) WHEN v.prev - s.prev > 4 * s.ref THEN s.ref ELSE (s.ref + greatest(v.prev - s.prev, 0.0)) / 2 END,
     'n': s.n + CASE WHEN s.done OR (s.ref >= 0 AND v.prev - s.prev > 4 * s.ref) THEN 0 ELSE 1 END, 'done': s.done OR (s.ref >= 0 AND v.prev - s.prev > 4 * s.ref)}) AS f FROM gaps
)
SELECT page_id, f.n::INT AS table_rows, round(f.ref, 6) AS reference_gap FROM folded"""
)
def table_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of a statement belong to its table: it ends at a gap over four times the running reference gap."""
    i = F.col("i")
    y = 100 + 40 * i + 13 * F.floor(i / 4) + 90 * F.floor(i / 9)
    rows = statement_words(spark, sf_dir).select("page_id", "i", y.cast("double").alias("y")).distinct()
    ys = F.transform(F.array_sort(F.collect_list(F.struct("i", "y"))), lambda s: s["y"])
    pages = rows.groupBy("page_id").agg(ys.alias("ys"))

    def step(s: Column, v: Column) -> Column:
        gap = v - s["prev"]
        stop = s["done"] | ((s["ref"] >= 0) & (gap > 4 * s["ref"]))
        ref = F.when(stop, s["ref"]).when(s["ref"] < 0, F.greatest(gap, F.lit(4.0))).otherwise((s["ref"] + F.greatest(gap, F.lit(0.0))) / 2)
        return F.struct(v.alias("prev"), ref.alias("ref"), (s["n"] + F.when(stop, 0).otherwise(1)).alias("n"), stop.alias("done"))

    first = F.struct(F.get("ys", F.lit(0)).alias("prev"), F.lit(-1.0).alias("ref"), F.lit(1).alias("n"), F.lit(False).alias("done"))
    folded = pages.select("page_id", F.aggregate(F.slice("ys", 2, 1 << 30), first, step).alias("f"))
    return folded.select("page_id", F.col("f.n").alias("table_rows"), F.round("f.ref", 6).alias("reference_gap"))


@query(
    f"""
WITH {DOC_WORDS}, hit AS (SELECT doc_id, line_no, lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS t, word_idx FROM doc_words
), sect AS (SELECT doc_id, line_no, max(CASE WHEN t = '{_DEBIT}' THEN 1 ELSE 0 END) AS d, max(CASE WHEN t = '{_CREDIT}' THEN 1 ELSE 0 END) AS c, count(*) AS n FROM hit GROUP BY doc_id, line_no
), labelled AS (SELECT *, CASE WHEN n > 6 THEN NULL WHEN d = 1 THEN 'debit' WHEN c = 1 THEN 'credit' END AS label FROM sect)
SELECT doc_id, line_no, n AS n_words, coalesce(last_value(label IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'none') AS section FROM labelled
"""
)
def label_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section each line stands in: short lines with a section word set it for those below."""
    return L.sections(doc_words(spark, sf_dir), {"debit": (_DEBIT,), "credit": (_CREDIT,)})


@query(
    f"""
WITH {DOC_WORDS}, phrase AS (
  SELECT doc_id, word_idx, text, x, y, w, h FROM (SELECT doc_id, (word_idx // 2) AS word_idx, string_agg(text, ' ' ORDER BY word_idx) AS text, min(x)::INT AS x, min(y)::INT AS y, (sum(w) + 10 * (count(*) - 1))::INT AS w, 14 AS h
  FROM doc_words GROUP BY doc_id, line_no, word_idx // 2)
), widths AS (SELECT *, list_transform(string_split(text, ''), lambda c: CASE WHEN regexp_matches(c, '^[0-9]$') THEN 85 WHEN contains(' .,:;"|!()[]{{}}ijl' || chr(9) || chr(39), c) THEN 45 WHEN contains('MWmw@', c) THEN 150 ELSE 100 END) AS ws FROM phrase)
SELECT doc_id, word_idx, y, sum(list_sum(ws))::BIGINT AS total_width, count(*) AS n FROM widths GROUP BY ALL
"""
)
def phrase_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated widths of two-word readings, by which a box is split between its words."""
    words = doc_words(spark, sf_dir).withColumn("pair", F.floor(F.col("word_idx") / 2))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda s: s["text"]), " ")
    phrases = words.groupBy("doc_id", "line_no", "pair").agg(text.alias("text"), F.min("y").alias("y"))
    width = F.round(T.text_width(F.col("text")) * 100).cast("long")
    return phrases.groupBy("doc_id", F.col("pair").alias("word_idx"), "y").agg(F.sum(width).alias("total_width"), F.count(F.lit(1)).alias("n"))
