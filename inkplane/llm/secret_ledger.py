"""Secret scans over an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger records which rules, in which version,
a blob has been scanned by and what each found, so a run reads only blobs with a rule-version pair that the ledger
lacks, once each however many paths hold them; findings, those of the asked rule versions only, are then joined back to
all paths. The ledger keeps which blobs a path has held, so findings of earlier versions of a path stay known. All of it is built-in
functions, offsets included: the pieces between matches give the place of each match.

Defined results: a null text is scanned as the empty text; null ids and repeated rows are paths like any other; an
empty table gives an empty ledger; further columns are kept and may have any name, dots and working names included.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkplane.llm.common import shared_dir


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; kept where the text of ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order in which kinds stand at equal starts. Runs that are too short can't hold or hide a longer match in the
#: second and third rule, so their length is part of the pattern.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
SPANS = "array<struct<start: int, ord: int, kind: string, end: int>>"
#: As kept: rule is kind and version, as a span stays in the ledger when a later version finds other ones.
KEPT = "array<struct<start: int, rule: string, end: int>>"
LEDGER = f"blob string, scanned array<string>, spans {KEPT}"
PATHS = "path string, blob string"


def spans_of(text: Column, rule: Rule) -> Column:
    """The rule's spans in code points, end exclusive, as KEPT."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    sizes = F.transform(found, F.length)

    def place(state: Column, i: Column) -> Column:
        start = state["at"] + F.get(gaps, i)
        end = start + F.get(sizes, i)
        here = F.struct(start.alias("start"), F.lit(rule.key).alias("rule"), end.alias("end"))
        good = F.lit(True) if rule.least <= 1 else F.length(F.regexp_extract(F.get(found, i), rule.pattern, rule.group)) >= rule.least
        return F.struct(end.alias("at"), F.when(good, F.array_append(state["out"], here)).otherwise(state["out"]).alias("out"))

    none = F.array().cast(KEPT)
    every = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), F.struct(F.lit(0).alias("at"), none.alias("out")), place, lambda s: s["out"])
    return F.when(text.rlike(rule.pattern), every).otherwise(none)


class BlobLedger:
    """What has been scanned, as Parquet files that runs append to."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_dir(spark, "ledger")

    def _table(self, name: str, schema: str) -> DataFrame | None:
        """A table of the ledger, None before anything was written to it."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return None
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def read(self) -> DataFrame:
        """LEDGER: which rules scanned each blob, and what they found, a row for each run that scanned it."""
        found = self._table("blobs", LEDGER)
        return self.spark.createDataFrame([], LEDGER) if found is None else found

    def paths(self) -> DataFrame:
        """PATHS: every blob that each path has held."""
        found = self._table("paths", PATHS)
        return self.spark.createDataFrame([], PATHS) if found is None else found.distinct()

    def update(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scan what versions(blob, text) hold that no run has scanned by these rules, and append it.

        Equal blobs are reduced to one in each task before the shuffle, so a blob that fills a third of all rows
        reaches its scan as one row a task at most.
        """
        blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))
        keys = F.array(*[F.lit(r.key) for r in rules])
        found = self._table("blobs", LEDGER)
        if found is None:
            todo = blobs.withColumn("todo", keys)
        else:
            done = found.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("done"))
            todo = blobs.join(done, "blob", "left").withColumn("todo", F.array_except(keys, F.coalesce("done", F.array().cast("array<string>"))))
            todo = todo.filter(F.size("todo") > 0)
        none = F.array().cast(KEPT)
        spans = F.concat(*[F.when(F.array_contains("todo", r.key), spans_of(F.col("text"), r)).otherwise(none) for r in rules])
        todo.select("blob", F.col("todo").alias("scanned"), spans.alias("spans")).write.mode("append").parquet(f"{self.path}/blobs")

    def record(self, held: DataFrame) -> None:
        """Note which blob each path of held(path, blob) holds now, where that is new."""
        known = self._table("paths", PATHS)
        if known is not None:
            held = held.join(known.select(F.col("path").alias("_p"), F.col("blob").alias("_b")), F.col("path").eqNullSafe(F.col("_p")) & (F.col("blob") == F.col("_b")), "left_anti")
        held.write.mode("append").parquet(f"{self.path}/paths")

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """blob and its SPANS by these rule versions, in order, for blobs that have any; a blob has a row for each run at most."""
        keys, kinds = F.array(*[F.lit(r.key) for r in rules]), F.array(*[F.lit(r.kind) for r in rules])

        def named(s: Column) -> Column:
            at = F.array_position(keys, s["rule"]).cast("int") - 1
            return F.struct(s["start"].alias("start"), at.alias("ord"), F.get(kinds, at).alias("kind"), s["end"].alias("end"))

        rows = self.read().select("blob", F.transform(F.filter("spans", lambda s: F.array_contains(keys, s["rule"])), named).alias("spans")).filter(F.size("spans") > 0)
        return rows.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))

    def history(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(path, blob, spans) of every version that a path has held, whether it still does or not."""
        held, found = self.paths(), self.findings(rules)
        return held.join(found, "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan(docs: DataFrame, ledger: BlobLedger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(_row, _spans): the rows of docs as structs and their spans, by way of the ledger."""
    text = F.coalesce("text", F.lit(""))
    ledger.update(docs.select(blob_id(F.col("text")).alias("blob"), text.alias("text")), rules)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"), F.col("doc_id").alias("_path"), blob_id(F.col("text")).alias("_blob"))
    ledger.record(rows.select(F.col("_path").cast("string").alias("path"), F.col("_blob").alias("blob")))
    found = ledger.findings(rules)
    return rows.join(found, rows["_blob"] == found["blob"], "left").select("_row", F.coalesce("spans", F.array().cast(SPANS)).alias("_spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: str) -> Column:
    """Number of spans of a kind in _spans."""
    return F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")
