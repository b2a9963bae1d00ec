"""The corpus pipeline: stages that each take the documents their predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents, but for the last, which returns where each
row stands in the committed shards.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkplane.llm import curriculum, quality_gbt, shards, simhash_pivot, winnow
from inkplane.llm.common import count_words, shared_dir, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on those of them that have labels, does not reject."""
    return quality_gbt.kept(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id."""
    return simhash_pivot.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of the benchmark occurs."""
    return winnow.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, sorted by training position, a file for each stretch of it."""
    words = docs.agg(F.sum(count_words(F.col("text")))).first()[0] or 0
    return curriculum.mixed(docs, slots=curriculum.slots_for(words))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row stands in the shards, which keep the training order: each file of the mix is an arrival."""
    columns = docs.columns
    try:
        rows = docs.select(*columns, F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:  # docs that are no files come in the order of their ids
        rows = docs.withColumns({"_file": F.floor(F.col("doc_id") / shards.ARRIVAL_IDS).cast("string"), "_row": F.col("doc_id")})
    store = shards.ShardStore(spark, shared_dir(spark, "shards"), rows.schema)
    store.append(rows, F.col("_file"), [F.col("_row"), F.col("doc_id")])
    store.compact()
    return store.read().select("row.doc_id", "shard", "tier", "position", F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long").alias("n_bytes"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]
#: Trees and SimHash components are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each over what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
