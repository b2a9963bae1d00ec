"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkplane.llm import curriculum, dac_tokens, edit_embedding, lang_crf, quality_gbt, secret_ledger, shards, simhash_pivot, warc, winnow
from inkplane.llm.common import held_out, shared_dir, table


def op1_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of each document, found once for each distinct text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = secret_ledger.scan(docs, secret_ledger.BlobLedger(spark))
    counts = [secret_ledger.count_of(k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    base = secret_ledger.joined(F.col("_spans"))
    return out.select("_row.doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), base.alias("spans"))


def op2_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document stands after its arrival was appended and small shards were merged."""
    docs = table(spark, sf_dir, "documents")
    store = shards.ShardStore(spark, shared_dir(spark, "shards"), docs.schema)
    store.append(docs, F.floor(F.col("doc_id") / shards.ARRIVAL_IDS), [F.col("doc_id")])
    store.compact()
    return store.read().select("row.doc_id", "shard", "tier", "position", F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long").alias("n_bytes"))


def op3_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of each document and the class of near-duplicates it belongs to."""
    out = simhash_pivot.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex(F.get("fp", F.lit(0)))), 16, "0").alias("fingerprint"), "component_id")


def op4_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and of its edited text, and how like they are."""
    return edit_embedding.compared(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside passages of the benchmark, and the items they come from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = winnow.with_hits(docs.withColumn("n_words", F.size(winnow.words(F.col("text"))).cast("long")), table(spark, sf_dir, "benchmark"))
    return out.select(
        "_row.doc_id", "_row.n_words", F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("_n_hit") > 0).alias("contaminated"),
    )


def op6_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = lang_crf.labelled(docs, lang_crf.learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_gbt.learn(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality_gbt.score(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= quality_gbt.THRESHOLD).cast("int"))


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and the training position of its first copy."""
    out = curriculum.dealt(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.round("first_position", 9).alias("first_position"))


def op9_dac_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's ids stand in the written token files, and their checksum, as read back."""
    import public_tokenizers

    return dac_tokens.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages hold, read back by splits."""
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_secret_ledger, op2_size_tiered_shards, op3_simhash_pivots, op4_edit_embedding, op5_winnowing, op6_language_crf, op7_quality_trees, op8_curriculum_mix, op9_dac_tokens, op10_warc)}
