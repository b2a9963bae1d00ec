"""The registered queries against their SQL, and the pipeline against a brute-force version of its stages."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkplane.llm.oracles import ORACLES
from inkplane.llm.queries import QUERIES
from tests.llm.test_operators import brute_hits
from tests.oracle import DATA, same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    step, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, step, DATA).write.parquet(f"{tmp_path}/{name}")
        step = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "sharding" or step.columns == docs.columns
        kept.append([r.doc_id for r in step.select("doc_id").collect()])
    good, single, fresh, mix, placed = kept
    # Quality: of labelled documents nearly all are judged as labelled.
    right = [(i in set(good)) == bool(y) for i, y in labels.items()]
    assert sum(right) >= 0.95 * len(right)
    # Near-duplicates: copies are gone, pairs of similarity 0.85 and more too; what went has a like one that stayed.
    assert len(set(single)) == len(single) == len({texts[i] for i in single})
    sets = {i: shingles(texts[i]) for i in good}
    like = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    assert not [(a, b) for a in single for b in single if a < b and like(a, b) >= 0.85]
    assert all(max(like(a, b) for b in good if b != a) >= 0.6 for a in set(good) - set(single))
    # Decontamination: exactly the documents without hits.
    hit = {i: h for i, _, h, _ in brute_hits([(i, texts[i]) for i in single], bench)}
    assert sorted(fresh) == sorted(i for i in single if not hit[i])
    # Mixing: three copies at most; sharding loses none of them.
    assert set(mix) <= set(fresh) and max(Counter(mix).values()) <= 3
    assert Counter(placed) == Counter(mix)
    assert step.groupBy("shard").agg((F.max(F.col("position") + F.col("n_bytes")) - F.sum("n_bytes")).alias("d")).filter("d <> 0").count() == 0


def test_contracts_of_queries_without_sql(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in QUERIES["op6_language_crf"](spark, DATA).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", docs.get(r.doc_id) or ""))
        assert r.lang_pred in {*lang.values(), "und"}
    for r in QUERIES["op7_quality_trees"](spark, DATA).collect():
        assert r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
    got = QUERIES["op3_simhash_pivots"](spark, DATA).collect()
    assert len(got) == len(docs) and all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) and r.component_id <= r.doc_id for r in got)
    assert len(QUERIES["op4_edit_embedding"](spark, DATA).collect()) == len(QUERIES["op9_dac_tokens"](spark, DATA).collect()) == len(docs)
