"""Streams, files, kernels and operators that decide in order."""

import random
import types

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkplane.functions import pixels
from inkplane.functions import text as T
from inkplane.operators import align, dictionary, labels, layout, matching, pages, sequential
from inkplane.sources import files
from inkplane.streaming import watch


def test_stable_files_stream(spark, tmp_path):
    rows = [("a", 1, 5, 1), ("a", 2, 5, 1), ("a", 4, 5, 1), ("a", 5, 5, 1), ("b", 1, 1, 1), ("b", 2, 2, 1), ("b", 3, 2, 1)]
    for n in range(1, 6):
        spark.createDataFrame([r for r in rows if r[1] == n] or [], watch.STABLE).write.parquet(f"{tmp_path}/in", mode="append")
    stream = spark.readStream.schema(watch.STABLE).parquet(f"{tmp_path}/in")
    q = watch.stable(stream).writeStream.format("memory").queryName("stable_files").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    assert sorted((r.path, r.scan_no) for r in spark.table("stable_files").collect()) == [("a", 2), ("a", 5), ("b", 3)]


def test_watched_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(3):
        (tmp_path / "in" / f"f{n}.txt").write_text("bad" if n == 1 else f"text {n}")

    def handle(batch):
        return batch.select("path", F.when(F.col("content").cast("string") == "bad", F.raise_error(F.lit("no"))).otherwise(F.col("length")).alias("n"))

    for _ in range(2):  # the second run finds nothing new
        watch.process(watch.watched(spark, str(tmp_path / "in"), "*.txt"), handle, f"{tmp_path}/out", f"{tmp_path}/failed", f"{tmp_path}/c").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2 and spark.read.parquet(f"{tmp_path}/failed").count() == 1


def test_failed_files_are_tried_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(4):
        (tmp_path / "in" / f"f{n}.txt").write_text(f"text {n}")
    bad, calls = {"f1.txt", "f2.txt"}, []

    def handle(batch):
        names = [r.path.rpartition("/")[2] for r in batch.select("path").collect()]
        calls.extend(names)
        if bad & set(names):
            raise ValueError("no")
        return batch.select("path", "length")

    def run():
        watch.process(watch.watched(spark, str(tmp_path / "in"), "*.txt"), handle, f"{tmp_path}/out", f"{tmp_path}/failed", f"{tmp_path}/c", remove=True).awaitTermination()
        return sorted(r.path.rpartition("/")[2] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    left = lambda: sorted(p.name for p in (tmp_path / "in").glob("*.txt"))
    assert run() == ["f0.txt", "f3.txt"] and left() == ["f1.txt", "f2.txt"]
    bad.remove("f1.txt")
    assert run() == ["f0.txt", "f1.txt", "f3.txt"] and left() == ["f2.txt"]
    (tmp_path / "in" / "f2.txt").unlink()
    (tmp_path / "in" / "f4.txt").write_text("new")
    assert run() == ["f0.txt", "f1.txt", "f3.txt", "f4.txt"] and left() == []
    calls.clear()
    run()
    assert calls == [] and watch._batches(spark, f"{tmp_path}/failed") == []


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"entries": [{"mapping_id": "m1", "source_text": "PT  A", "mock_value": "X"}, {"mapping_id": "m1", "source_text": "B", "mock_value": "Y"}], "counters": {}}')
    (tmp_path / "b.json").write_text('[{"mapping_id": "m2", "source_text": "Straße", "mock_value": "Z", "entity_type": "ORG"}]')
    assert [(r.mapping_id, r.normalized) for r in files.read_dictionary(spark, f"{tmp_path}/a.json").collect()] == [("m1", "pt a")]
    assert files.read_dictionary(spark, f"{tmp_path}/b.json").first().normalized == "strasse"
    (tmp_path / "m.csv").write_text('﻿source_text,other,mock_value\n"A ""x"", B",1,M\nC,2,\n', encoding="utf-8")
    df = files.read_mapping_csv(spark, f"{tmp_path}/m.csv")
    assert [tuple(r) for r in df.collect()] == [('A "x", B', "M"), ("C", "")]
    files.write_mapping_csv(df, f"{tmp_path}/out.csv")
    assert sorted(tuple(r) for r in files.read_mapping_csv(spark, f"{tmp_path}/out.csv").collect()) == [('A "x", B', "M"), ("C", "")]
    files.write_snapshot(df, f"{tmp_path}/snap")
    files.write_snapshot(df.limit(1), f"{tmp_path}/snap")
    assert files.read_snapshot(spark, f"{tmp_path}/snap").count() == 1
    assert files.snapshot_version(spark, f"{tmp_path}/snap") == 2
    with pytest.raises(files.SnapshotConflict):
        files.write_snapshot(df, f"{tmp_path}/snap", based_on=1)
    assert files.read_snapshot(spark, f"{tmp_path}/snap").count() == 1 and files.read_snapshot(spark, f"{tmp_path}/snap", 1).count() == df.count()
    assert len(list((tmp_path / "snap" / "data").iterdir())) == 2
    got = files.recognizers(spark, ["entity: NRIC\npatterns:\n  - name: n\n    pattern: '[A-Z]+'\n    score: 0.9\n  - name: d\n    regex: x\n", "entity: ["])
    assert [tuple(r) for r in got.collect()] == [("NRIC", "n", "[A-Z]+", 0.9), ("NRIC", "d", "x", 0.8)]


def test_privacy_of_sinks(spark, tmp_path):
    nested = spark.sql("select 'r' as request_id, array(named_struct('source_text', 'x')) as rows")
    with pytest.raises(ValueError):
        files.write_audit(nested, f"{tmp_path}/audit")
    files.write_audit(spark.sql("select 'r' as request_id, 1 as n"), f"{tmp_path}/audit")
    assert spark.read.json(f"{tmp_path}/audit").count() == 1
    files.write_audit(spark.sql("select 'r' as request_id, 2 as n union all select 's', 3"), f"{tmp_path}/audit")
    assert sorted(tuple(r) for r in spark.read.json(f"{tmp_path}/audit").select("request_id", "n").collect()) == [("r", 2), ("s", 3)]
    with pytest.raises(ValueError):
        files.write_ledger(spark.sql("select '../r' as request_id, 1 as n"), f"{tmp_path}/ledger")
    files.append_events(spark.sql("select 'e' as event, map('pages', '1', 'raw_text', 'x', 'pii_kind', 'y') as details"), f"{tmp_path}/events")
    assert spark.read.json(f"{tmp_path}/events").select("details.*").columns == ["pages"]
    assert spark.sql("select map('api_key', 'k', 'dpi', '200') as s").select(files.masked_settings(F.col("s"))).first()[0] == {"api_key": "***", "dpi": "200"}


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("pt bank", "bank pt", 1.0), ("abc", "", 0.0), ("abcd", "abxd", 0.75), ("x" * 70, "x" * 69, 2 * 69 / 139)],
)
def test_indel_ratio(spark, a, b, want):
    rows = lambda t: spark.createDataFrame([(1, t)], "id long, text string")
    got = matching.near_names(rows(a), rows(b), 0.3).collect()
    assert [round(r.ratio, 9) for r in got] == ([round(want, 9)] if want else [])


def test_name_predicates(spark):
    check = lambda f, *xs: spark.range(1).select(f(*[F.lit(x) for x in xs])).first()[0]
    assert check(T.is_family_pair, "Fund A", "Fund A - Class B") and not check(T.is_family_pair, "Fund A", "Fund A Plus")
    assert check(T.is_token_subset, "a b", "c b a") and not check(T.is_token_subset, "a d", "c b a")
    assert check(T.strip_generic, "Bank ABC Ltd., Group") == "ABC" and check(T.label_candidate, " N0 Rek: ") == "no rek"
    assert check(T.numeric_or_date, "12 Mei 2020") and not check(T.numeric_or_date, "Mei")


def test_skew_and_blur():
    page = np.full((400, 400), 255, np.uint8)
    page[40:360:20, 40:360] = 0
    page[41:361:20, 40:360] = 0
    assert pixels.skew(page) == 0.0 and pixels.blur_tier(pixels.laplacian_variance(page)) == "good"
    ys, xs = np.nonzero(page == 0)
    turned = np.full((500, 500), 255, np.uint8)
    a = np.radians(4)
    turned[np.round(ys * np.cos(a) + xs * np.sin(a)).astype(int), np.round(xs * np.cos(a) - ys * np.sin(a)).astype(int) + 40] = 0
    assert pixels.skew(turned) == pytest.approx(4, abs=0.35) and pixels.skew(np.full((50, 50), 255, np.uint8)) == 0.0


def test_fuzzy_spans_and_rows():
    assert [s[:2] for s in align.fuzzy_spans("pay Prudentia1 Life now", "Prudential Life", 0.9)] == [(4, 19)]
    assert align.fuzzy_spans("nothing like it here at all", "Prudential Life") == []
    words = pd.DataFrame({"x": [0, 50, 0, 60], "y": [0, 2, 30, 29], "w": [40] * 4, "h": [14] * 4})
    assert align.row_clusters(words) == [[0, 1], [3, 2]]


def test_second_chance_without_corporate_words(spark):
    known = spark.createDataFrame([(1, "Meridian Zenith Bank Ltd", "user"), (2, "Orchid Harbour Group", "auto"), (3, "Fund Alpha", "user")], "id long, text string, assignment_source string")
    names = spark.createDataFrame([(10, "Meridian Zenith"), (11, "Orchid Harbour"), (12, "Fund Alpha - Bank"), (13, None), (14, " ")], "id long, text string")
    assert [tuple(r)[:2] for r in dictionary.fuzzy(names, known).collect()] == []
    got = [(r.id, r.mapping, round(r.ratio, 4)) for r in dictionary.fuzzy(names, known, second_chance=True).collect()]
    assert got == [(10, 1, round(sequential.ratio("Meridian Zenith", "Meridian Zenith Bank Ltd"), 4))]


def test_token_set_ratio(spark):
    rows = [("a b", "b a c"), ("fuzzy bear", "fuzzy bean x"), ("", "x"), (None, None), ("abc", "xyz")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(matching.token_set_ratio(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1.0 and got[2] == got[3] == got[4] == 0.0
    assert got[1] == pytest.approx(max(sequential.ratio("fuzzy bear", "fuzzy bean x"), sequential.ratio("fuzzy", "fuzzy bear"), sequential.ratio("fuzzy", "fuzzy bean x")), abs=0.05)


def test_term_index_loses_no_fuzzy_span(spark):
    rng = random.Random(7)
    letters = "abcde fgh"
    terms = ["".join(rng.choice(letters) for _ in range(n)).strip() or "x" for n in (7, 8, 9, 10, 11, 14, 15, 19, 20, 25, 33, 60) for _ in range(3)]
    texts = [None, "", "short", "ab" * 4]
    for _ in range(250):
        parts = []
        for _ in range(4):
            t = list(rng.choice(terms))
            for _ in range(rng.randrange(0, 3)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(["", "z", "qq"])
            parts += ["".join(t), "".join(rng.choice(letters) for _ in range(rng.randrange(0, 30)))]
        texts.append("".join(parts) + ("\u0130" if rng.random() < 0.2 else ""))
    want = [(i, t, *s) for i, x in enumerate(texts) for t in set(terms) for s in align.fuzzy_spans(x or "", t)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(t, t) for t in set(terms)] + [(None, None)], "item_id string, term string")
    got = [tuple(r) for r in align.fuzzy_terms(docs, items).collect()]
    assert sorted(got) == sorted(want) and len(want) > 100


def _found_in_process(texts, terms, least):
    """What fuzzy_terms finds in one batch of a task, without Spark."""
    scan = align._scan(types.SimpleNamespace(value=align.TermIndex(terms, least)), terms, least)
    return [tuple(r) for b in scan([pd.DataFrame({"doc_id": range(len(texts)), "text": texts})]) for r in b.itertuples(index=False)]


def test_term_index_hands_on_few_windows(monkeypatch):
    docs, items = (pd.read_parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    terms = sorted({" ".join(t.split(" ")[:4]) for t in items["text"]})
    calls, kernel = [], align._lcs
    monkeypatch.setattr(align, "_lcs", lambda *a: calls.append(1) or kernel(*a))
    texts = docs["text"].tolist()[:40]
    _found_in_process(texts, terms, 0.9)
    assert len(calls) < sum(len(t or "") for t in texts) / 100


@pytest.mark.parametrize("least", [1.0, 0.95, 0.8, 0.65])
def test_term_index_loses_nothing_at_other_ratios(least):
    rng = random.Random(11)
    letters = "abcdefghijklmn \u00e9\u4e2d\U0001f600\0"
    terms = sorted({"".join(rng.choice(letters[:-1]) for _ in range(n)) for n in (7, 8, 9, 12, 13, 17, 30, 63, 64, 65, 90) for _ in range(2)} | {"abcdefgh"})
    texts = [None, "", "abXdeXgh", "\0" * 30]
    for _ in range(40):
        parts = []
        for t in rng.sample(terms, rng.randrange(1, 3)):
            t = list(t)
            for _ in range(rng.randrange(0, 2 + int(len(t) * (1 - least)))):
                t[rng.randrange(len(t))] = rng.choice(["", "z", "qq", "\0"])
            parts += ["".join(t), "".join(rng.choice(letters) for _ in range(rng.choice([0, 0, 9])))]
        texts.append("".join(parts))
    want = [(i, t, *s) for i, x in enumerate(texts) for t in terms for s in align.fuzzy_spans(x or "", t, least)]
    assert sorted(_found_in_process(texts, terms, least)) == sorted(want) and len(want) > 10


def test_prose_with_markers_of_their_own(spark):
    text = "dari PT Satu a/n PT Dua, ke Bank a/n Tiga 12 kepada Yth Empat Lima; a/n"
    words = spark.createDataFrame([(1, k, w) for k, w in enumerate(text.split())] + [(2, 0, None)], "doc_id long, word_idx int, text string")
    got = layout.prose_names(words, {"a/n": None, "kepada": "counterparty_org"}, {"dari": "debit_account_name", "ke": "credit_account_name"}).orderBy("word_idx").collect()
    assert [(r.marker, r.name_text, r.field_role) for r in got] == [("a/n", "PT Dua,", "debit_account_name"), ("a/n", "Tiga", "credit_account_name"), ("kepada", "Yth Empat Lima;", "counterparty_org")]


def test_sections_by_phrases(spark):
    lines = ["Debit dari", "PT Satu", "Kredit ke :", "Bank Dua", "debit dari the long line of many more words"]
    words = spark.createDataFrame([(1, n, w) for n, line in enumerate(lines) for w in line.split()], "doc_id long, line_no int, text string")
    got = layout.sections(words, {"debit": ("debit dari", "debit"), "credit": ("kredit ke",)}).orderBy("line_no").collect()
    assert [r.section for r in got] == ["debit", "debit", "credit", "credit", "credit"]


def test_unambiguous_alignment():
    rows = [(1, e, n * 10 + k, t, x, 0, 30, 10, c) for n, (e, c) in enumerate((("rapidocr", 0.9), ("tesseract", 0.8))) for k, (t, x) in enumerate((("ab", 0), ("cd", 60)))]
    pdf = pd.DataFrame(rows, columns=["page_id", "engine", "seq", "text", "x", "y", "w", "h", "conf"])
    pdf.loc[2, "text"] = "aB"
    out = align.align_page(pdf)
    assert out["text"].tolist() == ["aB", "cd"] and out["agreement"].tolist() == [1.0, 1.0]


def test_alignment_of_columns_is_that_of_rows(spark):
    import pyarrow as pa

    rng = random.Random(3)
    for n in range(160):
        wide, high = rng.choice([(60, 40), (300, 30), (2000, 300), (500, 2)])
        rows = [
            (7, rng.choice(["rapidocr", "tesseract", "easyocr"]), rng.randrange(50), rng.choice(["a", " a", "b", "c "]), rng.randrange(-20, wide), rng.randrange(-5, high), rng.choice([0, 3, 20, 25, 60]), rng.choice([0, 8, 10, 14]), rng.randrange(9) / 8)
            for _ in range(rng.choice([1, 2, 7, 40, 400 if n % 8 else 1500]))
        ]
        pdf = pd.DataFrame(rows, columns=["page_id", "engine", "seq", "text", "x", "y", "w", "h", "conf"])
        want, got = align.align_page(pdf), align.align_columns(pa.Table.from_pandas(pdf, preserve_index=False)).to_pandas()
        pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9)
    flat = spark.createDataFrame(pdf)
    nested = flat.groupBy("page_id").agg(F.collect_list(F.struct(*pdf.columns[1:])).alias("r"))
    assert sorted(map(tuple, align.align(nested, "r").collect())) == sorted(map(tuple, align.align(flat).collect()))


def test_labels_and_windows():
    assert sequential.label_windows("A/C Name : PT X A/C N0 1234 Bank BCA".split()) == [(0, 2, "account_name", 1.0), (5, 7, "account_number", 1.0), (8, 9, "bank", 1.0)]
    assert sequential.label_windows("No Jumlah Nama Rekening Bank No Rekening".split())[0][2] == "account_name"
    assert sequential.ratio("pt bank", "bank pt") == 1.0 and sequential.ratio("", "x") == 0.0
    assert sequential.munched([("fund", 0.95), ("fund plus", 0.93), ("fund plus two", 0.8)]) == 1


def test_cells_rows_and_tables():
    cells = [((0, 0, 50, 10), False), ((5, 12, 50, 10), False), ((0, 60, 50, 10), False), ((100, 0, 50, 10), True), ((100, 11, 50, 10), True)]
    assert sequential.merged_cells(cells) == [0, 0, 2, 3, 4]
    rows = [[(0, 0, 40, 10)], [(0, 12, 40, 10)], [(0, 40, 40, 10), (300, 40, 40, 10)]]
    assert sequential.stitched_rows(rows, [(0, 0, 60, 24), (0, 38, 60, 14)]) == [0, 0, 2]
    assert sequential.matched_tables([(0, 0, 10, 10), (0, 0, 10, 9), (50, 50, 5, 5)], [(0, 0, 10, 10), (1, 0, 10, 10)]) == ([0, 1, None], [])
    assert sequential.wraps([(0, 0, 90, 10), (0, 20, 20, 10)], True) and not sequential.wraps([(0, 0, 90, 10), (0, 20, 20, 10)], False)
    assert sequential.wraps([(80, 0, 20, 10), (0, 20, 20, 10)], False) and not sequential.wraps([(0, 0, 9, 9)], True)


def test_growth_and_pictures():
    name = str.istitle
    grown = sequential.spilled([(0, 0, 50, 10)], [((55, 0, 30, 10), "Life"), ((90, 1, 30, 10), "Plus"), ((200, 0, 9, 10), "Far"), ((122, 0, 9, 10), "low")], name)
    assert grown == [(0, 0, 120, 11)]
    assert sequential.spilled([(0, 0, 50, 10)], [((55, 0, 30, 10), "Life")], name, [(0, 0, 52, 12)]) == [(0, 0, 50, 10)]
    assert sequential.reconciled_picture((0, 0, 100, 100), [(0, 0, 100, 20)], False, 10) == (0, 20, 100, 80)
    assert sequential.reconciled_picture((0, 0, 100, 100), [(0, 0, 100, 60)], False, 10) is None
    assert sequential.reconciled_picture((0, 0, 100, 100), [(0, 0, 100, 60)], True, 10) == (0, 0, 100, 100)


def test_terms_are_found_beside_inner_punctuation(spark, tmp_path):
    from inkplane.plans import scalar_queries

    texts = [(1, "pre-information retrieval is a field"), (2, "The end.Information retrieval is a/field"), (3, "misinformation retrieval is a field"), (4, "so ¿? ¡! … – it says")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "information retrieval is a thing"), (8, "¿? ¡! … – it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = scalar_queries.term_spans(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, 7, 4, 30), (2, 7, 8, 34), (4, 8, 3, 12)]


def test_preferred_tables(spark):
    schema = "page_id long, t string, x int, y int, w int, h int"
    bordered = [(1, "a", 0, 0, 100, 100, 90), (1, "b", 0, 0, 100, 100, 90), (1, "c", 0, 0, 100, 100, 20), (1, "d", 0, 500, 100, 100, None), (1, "e", 0, 0, None, None, 5), (2, "a", 0, 0, 100, 100, 50)]
    implied = [(1, "p", 0, 5, 100, 100), (1, "q", 0, 9, 100, 100), (1, "r", 0, 12, 100, 100), (1, "s", 300, 0, 10, 10), (3, "p", 0, 0, 9, 9)]
    make = lambda rows, more="": spark.createDataFrame(rows, schema + more)
    got = sorted(tuple(r) for r in pages.preferred_tables(make(bordered, ", tallest int"), make(implied), "t").collect())
    # c keeps its own rows though it claims r; d has no counterpart, e no box, page 2 nothing implied.
    want = [(1, "bordered", "c"), (1, "bordered", "d"), (1, "bordered", "e"), (1, "implied", "p"), (1, "implied", "q"), (1, "implied", "s"), (2, "bordered", "a"), (3, "implied", "p")]
    assert got == want
    assert pages.preferred_tables(make([], ", tallest int"), make([]), "t").count() == 0
    assert pages.preferred_tables(make([], ", tallest int"), make(implied), "t").count() == len(implied)


def test_label_values(spark):
    pages_ = {
        1: ["Debit dari", "A/C Name : PT Satu Dua", "A/C No : 111", "Kredit ke", "A/C N0 : 222", "Nama Rekening : PT Tiga", "A/C No : 333", "Bank : Niaga", "Bank : 12/03/2024"],
        2: ["Kepada", "Kepada", "Kepada :", "Bank : Empat", "Up : PT Lima", "A/C Name : PT Enam"],
        3: ["A/C Name", "PT Tujuh", "Kepada"],
    }
    words = [(p, r, k, t) for p, rows in pages_.items() for r, line in enumerate(rows) for k, t in enumerate(line.split())]
    words = spark.createDataFrame([*words, (3, 1, 9, None)], "doc_id int, row_no int, row_pos int, text string")
    got = {(r.doc_id, r.row_no, r.row_pos): (r.value, r.field_role, r.account_number) for r in labels.label_values(words).collect()}
    assert got == {
        (1, 1, 3): ("PT Satu Dua", "debit_account_name", "111"),
        (1, 5, 3): ("PT Tiga", "credit_account_name", "222"),
        (1, 7, 2): ("Niaga", "bank_name", None),
        (2, 1, 0): ("Kepada", "counterparty_org", None),
        (2, 3, 0): ("Bank : Empat", "counterparty_org", None),
        (2, 4, 2): ("PT Lima", "counterparty_org", None),
        (2, 5, 3): ("PT Enam", "counterparty_org", None),
    }
    some = labels.label_values(words, spark.createDataFrame([(2, 0), (2, 1)], "doc_id int, row_no int")).filter("doc_id = 2")
    assert sorted(r.row_no for r in some.collect()) == [3, 4, 5]
    assert labels.label_values(words.limit(0)).count() == 0


def test_rows_of_stand_ins_read_like_rows(spark):
    rng = random.Random(5)
    pieces = ["a/c", "A/C", "name", "Nama", "rekening", "rekenlng", "N0", "No", "no.", ":", "-", "bank", "Banking", "12", "0158", "88bank8", "debit", "dari", "Kredlt", "ke", "to", "t0", "attn", "PT", "Zenith", "fund", "fu nd", "\u00e4ccount", "", "x1y2", "account", "number", "xq", "~"]
    rows = [[rng.choice(pieces) for _ in range(rng.randrange(1, 8))] for _ in range(3000)]
    for r in rows:
        assert labels._once(labels._row_kind, tuple(map(labels.stand_in, r))) == labels._row_kind(r)
        words = " ".join(r).split()
        assert labels._once(labels._hits, tuple(map(labels.stand_in, words))) == labels._hits(words)
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "r array<string>").coalesce(1).select(F.arrow_udf(labels._kinds, "kind string, at int, ratio double")("r")).collect()]
    assert [tuple(g) for g in got] == [labels.row_kind(r) for r in rows]


def test_letters_cost_no_reading_each(spark, tmp_path, monkeypatch):
    from inkplane.plans import composite_queries

    # Numbers of letters are alike to a label: rows that differ in them only are looked at once.
    calls = []
    monkeypatch.setattr(labels, "label_windows", lambda tokens, *more: calls.append(tokens) or sequential.label_windows(tokens, *more))
    labels._seen_rows.clear()
    import pyarrow as pa

    out = labels._line_hits(pa.array([f"A/C No : {n}" for n in range(5000)] + [None]))
    assert len(calls) == 1 and out[0].as_py() == out[4999].as_py() == [{"start": 0, "stop": 2, "label": "account_number", "ratio": 1.0}] and out[5000].as_py() is None
    spark.createDataFrame([(None,), (7,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = composite_queries.label_hits(spark, str(tmp_path)).filter("o_orderkey IS NULL").collect()
    assert sorted((r.line_no, r.start, r.stop, r.label) for r in got) == [(1, 0, 1, "bank"), (2, 0, 2, "account_number"), (3, 0, 2, "account_name"), (4, 0, 2, "account_name"), (4, 2, 4, "account_number")]


def test_column_groups(spark):
    rows = [
        (1, 0, "bank_name", 10, 10, 40, 10, 1, 10.0), (1, 1, "bank_name", 12, 22, 30, 10, 2, 10.0), (1, 2, "bank_name", 10, 36, 40, 10, 2, 10.0),  # a chain of small gaps
        (1, 3, "bank_name", 200, 10, 40, 10, 1, 10.0),  # another column
        (1, 4, "counterparty_org", 10, 22, 30, 10, 1, 10.0),  # another role
        (1, 5, "bank_name", 10, 100, 40, 10, 3, 10.0), (1, 6, "bank_name", 10, 112, 40, 10, 1, 10.0), (1, 7, "bank_name", 12, 106, 40, 10, 5, 10.0),  # 7 overlaps both by height
        (2, 0, "bank_name", 10, 10, 0, 10, 1, 10.0), (2, 1, "bank_name", 10, 12, 0, 10, 1, 10.0),
    ]
    finds = spark.createDataFrame(rows, "page_id int, k int, field_role string, x int, y int, w int, h int, n_words int, height double")
    got = {(r.page_id, r.k): r.group for r in labels.column_groups(finds, "k").collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 0, (1, 3): 3, (1, 4): 4, (1, 5): 5, (1, 6): 5, (1, 7): 5, (2, 0): 0, (2, 1): 1}
    assert labels.column_groups(finds.limit(0), "k").count() == 0
