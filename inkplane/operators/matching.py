"""Joins of names by likeness: blocked, exact, and native."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkplane.functions import text as T


def near_names(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs (l_id, l_text, r_id, r_text, ratio) of token-sort ratio ``least`` or more.

    LCS is at most the shorter length, so a ratio of t bounds the lengths' quotient by t / (2 - t). Distinct keys meet
    on each length that the bound allows, an equi-join that loses no pair, and are then verified.
    """
    sides = []
    for df, p in ((left, "l"), (right, "r")):
        sides.append(df.select(F.col("id").alias(f"{p}_id"), F.col("text").alias(f"{p}_text"), T.sorted_tokens(F.col("text")).alias(f"{p}_key")).filter(f"{p}_key <> ''"))
    a, b = sides
    # Distinct keys only: names that occur often are compared once.
    ka, kb = a.select("l_key").distinct(), b.select("r_key").distinct()
    n, q = F.length("l_key"), least / (2 - least)
    lengths = F.sequence(F.ceil(n * q - 1e-9).cast("int"), F.floor(n / q + 1e-9).cast("int"))
    right = kb.withColumn("n", F.length("r_key"))
    left = ka.select("l_key", F.explode(lengths).alias("n"))
    # A text's characters are bits of a long; dictionary names beyond that go through integers of any size.
    short = left.join(right.filter("n <= 62").withColumn("masks", T.char_masks(F.col("r_key"))), "n").withColumn("ratio", T.indel_ratio(F.col("masks"), F.col("n"), F.col("l_key"))).drop("masks", "n")
    slow = F.pandas_udf(_ratios, "double")
    long = left.join(right.filter("n > 62"), "n").drop("n").withColumn("ratio", slow("l_key", "r_key"))
    pairs = short.unionByName(long).filter(F.col("ratio") >= least)
    return pairs.join(a, "l_key").join(b, "r_key").select("l_id", "l_text", "r_id", "r_text", "ratio")


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    """Indel ratios, bit-parallel over integers."""

    def ratio(x: str, y: str) -> float:
        masks: dict[str, int] = {}
        for i, ch in enumerate(x):
            masks[ch] = masks.get(ch, 0) | 1 << i
        v = full = (1 << len(x)) - 1
        for ch in y:
            m = masks.get(ch, 0)
            v = ((v + (v & m)) | (v & ~m)) & full
        return 2.0 * (len(x) - v.bit_count()) / (len(x) + len(y)) if x or y else 0.0

    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)])


def token_sort_ratio(a: Column, b: Column) -> Column:
    """The Indel ratio of both sides' sorted words; 0 where one is blank or null."""
    x, y = T.sorted_tokens(F.coalesce(a, F.lit(""))), T.sorted_tokens(F.coalesce(b, F.lit("")))
    return F.when((x != "") & (y != ""), F.pandas_udf(_ratios, "double")(x, y)).otherwise(F.lit(0.0))


def token_set_ratio(a: Column, b: Column) -> Column:
    """1 where the words of one side, some of which are common, all stand on the other; else the best ratio among the
    common words and these with what either side has besides; 0 where one side is blank or null."""
    x, y = (F.array_distinct(T.tokens(F.coalesce(c, F.lit("")))) for c in (a, b))
    text = lambda c: F.array_join(F.array_sort(c), " ")
    common = text(F.array_intersect(x, y))
    more = [F.trim(F.concat_ws(" ", common, text(F.array_except(p, q)))) for p, q in ((x, y), (y, x))]
    ratio = F.pandas_udf(_ratios, "double")
    best = F.greatest(ratio(more[0], more[1]), *[F.when(common != "", ratio(common, m)).otherwise(F.lit(0.0)) for m in more])
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).when(T.is_token_subset(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))), F.lit(1.0)).otherwise(best)


def best_of(pairs: DataFrame, payload: list[str], score: Column, order: str) -> DataFrame:
    """The row of the greatest score for each l_id, the smallest ``order`` on ties."""
    return pairs.groupBy("l_id").agg(F.max_by(F.struct(*payload), F.struct(score.alias("s"), (-F.col(order)).alias("o"))).alias("best")).select("l_id", "best.*")


def _runs(text: Column) -> Column:
    return F.split(text, "[^A-Za-z0-9]+")


def sharing_a_word(docs: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """(doc_id, item_id, term) of docs(doc_id, text) and terms(item_id, term), the pairs in which the term may occur.

    A term stands in a text as a whole, so its longest run of A-Z, a-z and 0-9 is a run there too, whatever stands
    around it. Letters that only lower-casing makes plain count either way. Terms without a run meet every text.
    """
    longest = F.array_max(F.transform(F.filter(_runs(F.lower("term")), lambda w: w != ""), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    terms = terms.withColumn("word", longest)
    in_doc = F.array_union(F.transform(_runs(F.col(text)), F.lower), _runs(F.lower(text)))
    met = docs.select("doc_id", F.explode(in_doc).alias("word")).filter("word <> ''").join(terms, "word").select("doc_id", "item_id", "term")
    return met.unionByName(docs.select("doc_id").crossJoin(terms.filter("word IS NULL").select("item_id", "term"))).distinct()
