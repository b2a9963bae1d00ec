"""Operators on a dictionary of names: resolution, import, merging, cleaning, votes and collisions.

Names come as (id, text), dictionaries as (id, text, assignment_source) unless said otherwise. Blank names match nothing;
null ids and texts are never matched; empty tables give no rows; columns that are not named are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkplane.functions import text as T
from inkplane.functions import vocab as V
from inkplane.operators import matching as M


def fuzzy(names: DataFrame, known: DataFrame, second_chance: bool = False) -> DataFrame:
    """(id, mapping, ratio): the best entry over the threshold of how it was assigned, the smallest id on ties.

    With a second chance, users' entries also count that reach STRIPPED_RATIO once corporate words are taken off both
    sides, if enough is left of both and a hyphen does not set them apart; ratios are those of the whole names.
    """
    source = known.select(F.col("id").alias("r_id"), "assignment_source")
    pairs = M.near_names(names, known, min(V.AUTO_RATIO, V.USER_RATIO)).join(source, "r_id")
    found = pairs.filter(F.col("ratio") >= F.when(F.col("assignment_source") == "user", V.USER_RATIO).otherwise(V.AUTO_RATIO)).select("l_id", "r_id", "ratio")
    if second_chance:
        bare = lambda df: df.select("id", T.strip_generic(F.col("text")).alias("text"))
        again = M.near_names(bare(names), bare(known.filter("assignment_source = 'user'")), V.STRIPPED_RATIO)
        again = again.filter((F.length("l_text") >= V.STRIPPED_LEAST) & (F.length("r_text") >= V.STRIPPED_LEAST)).select("l_id", "r_id")
        whole = again.join(names.select(F.col("id").alias("l_id"), F.col("text").alias("a")), "l_id").join(known.select(F.col("id").alias("r_id"), F.col("text").alias("b")), "r_id")
        whole = whole.filter(~T.is_family_pair(F.col("a"), F.col("b"))).select("l_id", "r_id", M.token_sort_ratio(F.col("a"), F.col("b")).alias("ratio"))
        found = found.unionByName(whole).distinct()
    best = M.best_of(found, ["r_id", "ratio"], F.col("ratio"), "r_id")
    return best.select(F.col("l_id").alias("id"), F.col("r_id").alias("mapping"), "ratio")


def unambiguous(names: DataFrame, known: DataFrame) -> DataFrame:
    """(id, mapping, ratio): the best entry where it leads by UNAMBIGUOUS_MARGIN all but those whose words contain, or lie in, its own."""
    pairs = M.near_names(names, known, V.UNAMBIGUOUS_RATIO)
    best = M.best_of(pairs, ["r_id", "r_text", "ratio"], F.col("ratio"), "r_id").select("l_id", F.col("r_id").alias("mapping"), F.col("r_text").alias("winner"), F.col("ratio").alias("top"))
    rivals = pairs.join(best.select("l_id", "mapping", "winner"), "l_id").filter((F.col("r_id") != F.col("mapping")) & ~T.is_token_subset(F.col("r_text"), F.col("winner")))
    second = rivals.groupBy("l_id").agg(F.max("ratio").alias("second"))
    clear = best.join(second, "l_id", "left").filter(F.round(F.col("top") - F.coalesce("second", F.lit(0.0)), 9) >= V.UNAMBIGUOUS_MARGIN)
    return clear.select(F.col("l_id").alias("id"), "mapping", F.col("top").alias("ratio"))


def resolve(names: DataFrame, known: DataFrame, second_chance: bool = False) -> DataFrame:
    """(text, mapping, how, new_label, hits) of each distinct name against a dictionary as it stands.

    Equal text counts first, then likeness; what is left gets mapping -1 and a label derived from the name.
    """
    read = names.groupBy("text").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("hits"))
    exact = read.join(known.groupBy("text").agg(F.min("id").alias("exact")), "text", "left")
    near = fuzzy(exact.filter("exact is null").select("id", "text"), known, second_chance).select("id", F.col("mapping").alias("fuzzy"))
    out = exact.join(near, "id", "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("fuzzy").isNotNull(), "fuzzy").otherwise("created")
    return out.select("text", F.coalesce("exact", "fuzzy", F.lit(-1)).alias("mapping"), how.alias("how"), F.when(how == "created", T.auto_label(F.col("text"))).alias("new_label"), "hits")


def restricted(hits: DataFrame, known: DataFrame, second_chance: bool = False) -> DataFrame:
    """(id, text, mapping, how) of hits(id, text, anchored, custom) under the policy that only known names are covered.

    A hit is kept if it is in the dictionary, by text or likeness; if a field label anchors it and one entry is
    unambiguously nearest; or if it is a custom term, which always resolves, as created where nothing is known.
    """
    named = hits.join(resolve(hits.select("id", "text"), known, second_chance).select("text", "mapping", "how"), "text")
    left = named.filter((F.col("how") == "created") & F.col("anchored")).groupBy("text").agg(F.min("id").alias("id"))
    clear = left.join(unambiguous(left.select("id", "text"), known).select("id", F.col("mapping").alias("near")), "id").select("text", "near")
    out = named.join(clear, "text", "left").withColumn("near", F.when(F.col("anchored"), F.col("near")))
    out = out.filter((F.col("how") != "created") | F.col("near").isNotNull() | F.col("custom"))
    how = F.when((F.col("how") == "created") & F.col("near").isNotNull(), "unambiguous").otherwise(F.col("how"))
    return out.select("id", "text", F.when(F.col("how") == "created", F.coalesce("near", F.lit(-1))).otherwise(F.col("mapping")).alias("mapping"), how.alias("how"))


def judged_imports(rows: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """rows(source_text, mock_value) with norm and the reason for which each is refused, null if it enters.

    Rows enter in ``order``, unless a text is blank or its normal form is in ``known`` (norm) or came before.
    """
    here = known.select("norm").distinct().withColumn("known", F.lit(True))
    rows = rows.withColumn("norm", T.normalized(F.col("source_text"))).join(here, "norm", "left")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    rows = rows.withColumn("reason", F.when(blank("source_text"), "missing_source_text").when(blank("mock_value"), "missing_mock_value").when(F.col("known"), "existing_mapping"))
    nth = F.row_number().over(Window.partitionBy("norm", F.col("reason").isNull()).orderBy(*order))
    return rows.withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason")).when(nth > 1, "existing_mapping")).drop("known")


def merged(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """(key, mock_value, outcome, assignment_source) after changes(key, op, new_value) to current(key, mock_value, assignment_source).

    op is insert, override or delete; overrides and deletions of what is not there do nothing. One change a key.
    """
    m = current.select(key, "mock_value", "assignment_source", F.lit(True).alias("here")).join(changes, key, "full")
    here, o = F.col("here").isNotNull(), F.col("op")
    value = F.when(o == "delete", F.lit(None)).when(o.isNotNull() & (here | (o == "insert")), F.col("new_value")).otherwise(F.col("mock_value"))
    outcome = F.when(o.isNull(), "kept").when(~here & (o != "insert"), "not_found").when(o == "delete", "deleted").when(~here, "created").otherwise("updated")
    source = F.when(o.isNotNull() & (o != "delete"), "user").otherwise(F.col("assignment_source"))
    return m.select(key, value.alias("mock_value"), outcome.alias("outcome"), source.alias("assignment_source"))


def deduplicated(rows: DataFrame, order: str, placeholder: str = V.PLACEHOLDER) -> DataFrame:
    """(key, source_text, mock_value, n_rows, needs_review): one mapping for each loose key, real values before placeholders."""
    rows = rows.withColumn("key", T.loose_key(F.col("source_text"))).withColumn("placeholder", F.col("mock_value").rlike(placeholder))
    by, n = F.struct("placeholder", order), F.count(F.lit(1))
    return rows.groupBy("key").agg(F.min_by("source_text", by).alias("source_text"), F.min_by("mock_value", by).alias("mock_value"), n.alias("n_rows"), ((F.min("placeholder") == F.max("placeholder")) & (n > 1)).alias("needs_review"))


def voted(readings: DataFrame, group: str, seq: str, kind: Column, agreed: float = 0.67) -> DataFrame:
    """(group, value, score): the most frequent text of readings(group, seq, text, conf), the first on ties.

    Social security numbers are compared in their dashed form. A value is emitted if it is valid for its kind, or if
    enough agree; the score weighs agreement, validity and mean confidence at 0.5, 0.3 and 0.2.
    """
    digits = F.regexp_replace("text", "[^0-9]", "")
    dashed = F.when(kind.isin("SSN", "US_SSN") & (F.length(digits) == 9), F.regexp_replace(digits, "^(...)(..)(....)$", "$1-$2-$3")).otherwise(F.col("text"))
    counted = readings.withColumn("text", dashed).groupBy(group, "text").agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("first"), F.sum("conf").alias("c"))
    out = counted.groupBy(group).agg(F.max_by("text", F.struct("n", -F.col("first"))).alias("text"), (F.max("n") / F.sum("n")).alias("agreement"), (F.sum("c") / F.sum("n")).alias("conf"))
    valid = T.is_valid(kind, F.col("text"))
    score = 0.5 * F.col("agreement") + 0.3 * valid.cast("int") + 0.2 * F.col("conf")
    return out.select(group, F.when(valid | (F.col("agreement") >= agreed), F.col("text")).alias("value"), F.round(score, 4).alias("score"))


def collisions(items: DataFrame) -> DataFrame:
    """(a_id, b_id) of names items(id, text) whose words contain one another, but for those that a hyphen sets apart on purpose.

    Names meet on their least frequent word, so a word that all share brings nobody together.
    """
    words = items.select("id", "text", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rare = words.join(counts, "word").groupBy("id", "text").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    # The smaller of two word sets is found by its rarest word among all words of the larger.
    a, b = rare.select(F.col("id").alias("s_id"), F.col("text").alias("s"), "word"), words.select(F.col("id").alias("b_id"), F.col("text").alias("b"), "word")
    inside = F.size(F.array_except(T.tokens(F.col("s")), T.tokens(F.col("b")))) == 0
    pairs = a.join(b, "word").filter((F.col("s_id") != F.col("b_id")) & (F.col("s") != F.col("b")) & inside & ~T.is_family_pair(F.col("s"), F.col("b")))
    return pairs.select(F.least("s_id", "b_id").alias("a_id"), F.greatest("s_id", "b_id").alias("b_id")).distinct()


def reported(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """Collisions (a_id, b_id) without aliases: those whose entries(id, mock_value) stand for one value."""
    a, b = entries.select(F.col("id").alias("a_id"), F.col("mock_value").alias("_a")), entries.select(F.col("id").alias("b_id"), F.col("mock_value").alias("_b"))
    return pairs.join(a, "a_id").join(b, "b_id").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("a_id", "b_id")
