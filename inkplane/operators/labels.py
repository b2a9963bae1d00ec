"""Values that stand beside or below labels in the rows of pages, and parts of one value in a column."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkplane.functions import text as T
from inkplane.functions import vocab as V
from inkplane.operators.sequential import LABEL_GROUPS, _groups, as_label, label_windows, ratio

#: Words of a row at most that opens a section, or that names an addressee.
SECTION_WORDS, ADDRESSEE_WORDS = 6, 4
#: Rows between a name and its number at most; how sure the row below a bare addressee label is.
NUMBER_ROWS, BELOW = 3, 0.7
SECTIONS = {"debit": V.DEBIT_SECTION_LABELS, "credit": V.CREDIT_SECTION_LABELS}


def row_kind(tokens: list[str]) -> tuple[str | None, int, float]:
    """(kind, where its value starts, ratio) of a row: a section, the group of its first label, an addressee, or None."""
    tokens = list(tokens)

    def first(groups: dict, least: float, last: int) -> tuple[int, int, str, float] | None:
        return next(iter(label_windows(tokens, groups, least, last)), None)

    if len(tokens) <= SECTION_WORDS:
        for side, labels in SECTIONS.items():
            if first({side: labels}, 0.78, 2):
                return side, len(tokens), 1.0
    found = first(LABEL_GROUPS, 0.72, 3)
    if found is None and len(tokens) <= ADDRESSEE_WORDS:
        found = first({"addressee": V.ADDRESSEE_LABELS}, 0.78, 1)
    if found is None:
        return None, 0, 0.0
    at = found[1]
    while at < len(tokens) and not tokens[at].strip(" :.-"):
        at += 1
    return found[2], at, found[3]


#: Words of all labels, and their letters; a token less like each of them than LIKE is in no window that is a label.
LABEL_WORDS = sorted({q for labels in (*LABEL_GROUPS.values(), *SECTIONS.values(), V.ADDRESSEE_LABELS) for p in labels for q in p.split()})
LIKE, CACHED = 0.55, 200_000
_OTHER = {c: "\0" for c in range(128) if chr(c) not in "".join(LABEL_WORDS)}
_seen_words: dict[str, bool] = {}
_seen_rows: dict[tuple, object] = {}


def stand_in(token: str) -> str:
    """The token, if a label may hold it, else one that stands for all others that say, or say not, something."""
    if not (token.isascii() and token.isdigit()):
        word = as_label(token)
        if len(word.split()) > 1:
            return token
        key = word.translate(_OTHER)  # letters of no label are alike to a ratio
        like = _seen_words.get(key)
        if like is None:
            if len(_seen_words) >= CACHED:
                _seen_words.clear()
            like = _seen_words[key] = any(ratio(word, q) >= LIKE for q in LABEL_WORDS)
        if like:
            return token
    return "0" if token.strip(" :.-") else ":"


def _once(find, tokens: tuple[str, ...]):
    """What ``find`` says of a row of stand-ins, looked for once."""
    key = (find, tokens)
    if key not in _seen_rows:
        if len(_seen_rows) >= CACHED:
            _seen_rows.clear()
        _seen_rows[key] = find(list(tokens))
    return _seen_rows[key]


def _taken(results: list, kind: pa.DataType, which) -> pa.Array:
    """An array of results, each converted once."""
    known: dict[str, int] = {}
    at = pa.array([known.setdefault(repr(r), len(known)) for r in results], pa.int32())
    first = {k: r for r, k in zip(reversed(results), reversed(at.to_pylist()), strict=True)}
    return pa.array([first[k] for k in range(len(known))], kind).take(at.take(which))


HITS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("label", pa.string()), ("ratio", pa.float64())]))
KINDS = pa.struct([("kind", pa.string()), ("at", pa.int32()), ("ratio", pa.float64())])


def _hits(tokens: list[str]) -> list[dict]:
    return [dict(zip(("start", "stop", "label", "ratio"), hit, strict=True)) for hit in label_windows(tokens)]


def _row_kind(tokens: list[str]) -> dict:
    return dict(zip(("kind", "at", "ratio"), row_kind(tokens), strict=True))


def _line_hits(lines: pa.Array) -> pa.Array:
    lines = lines.dictionary_encode()
    return _taken([_once(_hits, tuple(map(stand_in, line.split()))) for line in lines.dictionary.to_pylist()], HITS, lines.indices)


def line_hits(line: Column) -> Column:
    """The label windows of a line, words being parted by white space; a null line has none."""
    return F.arrow_udf(_line_hits, "array<struct<start: int, stop: int, label: string, ratio: double>>")(line)


def _kinds(rows: pa.Array) -> pa.Array:
    ends = np.cumsum([0, *rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)])
    words = rows.flatten().dictionary_encode()
    stands = list(map(stand_in, words.dictionary.to_pylist()))
    code = {t: k for k, t in enumerate(dict.fromkeys(stands))}
    texts, size = list(code), 4
    codes = np.array([code[t] for t in stands], np.int32)[words.indices.to_numpy()].tobytes()
    known: dict[bytes, int] = {}
    ends = (ends * size).tolist()
    which = [known.setdefault(codes[a:b], len(known)) for a, b in zip(ends, ends[1:])]
    return _taken([_once(_row_kind, tuple(texts[c] for c in np.frombuffer(k, np.int32))) for k in known], KINDS, pa.array(which, pa.int32()))


def label_values(words: DataFrame, skip: DataFrame | None = None, page: str = "doc_id", row: str = "row_no", pos: str = "row_pos") -> DataFrame:
    """(page, row, pos, value, field_role, confidence, account_number): names, banks and addressees by their labels.

    Of words(page, row, pos, text), each row's first label tells what the rest of the row is. A name's role is that of
    the section it stands in, a counterparty's outside; its number is the nearest of its section within NUMBER_ROWS
    rows, the upper on ties. A bare addressee label makes the row below its value, whatever that says. Values that are
    blank, numbers or dates are dropped. ``pos`` is that of the value's first word. Rows of ``skip`` (page, row) are
    left out, such as table headers. Null words are not read; a null page is a page; an empty table gives no rows.
    """
    if skip is not None:
        here = words.alias("w").join(skip.select(F.col(page).alias("_p"), F.col(row).alias("_r")), F.col(page).eqNullSafe(F.col("_p")) & (F.col(row) == F.col("_r")), "left_anti")
    else:
        here = words
    lines = here.filter(F.col("text").isNotNull()).groupBy(page, row).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("text").alias("t")))).alias("_w"))
    return line_values(lines, "_w", page, row, pos)


def line_values(lines: DataFrame, words: str, page: str = "doc_id", row: str = "row_no", pos: str = "row_pos") -> DataFrame:
    """``label_values`` of lines(page, row, words), one for each page and row, with an array of p and t, ascending, not null.

    The lines of a page meet in one task, by one shuffle; rows are whole numbers.
    """
    kinds = F.arrow_udf(_kinds, "kind string, at int, ratio double")
    lines = lines.select(page, row, F.col(words).alias("_w"), kinds(F.col(f"{words}.t")).alias("_k"))

    down = Window.partitionBy(page).orderBy(row)
    so_far = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bare = (F.col("_k.kind") == "addressee") & (F.col("_k.at") == F.size("_w"))
    lines = lines.withColumn("_bare", F.coalesce(bare, F.lit(False)))
    chained = F.coalesce(F.lag("_bare").over(down) & (F.lag(row).over(down) == F.col(row) - 1), F.lit(False))
    # Of bare labels in a row, every second one is the value of the one above it.
    above = F.col(row) - F.last(F.when(~chained, F.col(row)), ignorenulls=True).over(so_far)
    lines = lines.withColumn("_below", above % 2 == 1)
    lines = lines.withColumn("_section", F.last(F.when(~F.col("_below") & F.col("_k.kind").isin(*SECTIONS), F.col("_k.kind")), ignorenulls=True).over(so_far))

    def own(below: Column, field: str) -> Column:
        return F.when(F.col("_below"), below).otherwise(F.col(f"_k.{field}"))

    events = lines.select(page, row, "_section", "_w", own(F.lit("addressee"), "kind").alias("_kind"), own(F.lit(0), "at").alias("_at"), own(F.lit(BELOW), "ratio").alias("_ratio"))
    rest = F.expr("slice(_w, _at + 1, size(_w))")
    events = events.filter(F.col("_kind").isin("addressee", *LABEL_GROUPS)).withColumn("_w", rest).withColumn("value", F.trim(F.array_join("_w.t", " ")))

    name = F.col("_kind") == "account_name"
    number = F.when(F.col("_kind") == "account_number", F.struct(F.col("_section").alias("s"), F.col(row).alias("r"), F.col("value").alias("number")))
    events = events.withColumn("_number", number)
    # Rows are whole numbers and differ within a page, so so many neighbours hold all that are near enough.
    beside = [f("_number", k).over(down) for f in (F.lag, F.lead) for k in range(1, NUMBER_ROWS + 1)]
    events = events.withColumn("_numbers", F.array(*beside))
    kept = events.filter((F.col("_kind") != "account_number") & (F.size("_w") > 0) & ~T.numeric_or_date(F.col("value")))
    near = F.filter("_numbers", lambda n: n["s"].eqNullSafe(F.col("_section")) & (F.abs(n["r"] - F.col(row)) <= NUMBER_ROWS))
    nearest = F.array_min(F.transform(near, lambda n: F.struct(F.abs(n["r"] - F.col(row)).alias("far"), n["r"].alias("r"), n["number"].alias("number"))))["number"]
    side = F.when(F.col("_section") == "debit", "debit_account_name").when(F.col("_section") == "credit", "credit_account_name").otherwise("counterparty_org")
    role = F.when(name, side).when(F.col("_kind") == "bank", "bank_name").otherwise("counterparty_org")
    return kept.select(page, row, F.get("_w.p", F.lit(0)).alias(pos), "value", role.alias("field_role"), F.round("_ratio", 4).alias("confidence"), F.when(name & (nearest != ""), nearest).alias("account_number"))


def column_groups(finds: DataFrame, key: str, page: str = "page_id") -> DataFrame:
    """(page, key, group): which finds of a page are parts of one value, ``group`` being the smallest key among them.

    Finds(page, key, field_role, x, y, w, h, n_words, height), height being the mean of their words', hang together, one
    through another, if they have one role, share half of the narrower's width, and either share 40 % of the lower's
    height, or have two words at most each and a gap of a fifth of their mean heights, 4 at least, or less. Keys are told
    apart within a page; boxes without width share none; an empty table gives no rows. The finds of one page and role
    are grouped in one task.
    """

    def group(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key)
        rows = list(part[["x", "y", "w", "h", "n_words", "height"]].itertuples(index=False))
        links = [(i, j) for j in range(len(rows)) for i in range(j) if _one_value(rows[i], rows[j])]
        keys = part[key].tolist()
        return pd.DataFrame({page: part[page].to_numpy(), key: keys, "group": [keys[r] for r in _groups(len(rows), links)]})

    kinds = {c: finds.schema[c].dataType.simpleString() for c in (page, key)}
    return finds.groupBy(page, "field_role").applyInPandas(group, f"{page} {kinds[page]}, {key} {kinds[key]}, group {kinds[key]}")


def _one_value(a: tuple, b: tuple) -> bool:
    ax, ay, aw, ah, an, am = a
    bx, by, bw, bh, bn, bm = b
    wide, high = min(ax + aw, bx + bw) - max(ax, bx), min(ay + ah, by + bh) - max(ay, by)
    if min(aw, bw) <= 0 or wide < 0.5 * min(aw, bw):
        return False
    beside = max(an, bn) <= 2 and -high <= max(4, 0.2 * (am + bm) / 2)
    return beside or (min(ah, bh) > 0 and high >= 0.4 * min(ah, bh))
