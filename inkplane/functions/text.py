"""String and similarity functions, as expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkplane.functions import vocab as V


def fold(x: Column) -> Column:
    """Lower case with the sharp s written out, as case folding has it."""
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def normalized(x: Column) -> Column:
    """Folded, white space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(fold(x), r"\s+", " "))


def loose_key(x: Column) -> Column:
    """Folded, everything but a-z and 0-9 collapsed to single spaces."""
    return F.trim(F.regexp_replace(fold(x), r"[^a-z0-9]+", " "))


def tokens(x: Column) -> Column:
    return F.filter(F.split(x, r"\s+"), lambda t: t != "")


def sorted_tokens(x: Column) -> Column:
    return F.array_join(F.array_sort(tokens(x)), " ")


def char_masks(a: Column) -> Column:
    """For each character of a, of 62 characters at most, the places where it stands, as a map to bits."""
    chars = F.filter(F.split(a, ""), lambda c: c != "")

    def bits(ch: Column) -> Column:
        return F.struct(ch, F.aggregate(F.transform(chars, lambda c, i: F.when(c == ch, F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y)))

    return F.map_from_entries(F.transform(F.array_distinct(chars), bits))


def lcs_length(masks: Column, n: Column, b: Column) -> Column:
    """Length of the longest common subsequence of b and a text of n characters with these masks, bit-parallel."""
    full = (F.pow(F.lit(2.0), n) - 1).cast("long")

    def step(v: Column, ch: Column) -> Column:
        m = F.coalesce(F.try_element_at(masks, ch), F.lit(0).cast("long"))
        return (v + v.bitwiseAND(m)).bitwiseOR(v.bitwiseAND(F.bitwise_not(m))).bitwiseAND(full)

    return n - F.bit_count(F.aggregate(F.split(b, "(?!$)"), full, step))


def indel_ratio(masks: Column, n: Column, b: Column) -> Column:
    """2 * LCS / (|a| + |b|)."""
    return 2.0 * lcs_length(masks, n, b) / (n + F.length(b))


def is_token_subset(a: Column, b: Column) -> Column:
    """Whether the tokens of one side all occur on the other, and there are any."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    some = F.size(F.array_intersect(x, y)) > 0
    return some & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))


def is_family_pair(a: Column, b: Column) -> Column:
    """Whether the longer continues the shorter by a hyphen and more."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (short != long) & F.startswith(long, short) & F.substr(long, F.length(short) + 1).rlike(r"^\s*-\s*\S")


def strip_generic(x: Column) -> Column:
    """The tokens that are not corporate boilerplate, judged without commas and stops at their ends."""
    return F.array_join(F.filter(tokens(x), lambda t: ~F.lower(F.btrim(t, F.lit(".,"))).isin(*V.GENERIC_ORG_TOKENS)), " ")


def label_candidate(x: Column) -> Column:
    """A label as read: ends trimmed, lower case, look-alike digits as letters unless digits prevail."""
    bare = F.lower(F.btrim(x, F.lit(" :.-")))
    digits = F.length(F.regexp_replace(bare, r"[^0-9]", ""))
    return F.when(digits * 2 <= F.length(bare), F.translate(bare, *V.CONFUSIONS)).otherwise(bare)


def numeric_or_date(x: Column) -> Column:
    """Blank, only digits and separators, or a digit beside a month name."""
    low = F.lower(x)
    month = F.lit(False)
    for m in V.MONTHS:
        month = month | low.contains(m)
    return (F.trim(x) == "") | F.trim(x).rlike(r"^[\d\s\-.,/:]+$") | (x.rlike(r"\d") & month)


def first_policy_hit(x: Column) -> Column:
    """Name of the first deny pattern that occurs, else null."""
    return F.coalesce(*[F.when(x.rlike(p), F.lit(n)) for n, p in V.DENY_PATTERNS])


def is_valid(kind: Column, value: Column) -> Column:
    """Format check by entity kind; kinds without one are valid."""
    digits, bare = F.regexp_replace(value, r"[^0-9]", ""), F.trim(value)
    area = F.substring(digits, 1, 3).cast("int")
    ssn = F.when(F.length(digits) == 9, ~area.isin(0, 666) & (area < 900)).otherwise(F.lit(False))
    k = F.upper(kind)
    return (
        F.when(k.isin("US_SSN", "SSN"), ssn)
        .when(k == "NRIC", bare.rlike(r"^[STFGM]\d{7}[A-Z]$"))
        .when(k.isin("MYKAD", "MY_KAD"), bare.rlike(r"^\d{6}-\d{2}-\d{4}$"))
        .when(k == "HKID", bare.rlike(r"^[A-Z]{1,2}\d{6}\([0-9A]\)$"))
        .when(k == "NIK", F.length(digits) == 16)
        .when(k == "EMAIL_ADDRESS", bare.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"))
        .when(k == "PHONE_NUMBER", F.length(digits).between(8, 15))
        .otherwise(F.lit(True))
    )


def auto_label(norm: Column, length: int = 6) -> Column:
    """MOCK_ and the first hex digits of a hash of the normalized text."""
    return F.concat(F.lit("MOCK_"), F.upper(F.substring(F.sha2(F.concat(F.lit("MOCK\x1f"), norm).cast("binary"), 256), 1, length)))


def char_width(ch: Column) -> Column:
    digit = ch.rlike(r"^\d$")
    return F.when(digit, F.lit(V.DIGIT_WIDTH)).when(F.lit(V.NARROW_CHARS).contains(ch), F.lit(V.NARROW_WIDTH)).when(F.lit(V.WIDE_CHARS).contains(ch), F.lit(V.WIDE_WIDTH)).otherwise(F.lit(V.PLAIN_WIDTH))


def text_width(x: Column) -> Column:
    """Sum of the character widths, in hundredths to keep it exact."""
    chars = F.filter(F.split(x, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda acc, c: acc + F.round(char_width(c) * 100).cast("long")) / 100.0


def term_spans(text: Column, pattern: Column) -> Column:
    """(start, stop) of each match of a pattern, from the lengths of the pieces between matches."""
    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def place(state: Column, i: Column) -> Column:
        start = state["at"] + F.get(gaps, i)
        stop = start + F.get(found, i)
        return F.struct(stop.alias("at"), F.array_append(state["out"], F.struct(start.alias("start"), stop.alias("stop"))).alias("out"))

    none = F.array().cast("array<struct<start: int, stop: int>>")
    every = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), F.struct(F.lit(0).alias("at"), none.alias("out")), place, lambda s: s["out"])
    return F.when(F.size(found) > 0, every).otherwise(none)


def term_pattern(term: Column) -> Column:
    """Case-insensitive literal of a term, with a word boundary at each edge that is alphanumeric."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    left = F.when(term.rlike(r"^[A-Za-z0-9]"), F.lit("(?<![A-Za-z0-9])")).otherwise(F.lit(""))
    right = F.when(term.rlike(r"[A-Za-z0-9]$"), F.lit("(?![A-Za-z0-9])")).otherwise(F.lit(""))
    return F.concat(F.lit("(?iu)"), left, quoted, right)
