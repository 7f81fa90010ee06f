"""Text functions: normalising, tokens, dates, numbers, categories. All over Spark columns.

Only Unicode decomposition has no built-in form; it runs on Arrow batches. Everything else is built in.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from tanik.functions import vocab


def _marks(low: int, high: int) -> re.Pattern:
    return re.compile("[%s]+" % "".join(re.escape(c) for c in map(chr, range(low, high)) if unicodedata.category(c).startswith("M")))


#: Marks that combine with the letter before them; classes of the basic plane alone are matched fast.
_MARKS, _HIGH, _HIGH_MARKS = _marks(0, 0x10000), re.compile("[\U00010000-\U0010ffff]"), _marks(0x10000, sys.maxunicode + 1)


def _unmarked(text: str) -> str:
    bare = _MARKS.sub("", text)
    return _HIGH_MARKS.sub("", bare) if _HIGH.search(bare) else bare


def plain_normalized(text: str) -> str:
    """Compatibility form, lower case, no marks; other runs than a-z and 0-9 become one space."""
    bare = text.lower()
    if not text.isascii():
        low = unicodedata.normalize("NFKC", text).lower()
        bare = _unmarked(unicodedata.normalize("NFD", low.replace("ı", "i")))
    return re.sub("[^a-z0-9]+", " ", bare).strip()


def plain_folded(text: str) -> str:
    """Lower case without marks, punctuation kept, white space collapsed."""
    bare = text.lower() if text.isascii() else _unmarked(unicodedata.normalize("NFD", text.lower()))
    return " ".join(bare.replace("ı", "i").split())


@F.pandas_udf(T.StringType())
def normalize_text(texts: pd.Series) -> pd.Series:
    """``plain_normalized`` of a column; null stays null."""
    return texts.map(plain_normalized, na_action="ignore")


@F.pandas_udf(T.StringType())
def fold_turkish(texts: pd.Series) -> pd.Series:
    """``plain_folded`` of a column; null stays null."""
    return texts.map(plain_folded, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def normalize_each(lists: pd.Series) -> pd.Series:
    """``plain_normalized`` of every string of an array; nulls stay in place."""
    return lists.map(lambda texts: [None if t is None else plain_normalized(t) for t in texts], na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def fold_each(lists: pd.Series) -> pd.Series:
    """``plain_folded`` of every string of an array; nulls stay in place."""
    return lists.map(lambda texts: [None if t is None else plain_folded(t) for t in texts], na_action="ignore")


def turkish_year(at: Column) -> Column:
    """The calendar year of a time in Turkey."""
    return F.year(F.from_utc_timestamp(at, "Europe/Istanbul"))


def word_set(normalized: Column, stop: Sequence[str] = vocab.STOP_WORDS, synonyms: Mapping[str, str] = vocab.SYNONYMS) -> Column:
    """Sorted distinct words of three letters or more of a normalised text, some read as others."""
    words = F.filter(F.split(normalized, " "), lambda w: (F.length(w) > 2) & ~w.isin(list(stop)))
    if synonyms:
        pairs = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair])
        words = F.transform(words, lambda w: F.coalesce(pairs[w], w))
    return F.array_sort(F.array_distinct(words))


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements over all elements of two sets; 0 for two empty ones."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def read_number(text: Column) -> Column:
    """Digits with a decimal point or comma, or a number word up to ten; otherwise null."""
    words = F.create_map(*[F.lit(x) for pair in vocab.NUMBER_WORDS.items() for x in pair]).cast("map<string,double>")
    folded = F.translate(F.lower(text), "ıüöş", "iuos").try_cast("string")
    digits = F.regexp_extract(text, r"^\s*([0-9]+(?:[.,][0-9]+)?)\s*$", 1)
    return F.coalesce(F.replace(digits, F.lit(","), F.lit(".")).try_cast("double"), words[F.regexp_replace(F.trim(folded), "ç", "c")])


def first_match(text: Column, rules: Sequence[tuple[str, str]], otherwise: Column | str | None) -> Column:
    """The name of the first rule whose pattern is found."""
    found = F
    for name, pattern in rules:
        found = found.when(text.rlike(pattern), F.lit(name))
    other = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return found.otherwise(other)


def event_kind(normalized: Column, rules: Sequence[tuple[str, str]] = vocab.EVENT_KINDS) -> Column:
    """The kind of event that a normalised text tells of, or general."""
    return first_match(normalized, rules, "general")


def agency_hint(normalized: Column, rules: Sequence[tuple[str, str]] = vocab.AGENCIES) -> Column:
    """The wire agency to which a normalised text is attributed, or null."""
    return first_match(normalized, rules, F.lit(None).cast("string"))


def news_category(title: Column, excerpt: Column, kind: Column, source: Column, rules: Sequence[tuple[str, str]] = vocab.CATEGORIES) -> Column:
    """Category of an item from its normalised title, else its kind, source or normalised excerpt."""
    whole = [(name, rf"\b(?:{words})\b") for name, words in rules]
    fallback = F.when(kind.isin(*vocab.HARD_NEWS), "gundem").when(source.isin(*vocab.EDUCATION_SOURCES), "egitim").otherwise(first_match(excerpt, whole, "gundem"))
    return F.when(kind == "sports", "spor").otherwise(first_match(title, whole, fallback))


def is_breaking(published: Column, now: Column) -> Column:
    """Published in the last 24 hours and not in the future."""
    age = now.cast("double") - published.cast("double")
    return F.coalesce(age.between(0, 86400), F.lit(False))


def is_recent(published: Column, stale: Column, now: Column) -> Column:
    """Not stale, and published in the last 48 hours and not in the future."""
    age = now.cast("double") - published.cast("double")
    return F.coalesce(~stale & age.between(0, 172800), F.lit(False))


def normalize_content(raw: Column) -> Column:
    """Line ends as LF, blanks in a line as one space, lines trimmed, at most one empty line, trimmed."""
    text = F.regexp_replace(raw, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[\t ]+", " ")
    text = F.regexp_replace(text, r"[^\S\n]*\n[^\S\n]*", "\n")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def excerpt(text: Column, most: int) -> Column:
    """White space collapsed; cut to ``most`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…")))


def normalize_query(folded: Column) -> Column:
    """A folded query with other characters than letters and digits as spaces, 240 at most."""
    return F.substring(F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " ")), 1, 240)


def private_summary(query: Column, normalized: Column, vocabulary: Sequence[str]) -> Column:
    """Only known words and years, sorted; null for queries that may name a person or hold a number."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(normalized, " "), lambda w: w.isin(list(vocabulary)) | w.rlike("^20[0-9]{2}$"))))
    risky = query.rlike("@|https?://|www\\.") | F.regexp_replace(query, r"\s", "").rlike("[0-9]{5}") | (F.length(query) > 240)
    return F.when(~risky & (F.size(words) > 0), F.array_join(words, " "))


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def _month(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in vocab.MONTHS]), name)


def parse_dates(folded: Column) -> Column:
    """The explicit dates of a folded text as ISO strings: a range over or in a month, else all dates.

    A year is never guessed; a reversed range and an impossible day give nothing.
    """
    text = F.regexp_replace(F.trim(folded), "[–—]", "-")
    across = r"^([0-9]{1,2})\s+([a-z]+)\s*-\s*([0-9]{1,2})\s+([a-z]+)\s+([0-9]{4})$"
    inside = r"^([0-9]{1,2})\s*-\s*([0-9]{1,2})\s+([a-z]+)\s+([0-9]{4})$"
    part = lambda pattern, k: F.regexp_extract(text, pattern, k)
    ordered = lambda a, b: F.when(a <= b, F.array(a.cast("string"), b.cast("string"))).otherwise(F.array().cast("array<string>"))
    one = ordered(_date(part(across, 5), _month(part(across, 2)), part(across, 1)), _date(part(across, 5), _month(part(across, 4)), part(across, 3)))
    two = ordered(_date(part(inside, 4), _month(part(inside, 3)), part(inside, 1)), _date(part(inside, 4), _month(part(inside, 3)), part(inside, 2)))
    numeric, named = r"([0-9]{1,2})[./]([0-9]{1,2})[./]([0-9]{4})", r"([0-9]{1,2})\s+([a-z]+)\s+([0-9]{4})"
    every = F.regexp_extract_all(text, F.lit(rf"(?<![0-9])(?:{numeric}|{named})(?![0-9])"), F.lit(0))
    get = lambda m, pattern, k: F.regexp_extract(m, pattern, k)
    dates = F.transform(every, lambda m: F.coalesce(_date(get(m, numeric, 3), get(m, numeric, 2).try_cast("int"), get(m, numeric, 1)), _date(get(m, named, 3), _month(get(m, named, 2)), get(m, named, 1))).cast("string"))
    iso = F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.array(F.try_to_date(text, "yyyy-MM-dd").cast("string"))).otherwise(F.array().cast("array<string>"))
    return F.when(text.rlike(across), one).when(text.rlike(inside), two).otherwise(F.array_compact(F.concat(dates, iso)))


def parse_news_date(text: Column, folded: Column) -> Column:
    """A publication time: ISO, feed (RFC 822), Turkish or numeric; without an offset it is UTC+3."""
    iso = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})[T ]([0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?)\s*(Z|[+-][0-9]{2}:?[0-9]{2})?$"
    trimmed = F.trim(text)
    part = lambda column, pattern, k: F.regexp_extract(column, pattern, k)
    zone = F.when(part(trimmed, iso, 5) == "", "+03:00").otherwise(F.regexp_replace(part(trimmed, iso, 5), r"([+-][0-9]{2}):?([0-9]{2})", "$1:$2"))
    first = F.concat(part(trimmed, iso, 1), F.lit("-"), part(trimmed, iso, 2), F.lit("-"), part(trimmed, iso, 3), F.lit("T"), part(trimmed, iso, 4), zone).try_cast("timestamp")
    rfc = F.regexp_replace(F.regexp_replace(trimmed, r"^[A-Za-z]{3},\s*", ""), r"\s+(GMT|UTC|UT|Z)$", " +0000")
    second = F.try_to_timestamp(F.when(rfc.rlike(r"^[0-9]{1,2} [A-Za-z]{3} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2} [+-][0-9]{4}$"), rfc), F.lit("d MMM yyyy HH:mm:ss xx"))
    day = r"^([0-9]{1,2}) ([a-z]+) ([0-9]{4})(?:[ ,-]+([0-9]{2}:[0-9]{2}))?$"
    dmy, ymd = r"^([0-9]{1,2})[./-]([0-9]{1,2})[./-]([0-9]{4})(?:[ ,-]+([0-9]{2}:[0-9]{2}))?$", r"^([0-9]{4})[./-]([0-9]{1,2})[./-]([0-9]{1,2})(?:[ ,-]+([0-9]{2}:[0-9]{2}))?$"
    clock = lambda pattern: F.when(part(folded, pattern, 4) == "", "00:00").otherwise(part(folded, pattern, 4))
    local = lambda date, pattern: F.concat(date.cast("string"), F.lit("T"), clock(pattern), F.lit(":00+03:00")).try_cast("timestamp")
    third = local(_date(part(folded, day, 3), _month(part(folded, day, 2)), part(folded, day, 1)), day)
    fourth = local(_date(part(folded, dmy, 3), part(folded, dmy, 2).try_cast("int"), part(folded, dmy, 1)), dmy)
    fifth = local(_date(part(folded, ymd, 1), part(folded, ymd, 2).try_cast("int"), part(folded, ymd, 3)), ymd)
    found = F.when(trimmed.rlike(iso), first).when(second.isNotNull(), second).when(folded.rlike(day), third).when(folded.rlike(dmy), fourth).when(folded.rlike(ymd), fifth)
    return F.when(F.year(found) >= 2016, found)
