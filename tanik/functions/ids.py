"""Identities and spans: hashes of ordered JSON, UTF-16 slices, canonical values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def json_hash(*parts: Column) -> Column:
    """SHA-256 of the ordered JSON array of the parts, all of them strings; nulls stay in place."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def utf16_slice(text: Column, start: Column, end: Column) -> Column:
    """The slice [start, end) in UTF-16 units; null outside the text or where a pair would be split."""
    raw = F.encode(text, "UTF-16BE")
    part = F.substring(raw, 2 * start + 1, 2 * (end - start))
    low = lambda at: F.hex(F.substring(raw, 2 * at + 1, 1)).rlike("^D[CDEF]$")  # noqa: E731  the second half of a pair
    inside = (start >= 0) & (end >= start) & (end <= utf16_length(text))
    return F.when(inside & ~F.coalesce(low(start), F.lit(False)) & ~F.coalesce(low(end), F.lit(False)), F.decode(part, "UTF-16BE"))


def quote_matches(text: Column, quote: Column, start: Column, end: Column) -> Column:
    """Whether a quote is exactly the text at its place, or anywhere if it has none."""
    placed = F.coalesce(utf16_slice(text, start, end) == quote, F.lit(False))
    return F.when(start.isNotNull() & end.isNotNull(), placed).otherwise(F.coalesce(F.contains(text, quote), F.lit(False)))


def number_json(value: Column) -> Column:
    """A number as JSON prints it: whole numbers without a fraction."""
    return F.when(value == F.floor(value), F.floor(value).cast("bigint").cast("string")).otherwise(value.cast("string"))
