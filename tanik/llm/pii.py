"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Everything on the path is a built-in Spark function. Positions are code points, ends exclusive.
Java's matcher gives the same matches to ``regexp_extract_all`` and ``split``, so the lengths of the
pieces between matches give the offsets without any Python. Running sums and maxima double their reach
in each round, and text at a place is read from chunks of fixed length, so that the work on a text with
very many matches does not grow with their square.

The patterns are written so that matching stays linear on long texts: a possessive quantifier never
gives characters back, and ``\\G`` / look-behind stop a failed run of characters from being tried
again at each of its positions. Neither changes what the plain patterns find.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Kind:
    """One kind of personal data. ``hint``: a cheap pattern without which there is no match."""

    name: str
    pattern: str
    hint: str
    words: str
    base: float
    confirmed: float


#: In the order in which spans are listed; the first four are the base kinds.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+", "@", "mail|contact|write|address", 0.9, 0.0),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", "ip|host|server|login|address", 0.5, 0.2),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", "card|visa|payment|credit|pay", 0.2, 0.6),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", "tel|phone|call|mobile|fax", 0.7, 0.0),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", "[A-Z]{2}[0-9]{2}", "iban|bank|account|transfer", 0.2, 0.7),
)
BASE = tuple(kind.name for kind in KINDS[:4])
#: Letters count as 10 to 35 in the mod-97 check.
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def luhn(digits: Column) -> Column:
    """True where a string of digits passes Luhn's check."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).when(v < 5, v * 2).otherwise(v * 2 - 9))
    return F.aggregate(doubled, F.lit(0), lambda total, v: total + v) % 10 == 0


def mod97(code: Column) -> Column:
    """True where an account number without spaces leaves 1 modulo 97 (ISO 7064)."""
    turned = F.concat(F.substring(code, 5, 40), F.substring(code, 1, 4))
    step = lambda total, c: (total * F.when(c.between("0", "9"), F.lit(10)).otherwise(F.lit(100)) + F.instr(F.lit(_DIGITS), c) - 1) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _confirmed(kind: str, found: Column, before: Column, after: Column) -> Column:
    """Whether a proposed span is kept."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        part = "0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return found.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        code = F.replace(found, F.lit(" "), F.lit(""))
        alone = ~before.rlike("[A-Za-z0-9]$") & ~after.rlike("^[A-Za-z0-9]")
        return F.when(F.length(code).between(15, 34) & alone, mod97(code)).otherwise(False)
    return F.lit(True)


_SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
#: Characters of one chunk of a text.
CHUNK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Of each element the combination of all up to it; as many rounds as the length has binary digits."""
    reach = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda s: s < F.size(values))
    return F.aggregate(reach, values, lambda done, s: F.transform(done, lambda x, i: F.when(i >= s, combine(x, F.get(done, i - s))).otherwise(x)))


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _between(chunks: Column, start: Column, end: Column) -> Column:
    """The characters [start, end) of a text given as its chunks; reads only the chunks that hold them."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor(F.greatest(start, end - 1) / CHUNK).cast("int")
    held = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
    return F.when(end > start, F.substring(held, start - first * CHUNK + 1, end - start)).otherwise("")


def _spans(text: Column, chunks: Column, kind: Kind, near: int) -> Column:
    """The kept spans of one kind with their scores, by position."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), matches.alias("found")), lambda p: p["found"].isNotNull())

    def placed(pairs: Column) -> Column:
        ends = running(F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["found"])), lambda a, b: a + b)
        return F.zip_with(pairs, ends, lambda p, end: F.struct((end - F.length(p["found"])).alias("start"), end.alias("end"), p["found"].alias("found")))

    before = lambda s: _between(chunks, F.greatest(s["start"] - near, F.lit(0)), s["start"])
    after = lambda s: _between(chunks, s["end"], s["end"] + near)
    kept = F.filter(let(pairs, placed), lambda s: _confirmed(kind.name, s["found"], before(s), after(s)))

    def scored(s):
        words = rf"(?i)\b(?:{kind.words})"
        context = before(s).rlike(words) | after(s).rlike(words)
        score = F.round(F.lit(kind.base + kind.confirmed) + F.when(context, 0.1).otherwise(0.0), 2)
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

    return F.when(text.rlike(kind.hint), F.transform(kept, scored)).otherwise(F.array().cast(_SPANS))


def find_pii(docs: DataFrame, text: str = "text", near: int = 40, least: float = 0.0) -> DataFrame:
    """Adds ``pii_spans``: array of (kind, start, end, score), by kind as listed in ``KINDS``, then start.

    ``near``: characters on each side in which context words count. ``least``: base kinds are always
    kept; spans of added kinds (iban) need this score. A null text has no spans. Every row gives one
    row, repeated rows included; an empty table gives an empty one. A column of the input named
    ``pii_spans`` is replaced; all other columns stay.
    """
    clean = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def every(chunks: Column) -> Column:
        parts = [_spans(clean, chunks, kind, near) for kind in KINDS]
        parts[4:] = [F.filter(part, lambda s: s["score"] >= least) for part in parts[4:]]
        return F.concat(*parts)

    hinted = clean.rlike("|".join(kind.hint for kind in KINDS))
    return docs.withColumn("pii_spans", F.when(hinted, let(_chunks(clean), every)).otherwise(F.array().cast(_SPANS)))


def redact(docs: DataFrame, text: str = "text", near: int = 40) -> DataFrame:
    """The same rows with every found span replaced by ``[KIND]``; overlapping spans become one.

    The tag is that of the span which starts first. A null text stays null.
    """
    found = find_pii(docs, text, near)
    ordered = F.array_sort(F.transform("pii_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    body = F.col(f"`{text}`")

    def runs(spans: Column) -> Column:
        """Spans that overlap, as one: from the first start to the farthest end."""
        far = running(F.transform(spans, lambda s: s["end"]), F.greatest)
        return let(far, lambda far: let(_heads(spans, far), lambda heads: F.transform(heads, lambda h, k: F.struct(F.get(spans, h)["start"].alias("start"), F.get(far, F.coalesce(F.get(heads, k + 1), F.size(spans)) - 1).alias("end"), F.get(spans, h)["kind"].alias("kind")))))

    def written(chunks: Column, runs: Column) -> Column:
        from_ = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(runs, k - 1)["end"])
        parts = F.transform(runs, lambda r, k: F.concat(_between(chunks, from_(k), r["start"]), F.lit("["), F.upper(r["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), _between(chunks, F.element_at(runs, -1)["end"], F.length(body)))

    clean = F.when(F.size("pii_spans") == 0, body).otherwise(let(_chunks(body), lambda chunks: let(let(ordered, runs), lambda r: written(chunks, r))))
    return found.withColumn(text, clean).drop("pii_spans")


def _heads(spans: Column, far: Column) -> Column:
    """The places of the spans that start at or behind all ends before them."""
    places = F.transform(spans, lambda s, i: F.when((i == 0) | (s["start"] >= F.get(far, i - 1)), i))
    return F.array_compact(places)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the count of each base kind, the hash of the base spans and all spans as text."""
    found = find_pii(docs.select("doc_id", "text"))
    as_text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = as_text(F.filter("pii_spans", lambda s: s["kind"].isin(*BASE)))
    return found.select("doc_id", *[count(kind) for kind in BASE], F.sha2(base, 256).alias("base_sha256"), as_text(F.col("pii_spans")).alias("spans"))
