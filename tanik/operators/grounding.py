"""Analyses and fact candidates from outside, checked against the text that they claim to describe."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tanik.functions import vocab
from tanik.functions.ids import utf16_length, utf16_slice
from tanik.functions.spans import analyze
from tanik.functions.text import fold_each, fold_turkish, normalize_each, normalize_text, parse_news_date, read_number
from tanik.operators.facts import VALUE
from tanik.sources.html import chunk_blocks

#: What an analysis from outside holds; value is JSON text, type one of number, boolean, text, datetime.
CLAIM = "struct<predicate:string,scope:string,type:string,value:string,value_text:string,quote:string,start:int,end:int,correction:boolean,as_of:string>"
ANALYSIS = f"report_id string, kind string, claims array<{CLAIM}>, entities array<struct<kind:string,value:string,text:string>>, occurred_at timestamp, occurrence_text string"


def _bare(value: Column) -> Column:
    """JSON text without its quotation marks."""
    return F.regexp_replace(value, '^"|"$', "")


def _told(occurrence: Column) -> Column:
    """The time of an occurrence as a text states it."""
    text = F.replace(occurrence, F.lit("saat "), F.lit(""))
    return parse_news_date(text, fold_turkish(text))


def _kind_told(kind: Column, normalized: Column) -> Column:
    """Whether a normalised text names the kind of event."""
    found = F.lit(False)
    for name, pattern in vocab.EVENT_KINDS:
        found = found | ((kind == name) & normalized.rlike(pattern))
    return found


def _when(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that holds, or null."""
    ladder = F
    for broken, name in rules:
        ladder = ladder.when(F.coalesce(broken, F.lit(False)), name)
    return ladder.otherwise(F.lit(None).cast("string"))


def ground_analysis(reports: DataFrame, analyses: DataFrame) -> DataFrame:
    """(report_id, error, kind, claims, entities, occurred_at): each analysis against its report.

    ``reports``: id, title, text. ``analyses`` as ANALYSIS; nothing in them is trusted. A claim must be an
    exact slice of the text that holds its value, and the value must follow from the words: counts and yes
    or no as the library's own rules find them, numbers, times and names re-read. error is that of the
    first claim, else of the first entity, else of the occurrence; without one the claims come back with
    ``correction`` only where the sentence corrects, and ``as_of`` only where it is told. All of it is
    done row by row: no shuffle but the join by report.
    """
    empty = F.array().cast(f"array<{CLAIM}>")
    rows = reports.select(F.col("id").alias("report_id"), "title", "text").join(analyses, "report_id")
    rows = rows.withColumn("claims", F.coalesce("claims", empty)).withColumn("entities", F.coalesce("entities", F.array().cast("array<struct<kind:string,value:string,text:string>>")))
    get = lambda column, part: F.transform(column, lambda c: c[part])
    whole = F.concat_ws(" ", "title", "text")
    rows = rows.withColumn("own", analyze(F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))).withColumn("n", normalize_text(whole))
    rows = rows.withColumn("nq", normalize_each(get("claims", "quote"))).withColumn("nt", normalize_each(get("claims", "value_text"))).withColumn("nv", normalize_each(F.transform("claims", lambda c: _bare(c["value"]))))
    rows = rows.withColumn("ft", fold_each(get("claims", "value_text"))).withColumn("ev", normalize_each(get("entities", "value"))).withColumn("et", normalize_each(get("entities", "text")))
    rows = rows.withColumn("told", _told(F.col("occurrence_text")))

    def checked(z: Column) -> Column:
        c, kind = z["claims"], z["claims"]["type"]
        same = lambda g: (g["predicate"] == c["predicate"]) & (g["value"] == c["value"]) & (g["quote"] == c["quote"])
        known = F.exists("own.claims", same)
        slice_ = F.coalesce(utf16_slice(F.col("text"), c["start"], c["end"]) == c["quote"], F.lit(False)) & F.coalesce(F.contains(c["quote"], c["value_text"]), F.lit(False))
        time = parse_news_date(c["value_text"], z["ft"])
        error = _when(
            (c["predicate"].isin(*vocab.COUNTED) & ~known, "claim_predicate_not_grounded"),
            (~slice_, "claim_grounding_failed"),
            ((kind == "number") & ~F.coalesce(read_number(c["value_text"]) == c["value"].try_cast("double"), F.lit(False)), "claim_number_not_grounded"),
            ((kind == "datetime") & ~F.coalesce(time == _bare(c["value"]).try_cast("timestamp"), F.lit(False)), "claim_date_not_grounded"),
            ((kind == "boolean") & ~known, "claim_boolean_not_grounded"),
            ((c["predicate"] == "event_occurred") & ~((kind == "text") & _kind_told(_bare(c["value"]), z["nq"])), "event_type_not_grounded"),
            ((kind == "text") & (c["predicate"] != "event_occurred") & ~F.coalesce(F.contains(z["nt"], z["nv"]), F.lit(False)), "claim_text_not_grounded"),
        )
        dated = F.contains(c["quote"], c["as_of"]) | F.coalesce(time == c["as_of"].try_cast("timestamp"), F.lit(False))
        claim = c.withField("correction", F.coalesce(c["correction"] & z["nq"].rlike(vocab.CORRECTION), F.lit(False))).withField("as_of", F.when(dated, c["as_of"]))
        return F.struct(error.alias("error"), claim.alias("claim"))

    def named(z: Column) -> Column:
        e = z["entities"]
        mapped = F.exists("own.entities", lambda k: (k["kind"] == e["kind"]) & (k["value"] == e["value"]) & (k["text"] == e["text"]))
        return _when((~F.coalesce(F.contains(F.col("n"), z["et"]), F.lit(False)), "entity_not_grounded"), (~F.equal_null(z["ev"], z["et"]) & ~mapped, "entity_mapping_not_grounded"))

    rows = rows.withColumn("c", F.transform(F.arrays_zip("claims", "nq", "nt", "nv", "ft"), checked)).withColumn("e", F.transform(F.arrays_zip("entities", "ev", "et"), named))
    first = lambda errors: F.get(F.filter(errors, lambda x: x.isNotNull()), 0)
    occurrence = F.when(F.col("occurred_at").isNotNull() & ~(F.coalesce(F.contains("text", "occurrence_text"), F.lit(False)) & F.equal_null("told", "occurred_at")), "occurrence_not_grounded")
    rows = rows.withColumn("error", F.coalesce(first(F.transform("c", lambda x: x["error"])), first("e"), occurrence))
    fine = F.col("error").isNull()
    return rows.select("report_id", "error", "kind", F.when(fine, F.transform("c", lambda x: x["claim"])).alias("claims"), F.when(fine, F.col("entities")).alias("entities"), F.when(fine, F.col("occurred_at")).alias("occurred_at"))


def own_analyses(reports: DataFrame) -> DataFrame:
    """The library's own analyses of reports (id, title, text), in the form of ANALYSIS."""
    rows = reports.select(F.col("id").alias("report_id"), analyze(F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))).alias("a"))
    kind = lambda v: F.when(v.isin("true", "false"), "boolean").when(v.startswith('"'), "text").otherwise("number")
    claims = F.transform("a.claims", lambda c: F.struct(c["predicate"].alias("predicate"), c["scope"].alias("scope"), kind(c["value"]).alias("type"), c["value"].alias("value"), c["value_text"].alias("value_text"), c["quote"].alias("quote"), c["start"].alias("start"), c["end"].alias("end"), c["correction"].alias("correction"), F.lit(None).cast("string").alias("as_of")))
    occurred = F.col("a.occurrence")
    return rows.select("report_id", "a.kind", claims.alias("claims"), "a.entities", _told(occurred).alias("occurred_at"), occurred.alias("occurrence_text"))


def analyzed(reports: DataFrame, provider: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Analyses of reports: the library's own, or those of ``provider``, each checked by ``ground_analysis``."""
    return own_analyses(reports).withColumn("error", F.lit(None).cast("string")) if provider is None else ground_analysis(reports, provider(reports))


def rule_candidates(versions: DataFrame) -> DataFrame:
    """(version_id, entity_key, topic_key, predicate, value, value_text, reference_period, quote, start, end) of official versions.

    ``versions``: version_id, title, raw_text. Only exact forms of a title count: results announced, where
    the text holds the title; and the preference period, from the one sentence that states its range, in
    the title's year and with real dates in order. Offsets are UTF-16 units of raw_text.
    """
    title = F.trim(F.regexp_replace("title", r"\s+", " "))
    rows = versions.select("version_id", "raw_text", title.alias("t"))
    entity, period = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, key in vocab.RESULT_TITLES:
        entity, period = F.when(F.col("t").rlike(pattern), key).otherwise(entity), F.when(F.col("t").rlike(pattern), F.regexp_extract("t", pattern, 1)).otherwise(period)
    part = lambda k: F.regexp_extract("raw_text", vocab.PREFERENCE_RANGE, k)
    months = F.array(*[F.lit(m) for m in vocab.MONTH_NAMES])
    day = lambda year, month, d: F.try_to_date(F.concat_ws("-", part(year), F.lpad(F.array_position(months, part(month)).cast("string"), 2, "0"), F.lpad(part(d), 2, "0")), "yyyy-MM-dd")
    year = F.regexp_extract("t", vocab.PREFERENCE_TITLE, 1)
    rows = rows.select("version_id", "raw_text", "t", entity.alias("entity"), period.alias("period"), year.alias("year"), part(0).alias("range_quote"), part(1).alias("range"), part(4).alias("from_year"), day(4, 3, 2).alias("from"), day(7, 6, 5).alias("to"))
    announced = F.col("entity").isNotNull()
    preferred = ~announced & (F.col("year") != "") & (F.col("range_quote") != "") & (F.col("from_year") == F.col("year")) & (F.col("from") <= F.col("to"))
    quote = F.when(announced, F.col("t")).when(preferred, F.col("range_quote"))
    rows = rows.withColumn("quote", quote).withColumn("at", F.call_function("instr", "raw_text", "quote")).where("at > 0")
    start = utf16_length(F.substring(F.col("raw_text"), F.lit(1), F.col("at") - 1))
    none = F.lit(None).cast("string")
    status = F.struct(F.lit("status").alias("type"), F.lit("announced").alias("value"), *[none.alias(n) for n in ("start", "end", "amount", "currency", "schema_key", "json")])
    dates = F.struct(F.lit("date_range").alias("type"), none.alias("value"), F.col("from").cast("string").alias("start"), F.col("to").cast("string").alias("end"), *[none.alias(n) for n in ("amount", "currency", "schema_key", "json")])
    told = F.col("entity").isNotNull()
    return rows.select(
        "version_id", F.coalesce("entity", F.lit("yks")).alias("entity_key"), F.lit("education.exams").alias("topic_key"), F.when(told, "results_status").otherwise("preference_period").alias("predicate"), F.when(told, status).otherwise(dates).cast(VALUE).alias("value"),
        F.when(told, "Açıklandı").otherwise(F.col("range")).alias("value_text"), F.coalesce("period", "year").alias("reference_period"), "quote", start.alias("start"), (start + utf16_length(F.col("quote"))).alias("end"))


def extract_candidates(documents: DataFrame, provider: Callable, schema: str, most: int = 100_000) -> DataFrame:
    """Candidates of a provider over windows of documents, offsets mapped back to the document.

    ``documents``: document_id (long), raw_text, blocks (array of struct(start, end), code points).
    ``provider``: a function over an iterator of pandas frames (document_id, window, text) that yields frames
    with document_id, window and the columns of ``schema``, start and end among them, relative to the
    window. Documents whose blocks do not fit are left out, as ``chunk_blocks`` says why. What comes out is
    still unchecked: join its context and pass it to ``validate_candidates``.
    """
    windows = chunk_blocks(documents, most).where("error IS NULL").withColumnRenamed("start", "from").withColumnRenamed("end", "to")
    cut = windows.join(documents.select("document_id", "raw_text"), "document_id").select("document_id", "window", F.substring(F.col("raw_text"), F.col("from") + 1, F.col("to") - F.col("from")).alias("text"))
    found = cut.mapInPandas(provider, f"document_id long, window int, {schema}")
    placed = found.join(windows.select("document_id", "window", "from"), ["document_id", "window"])
    return placed.withColumn("start", F.col("start") + F.col("from")).withColumn("end", F.col("end") + F.col("from")).drop("from")
