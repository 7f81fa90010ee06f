"""Typed facts: value checks, grounding ladders, publication rules, conflicts, lifecycle.

A fact value is struct<type, value, start, end, amount, currency, schema_key, json>, all strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tanik.functions.ids import json_hash, quote_matches, utf16_slice
from tanik.functions.text import parse_dates

# --- fixed values: the shape of a fact's value, what makes two facts rivals, and the forms of keys and times
VALUE = "struct<type:string,value:string,start:string,end:string,amount:string,currency:string,schema_key:string,json:string>"
CONTEXT = ("subject_entity_id", "topic_id", "predicate", "reference_period")
_KEY = "^[a-z0-9]+(?:[._-][a-z0-9]+)*$"
_OFFSET = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:[0-9]{2})$"


# --- fixed values: numbers and money as texts write them
NUMBER_FORM = "^-?[0-9]+(?:,[0-9]+)?$"
MONEY_FORM = r"^((?:0|[1-9][0-9]*)(?:,[0-9]{1,2})?|[1-9][0-9]{0,2}(?:\.[0-9]{3})+(?:,[0-9]{1,2})?)\s*(TL|TRY|₺)$"


def _day(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def value_is_valid(v: Column) -> Column:
    """Whether a tagged value has the shape of its type."""
    kind, text = v["type"], v["value"]
    checks = [
        ("date", _day(text).isNotNull()),
        ("datetime", text.rlike(_OFFSET) & text.try_cast("timestamp").isNotNull()),
        ("date_range", _day(v["start"]).isNotNull() & _day(v["end"]).isNotNull() & (_day(v["start"]) <= _day(v["end"]))),
        ("money", v["amount"].rlike(r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?$") & v["currency"].rlike("^[A-Z]{3}$")),
        ("number", text.rlike(r"^-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$")),
        ("boolean", text.isin("true", "false")),
        ("status", text.rlike(_KEY)),
        ("string", F.length(F.trim(text)) > 0),
        ("url", F.try_parse_url(text, F.lit("HOST")).isNotNull() & text.rlike("^https?://")),
        ("json", v["schema_key"].rlike(_KEY) & F.try_parse_json(v["json"]).isNotNull()),
    ]
    ladder = F
    for name, fine in checks:
        ladder = ladder.when(kind == name, F.coalesce(fine, F.lit(False)))
    return ladder.otherwise(False)


def check_fact_values(rows: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``valid``."""
    return rows.withColumn("valid", value_is_valid(F.col(value)))


def validate_evidence(rows: DataFrame) -> DataFrame:
    """Adds ``error`` (null if fine) to (fact_version_id, version_id, raw_text, quote, start, end)."""
    found = quote_matches(F.col("raw_text"), F.col("quote"), F.col("start"), F.col("end"))
    error = F.when(F.col("fact_version_id") != F.col("version_id"), "version_mismatch").when(~found, "evidence_not_found_in_raw_text")
    return rows.withColumn("error", error)


def publication_errors(rows: DataFrame, now: Column) -> DataFrame:
    """Adds ``errors``, the array of all publication rules that a fact breaks.

    Rows: facts with source_status, source_id, expected_period, and evidence as array of struct(fact_id,
    source_id, error).
    """
    col, other = F.col, lambda a, b: ~F.equal_null(F.col(a), F.col(b))
    rules = [
        (~col("status").isin("verified", "published") | col("verified_at").isNull(), "fact_not_verified"),
        (col("verified_at") > now, "verification_in_future"),
        ((col("source_status") != "active") | other("source_id", "authority_source_id"), "authority_not_active"),
        (now < col("valid_from"), "not_yet_valid"),
        (now >= col("valid_until"), "validity_expired"),
        (now < col("effective_at"), "not_yet_effective"),
        (other("reference_period", "expected_period"), "reference_period_mismatch"),
        (F.size("evidence") == 0, "missing_evidence"),
        (F.exists("evidence", lambda e: (e["fact_id"] != col("id")) | (e["source_id"] != col("authority_source_id"))), "evidence_authority_or_fact_mismatch"),
        (F.exists("evidence", lambda e: e["error"] == "version_mismatch"), "version_mismatch"),
        (F.exists("evidence", lambda e: e["error"] == "evidence_not_found_in_raw_text"), "evidence_not_found_in_raw_text"),
    ]
    return rows.withColumn("errors", F.array_compact(F.array(*[F.when(broken, name) for broken, name in rules])))


# --- fixed values: coverage reasons that do not stand against a fact
TOLERATED = ("document_limit", "bounded_or_incomplete_discovery")


def freshness_reasons(rows: DataFrame, now: Column, max_age_seconds: int) -> DataFrame:
    """Adds ``reasons`` why evidence is not current: version, ages of the three checks, coverage reasons."""
    old = lambda c: F.col(c).isNull() | (F.col(c) > now) | (now.cast("double") - F.col(c).cast("double") > max_age_seconds)
    odd = F.size(F.array_except(F.coalesce("coverage_reasons", F.array().cast("array<string>")), F.array(*[F.lit(t) for t in TOLERATED]))) > 0
    stale = old("last_observed_at") | old("last_success_at") | old("coverage_checked_at")
    reasons = [F.when(~F.equal_null(F.col("current_version_id"), F.col("version_id")), "historical_document_version"), F.when(stale, "source_coverage_stale_or_unknown"), F.when(odd, "source_health_requires_review")]
    return rows.withColumn("reasons", F.array_compact(F.array(*reasons)))


def fact_conflicts(facts: DataFrame) -> DataFrame:
    """Adds ``final_status``: needs_review where facts of one context have different values.

    The values of a context are counted before the join, so a context with very many facts meets one row.
    """
    live = facts.where(F.col("status").isin("verified", "published", "needs_review"))
    split = live.groupBy(*CONTEXT).agg(F.countDistinct(F.to_json("value")).alias("n")).where("n > 1")
    split = split.select(*[F.col(c).alias(f"_{c}") for c in CONTEXT], F.lit(True).alias("split"))
    same = F.lit(True)
    for c in CONTEXT:
        same = same & F.equal_null(F.col(c), F.col(f"_{c}"))
    joined = facts.join(split, same, "left")
    review = F.coalesce("split", F.lit(False)) & F.col("status").isin("verified", "published", "needs_review")
    return joined.withColumn("final_status", F.when(review, "needs_review").otherwise(F.col("status"))).drop("split", *[f"_{c}" for c in CONTEXT])


def mentions(folded: Column, phrase: Column) -> Column:
    """Whether a folded phrase stands in a folded text as whole words."""
    pad = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(c, "[^a-z0-9]+", " ")), F.lit(" "))
    return F.coalesce(F.contains(pad(folded), pad(phrase)), F.lit(False))


def validate_candidates(rows: DataFrame, now: Column) -> DataFrame:
    """Adds ``decision`` (verified, needs_review, rejected) and ``reasons`` to extraction candidates.

    One row holds a candidate with what it is checked against, joined beforehand: source_active, trusted
    (URL), document_id, version_document_id, version_id, current_version_id, document_status, fetched_at,
    published_at, raw_text, folded_title, quote, folded_quote, start, end, page, value_text,
    folded_value_text, warnings, blocks (array of start, end, page, folded_heading, folded_text),
    known_keys, authorized, aliases, ambiguous_when, cues, other_cues (folded arrays), unit,
    predicate_unit, value_types, value (as VALUE), lexicon (map), reference_period, expected_period,
    correction_of. Cheap rejections stand first; the first rule that holds decides.
    """
    col = F.col
    rows = rows.withColumn("block", F.when(F.size("blocks") > 0, F.try_element_at(F.filter("blocks", lambda b: (b["start"] <= col("start")) & (b["end"] >= col("end")) & F.equal_null(b["page"], col("page"))), F.lit(1))))
    heading = F.coalesce(col("block.folded_heading"), F.lit(""))
    named = lambda *texts: F.exists("aliases", lambda a: _any(*[mentions(t, a) for t in texts]))
    until = lambda text, part, n: F.call_function("substring_index", text, part, F.lit(n))
    before = until(col("folded_quote"), col("folded_value_text"), 1)
    last = F.transform("cues", lambda c: F.struct((F.length(before) - F.length(until(before, c, -1))).alias("end"), c.alias("cue")))
    label = F.array_max(F.filter(last, lambda x: x["end"] > 0))
    between = F.substring(before, label["end"] + 1, F.length(before))
    loose = (F.length(between) > 80) | (F.size(parse_dates(between)) > 0) | F.exists("other_cues", lambda c: F.contains(between, c))
    value, dates = col("value"), parse_dates(col("folded_value_text"))
    years = F.when(value["type"].isin("date", "datetime"), F.array(F.substring(value["value"], 1, 4))).when(value["type"] == "date_range", F.array(F.substring(value["start"], 1, 4), F.substring(value["end"], 1, 4))).otherwise(F.array().cast("array<string>"))
    periods = F.regexp_extract_all("reference_period", F.lit("(?<![0-9])[0-9]{4}(?![0-9])"), F.lit(0))
    text = F.trim("value_text")
    number = text.rlike(NUMBER_FORM) & (F.replace(text, F.lit(","), F.lit(".")).try_cast("double") == value["value"].try_cast("double"))
    amount = F.replace(F.replace(F.regexp_extract("value_text", MONEY_FORM, 1), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    money = col("value_text").rlike(MONEY_FORM) & (value["currency"] == "TRY") & (amount == value["amount"])
    words = F.coalesce(F.try_element_at("lexicon", value["value"]), F.array().cast("array<string>"))
    grounded = (
        F.when(value["type"] == "date", (F.size(dates) == 1) & (F.get(dates, 0) == value["value"]))
        .when(value["type"] == "date_range", (F.size(dates) == 2) & (F.get(dates, 0) == value["start"]) & (F.get(dates, 1) == value["end"]))
        .when(value["type"] == "datetime", (col("value_text") == value["value"]) & col("value_text").rlike("(?:Z|[+-][0-9]{2}:[0-9]{2})$"))
        .when(value["type"] == "number", number)
        .when(value["type"] == "money", money)
        .when(value["type"].isin("boolean", "status"), F.array_contains(words, col("folded_value_text")))
        .otherwise(col("value_text") == value["value"])
    )
    rules = [
        (~value_is_valid(value), "rejected", "candidate_schema_invalid"),
        (~col("source_active") | ~col("trusted"), "rejected", "source_not_trusted"),
        (col("version_document_id") != col("document_id"), "rejected", "version_document_mismatch"),
        (~F.equal_null(col("current_version_id"), col("version_id")) | (col("document_status") != "active"), "needs_review", "historical_document_version"),
        ((col("fetched_at") > now) | F.coalesce(col("published_at") > now, F.lit(False)), "needs_review", "future_or_invalid_document_time"),
        ((col("end") <= col("start")) | ~F.equal_null(utf16_slice(col("raw_text"), col("start"), col("end")), col("quote")), "rejected", "evidence_not_exact"),
        (~F.contains("quote", "value_text"), "rejected", "value_text_not_in_evidence"),
        (col("blocks").isNull(), "needs_review", "missing_structure"),
        (F.size("warnings") > 0, "needs_review", None),
        (col("block").isNull(), "rejected", "locator_outside_block_or_page"),
        (~col("known_keys"), "rejected", "unknown_ontology_key"),
        (~col("authorized"), "needs_review", "no_contextual_authority"),
        (~named(col("folded_quote"), col("folded_title"), heading), "needs_review", "entity_not_grounded"),
        (F.exists("ambiguous_when", lambda t: mentions(F.concat_ws(" ", "folded_title", "folded_quote"), t)), "needs_review", "entity_requires_more_specific_scope"),
        (col("page").isNotNull() & ~named(col("folded_quote")), "needs_review", "pdf_entity_not_in_evidence"),
        (~F.exists("cues", lambda c: F.contains(col("folded_quote"), c)), "rejected", "predicate_not_grounded"),
        (label.isNull() | loose, "needs_review", "value_label_relation_ambiguous"),
        (~F.equal_null(col("unit"), col("predicate_unit")) | ~F.array_contains("value_types", value["type"]), "rejected", "type_or_unit_mismatch"),
        (col("reference_period").isNull(), "needs_review", "reference_period_missing"),
        (col("expected_period").isNotNull() & (col("expected_period") != col("reference_period")), "rejected", "reference_period_mismatch"),
        (~_any(*[mentions(t, col("reference_period")) for t in (col("folded_quote"), col("folded_title"), heading)]), "needs_review", "reference_period_not_grounded"),
        ((F.size(years) > 0) & ((F.size(periods) == 0) | (F.size(F.array_except(years, periods)) > 0)), "needs_review", "value_year_differs_from_reference_period"),
        (col("correction_of").isNotNull(), "needs_review", "explicit_correction_requires_resolution"),
        (value["type"] == "json", "needs_review", "json_requires_registered_semantic_validator"),
        (~F.coalesce(grounded, F.lit(False)) & (F.size(dates) == 0) & value["type"].isin("date", "date_range", "datetime"), "needs_review", "value_not_deterministically_grounded"),
        (~F.coalesce(grounded, F.lit(False)), "rejected", "value_not_deterministically_grounded"),
        (F.when(col("page").isNotNull(), col("folded_quote")).otherwise(col("block.folded_text")).rlike(r"\b(?:iptal|duzelt|degistiril|ertelen|onceki|degil)"), "needs_review", "negation_or_correction_context"),
    ]
    verified = ("official_source", "exact_evidence", "structured_locator", "contextual_authority", "typed_value", "explicit_period")
    result = lambda status, reasons: F.struct(F.lit(status).alias("decision"), reasons.alias("reasons"))
    ladder = F
    for broken, status, reason in rules:
        ladder = ladder.when(F.coalesce(broken, F.lit(False)), result(status, F.array(F.lit(reason)) if reason else col("warnings")))
    return rows.withColumn("d", ladder.otherwise(result("verified", F.array(*[F.lit(r) for r in verified])))).select("*", "d.decision", "d.reasons").drop("d", "block")


def _any(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def review_queue(decided: DataFrame) -> DataFrame:
    """(decision, reason, candidates): how many candidates each reason sends where."""
    return decided.select("decision", F.explode("reasons").alias("reason")).groupBy("decision", "reason").agg(F.count("*").alias("candidates"))


def record_extractions(attempts: DataFrame, completed: DataFrame) -> DataFrame:
    """New attempts to store: one completed attempt per idempotency key, any number of failed ones.

    ``attempts``: attempt_id, idempotency_key, status, at. Keys in ``completed`` are done already.
    """
    new = attempts.join(completed.select("idempotency_key").distinct(), "idempotency_key", "left_anti")
    first = new.where("status = 'completed'").groupBy("idempotency_key").agg(F.min_by("attempt_id", F.struct("at", "attempt_id")).alias("attempt_id"))
    return new.join(first.withColumn("take", F.lit(True)), ["idempotency_key", "attempt_id"], "left").where("status <> 'completed' OR take").drop("take")


def facts_of_candidates(verified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, evidence) of verified candidates, each once: facts by claim hash, evidence by its place."""
    claim = json_hash(*[F.col(c) for c in ("subject_entity_id", "topic_id", "predicate", "reference_period")], F.to_json("value"), F.col("unit"), F.col("authority_source_id"))
    rows = verified.withColumn("claim_hash", claim)
    facts = rows.groupBy("claim_hash").agg(*[F.min_by(c, F.struct("at", "candidate_id")).alias(c) for c in (*CONTEXT, "value", "unit", "authority_source_id", "at")])
    return facts, rows.select("claim_hash", "version_id", "quote", "start", "end", "page").distinct()


def publication_gate(facts: DataFrame, audits: DataFrame, endpoints: DataFrame, now: Column) -> DataFrame:
    """The verified facts that may be published.

    ``audits``: fact_id, version_id, grounded. ``endpoints``: fact_id, status, last_success_at,
    last_observed_at, max_age_seconds, reasons; all of a fact's endpoints must be sound.
    """
    age = lambda c: now.cast("double") - F.col(c).cast("double")
    odd = F.size(F.array_except("reasons", F.array(*[F.lit(t) for t in TOLERATED]))) > 0
    sound = (F.col("status") == "active") & F.coalesce(age("last_success_at").between(0, F.col("max_age_seconds")), F.lit(False)) & F.coalesce(age("last_observed_at").between(0, F.col("max_age_seconds")), F.lit(False)) & ~odd
    bad = endpoints.where(~F.coalesce(sound, F.lit(False))).select("fact_id")
    rows = facts.where("status = 'verified'")
    ids = lambda df: df.select(F.col("fact_id").alias("id")).distinct()
    return rows.join(ids(audits.where("grounded")), "id", "left_semi").join(ids(endpoints), "id", "left_semi").join(ids(bad), "id", "left_anti")


def verified_from_provider(facts: DataFrame, candidates: DataFrame, provider: str) -> DataFrame:
    """Verified facts with a verified candidate of the provider (candidates: fact_id, provider, decision)."""
    chosen = candidates.where((F.col("provider") == provider) & (F.col("decision") == "verified")).select(F.col("fact_id").alias("id"))
    return facts.where("status = 'verified'").join(chosen, "id", "left_semi")


def fact_history(facts: DataFrame, actions: DataFrame) -> DataFrame:
    """(fact_id, at, action): lifecycle times and review actions; of equal ones the review action stays."""
    stamps = F.array(*[F.struct(F.col(c).alias("at"), F.lit(a).alias("action")) for c, a in (("created_at", "extracted"), ("verified_at", "verified"), ("published_at", "published"), ("superseded_at", "superseded"))])
    born = facts.select(F.col("id").alias("fact_id"), F.explode(stamps).alias("s")).where("s.at IS NOT NULL").select("fact_id", "s.at", "s.action", F.lit("lifecycle").alias("origin"))
    done = actions.select("fact_id", "at", "action", F.lit("review").alias("origin"))
    return born.unionByName(done).groupBy("fact_id", "at", "action").agg(F.max("origin").alias("origin"))


# --- fixed values: states that take no action
FINAL = ("superseded", "revoked", "expired")


def replay_reviews(facts: DataFrame, actions: DataFrame) -> DataFrame:
    """(fact_id, status, refused): each fact's status after its actions in order of (at, action_id, action).

    publish needs verified; review needs verified or published; reject needs needs_review or verified;
    correct (supersede) needs published. A final status takes no action. Refused actions are listed.
    """
    ordered = actions.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("at", "action_id", "action"))).alias("actions"))
    rows = facts.select(F.col("id").alias("fact_id"), "status").join(ordered, "fact_id", "left")
    may = lambda s, a: ((a == "publish") & (s == "verified")) | ((a == "review") & s.isin("verified", "published")) | ((a == "reject") & s.isin("needs_review", "verified")) | ((a == "correct") & (s == "published"))
    after = lambda a: F.when(a == "publish", "published").when(a == "review", "needs_review").when(a == "reject", "revoked").otherwise("superseded")
    start = F.struct(F.col("status").alias("status"), F.array().cast("array<string>").alias("refused"))

    def step(s, x):
        fine = may(s["status"], x["action"])
        return F.struct(F.when(fine, after(x["action"])).otherwise(s["status"]).alias("status"), F.when(fine, s["refused"]).otherwise(F.concat(s["refused"], F.array(x["action_id"].cast("string")))).alias("refused"))

    end = F.aggregate(F.coalesce("actions", F.array().cast("array<struct<at:timestamp,action_id:bigint,action:string>>")), start, step)
    return rows.withColumn("end", end).select("fact_id", "end.status", "end.refused")


def fact_snapshot(facts: DataFrame, evidence: DataFrame, entities: list[str] | None = None, year: str | None = None, versions: DataFrame | None = None, validations: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """Facts of some entities and a year (or all), each with what it rests on as sorted arrays.

    ``evidence``: fact_id, version_id, quote; ``versions``: version_id, document_id; ``validations``:
    fact_id, decision; ``history``: fact_id, at, action. Adds columns evidence, versions (with their
    documents), validations and history; an empty array where there is nothing.
    """
    chosen = facts
    if entities is not None:
        chosen = chosen.where(F.col("subject_entity_id").isin(entities))
    if year is not None:
        chosen = chosen.where(F.col("reference_period") == year)
    mine = chosen.select(F.col("id").alias("fact_id"))
    parts = [("evidence", evidence, ("version_id", "quote"))]
    if versions is not None:
        parts.append(("versions", evidence.select("fact_id", "version_id").distinct().join(versions, "version_id"), ("version_id", "document_id")))
    parts += [(name, rows, columns) for name, rows, columns in (("validations", validations, ("decision",)), ("history", history, ("at", "action"))) if rows is not None]
    out = chosen
    for name, rows, columns in parts:
        listed = rows.join(mine, "fact_id", "left_semi").groupBy(F.col("fact_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(listed, "id", "left").withColumn(name, F.coalesce(name, F.array().cast(listed.schema[name].dataType)))
    return out
