"""Events as the public sees them: eligible reports, and claims that rest on these reports alone."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tanik.functions.ids import quote_matches, utf16_length, utf16_slice
from tanik.operators.claims import reconcile_claims
from tanik.session import saved


class PublicView(NamedTuple):
    """Three tables, so that an event with very many reports is never one row."""

    events: DataFrame  #: event_id, primary_report_id, title, published_at, checked_at, reports, stale, conflicts, claims
    sources: DataFrame  #: event_id, report_id, source_id, name, title, url, published_at, checked_at, excerpt, stale
    claims: DataFrame  #: as of ``reconcile_claims``, without superseded claims


def excerpt_of(text: Column, most: int = 300) -> Column:
    """The first ``most`` UTF-16 units of a text, one fewer where that would split a character, and "…" if there is more."""
    cut = F.coalesce(utf16_slice(text, F.lit(0), F.lit(most)), utf16_slice(text, F.lit(0), F.lit(most - 1)))
    return F.when(utf16_length(text) > most, F.concat(cut, F.lit("…"))).otherwise(text)


def eligible_reports(reports: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Reports that may be shown, one row per event and report, with their source's name, last check and ``stale``.

    Official and test reports, reports of the future, and addresses that are not plain https on one of the
    source's hosts are left out. A source is stale if it was never checked, not within twice its interval (half an hour
    at least), or its last run had an error or failures.
    """
    authority = F.regexp_extract("canonical_url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(authority, ":443$", ""))
    secure = F.lower(F.substring("canonical_url", 1, 8)) == "https://"
    fine = F.col("official_version_id").isNull() & ~F.coalesce("fixture", F.lit(False)) & secure & F.array_contains("hosts", host) & F.coalesce(F.col("published_at") <= now, F.lit(True))
    late = (now.cast("double") - F.col("checked_at").cast("double")) > F.greatest(F.lit(1800), F.col("interval_seconds") * 2)
    stale = F.coalesce(late, F.lit(True)) | F.col("error").isNotNull() | (F.coalesce("failures", F.lit(0)) > 0)
    known = sources.select("source_id", "name", "hosts", "interval_seconds", "checked_at", "error", "failures")
    rows = reports.join(known, "source_id").where(fine).withColumn("stale", stale)
    return rows.select("event_id", "report_id", "source_id", "name", "title", "text", "canonical_url", "published_at", "checked_at", "stale").dropDuplicates(["event_id", "report_id"])


def public_view(reports: DataFrame, sources: DataFrame, evidence: DataFrame, now: Column) -> PublicView:
    """The public view of events at the time ``now``; an event without an eligible report is not in it.

    ``reports``: event_id, report_id, source_id, title, text, canonical_url, published_at, official_version_id,
    fixture (latest revisions). ``sources``: source_id, name, hosts, interval_seconds, checked_at, error, failures.
    ``evidence``: as in claims, with quote, start, end in UTF-16 units of the report's text. Claims are reconciled
    anew from the evidence of eligible reports; a claim of which any quote is not the text at its place is not
    shown, though other values of it still contradict it. primary: the newest report, undated ones last, then the smallest id.
    """
    rows = saved(eligible_reports(reports, sources, now))
    age = -F.coalesce(F.unix_micros(F.col("published_at").cast("timestamp")), F.lit(0))
    primary = F.min_by(F.struct("report_id", "title", "published_at"), F.struct(age.alias("age"), "report_id")).alias("primary")
    base = rows.groupBy("event_id").agg(primary, F.max("checked_at").alias("checked_at"), F.count("*").alias("reports"), F.bool_or("stale").alias("stale"))
    own = saved(evidence.join(rows.select("event_id", "report_id", "text"), ["event_id", "report_id"]).withColumn("exact", quote_matches(F.col("text"), F.col("quote"), F.col("start"), F.col("end"))).drop("text", "quote", "start", "end"))
    claim = ["event_id", "predicate", "scope", "value"]
    sound = own.groupBy(*claim).agg(F.bool_and("exact").alias("exact")).where("exact").drop("exact")
    told = saved(reconcile_claims(own.drop("exact")).join(sound, claim, "left_semi"))
    marks = told.groupBy("event_id").agg(F.bool_or(F.col("status") == "conflicting").alias("conflicts"), F.count_if(F.col("status") != "superseded").alias("claims"))
    out = base.join(marks, "event_id", "left").select("event_id", F.col("primary.report_id").alias("primary_report_id"), "primary.title", "primary.published_at", "checked_at", "reports", "stale", F.coalesce("conflicts", F.lit(False)).alias("conflicts"), F.coalesce("claims", F.lit(0)).alias("claims"))
    shown = rows.select("event_id", "report_id", "source_id", "name", "title", F.col("canonical_url").alias("url"), "published_at", "checked_at", excerpt_of(F.col("text")).alias("excerpt"), "stale")
    return PublicView(out, shown, told.where("status <> 'superseded'"))
