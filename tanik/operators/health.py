"""Crawl statistics, coverage, source health and data-quality counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tanik.functions.ids import quote_matches


def crawl_stats(items: DataFrame) -> DataFrame:
    """Per run: discovered, fetched, changed, errors and the status they amount to."""
    counts = items.groupBy("crawl_run_id").agg(F.count("*").alias("discovered"), F.count_if(F.col("outcome") != "error").alias("fetched"), F.count_if(F.col("outcome").isin("new_document", "new_version")).alias("changed"), F.count_if(F.col("outcome") == "error").alias("errors"))
    status = F.when(F.col("errors") == 0, "success").when(F.col("fetched") > 0, "partial").otherwise("failed")
    return counts.withColumn("status", status)


def source_crawl_stats(sources: DataFrame, endpoints: DataFrame, found: DataFrame, responses: DataFrame, begin: Column | None = None, end: Column | None = None) -> DataFrame:
    """What a crawl did at each source: one row per source, zeros where nothing happened.

    ``sources``: source_id, max_reports, max_pages. ``endpoints``: source_id, url, visited, problem (null: read).
    ``found``: source_id, url, position: links of the endpoints, repeats included. ``responses``: source_id, url,
    fetched, not_modified, problem (null: parsed), published_at, date_problem. discovered: different links, as many
    as max_reports allows; bounded: a link came after them, or endpoints were left; parsed: without a problem and,
    where dated, within [begin, end]; publication_missing and date_problems also count those outside. Nulls are
    false. Only sums and extremes are dealt out, so a source with most rows is no task of its own.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    read = yes("visited") & F.col("problem").isNull()
    by_endpoint = endpoints.groupBy("source_id").agg(F.count_if(read).alias("discovery_successes"), F.count_if(yes("visited") & F.col("problem").isNotNull()).alias("discovery_failures"), F.max(~yes("visited")).alias("left_over"))
    links = found.where("url IS NOT NULL").groupBy("source_id", "url").agg(F.min("position").alias("first"), F.max("position").alias("last"))
    by_link = links.groupBy("source_id").agg(F.count("*").alias("links"), F.max("first").alias("newest"), F.max("last").alias("latest"))
    parsed = yes("fetched") & F.col("problem").isNull()
    told = parsed & F.col("published_at").isNotNull()
    outside = F.lit(False)
    if begin is not None:
        outside = outside | (told & (F.col("published_at") < begin))
    if end is not None:
        outside = outside | (told & (F.col("published_at") > end))
    by_response = responses.groupBy("source_id").agg(
        F.count_if(yes("fetched")).alias("fetched"), F.count_if(yes("fetched") & yes("not_modified")).alias("unchanged"), F.count_if(parsed & ~outside).alias("parsed"), F.count_if(~parsed).alias("failed"),
        F.count_if(parsed & F.col("published_at").isNull()).alias("publication_missing"), F.count_if(parsed & yes("date_problem")).alias("date_problems"))
    rows = sources.join(by_link, "source_id", "left").join(by_endpoint, "source_id", "left").join(by_response, "source_id", "left")
    full = F.coalesce((F.col("links") > F.col("max_reports")) | ((F.col("links") == F.col("max_reports")) & (F.col("latest") > F.col("newest"))), F.lit(False))
    counts = ("fetched", "unchanged", "parsed", "failed", "publication_missing", "date_problems", "discovery_successes", "discovery_failures")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select("source_id", zero(F.least(F.coalesce("links", F.lit(0)), F.col("max_reports"))).alias("discovered"), *[zero(F.col(c)).alias(c) for c in counts], (full | yes("left_over")).alias("bounded"))


def crawl_errors(endpoints: DataFrame, responses: DataFrame) -> DataFrame:
    """(source_id, url, reason): what went wrong in a crawl; an endpoint that was not visited is no error."""
    first = endpoints.where(F.col("visited") & F.col("problem").isNotNull()).select("source_id", "url", F.col("problem").alias("reason"))
    failed = F.when(F.col("problem").isNotNull(), F.col("problem")).when(~F.coalesce(F.col("fetched"), F.lit(False)), "report_failed")
    return first.unionByName(responses.select("source_id", "url", failed.alias("reason")).where("reason IS NOT NULL"))


def assess_coverage(runs: DataFrame, back: int = 10, share: float = 0.3) -> DataFrame:
    """Adds ``reasons`` and ``complete`` to runs (endpoint_id, started_at, run_id, status, discovered).

    Against the ``back`` runs before: discovered under ``share`` of the upper median of at least three
    successes; failed after two failures; or not a success.
    """
    order = W.partitionBy("endpoint_id").orderBy("started_at", "run_id")
    earlier = F.collect_list(F.struct("status", "discovered")).over(order.rowsBetween(-back, -1))
    wins = F.array_sort(F.transform(F.filter(earlier, lambda r: r["status"] == "success"), lambda r: r["discovered"]))
    rows = runs.withColumn("wins", wins).withColumn("lag1", F.lag("status", 1).over(order)).withColumn("lag2", F.lag("status", 2).over(order))
    median = F.element_at("wins", F.floor(F.size("wins") / 2).cast("int") + 1)
    collapse = F.when(F.size("wins") >= 3, F.col("discovered") < median * share).otherwise(False)
    again = (F.col("status") == "failed") & (F.col("lag1") == "failed") & (F.col("lag2") == "failed")
    reasons = F.array_compact(F.array(F.when(collapse, "parser_drift_count_collapse"), F.when(F.coalesce(again, F.lit(False)), "repeated_source_failures"), F.when(F.col("status") != "success", "crawl_incomplete")))
    return rows.withColumn("reasons", reasons).withColumn("complete", F.size("reasons") == 0).drop("wins", "lag1", "lag2")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest finished run of each endpoint, and its last success."""
    done = runs.where("status <> 'running'")
    newest = F.max_by(F.struct("run_id", "status", "started_at"), F.struct("started_at", "run_id")).alias("newest")
    last = F.max(F.when(F.col("status") == "success", F.col("started_at"))).alias("last_success_at")
    return done.groupBy("endpoint_id").agg(newest, last).select("endpoint_id", "newest.*", "last_success_at")


def patience(poll_seconds, official):
    """Seconds without a success after which a source is stale: max(3 polls, 1 hour) for official ones, max(2 polls, 30 minutes) for others."""
    return F.when(official, F.greatest(3 * poll_seconds, F.lit(3600))).otherwise(F.greatest(2 * poll_seconds, F.lit(1800)))


def is_stale(last_success, now, poll_seconds, official):
    """No success for longer than the source's ``patience``."""
    return last_success.isNull() | (now.cast("double") - last_success.cast("double") > patience(poll_seconds, official))


def source_health(sources: DataFrame, reports: DataFrame, attempts: DataFrame, assigned: DataFrame, now) -> DataFrame:
    """Per source: reports, pending reports, attempts of the last day by status, staleness.

    ``sources``: source_id, official, poll_seconds. ``attempts``: source_id, at, status. One aggregate
    for each table, joined to the list of sources.
    """
    pending = reports.join(assigned.select("report_id").distinct(), "report_id", "left_anti").groupBy("source_id").agg(F.count("*").alias("pending_reports"))
    total = reports.groupBy("source_id").agg(F.count("*").alias("reports"))
    day = F.col("at") > now - F.expr("INTERVAL 1 DAY")
    tried = attempts.groupBy("source_id").agg(*[F.count_if(day & (F.col("status") == s)).alias(f"{s}_attempts") for s in ("success", "partial", "failed")], F.max(F.when(F.col("status") == "success", F.col("at"))).alias("last_success_at"))
    out = sources.join(total, "source_id", "left").join(pending, "source_id", "left").join(tried, "source_id", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("reports", "pending_reports", "success_attempts", "partial_attempts", "failed_attempts")]
    return out.select("source_id", *counts, is_stale(F.col("last_success_at"), now, F.col("poll_seconds"), F.col("official")).alias("stale"))


def quality_checks(texts: DataFrame, evidence: DataFrame, claims: DataFrame, events: DataFrame, updates: DataFrame) -> DataFrame:
    """(check, violations): quotes that are not in their text, claims without evidence, events without update."""
    wrong = evidence.join(texts, "report_id").where(~quote_matches(F.col("text"), F.col("quote"), F.col("start"), F.col("end")))
    bare = claims.join(evidence, ["event_id", "claim_id"], "left_anti")
    still = events.join(updates, "event_id", "left_anti")
    named = [("quote_mismatch", wrong), ("claim_without_evidence", bare), ("event_without_update", still)]
    counts = [df.agg(F.count("*").alias("violations")).select(F.lit(n).alias("check"), "violations") for n, df in named]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def endpoint_checks(runs: DataFrame, observed: DataFrame, extractions: DataFrame) -> DataFrame:
    """Per endpoint's newest run: ``extraction_complete`` if it is a complete success and all its versions are extracted.

    ``runs``: endpoint_id, run_id, started_at, status, reasons. ``observed``: run_id, version_id.
    ``extractions``: version_id, completed, verified.
    """
    newest = runs.where("status <> 'running'").groupBy("endpoint_id").agg(F.max_by(F.struct("run_id", "status", "reasons"), F.struct("started_at", "run_id")).alias("n")).select("endpoint_id", "n.*")
    done = extractions.groupBy("version_id").agg(F.bool_or(F.col("completed")).alias("completed"), F.bool_and(F.col("verified")).alias("verified"))
    seen = observed.join(done, "version_id", "left").groupBy("run_id").agg(F.count("*").alias("documents"), F.bool_and(F.coalesce(F.col("completed") & F.col("verified"), F.lit(False))).alias("all_done"))
    rows = newest.join(seen, "run_id", "left")
    complete = (F.col("status") == "success") & (F.size("reasons") == 0) & (F.coalesce("documents", F.lit(0)) > 0) & F.coalesce("all_done", F.lit(False))
    return rows.select("endpoint_id", "run_id", "status", F.coalesce("documents", F.lit(0)).alias("documents"), complete.alias("extraction_complete"))


def system_health(endpoints: DataFrame, tolerated: tuple[str, ...] = ()) -> DataFrame:
    """One row ``ok``: every endpoint's newest run is a success, not stale, with tolerated reasons only."""
    fine = (F.col("status") == "success") & ~F.col("stale") & (F.size(F.array_except("reasons", F.array(*[F.lit(t) for t in tolerated]).cast("array<string>"))) == 0)
    return endpoints.agg(F.coalesce(F.bool_and(fine), F.lit(True)).alias("ok"), F.count("*").alias("endpoints"))


def daily_counts(events: DataFrame, now=None, keep_days: int = 30) -> DataFrame:
    """Rows per (day, kind, key), without days older than ``keep_days`` before ``now``."""
    rows = events.withColumn("day", F.to_date("at"))
    if now is not None:
        rows = rows.where(F.col("day") >= F.date_sub(F.to_date(now), keep_days))
    return rows.groupBy("day", "kind", "key").agg(F.count("*").alias("n"))
