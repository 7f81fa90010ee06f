"""The public read model: merged feed, listings, histories, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tanik.functions.text import is_breaking


def combine_feed(official: DataFrame, events: DataFrame, now: Column, category: str | None = None, most: int = 50) -> DataFrame:
    """Official items and events as one feed, newest first, undated last, then id.

    Both: id, title, category, published_at. ``category``: a name, or breaking for the last 24 hours.
    Filters come before the limit, so the plan keeps a top-k and every fitting row has its chance.
    """
    rows = official.select("id", "title", "category", "published_at", F.lit("official").alias("origin")).unionByName(events.select("id", "title", "category", "published_at", F.lit("event").alias("origin")))
    if category == "breaking":
        rows = rows.where(is_breaking(F.col("published_at"), now))
    elif category is not None:
        rows = rows.where(F.col("category") == category)
    return rows.orderBy(F.desc_nulls_last("published_at"), "id").limit(most)


def list_news(editions: DataFrame, sources: DataFrame, source: str | None = None, most: int = 1000, quotes: DataFrame | None = None, actions: DataFrame | None = None) -> DataFrame:
    """Current editions of active sources, newest first, with their quotes and the actions that are still trusted.

    editions: edition_id, source_id, current, published_at, first_seen_at. quotes: edition_id, ordinal,
    quote. actions: edition_id, label, url, trusted. The limit comes first, so only what is shown is joined.
    """
    rows = editions.where("current").join(sources.where("status = 'active'").select("source_id"), "source_id", "left_semi")
    if source is not None:
        rows = rows.where(F.col("source_id") == source)
    shown = rows.orderBy(F.desc_nulls_last("published_at"), F.desc("first_seen_at"), "edition_id").limit(most)
    parts = {"quotes": None if quotes is None else quotes.select("edition_id", F.struct("ordinal", "quote").alias("x")), "actions": None if actions is None else actions.where("trusted").select("edition_id", F.struct("label", "url").alias("x"))}
    for name, part in parts.items():
        if part is not None:
            listed = part.groupBy("edition_id").agg(F.array_sort(F.collect_list("x")).alias(name))
            shown = shown.join(listed, "edition_id", "left").withColumn(name, F.coalesce(name, F.array().cast(listed.schema[name].dataType)))
    return shown


def recent_announcements(documents: DataFrame, most: int = 24) -> DataFrame:
    """Active documents by publication, else first sight; newest first."""
    return documents.where("status = 'active'").orderBy(F.desc(F.coalesce("published_at", "first_seen_at")), "document_id").limit(most)


def list_public_events(events: DataFrame, source: str | None = None, most: int = 200) -> DataFrame:
    """Public events that have reports, by their newest publication. events: event_id, sources, published_at."""
    rows = events if source is None else events.where(F.array_contains("sources", source))
    return rows.orderBy(F.desc_nulls_last("published_at"), "event_id").limit(most)


def recent_activity(logs: dict[str, DataFrame], before: Column, most: int = 50, before_id: dict[str, Column] | None = None) -> DataFrame:
    """(log, id, at): the newest ``most`` rows of each log before a time, newest first.

    The next page starts at the last row's time and id (``before_id``: of each log), so rows that
    share a time at the border of two pages are shown once each.
    """
    out = None
    for name, rows in logs.items():
        last = (before_id or {}).get(name)
        older = F.col("at") < before
        page = rows.where(older if last is None else older | ((F.col("at") == before) & (F.col("id") < last))).orderBy(F.desc("at"), F.desc("id")).limit(most).select(F.lit(name).alias("log"), F.col("id").cast("string").alias("id"), "at")
        out = page if out is None else out.unionByName(page)
    return out


def edition_history(editions: DataFrame, by: str = "document_id", most: int = 20) -> DataFrame:
    """The newest ``most`` editions of each document, with their place."""
    place = F.row_number().over(W.partitionBy(by).orderBy(F.desc("at"), F.desc("id")))
    return editions.withColumn("place", place).where(F.col("place") <= most)


def public_events(members: DataFrame, claims: DataFrame, stale_sources: DataFrame, now: Column) -> DataFrame:
    """One row per event as the public sees it: primary report, sources, conflict and staleness flags.

    ``members``: event_id, report_id, source_id, title, published_at, discovered_at (latest revisions
    of open-web reports). ``claims``: event_id, status. Future reports are left out; an event is stale
    if any of its sources is.
    """
    rows = members.where(F.coalesce("published_at", "discovered_at") <= now)
    newest = F.max_by(F.struct("report_id", "title"), F.struct(F.coalesce("published_at", F.timestamp_seconds(F.lit(0))), "report_id")).alias("primary")
    base = rows.join(stale_sources.select("source_id", F.lit(True).alias("old")), "source_id", "left").groupBy("event_id").agg(newest, F.max("published_at").alias("published_at"), F.max("discovered_at").alias("checked_at"), F.array_sort(F.collect_set("source_id")).alias("sources"), F.coalesce(F.bool_or("old"), F.lit(False)).alias("stale"))
    marks = claims.groupBy("event_id").agg(F.bool_or(F.col("status") == "conflicting").alias("conflicts"), F.count_if(F.col("status") != "superseded").alias("claims"))
    out = base.join(marks, "event_id", "left")
    return out.select("event_id", F.col("primary.report_id").alias("primary_report_id"), F.col("primary.title").alias("title"), "published_at", "checked_at", "sources", "stale", F.coalesce("conflicts", F.lit(False)).alias("conflicts"), F.coalesce("claims", F.lit(0)).alias("claims"))


def edition_gate(editions: DataFrame, now: Column) -> DataFrame:
    """Editions that may be published: active current trusted html without warnings, 1 to 4 checked quotes, known links.

    editions: status, current, mime_type, trusted, warnings, published_at, quotes (array of struct(quote,
    ok)), actions (array of urls), links (array of urls).
    """
    fine = (F.col("status") == "active") & F.col("current") & (F.col("mime_type") == "text/html") & F.col("trusted") & (F.size("warnings") == 0) & F.coalesce(F.col("published_at") <= now, F.lit(True))
    quotes = F.size("quotes").between(1, 4) & F.forall("quotes", lambda q: q["ok"])
    return editions.where(fine & quotes & (F.size(F.array_except("actions", "links")) == 0))


def answer_news(answers: DataFrame, editions: DataFrame) -> DataFrame:
    """The edition of the very version on which an answer rests: answers (resource, year, document_id, version_id)."""
    joined = answers.join(editions, ["document_id", "version_id"])
    first = F.min_by(F.struct("edition_id", "document_id", "version_id"), "edition_id")
    return joined.groupBy("resource", "year").agg(first.alias("e")).select("resource", "year", "e.*")
