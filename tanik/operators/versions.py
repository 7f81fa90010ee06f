"""Document versions: what each observation of a page changed, and the state that results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tanik.functions.ids import json_hash
from tanik.functions.text import normalize_content

DOCUMENT = ("source_id", "canonical_url")


def fingerprint(title: Column, text: Column, mime: Column, kind: Column, published: Column, attachments: Column | None = None) -> Column:
    """SHA-256 of the ordered content of a page; null if its text is empty. Attachment order is irrelevant."""
    files = F.array_join(F.array_sort(attachments), "\n") if attachments is not None else F.lit("")
    body = normalize_content(text)
    parts = F.array(F.lit("v1"), normalize_content(title), body, mime, kind, published.cast("string"), files)
    return F.when(F.length(body) > 0, F.sha2(F.to_json(parts), 256))


def extraction_key(version: Column, provider: Column, model: Column, most: Column, prompt: Column, ontology: Column, validator: Column) -> Column:
    """Identity of an extraction: the same version read the same way is the same work."""
    return json_hash(version, provider, model, most, prompt, ontology, validator)


def reject_stale(observations: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Adds ``accepted``: false where a fetch is older than one already accepted for its document."""
    before = W.partitionBy(*DOCUMENT).orderBy(arrival).rowsBetween(W.unboundedPreceding, -1)
    latest = F.max("fetched_at").over(before)
    return observations.withColumn("accepted", latest.isNull() | (F.col("fetched_at") >= latest))


def detect_versions(observations: DataFrame) -> DataFrame:
    """Adds ``outcome``: new_document, unchanged or new_version against the fetch before."""
    previous = F.lag("content_hash").over(W.partitionBy(*DOCUMENT).orderBy("fetched_at", "observation_id"))
    outcome = F.when(previous.isNull(), "new_document").when(previous == F.col("content_hash"), "unchanged").otherwise("new_version")
    return observations.withColumn("outcome", outcome)


def document_versions(observations: DataFrame) -> DataFrame:
    """One row for each (document, content): first fetch, and how often it was seen."""
    return observations.groupBy(*DOCUMENT, "content_hash").agg(F.min("fetched_at").alias("first_fetched_at"), F.count("*").alias("observations"))


def current_documents(observations: DataFrame) -> DataFrame:
    """The state of each document; a grouped maximum, so no document's history is sorted."""
    latest = F.max_by(F.struct("content_hash", "title"), F.struct("fetched_at", "observation_id"))
    found = observations.groupBy(*DOCUMENT).agg(F.min("fetched_at").alias("first_seen_at"), F.max("fetched_at").alias("latest_seen_at"), F.countDistinct("content_hash").alias("versions"), F.count("*").alias("observations"), latest.alias("latest"))
    return found.select(*DOCUMENT, "first_seen_at", "latest_seen_at", "versions", "observations", F.col("latest.content_hash").alias("current_hash"), F.col("latest.title").alias("title"))


def dedupe_crawl(discovered: DataFrame) -> DataFrame:
    """Adds ``status``: kept, duplicate_discovery (same URL in the run) or duplicate_canonical (same page)."""
    by_url = F.row_number().over(W.partitionBy("crawl_run_id", "url").orderBy("position"))
    rows = discovered.withColumn("seen", by_url)
    first = F.when(F.col("seen") == 1, F.col("position"))
    by_page = F.min(first).over(W.partitionBy("crawl_run_id", "canonical_url"))
    status = F.when(F.col("seen") > 1, "duplicate_discovery").when(F.col("position") > by_page, "duplicate_canonical").otherwise("kept")
    return rows.withColumn("status", status).drop("seen")
