"""Reports, raw responses and event tables: reading with checks, idempotent appends, flat writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tanik.functions.ids import json_hash
from tanik.sources.store import BatchStore

REPORT = (
    "id string, key string, source_id string, source_family string, source_reliability double, canonical_url string, title string, text string, "
    "content_hash string, published_at timestamp, modified_at timestamp, discovered_at timestamp, official_version_id string, metadata map<string,string>"
)
NEWS_SOURCE = "id string, name string, owner string, kind string, url string, hosts array<string>, reliability double, max_reports int, poll_seconds int, active boolean"


def read_registry(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """News sources from JSON (one document, or one source a line) with a fixed schema; missing settings get their defaults."""
    raw = spark.read.schema(NEWS_SOURCE).json(path, multiLine=not lines)
    defaults = {"reliability": 0.5, "max_reports": 30, "poll_seconds": 900, "active": True}
    return raw.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in raw.columns])


def split_reports(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows that keep to the report schema, and the others with their ``problems``."""
    checks = [("title", F.length("title").between(1, 1000)), ("text", F.length("text").between(40, 100000)), ("id", F.col("id").rlike("^[0-9a-f]{64}$")), ("key", F.col("key").rlike("^[0-9a-f]{64}$")), ("content_hash", F.col("content_hash").rlike("^[0-9a-f]{64}$")), ("reliability", F.col("source_reliability").between(0, 1)), ("discovered_at", F.col("discovered_at").isNotNull())]
    problems = F.array_compact(F.array(*[F.when(~F.coalesce(fine, F.lit(False)), name) for name, fine in checks]))
    rows = raw.withColumn("problems", problems)
    return rows.where(F.size("problems") == 0).drop("problems"), rows.where(F.size("problems") > 0)


def read_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) reports of JSON lines; a line that is no report is bad, with its text in ``_corrupt_record``."""
    return split_reports(spark.read.schema(f"{REPORT}, _corrupt_record string").json(path, mode="PERMISSIVE"))


def with_identity(rows: DataFrame) -> DataFrame:
    """Adds content_hash, key and id; the time of discovery is no part of any."""
    content = json_hash(F.col("title"), F.col("text"), F.col("published_at"), F.col("modified_at"))
    keyed = rows.withColumn("content_hash", content).withColumn("key", json_hash(F.col("source_id"), F.col("canonical_url")))
    return keyed.withColumn("id", json_hash(F.col("key"), F.col("content_hash")))


def scan_reports(reports: DataFrame, assigned: DataFrame, namespace: str, start: Column, end: Column, sources: list[str] | None = None, most: int = 1000) -> DataFrame:
    """Stored reports of a discovery range that are not yet in the namespace, oldest first."""
    rows = reports.where(F.col("discovered_at").between(start, end))
    if sources is not None:
        rows = rows.where(F.col("source_id").isin(sources))
    done = assigned.where(F.col("namespace") == namespace).select(F.col("report_id").alias("id"))
    return rows.join(done, "id", "left_anti").orderBy(F.coalesce("published_at", "discovered_at"), "discovered_at", "id").limit(most)


def new_reports(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows of a batch to append: new ids, and new (source, URL, content) triples, once each."""
    place = ["source_id", "canonical_url", "content_hash"]
    first = F.min_by(F.struct(*batch.columns), F.struct("discovered_at", "id"))
    once = batch.groupBy("id").agg(first.alias("r")).select("r.*").groupBy(*place).agg(first.alias("r")).select("r.*")
    return once.join(stored.select("id"), "id", "left_anti").join(stored.select(*place), place, "left_anti").select(*batch.columns)


def append_reports(batch: DataFrame, store: BatchStore, name: int | str, table: str = "reports") -> bool:
    """Adds the new rows of a batch to a table of a store under the batch's name; a repeated call does nothing."""
    return not store.counts(name) and store.write(name, {table: new_reports(batch, store.read(table).drop("batch"))})


def publication_range(reports: DataFrame, start: Column, end: Column) -> DataFrame:
    """Reports published in [start, end]; an unknown date passes."""
    return reports.where(F.col("published_at").isNull() | F.col("published_at").between(start, end))


def current_revisions(reports: DataFrame) -> DataFrame:
    """The latest revision of each report key by (discovered_at, id); a grouped maximum, not a sort."""
    return reports.groupBy("key").agg(F.max_by(F.struct(*reports.columns), F.struct("discovered_at", "id")).alias("r")).select("r.*")


def distinct_items(rows: DataFrame, by: list[str], position: str) -> DataFrame:
    """One row for each value of ``by``: the last one by ``position``, with first_position and the number of items."""
    rest = [c for c in rows.columns if c not in by]
    out = rows.groupBy(*by).agg(F.max_by(F.struct(*rest), position).alias("r"), F.min(position).alias("first_position"), F.count("*").alias("items"))
    return out.select(*by, "r.*", "first_position", "items")


def union_reports(web: DataFrame, official: DataFrame) -> DataFrame:
    """Open-web and official reports in one table."""
    return web.unionByName(official, allowMissingColumns=True)


def bridge_official(documents: DataFrame, versions: DataFrame, sources: DataFrame, members: DataFrame, most: int = 100) -> DataFrame:
    """Current active parsed official documents, not yet in an event, as the newest report rows.

    documents: document_id, source_id, canonical_url, current_version_id, status. versions: version_id,
    title, raw_text, published_at, fetched_at, parsed. sources: source_id, name, host, trusted.
    members: official_version_id.
    """
    rows = documents.where("status = 'active'").join(versions.where("parsed").where(F.length("raw_text").between(40, 100000)), F.col("current_version_id") == F.col("version_id"))
    rows = rows.join(sources.where("trusted").select("source_id", "host"), "source_id").join(members.select(F.col("official_version_id").alias("version_id")), "version_id", "left_anti")
    out = rows.select(F.concat(F.lit("official:"), F.col("host")).alias("source_id"), F.lit(None).cast("string").alias("source_family"), F.lit(1.0).alias("source_reliability"), "canonical_url", "title", F.col("raw_text").alias("text"), "published_at", F.lit(None).cast("timestamp").alias("modified_at"), F.col("fetched_at").alias("discovered_at"), F.col("version_id").alias("official_version_id"))
    return with_identity(out).orderBy(F.desc_nulls_last("published_at"), F.desc("discovered_at"), "id").limit(most)


def archive_artifacts(responses: DataFrame, most: int = 10_000_000) -> tuple[DataFrame, DataFrame]:
    """(artifacts, links) of responses (version_id, parent_version_id, url, body_base64, fetched_at).

    artifacts: one row per SHA-256 of 1 byte to ``most``. links: null-safe distinct (version, parent, URL, hash).
    """
    rows = responses.withColumn("bytes", F.unbase64("body_base64")).where(F.octet_length("bytes").between(1, most)).withColumn("hash", F.sha2("bytes", 256))
    artifacts = rows.groupBy("hash").agg(F.first("bytes").alias("bytes"), F.min("fetched_at").alias("first_fetched_at")).withColumn("size", F.octet_length("bytes"))
    return artifacts, rows.select("version_id", "parent_version_id", "url", "hash").distinct()


def event_tables(events: DataFrame, namespace: str) -> dict[str, DataFrame]:
    """Flat tables of nested event snapshots (event_id, kind, reports, claims with evidence, timeline)."""
    base = events.withColumn("namespace", F.lit(namespace))
    reports = base.select("namespace", "event_id", F.explode("reports").alias("r")).select("namespace", "event_id", "r.*")
    time = F.coalesce("occurred_at", "published_at", "discovered_at")
    span = reports.groupBy("event_id").agg(F.min(time).alias("range_start"), F.max(time).alias("range_end"))
    claims = base.select("namespace", "event_id", F.explode("claims").alias("c")).select("namespace", "event_id", "c.*")
    evidence = claims.select("namespace", "event_id", "claim_id", F.explode("evidence").alias("x")).select("namespace", "event_id", "claim_id", "x.*")
    updates = base.select("namespace", "event_id", F.explode("timeline").alias("u")).select("namespace", "event_id", "u.*")
    return {"events": base.select("namespace", "event_id", "kind").join(span, "event_id", "left"), "event_reports": reports, "claims": claims.drop("evidence"), "evidence": evidence, "updates": updates}


def event_store(spark: SparkSession, events: DataFrame, folder: str) -> BatchStore:
    """The flat tables of events like these in a folder; a batch is a namespace."""
    return BatchStore(spark, folder, {name: rows.drop("namespace").schema for name, rows in event_tables(events, "").items()}, "string")


def write_event_tables(events: DataFrame, namespace: str, folder: str) -> bool:
    """Writes the flat tables of a namespace; readers see all of them or none, and a repeated call does nothing."""
    tables = {name: rows.drop("namespace") for name, rows in event_tables(events, namespace).items()}
    return event_store(events.sparkSession, events, folder).write(namespace, tables)
