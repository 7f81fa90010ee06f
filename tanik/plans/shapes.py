"""The given tables in the shapes that the jobs read, and the same shapes as SQL for the twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tanik.functions.text import normalize_content
from tanik.operators.versions import fingerprint
from tanik.session import table

#: Times count from the first day of the event table.
START = "TIMESTAMP '2024-01-01 00:00:00'"
NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def now() -> Column:
    return F.expr(NOW)


def at_minutes(minutes: Column) -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + minutes * 60)


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """documents as fetches of logical pages: three doc_ids in a row of one source share a URL."""
    rows = table(spark, sf, "documents")
    body = F.col("text")
    return rows.select(
        F.col("doc_id").alias("observation_id"), F.col("source").alias("source_id"), F.concat(F.lit("https://"), "source", F.lit(".example.org/"), (F.col("doc_id") % 7).cast("string")).alias("canonical_url"),
        F.concat(F.lit("t"), (F.col("doc_id") % 5).cast("string")).alias("title"), at_minutes(F.col("doc_id") * 5 - (F.col("doc_id") % 4) * 600).alias("fetched_at"), F.col("doc_id").alias("arrival"),
        F.sha2(normalize_content(body), 256).alias("content_hash"), body.alias("text"))


#: The content rule in SQL.
CONTENT_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\t ]+', ' ', 'g'), '[^\S\n]*\n[^\S\n]*', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""
OBSERVED = rf"""obs AS (SELECT doc_id AS observation_id, source AS source_id, 'https://' || source || '.example.org/' || (doc_id % 7) AS canonical_url, 't' || (doc_id % 5) AS title,
  {START} + to_seconds((doc_id * 5 - (doc_id % 4) * 600) * 60) AS fetched_at, doc_id AS arrival, sha256({CONTENT_SQL}) AS content_hash FROM documents)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """events as crawl runs of endpoints."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "partial").when(F.col("event_type") == "signup", "running").otherwise("success")
    return table(spark, sf, "events").select(F.col("user_id").alias("endpoint_id"), F.col("event_id").alias("run_id"), F.col("ts").cast("timestamp").alias("started_at"), status.alias("status"), F.floor(F.coalesce("value", F.lit(0.0))).cast("long").alias("discovered"))


RUNS = """runs AS (SELECT user_id AS endpoint_id, event_id AS run_id, ts AS started_at,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'partial' WHEN 'signup' THEN 'running' ELSE 'success' END AS status, floor(coalesce(value, 0))::BIGINT AS discovered FROM events)"""


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as facts: part is the entity, return flag the predicate, ship year the period."""
    rows = table(spark, sf, "lineitem")
    none = F.lit(None).cast("string")
    amount = F.col("l_quantity").cast("int").cast("string")
    value = F.struct(F.lit("number").alias("type"), amount.alias("value"), none.alias("start"), none.alias("end"), none.alias("amount"), none.alias("currency"), none.alias("schema_key"), none.alias("json"))
    status = F.element_at(F.array(*[F.lit(s) for s in ("verified", "published", "superseded", "extracted")]), (F.col("l_orderkey") % 4 + 1).cast("int"))
    shipped = F.col("l_shipdate").cast("timestamp")
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_partkey").alias("subject_entity_id"), (F.col("l_suppkey") % 5).alias("topic_id"), F.col("l_returnflag").alias("predicate"),
        F.year("l_shipdate").cast("string").alias("reference_period"), value.alias("value"), F.lit("piece").alias("unit"), F.col("l_suppkey").alias("authority_source_id"), status.alias("status"), shipped.alias("created_at"),
        F.when(F.col("l_orderkey") % 4 != 3, shipped + F.expr("INTERVAL 1 DAY")).alias("verified_at"), F.when(F.col("l_orderkey") % 4 == 1, shipped + F.expr("INTERVAL 2 DAYS")).alias("published_at"),
        F.when(F.col("l_orderkey") % 4 == 2, shipped + F.expr("INTERVAL 9 DAYS")).alias("superseded_at"), shipped.alias("valid_from"), (shipped + F.expr("INTERVAL 400 DAYS")).alias("valid_until"), F.lit(None).cast("timestamp").alias("effective_at"))


FACTS = """facts AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_partkey AS subject_entity_id, l_suppkey % 5 AS topic_id, l_returnflag AS predicate, year(l_shipdate)::VARCHAR AS reference_period,
  l_quantity::INT::VARCHAR AS value, l_suppkey AS authority_source_id, ['verified', 'published', 'superseded', 'extracted'][l_orderkey % 4 + 1] AS status, l_shipdate AS created_at,
  CASE WHEN l_orderkey % 4 <> 3 THEN l_shipdate + INTERVAL 1 DAY END AS verified_at, CASE WHEN l_orderkey % 4 = 1 THEN l_shipdate + INTERVAL 2 DAY END AS published_at,
  CASE WHEN l_orderkey % 4 = 2 THEN l_shipdate + INTERVAL 9 DAY END AS superseded_at, l_shipdate AS valid_from, l_shipdate + INTERVAL 400 DAY AS valid_until FROM lineitem)"""


def rules(spark: SparkSession, sf: str) -> DataFrame:
    """supplier as authority rules on topics; one in three holds for all entities."""
    day = F.expr("TIMESTAMP '1992-01-01 00:00:00'")
    rows = table(spark, sf, "supplier")
    return rows.select(
        (F.col("s_suppkey") % 5).alias("topic_id"), F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("predicate"),
        F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey") * 2).alias("subject_entity_id"), F.col("s_suppkey").alias("source_id"), (day + F.make_interval(days=(F.col("s_suppkey") % 900).cast("int"))).alias("valid_from"),
        F.when(F.col("s_suppkey") % 2 == 0, day + F.make_interval(days=(F.col("s_suppkey") % 900 + 2000).cast("int"))).alias("valid_until"), F.when(F.col("s_acctbal") < 0, "revoked").otherwise("active").alias("status"))


RULES = """rules AS (SELECT s_suppkey % 5 AS topic_id, ['A', 'N', 'R'][s_suppkey % 3 + 1] AS predicate, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey * 2 END AS subject_entity_id, s_suppkey AS source_id,
  TIMESTAMP '1992-01-01' + to_days((s_suppkey % 900)::INT) AS valid_from, CASE WHEN s_suppkey % 2 = 0 THEN TIMESTAMP '1992-01-01' + to_days((s_suppkey % 900 + 2000)::INT) END AS valid_until,
  CASE WHEN s_acctbal < 0 THEN 'revoked' ELSE 'active' END AS status FROM supplier)"""


def fingerprints(rows: DataFrame) -> DataFrame:
    return rows.withColumn("fingerprint", fingerprint(F.col("title"), F.col("text"), F.lit("text/html"), F.lit("page"), F.col("fetched_at")))
