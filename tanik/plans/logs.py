"""Queries over observations, crawl runs and counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tanik.functions.ids import number_json, quote_matches, utf16_length, utf16_slice
from tanik.functions.text import event_kind, excerpt, is_breaking, is_recent, jaccard, normalize_content, normalize_text, word_set
from tanik.operators import health, versions
from tanik.plans.query import query
from tanik.plans.shapes import CONTENT_SQL, NOW, OBSERVED, RUNS, now, observations, runs
from tanik.session import table
from tanik.streaming import jobs

PAGE = "source_id, canonical_url"


@query(f"SELECT doc_id, sha256({CONTENT_SQL}) AS content_hash, length({CONTENT_SQL})::BIGINT AS n FROM documents")
def h8_normalize_content(spark, sf):
    text = normalize_content(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(text, 256).alias("content_hash"), F.length(text).cast("long").alias("n"))


#: Normalised text in SQL.
NORMAL_SQL = "trim(regexp_replace(strip_accents(replace(regexp_replace(lower(nfc_normalize({0})), '[’''`]', ' ', 'g'), 'ı', 'i')), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({NORMAL_SQL.format('text')}) AS normal_md5 FROM documents")
def h1_normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(normalize_text("text").cast("binary")).alias("normal_md5"))


@query(f"""SELECT doc_id, len(w)::BIGINT AS n_tokens, md5(array_to_string(list_sort(w), ' ')) AS tokens_md5 FROM (
  SELECT doc_id, list_distinct(list_transform(list_filter(string_split({NORMAL_SQL.format('text')}, ' '), lambda x: length(x) > 2 AND x NOT IN ('the', 'and', 'der')), lambda x: CASE x WHEN 'les' THEN 'la' ELSE x END)) AS w FROM documents)""")
def h3_tokens(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", normalize_text("text").alias("n"))
    words = word_set(F.col("n"), stop=("the", "and", "der"), synonyms={"les": "la"})
    return rows.select("doc_id", words.alias("w")).select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.md5(F.array_join("w", " ").cast("binary")).alias("tokens_md5"))


@query("""WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) AS w FROM conversations)
SELECT a.conv_id, a.turn, len(list_intersect(a.w, b.w)) / greatest(1, len(list_distinct(list_concat(a.w, b.w))))::DOUBLE AS similarity FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def g3_jaccard(spark, sf):
    words = F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda w: w != ""))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", words.alias("w"))
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("next"))
    return rows.join(after, ["conv_id", "turn"]).select("conv_id", "turn", jaccard(F.col("w"), F.col("next")).alias("similarity"))


@query(r"""SELECT event_kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(n, '\bthe\b') THEN 'traffic_accident' WHEN regexp_matches(n, 'tion') THEN 'fire' WHEN regexp_matches(n, 'sch') THEN 'crime' ELSE 'general' END AS event_kind
  FROM (SELECT trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')) AS n FROM documents)) GROUP BY 1""")
def b6_event_kind(spark, sf):
    rules = (("traffic_accident", r"\bthe\b"), ("fire", "tion"), ("crime", "sch"))
    rows = table(spark, sf, "documents").select(event_kind(normalize_text("text"), rules).alias("event_kind"))
    return rows.groupBy("event_kind").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN length(f) <= 160 THEN f ELSE rtrim(f[1:159]) || '…' END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents)""".replace("\\\\", "\\"))
def h19_excerpt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", excerpt(F.col("text"), 160).alias("excerpt"))


@query(f"SELECT event_type AS kind, count(*) FILTER (ts BETWEEN {NOW} - INTERVAL 24 HOUR AND {NOW}) AS breaking, count(*) FILTER (ts BETWEEN {NOW} - INTERVAL 48 HOUR AND {NOW}) AS recent FROM events GROUP BY 1")
def b5_recency(spark, sf):
    rows = table(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return rows.groupBy(F.col("event_type").alias("kind")).agg(F.count_if(is_breaking(F.col("ts"), now())).alias("breaking"), F.count_if(is_recent(F.col("ts"), F.lit(False), now())).alias("recent"))


@query("""SELECT doc_id, coalesce(list_sum(list_transform(string_split(text, ''), lambda c: CASE WHEN c = '' THEN 0 WHEN unicode(c) > 65535 THEN 2 ELSE 1 END)), 0)::BIGINT AS units, true AS slice_ok FROM documents""")
def h7_utf16(spark, sf):
    text = F.col("text")
    half = (utf16_length(text) / 2).cast("int")
    return table(spark, sf, "documents").select("doc_id", utf16_length(text).cast("long").alias("units"), quote_matches(text, utf16_slice(text, F.lit(0), half), F.lit(0), half).alias("slice_ok"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice = floor(o_totalprice) THEN floor(o_totalprice)::BIGINT::VARCHAR ELSE round(o_totalprice, 2)::VARCHAR END AS shown FROM orders")
def h21_number_json(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", number_json(F.col("o_totalprice")).alias("shown"))


@query(f"""WITH {OBSERVED} SELECT {PAGE}, observation_id, coalesce(fetched_at >= max(fetched_at) OVER (PARTITION BY {PAGE} ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM obs""")
def e2_reject_stale(spark, sf):
    return versions.reject_stale(observations(spark, sf).drop("text")).select("source_id", "canonical_url", "observation_id", "accepted")


@query(f"""WITH {OBSERVED} SELECT {PAGE}, observation_id, CASE WHEN p IS NULL THEN 'new_document' WHEN p = content_hash THEN 'unchanged' ELSE 'new_version' END AS outcome
FROM (SELECT *, lag(content_hash) OVER (PARTITION BY {PAGE} ORDER BY fetched_at, observation_id) AS p FROM obs)""")
def e1_detect_versions(spark, sf):
    return versions.detect_versions(observations(spark, sf).drop("text")).select("source_id", "canonical_url", "observation_id", "outcome")


@query(f"WITH {OBSERVED} SELECT {PAGE}, content_hash, min(fetched_at) AS first_fetched_at, count(*) AS observations FROM obs GROUP BY ALL")
def e1_document_versions(spark, sf):
    return versions.document_versions(observations(spark, sf))


@query(f"""WITH {OBSERVED} SELECT {PAGE}, min(fetched_at) AS first_seen_at, max(fetched_at) AS latest_seen_at, count(DISTINCT content_hash) AS versions, count(*) AS observations,
  arg_max(content_hash, (fetched_at, observation_id)) AS current_hash, arg_max(title, (fetched_at, observation_id)) AS title FROM obs GROUP BY {PAGE}""")
def e3_current_documents(spark, sf):
    return versions.current_documents(observations(spark, sf))


_CRAWL = "d AS (SELECT user_id AS crawl_run_id, event_type || (event_id % 9) AS url, event_type || (event_id % 3) AS canonical_url, event_id AS position FROM events)"


@query(f"""WITH {_CRAWL}, s AS (SELECT *, row_number() OVER (PARTITION BY crawl_run_id, url ORDER BY position) AS n FROM d),
m AS (SELECT *, min(CASE WHEN n = 1 THEN position END) OVER (PARTITION BY crawl_run_id, canonical_url) AS f FROM s)
SELECT crawl_run_id, position, CASE WHEN n > 1 THEN 'duplicate_discovery' WHEN position > f THEN 'duplicate_canonical' ELSE 'kept' END AS status FROM m""")
def e4_dedupe_crawl(spark, sf):
    name = lambda k: F.concat("event_type", (F.col("event_id") % k).cast("string"))
    rows = table(spark, sf, "events").select(F.col("user_id").alias("crawl_run_id"), name(9).alias("url"), name(3).alias("canonical_url"), F.col("event_id").alias("position"))
    return versions.dedupe_crawl(rows).select("crawl_run_id", "position", "status")


@query("""SELECT *, CASE WHEN errors = 0 THEN 'success' WHEN fetched > 0 THEN 'partial' ELSE 'failed' END AS status FROM (
  SELECT user_id AS crawl_run_id, count(*) AS discovered, count(*) FILTER (event_type <> 'error') AS fetched, count(*) FILTER (event_type IN ('view', 'purchase')) AS changed, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)""")
def d6_crawl_stats(spark, sf):
    outcome = F.when(F.col("event_type") == "view", "new_document").when(F.col("event_type") == "purchase", "new_version").when(F.col("event_type") == "error", "error").otherwise("unchanged")
    return health.crawl_stats(table(spark, sf, "events").select(F.col("user_id").alias("crawl_run_id"), outcome.alias("outcome")))


def _crawled(spark, sf):
    """events as what happened at 40 sources: endpoints (signups), links (clicks and views) and responses (the others)."""
    n, rows = F.col("event_id"), table(spark, sf, "events").withColumn("source_id", F.col("user_id") % 40)
    sources = rows.select("source_id").distinct().select("source_id", (F.col("source_id") * 7 + 3).cast("int").alias("max_reports"), F.lit(9).alias("max_pages"))
    endpoints = rows.where("event_type = 'signup'").select("source_id", F.concat(F.lit("e"), n.cast("string")).alias("url"), (n % 97 != 0).alias("visited"), F.when(n % 5 == 0, "discovery_failed").alias("problem"))
    found = rows.where("event_type IN ('click', 'view')").select("source_id", F.concat(F.lit("u"), (n % 211).cast("string")).alias("url"), n.alias("position"))
    problem = F.when(n % 9 == 0, "parser_drift")
    responses = rows.where("event_type IN ('purchase', 'error')").select("source_id", F.concat(F.lit("u"), n.cast("string")).alias("url"), (F.col("event_type") != "error").alias("fetched"), (n % 4 == 0).alias("not_modified"), problem.alias("problem"), F.when(n % 7 != 0, F.col("ts").cast("timestamp")).alias("published_at"), (n % 14 == 0).alias("date_problem"))
    return sources, endpoints, found, responses


_CRAWLED = "v AS (SELECT *, user_id % 40 AS s, event_id AS n FROM events)"


@query(f"""WITH {_CRAWLED}, src AS (SELECT DISTINCT s, s * 7 + 3 AS most FROM v), f AS (SELECT s, n, n % 211 AS u, row_number() OVER (PARTITION BY s, n % 211 ORDER BY n) AS k FROM v WHERE event_type IN ('click', 'view')),
g AS (SELECT *, count(*) FILTER (k = 1) OVER (PARTITION BY s ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f), l AS (SELECT s, count(DISTINCT u) AS links, bool_or(before >= most) AS full FROM g JOIN src USING (s) GROUP BY s),
e AS (SELECT s, count(*) FILTER (n % 97 <> 0 AND n % 5 <> 0) AS ok, count(*) FILTER (n % 97 <> 0 AND n % 5 = 0) AS bad, bool_or(n % 97 = 0) AS more FROM v WHERE event_type = 'signup' GROUP BY s),
r AS (SELECT s, count(*) FILTER (NOT lost) AS fetched, count(*) FILTER (NOT lost AND n % 4 = 0) AS unchanged, count(*) FILTER (fine AND (n % 7 = 0 OR ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20')) AS parsed, count(*) FILTER (NOT fine) AS failed, count(*) FILTER (fine AND n % 7 = 0) AS missing, count(*) FILTER (fine AND n % 14 = 0) AS dates
  FROM (SELECT *, event_type = 'error' AS lost, event_type <> 'error' AND n % 9 <> 0 AS fine FROM v WHERE event_type IN ('purchase', 'error')) GROUP BY s)
SELECT s AS source_id, least(coalesce(links, 0), most) AS discovered, coalesce(fetched, 0) AS fetched, coalesce(unchanged, 0) AS unchanged, coalesce(parsed, 0) AS parsed, coalesce(failed, 0) AS failed, coalesce(missing, 0) AS publication_missing, coalesce(dates, 0) AS date_problems,
  coalesce(ok, 0) AS discovery_successes, coalesce(bad, 0) AS discovery_failures, coalesce("full", false) OR coalesce(more, false) AS bounded FROM src LEFT JOIN l USING (s) LEFT JOIN e USING (s) LEFT JOIN r USING (s)""")
def d6_source_stats(spark, sf):
    """Counts of each source for reports of fifteen days."""
    return health.source_crawl_stats(*_crawled(spark, sf), F.expr("TIMESTAMP '2024-01-05 00:00:00'"), F.expr("TIMESTAMP '2024-01-20 00:00:00'"))


@query(f"""WITH {_CRAWLED} SELECT s AS source_id, 'e' || n AS url, 'discovery_failed' AS reason FROM v WHERE event_type = 'signup' AND n % 97 <> 0 AND n % 5 = 0
UNION ALL SELECT s, 'u' || n, CASE WHEN n % 9 = 0 THEN 'parser_drift' ELSE 'report_failed' END FROM v WHERE (event_type = 'purchase' AND n % 9 = 0) OR event_type = 'error'""")
def d6_crawl_errors(spark, sf):
    _, endpoints, _, responses = _crawled(spark, sf)
    return health.crawl_errors(endpoints, responses)


@query(f"""WITH {RUNS}, w AS (SELECT *, list_sort(list_filter(list_transform(list({{'s': status, 'd': discovered}}) OVER b, lambda x: CASE WHEN x.s = 'success' THEN x.d END), lambda x: x IS NOT NULL)) AS wins,
  lag(status, 1) OVER o AS l1, lag(status, 2) OVER o AS l2 FROM runs WINDOW o AS (PARTITION BY endpoint_id ORDER BY started_at, run_id), b AS (PARTITION BY endpoint_id ORDER BY started_at, run_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
r AS (SELECT endpoint_id, run_id, array_to_string(list_filter([CASE WHEN len(wins) >= 3 AND discovered < wins[len(wins) // 2 + 1] * 0.3 THEN 'parser_drift_count_collapse' END,
  CASE WHEN status = 'failed' AND l1 = 'failed' AND l2 = 'failed' THEN 'repeated_source_failures' END, CASE WHEN status <> 'success' THEN 'crawl_incomplete' END], lambda x: x IS NOT NULL), ',') AS reasons FROM w)
SELECT *, reasons = '' AS complete FROM r""")
def d7_assess_coverage(spark, sf):
    return health.assess_coverage(runs(spark, sf)).select("endpoint_id", "run_id", F.array_join("reasons", ",").alias("reasons"), "complete")


@query(f"""WITH {RUNS} SELECT endpoint_id, arg_max(run_id, (started_at, run_id)) AS run_id, arg_max(status, (started_at, run_id)) AS status, max(started_at) AS started_at,
  max(CASE WHEN status = 'success' THEN started_at END) AS last_success_at FROM runs WHERE status <> 'running' GROUP BY 1""")
def e9_latest_runs(spark, sf):
    return health.latest_runs(runs(spark, sf))


_HEALTH = f"""src AS (SELECT DISTINCT source AS source_id, 3600 AS poll, source IN ('src0', 'src1') AS official FROM documents),
tries AS (SELECT 'src' || (user_id % 20) AS source_id, ts AS t, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'partial' ELSE 'success' END AS status FROM events)"""


@query(f"""WITH {_HEALTH}, t AS (SELECT source_id, count(*) FILTER (status = 'success' AND t > {NOW} - INTERVAL 1 DAY) AS s, count(*) FILTER (status = 'partial' AND t > {NOW} - INTERVAL 1 DAY) AS p,
  count(*) FILTER (status = 'failed' AND t > {NOW} - INTERVAL 1 DAY) AS f, max(t) FILTER (status = 'success') AS last FROM tries GROUP BY 1),
d AS (SELECT source AS source_id, count(*) AS reports, count(*) FILTER (doc_id % 3 <> 0) AS pending FROM documents GROUP BY 1)
SELECT source_id, reports, pending AS pending_reports, coalesce(s, 0) AS success_attempts, coalesce(p, 0) AS partial_attempts, coalesce(f, 0) AS failed_attempts,
  last IS NULL OR epoch({NOW}) - epoch(last) > CASE WHEN official THEN 10800 ELSE 7200 END AS stale FROM src JOIN d USING (source_id) LEFT JOIN t USING (source_id)""")
def d8_source_health(spark, sf):
    docs = table(spark, sf, "documents")
    reports = docs.select(F.col("doc_id").alias("report_id"), F.col("source").alias("source_id"))
    sources = reports.select("source_id").distinct().select("source_id", F.col("source_id").isin("src0", "src1").alias("official"), F.lit(3600).alias("poll_seconds"))
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "partial").otherwise("success")
    tries = table(spark, sf, "events").select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source_id"), F.col("ts").cast("timestamp").alias("at"), status.alias("status"))
    return health.source_health(sources, reports, tries, reports.where("report_id % 3 = 0"), now())


@query("""WITH e AS (SELECT doc_id, doc_id % 11 = 0 AS wrong FROM documents WHERE length(text) >= 20)
SELECT 'quote_mismatch' AS check, count(*) FILTER (wrong) AS violations FROM e UNION ALL SELECT 'claim_without_evidence', count(*) FROM documents WHERE length(text) < 20 UNION ALL SELECT 'event_without_update', count(*) FILTER (doc_id % 7 = 3) FROM documents""")
def d9_quality_checks(spark, sf):
    docs = table(spark, sf, "documents")
    quote = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("~"), F.substring("text", 1, 10))).otherwise(F.substring("text", 5, 12))
    evidence = docs.where(F.length("text") >= 20).select(F.col("doc_id").alias("report_id"), F.col("doc_id").alias("event_id"), F.lit(1).alias("claim_id"), quote.alias("quote"), F.lit(4).alias("start"), F.lit(16).alias("end"))
    events = docs.select(F.col("doc_id").alias("event_id"), F.lit(1).alias("claim_id"))
    return health.quality_checks(docs.select(F.col("doc_id").alias("report_id"), "text"), evidence, events, events.select("event_id"), events.where("event_id % 7 <> 3").select("event_id"))


@query(f"""WITH {RUNS}, n AS (SELECT endpoint_id, arg_max(run_id, (started_at, run_id)) AS run_id, arg_max(status, (started_at, run_id)) AS status FROM runs WHERE status <> 'running' GROUP BY 1),
d AS (SELECT event_id AS run_id, 1 AS documents, event_id % 5 <> 0 AND event_id % 3 <> 1 AS done FROM events WHERE event_id % 2 = 0)
SELECT endpoint_id, n.run_id, status, coalesce(documents, 0)::BIGINT AS documents, status = 'success' AND coalesce(done, false) AS extraction_complete FROM n LEFT JOIN d USING (run_id)""")
def d10_endpoint_checks(spark, sf):
    ids = table(spark, sf, "events").select("event_id")
    seen = ids.where("event_id % 2 = 0").select(F.col("event_id").alias("run_id"), F.col("event_id").alias("version_id"))
    work = ids.where("event_id % 5 <> 0").select(F.col("event_id").alias("version_id"), F.lit(True).alias("completed"), (F.col("event_id") % 3 != 1).alias("verified"))
    return health.endpoint_checks(runs(spark, sf).withColumn("reasons", F.array().cast("array<string>")), seen, work)


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS kind, (user_id % 10)::VARCHAR AS key, count(*) AS n FROM events WHERE ts::DATE >= DATE '2024-01-01' GROUP BY ALL")
def d11_daily_counts(spark, sf):
    rows = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("kind"), (F.col("user_id") % 10).cast("string").alias("key"))
    return health.daily_counts(rows, now(), 30).withColumn("day", F.col("day").cast("string"))


@query(f"""WITH {RUNS}, n AS (SELECT endpoint_id, arg_max(status, (started_at, run_id)) AS status, max(started_at) FILTER (status = 'success') AS last FROM runs WHERE status <> 'running' GROUP BY 1)
SELECT bool_and(status = 'success' AND coalesce(epoch({NOW}) - epoch(last) <= 10800, false)) AS ok, count(*) AS endpoints FROM n""")
def d15_system_health(spark, sf):
    latest = health.latest_runs(runs(spark, sf))
    rows = latest.select("status", health.is_stale(F.col("last_success_at"), now(), F.lit(3600), F.lit(True)).alias("stale"), F.array().cast("array<string>").alias("reasons"))
    return health.system_health(rows)


@query(f"""WITH {_HEALTH} SELECT s.source_id, max(t) AS last_success_at, max(t) IS NULL OR epoch({NOW}) - epoch(max(t)) > CASE WHEN any_value(official) THEN 10800 ELSE 7200 END AS stale
FROM src s LEFT JOIN (SELECT * FROM tries WHERE status = 'success') x USING (source_id) GROUP BY 1""")
def i6_staleness(spark, sf):
    names = table(spark, sf, "documents").select(F.col("source").alias("source_id")).distinct()
    sources = names.select("source_id", F.col("source_id").isin("src0", "src1").alias("official"), F.lit(3600).alias("poll_seconds"))
    done = table(spark, sf, "events").where("event_type NOT IN ('error', 'click')").select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source_id"), F.col("ts").cast("timestamp").alias("at"))
    return jobs.staleness(done, sources, now())
