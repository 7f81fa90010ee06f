"""Queries over reports, pairs, events, claims, facts, answers and the public feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tanik.functions.text import event_kind, news_category, normalize_text, parse_dates, word_set
from tanik.operators import answers, claims, events, facts as fact_jobs, feed, pairs, public
from tanik.operators.components import connected_components
from tanik.plans import shapes
from tanik.plans.query import query
from tanik.plans.shapes import FACTS, NOW, RULES, START, at_minutes, now
from tanik.session import saved, table
from tanik.sources import reports as report_jobs

#: Kinds, words without a topic and named things of the invented languages.
KINDS = (("crime", r"\bthe\b|\band\b"), ("fire", r"\ble\b|\bla\b"), ("sports", r"\bder\b|\bdie\b"))
STOP = ("the", "and", "les", "des", "der", "die", "que")


def features(spark, sf):
    """documents as reports with the features that pairing reads; bodies with all their words, as numbers."""
    rows = table(spark, sf, "documents").select("doc_id", F.col("source").alias("source_id"), "text", normalize_text("text").alias("n"))
    words = word_set(F.col("n"), STOP, {})
    long = F.filter(words, lambda w: F.length(w) >= 16)
    key = F.sha2(F.concat("source_id", F.lit(":"), F.when(F.col("doc_id") % 50 == 1, F.col("doc_id") - 1).otherwise(F.col("doc_id")).cast("string")), 256)
    return rows.select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"), key.alias("key"), "source_id", event_kind(F.col("n"), KINDS).alias("kind"), at_minutes(F.col("doc_id") * 5).alias("at"), at_minutes(F.col("doc_id") * 5).alias("published_at"), at_minutes(F.col("doc_id") * 5).alias("discovered_at"),
        F.transform(long, lambda w: F.struct(F.lit("location").alias("kind"), w.alias("value"))).alias("entities"), pairs.word_numbers(words).alias("tokens"), F.sha2("text", 256).alias("content_hash")).withColumn("body_tokens", F.col("tokens"))


def saved_features(spark, sf):
    """``features`` computed once; words, which are those of the body as well, are kept once."""
    return saved(features(spark, sf).drop("body_tokens")).withColumn("body_tokens", F.col("tokens"))


_N = "trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g'))"
FEATURES = rf"""f AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS id, sha256(source || ':' || CASE WHEN doc_id % 50 = 1 THEN doc_id - 1 ELSE doc_id END) AS key, source AS source_id, doc_id,
  CASE WHEN regexp_matches(n, '\bthe\b|\band\b') THEN 'crime' WHEN regexp_matches(n, '\ble\b|\bla\b') THEN 'fire' WHEN regexp_matches(n, '\bder\b|\bdie\b') THEN 'sports' ELSE 'general' END AS kind,
  list_sort(list_distinct(list_filter(string_split(n, ' '), lambda x: length(x) > 2 AND x NOT IN ('the', 'and', 'les', 'des', 'der', 'die', 'que')))) AS tokens FROM (SELECT *, {_N} AS n FROM documents)),
g AS (SELECT *, list_filter(tokens, lambda x: length(x) >= 16) AS things FROM f)"""
PAIRS = f"""{FEATURES}, p AS (SELECT a.id AS a, b.id AS b, a.key = b.key AS same, a.kind = b.kind AS kin, abs(a.doc_id - b.doc_id) * 5 / 60.0 AS h, len(list_intersect(a.things, b.things)) > 0 AS spec,
    len(list_intersect(a.tokens, b.tokens)) AS shared, len(a.tokens) AS na, len(b.tokens) AS nb
  FROM g a JOIN g b ON a.id < b.id AND abs(a.doc_id - b.doc_id) <= 432 AND (a.kind = b.kind OR a.key = b.key)),
q AS (SELECT *, shared / greatest(1, na + nb - shared)::DOUBLE AS lex, lex AS copy FROM p),
s AS (SELECT a, b, same, h, spec, na, nb, copy, CASE WHEN same THEN 1.0::DOUBLE WHEN NOT kin THEN 0 WHEN h <= 6 AND na >= 15 AND nb >= 15 AND copy >= 0.85 THEN 0.95
  WHEN NOT spec AND NOT (lex >= 0.65 AND h <= 6) THEN 0 ELSE least(1.0, 0.2::DOUBLE + CASE WHEN spec THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN h <= 6 THEN 0.15::DOUBLE ELSE 0.05::DOUBLE END + lex * CASE WHEN spec THEN 0.2::DOUBLE ELSE 0.4::DOUBLE END) END AS score FROM q)"""


@query(f"WITH {PAIRS} SELECT a, b, round(score, 6) AS score FROM s WHERE score >= 0.7")
def c2_strong_pairs(spark, sf):
    return pairs.strong_pairs(saved_features(spark, sf)).select("a", "b", F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE {PAIRS}, e AS (SELECT a, b FROM s WHERE score >= 0.7 UNION SELECT b, a FROM s WHERE score >= 0.7),
r AS (SELECT a AS node, b AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
SELECT node, least(node, min(seen)) AS component FROM r GROUP BY node""")
def c2_report_components(spark, sf):
    return connected_components(pairs.strong_pairs(saved_features(spark, sf)))


#: The replay in SQL, one report a step: what it scores best against the events so far, and its own.
EVENTS = f"""{PAIRS}, o AS (SELECT id, key, row_number() OVER (ORDER BY doc_id) AS k FROM g), t AS (SELECT b.k, list({{'i': a.k, 's': score}}) AS near FROM s JOIN o a ON a.id = s.a JOIN o b ON b.id = s.b WHERE score >= 0.7 GROUP BY b.k),
u AS MATERIALIZED (SELECT o.*, coalesce(near, []) AS near FROM o LEFT JOIN t USING (k)),
r AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS member, ''::VARCHAR AS id, ''::VARCHAR AS decision, 0.0::DOUBLE AS score UNION ALL
  SELECT k, list_append(member, CASE WHEN decision = 'joined' THEN best[1].e ELSE sha256('["event","' || key || '"]') END), id, decision, coalesce(-best[1].m, 0) FROM (
    SELECT *, CASE WHEN len(best) = 0 THEN 'created' WHEN -best[1].m < 1 AND len(best) > 1 AND best[2].m - best[1].m < 0.08 THEN 'ambiguous' ELSE 'joined' END AS decision FROM (
      SELECT k, member, id, key, list_sort(list_transform(list_distinct(list_transform(cand, lambda c: c.e)), lambda e: {{'m': -list_max(list_transform(list_filter(cand, lambda c: c.e = e), lambda c: c.s)), 'e': e}})) AS best FROM (
        SELECT u.k, r.member, u.id, u.key, list_transform(u.near, lambda x: {{'e': r.member[x.i], 's': x.s}}) AS cand FROM r JOIN u ON u.k = r.k + 1)))),
ev AS MATERIALIZED (SELECT id, member[k] AS event_id, decision, score FROM r WHERE k > 0)"""


@query(f"WITH RECURSIVE {EVENTS} SELECT id AS report_id, event_id, decision, round(score, 6) AS score FROM ev")
def e7_cluster_reports(spark, sf):
    return events.cluster_reports(saved_features(spark, sf)).select("report_id", "event_id", "decision", F.round("score", 6).alias("score"))


#: Each report's first copy in its event, followed to a report that copies none.
FAMILIES = f"""{EVENTS}, m AS (SELECT ev.event_id, g.*, sha256(text) AS h FROM ev JOIN g USING (id) JOIN documents USING (doc_id)),
c AS MATERIALIZED (SELECT b.event_id, b.id, b.doc_id, b.source_id, coalesce(min(a.doc_id), b.doc_id) AS up FROM m b LEFT JOIN m a ON a.event_id = b.event_id AND a.doc_id < b.doc_id
  AND (a.h = b.h OR (len(a.tokens) >= 15 AND len(b.tokens) >= 15 AND len(list_intersect(a.tokens, b.tokens)) >= 0.85 * (len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens))))) GROUP BY b.event_id, b.id, b.doc_id, b.source_id),
w AS (SELECT event_id, id, doc_id AS at, up FROM c UNION ALL SELECT w.event_id, w.id, c.doc_id, c.up FROM w JOIN c ON c.event_id = w.event_id AND c.doc_id = w.up WHERE w.up <> w.at),
fam AS (SELECT w.event_id, w.id, 'unknown:' || c.source_id AS family FROM w JOIN c ON c.event_id = w.event_id AND c.doc_id = w.at WHERE w.up = w.at)"""


@query(f"WITH RECURSIVE {FAMILIES} SELECT event_id, id AS report_id, family FROM fam")
def e5_evidence_families(spark, sf):
    rows = saved_features(spark, sf)
    found = events.cluster_reports(rows).select("event_id", F.col("report_id").alias("id"))
    none = F.lit(None).cast("string")
    return events.evidence_families(rows.join(found, "id").withColumn("agency", none).withColumn("source_family", none))


@query(f"""WITH RECURSIVE {FAMILIES}, told AS (SELECT m.event_id, m.id, m.doc_id, m.key, m.source_id, family, len(m.tokens) % 3 AS value, len(things) > 0 AS placed, epoch({NOW}) - epoch({START}) - doc_id * 300 AS age FROM m JOIN fam USING (event_id, id)),
x AS (SELECT *, doc_id = max(doc_id) OVER (PARTITION BY event_id, key) AS active FROM told),
k AS (SELECT event_id, value, count(*) FILTER (active) AS live, count(DISTINCT family) FILTER (active) AS families FROM x GROUP BY ALL),
st AS (SELECT *, CASE WHEN live = 0 THEN 'superseded' WHEN count(*) FILTER (live > 0) OVER (PARTITION BY event_id) > 1 THEN 'conflicting' WHEN families >= 2 THEN 'supported' ELSE 'weakly_supported' END AS status FROM k),
cl AS (SELECT event_id, count(*) FILTER (status <> 'superseded') AS active_claims, count(*) FILTER (status = 'supported') AS supported_claims, count(DISTINCT CASE WHEN status = 'conflicting' THEN 1 END) AS contradictions FROM st GROUP BY 1),
ql AS (SELECT source AS source_id, avg(quality) AS q FROM labels JOIN documents USING (doc_id) GROUP BY 1),
e AS (SELECT event_id, count(*) AS reports, count(DISTINCT family) AS families, count(DISTINCT CASE WHEN family LIKE 'unknown:%' THEN family END) AS unknown_origins, min(age) FILTER (age >= 0) AS youngest, count(*) FILTER (age < 3600) AS hour, max(placed) AS placed, avg(coalesce(q, 0.5)) AS rel FROM told LEFT JOIN ql USING (source_id) GROUP BY 1),
y AS (SELECT *, coalesce(greatest(0, 1 - youngest / 86400), 0)::DOUBLE AS fresh, CASE WHEN placed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS geo FROM e JOIN cl USING (event_id)),
z AS (SELECT *, CASE WHEN active_claims > 0 THEN greatest(0, least(1, 0.15::DOUBLE + least(families, 4) * 0.12::DOUBLE + fresh * 0.1::DOUBLE + rel * 0.1::DOUBLE + geo * 0.1::DOUBLE - contradictions * 0.2::DOUBLE - unknown_origins * 0.03::DOUBLE)) ELSE 0 END AS raw FROM y)
SELECT event_id, reports, families, unknown_origins, 0 AS official_reports, active_claims, supported_claims, round(fresh, 6) AS freshness, hour AS reports_last_hour, hour AS updates_last_hour, contradictions, geo AS geographic_specificity, round(rel, 6) AS source_reliability, round(raw, 3) AS score,
  round(least(1, raw * 0.5::DOUBLE + least(hour, 10) * 0.025::DOUBLE + least(hour, 5) * 0.025::DOUBLE + geo * 0.125::DOUBLE), 3) AS importance FROM z""")
def j_events(spark, sf):
    """Reports to events with claims, confidence and importance."""
    rows = saved_features(spark, sf)
    assigned = saved(events.cluster_reports(rows))
    members = saved(rows.join(assigned.select("event_id", F.col("report_id").alias("id"), "position"), "id").where("event_id IS NOT NULL"))
    none = F.lit(None).cast("string")
    families = events.evidence_families(members.withColumn("agency", none).withColumn("source_family", none)).withColumnRenamed("report_id", "id")
    told = members.join(families, ["event_id", "id"])
    quality = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", F.col("source").alias("source_id")), "doc_id").groupBy("source_id").agg(F.avg("quality").alias("source_reliability"))
    evidence = told.select("event_id", F.col("id").alias("report_id"), "key", "family", F.lit("kind").alias("predicate"), F.lit("event").alias("scope"), (F.size("tokens") % 3).cast("string").alias("value"), F.col("at").alias("as_of"), F.lit(False).alias("correction"), F.lit(None).cast("timestamp").alias("correction_as_of"), "discovered_at", none.alias("official_version_id"))
    known = claims.reconcile_claims(evidence)
    reports = told.join(quality, "source_id", "left").select("event_id", F.col("id").alias("report_id"), "family", F.coalesce("source_reliability", F.lit(0.5)).alias("source_reliability"), "published_at", F.lit(None).cast("timestamp").alias("modified_at"), "discovered_at", none.alias("official_version_id"))
    things = told.select("event_id", F.explode("entities").alias("e")).select("event_id", "e.kind")
    out = claims.confidence_signals(reports, known, things, told.select("event_id", F.col("discovered_at").alias("at")), now())
    return out.withColumn("freshness", F.round("freshness", 6)).withColumn("source_reliability", F.round("source_reliability", 6))


@query(f"""WITH {FEATURES}, ev AS (SELECT 'e' || (doc_id // 40) AS event_id, {START} + to_minutes((min(doc_id) * 5)::BIGINT) AS lo, {START} + to_minutes((max(doc_id) * 5)::BIGINT) AS hi FROM g GROUP BY 1),
m AS (SELECT 'e' || (doc_id // 40) AS event_id, key FROM g), r AS (SELECT id AS report_id, key, {START} + to_minutes((doc_id * 5)::BIGINT) AS t FROM g)
SELECT DISTINCT report_id, event_id, false AS over_limit FROM (SELECT report_id, event_id FROM r JOIN ev ON t >= lo - INTERVAL 36 HOUR AND t <= hi + INTERVAL 36 HOUR UNION SELECT report_id, event_id FROM r JOIN m USING (key))""")
def c3_event_candidates(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("report_id"), F.sha2(F.concat("source", F.lit(":"), F.when(F.col("doc_id") % 50 == 1, F.col("doc_id") - 1).otherwise(F.col("doc_id")).cast("string")), 256).alias("key"), at_minutes(F.col("doc_id") * 5).alias("at"), F.concat(F.lit("e"), F.floor(F.col("doc_id") / 40).cast("string")).alias("event_id"))
    known = docs.groupBy("event_id").agg(F.min("at").alias("range_start"), F.max("at").alias("range_end"))
    return pairs.event_candidates(docs.select("report_id", "key", "at"), known, docs.select("event_id", "key"))


@query("""WITH r AS (SELECT source AS key, doc_id AS id, doc_id // 3 AS d FROM documents) SELECT key, arg_max(id, (d, id)) AS id, max(d) AS discovered_at FROM r GROUP BY key""")
def c4_current_revisions(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("source").alias("key"), F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 3).alias("discovered_at"))
    return report_jobs.current_revisions(rows)


EVIDENCE = f"""ev AS (SELECT l_partkey AS event_id, l_orderkey || '-' || l_linenumber AS report_id, l_orderkey::VARCHAR AS key, 'f' || (l_suppkey % 7) AS family, l_returnflag AS predicate, 'event' AS scope, (l_quantity::INT % 4)::VARCHAR AS value,
  l_shipdate AS as_of, l_tax >= 0.07 AS correction, l_shipdate AS fixed, l_shipdate AS discovered, CASE WHEN l_discount >= 0.1 THEN 'v' END AS official FROM lineitem),
m AS (SELECT *, NOT (coalesce(EXISTS (SELECT 1 FROM ev n WHERE n.event_id = e.event_id AND n.key = e.key AND n.discovered > e.discovered), false)
  OR EXISTS (SELECT 1 FROM ev n WHERE n.event_id = e.event_id AND n.family = e.family AND n.predicate = e.predicate AND n.scope = e.scope AND n.report_id <> e.report_id AND n.correction AND n.fixed > e.as_of)) AS active FROM ev e)"""


def evidence(spark, sf):
    day = F.col("l_shipdate").cast("timestamp")
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("event_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("report_id"), F.col("l_orderkey").cast("string").alias("key"), F.concat(F.lit("f"), (F.col("l_suppkey") % 7).cast("string")).alias("family"),
        F.col("l_returnflag").alias("predicate"), F.lit("event").alias("scope"), (F.col("l_quantity").cast("int") % 4).cast("string").alias("value"), day.alias("as_of"), (F.col("l_tax") >= 0.07).alias("correction"), day.alias("correction_as_of"), day.alias("discovered_at"),
        F.when(F.col("l_discount") >= 0.1, "v").alias("official_version_id"))


@query(f"WITH {EVIDENCE} SELECT event_id, report_id, active FROM m")
def c7_supersession(spark, sf):
    return claims.mark_superseded(evidence(spark, sf)).select("event_id", "report_id", "active")


@query(f"""WITH {EVIDENCE}, c AS (SELECT event_id, predicate, scope, value, count(*) AS evidence, count(*) FILTER (active) AS active_evidence, count(DISTINCT family) FILTER (active) AS families, bool_or(active AND official IS NOT NULL) AS o FROM m GROUP BY ALL)
SELECT event_id, predicate, scope, value, evidence, active_evidence, families, CASE WHEN active_evidence = 0 THEN 'superseded' WHEN count(*) FILTER (active_evidence > 0) OVER (PARTITION BY event_id, predicate, scope) > 1 THEN 'conflicting' WHEN families >= 2 OR o THEN 'supported' ELSE 'weakly_supported' END AS status FROM c""")
def d2_claim_status(spark, sf):
    return claims.reconcile_claims(evidence(spark, sf)).drop("claim_id")


_SIGNALS = f"""w AS (SELECT l_partkey AS event_id, 'f' || (l_suppkey % 7) AS family, CASE WHEN l_suppkey % 7 = 3 THEN 'unknown:' ELSE '' END || 'f' || (l_suppkey % 7) AS fam, l_discount * 10 AS rel, l_shipdate AS t FROM lineitem)"""


@query(f"""WITH {_SIGNALS}, r AS (SELECT event_id, count(*) AS n, count(DISTINCT fam) AS fams, count(DISTINCT CASE WHEN fam LIKE 'unknown:%' THEN fam END) AS unk, avg(rel) AS rel, max(epoch(t)) FILTER (t <= TIMESTAMP '1998-12-01') AS fresh,
  count(*) FILTER (epoch(TIMESTAMP '1998-12-01') - epoch(t) < 3600) AS vel FROM w GROUP BY 1),
x AS (SELECT *, greatest(0, coalesce(1 - greatest(0, epoch(TIMESTAMP '1998-12-01') - fresh) / 86400, 0)) AS f FROM r),
y AS (SELECT *, greatest(0, least(1, 0.15::DOUBLE + least(fams, 4) * 0.12::DOUBLE + f * 0.1::DOUBLE + rel * 0.1::DOUBLE + 0.05::DOUBLE - unk * 0.03::DOUBLE)) AS raw FROM x)
SELECT event_id, n AS reports, fams AS families, unk AS unknown_origins, round(raw, 3) AS score, round(least(1, raw * 0.5::DOUBLE + least(vel, 10) * 0.025::DOUBLE + least(vel, 5) * 0.025::DOUBLE + 0.0625::DOUBLE), 3) AS importance FROM y""")
def d4_confidence(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("event_id"), F.monotonically_increasing_id().cast("string").alias("report_id"), F.concat(F.when(F.col("l_suppkey") % 7 == 3, "unknown:").otherwise(""), F.lit("f"), (F.col("l_suppkey") % 7).cast("string")).alias("family"), (F.col("l_discount") * 10).alias("source_reliability"), F.col("l_shipdate").cast("timestamp").alias("published_at"), F.lit(None).cast("timestamp").alias("modified_at"), F.col("l_shipdate").cast("timestamp").alias("discovered_at"), F.lit(None).cast("string").alias("official_version_id"))
    ids = rows.select("event_id").distinct()
    out = claims.confidence_signals(rows, ids.select("event_id", F.lit("p").alias("predicate"), F.lit("s").alias("scope"), F.lit("weakly_supported").alias("status")), ids.select("event_id", F.lit("city").alias("kind")), rows.select("event_id", F.col("discovered_at").alias("at")), F.expr("TIMESTAMP '1998-12-01 00:00:00'"))
    return out.select("event_id", "reports", "families", "unknown_origins", "score", "importance")


@query("""WITH m AS (SELECT o_custkey AS event_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position, o_orderpriority AS kind, o_orderdate AS t, o_orderstatus AS e FROM orders)
SELECT event_id, arg_min(kind, position) AS kind, count(*) AS reports, min(t) AS range_start, max(t) AS range_end, array_to_string(list_sort(list_distinct(list(e))), ',') AS entities FROM m GROUP BY 1""")
def d5_event_rollup(spark, sf):
    from pyspark.sql import Window as W

    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("event_id"), F.col("o_orderkey").alias("id"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("position"), F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderdate").cast("timestamp").alias("discovered_at"), F.array(F.struct(F.lit("s").alias("kind"), F.col("o_orderstatus").alias("value"), F.col("o_orderstatus").alias("text"))).alias("entities"))
    return events.event_rollup(rows).select("event_id", "kind", "reports", "range_start", "range_end", F.array_join(F.transform("entities", lambda e: e["value"]), ",").alias("entities"))


@query("""WITH s AS (SELECT o_custkey::VARCHAR AS report_id, o_orderpriority AS event_id, max(o_totalprice) AS score FROM orders GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY score DESC, event_id) AS place FROM s) SELECT * FROM t WHERE place <= 3""")
def f7_top_alternatives(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("report_id"), F.col("o_orderpriority").alias("event_id"), F.col("o_totalprice").alias("score"))
    return events.top_alternatives(rows, 3)


@query("""WITH b AS (SELECT o_custkey AS event_id, o_orderkey AS report_id FROM orders), n AS (SELECT * FROM b WHERE report_id % 9 <> 0 UNION ALL SELECT event_id + 1, report_id FROM b WHERE report_id % 13 = 0 AND report_id % 9 <> 0)
SELECT 'lost_report' AS violation, event_id, report_id FROM b WHERE report_id % 9 = 0 UNION ALL SELECT 'report_in_two_events', min(event_id), report_id FROM n GROUP BY report_id HAVING count(DISTINCT event_id) > 1""")
def g4_append_only(spark, sf):
    before = table(spark, sf, "orders").select(F.col("o_custkey").alias("event_id"), F.col("o_orderkey").alias("report_id"))
    kept = before.where("report_id % 9 <> 0")
    return events.append_only_violations(before, kept.unionAll(kept.where("report_id % 13 = 0").select(F.col("event_id") + 1, "report_id")))


@query(f"""WITH {FACTS}, c AS (SELECT subject_entity_id, topic_id, predicate, reference_period FROM facts WHERE status IN ('verified', 'published', 'needs_review') GROUP BY ALL HAVING count(DISTINCT value) > 1)
SELECT id, status, CASE WHEN c.topic_id IS NOT NULL AND status IN ('verified', 'published', 'needs_review') THEN 'needs_review' ELSE status END AS final_status FROM facts LEFT JOIN c USING (subject_entity_id, topic_id, predicate, reference_period)""")
def d3_fact_conflicts(spark, sf):
    return fact_jobs.fact_conflicts(shapes.facts(spark, sf)).select("id", "status", "final_status")


_AS_OF = "TIMESTAMP '1996-06-01 00:00:00'"


@query(f"""WITH {FACTS} SELECT id, array_to_string(list_filter([CASE WHEN status NOT IN ('verified', 'published') OR verified_at IS NULL THEN 'fact_not_verified' END, CASE WHEN verified_at > {_AS_OF} THEN 'verification_in_future' END,
  CASE WHEN authority_source_id % 10 = 0 THEN 'authority_not_active' END, CASE WHEN {_AS_OF} < valid_from THEN 'not_yet_valid' END, CASE WHEN {_AS_OF} >= valid_until THEN 'validity_expired' END,
  CASE WHEN reference_period <> '1996' THEN 'reference_period_mismatch' END, CASE WHEN subject_entity_id % 6 = 0 THEN 'missing_evidence' END], lambda x: x IS NOT NULL), ',') AS errors FROM facts""")
def b13_publication_errors(spark, sf):
    rows = shapes.facts(spark, sf)
    proof = F.array(F.struct(F.col("id").alias("fact_id"), F.col("authority_source_id").alias("source_id"), F.lit(None).cast("string").alias("error")))
    rows = rows.withColumn("source_id", F.col("authority_source_id")).withColumn("source_status", F.when(F.col("source_id") % 10 == 0, "inactive").otherwise("active")).withColumn("expected_period", F.lit("1996"))
    rows = rows.withColumn("evidence", F.when(F.col("subject_entity_id") % 6 == 0, F.slice(proof, 1, 0)).otherwise(proof))
    return fact_jobs.publication_errors(rows, F.expr(_AS_OF)).select("id", F.array_join("errors", ",").alias("errors"))


@query(f"""SELECT o_orderkey AS id, array_to_string(list_filter([CASE WHEN o_orderkey % 3 = 0 THEN 'historical_document_version' END, CASE WHEN o_orderdate > {_AS_OF} OR epoch({_AS_OF}) - epoch(o_orderdate) > 86400 * 200 THEN 'source_coverage_stale_or_unknown' END,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'source_health_requires_review' END], lambda x: x IS NOT NULL), ',') AS reasons FROM orders""")
def b14_freshness(spark, sf):
    day = F.col("o_orderdate").cast("timestamp")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "old").otherwise("v").alias("current_version_id"), F.lit("v").alias("version_id"), day.alias("last_observed_at"), day.alias("last_success_at"), day.alias("coverage_checked_at"), F.array(F.when(F.col("o_orderpriority") == "1-URGENT", "drift").otherwise("document_limit")).alias("coverage_reasons"))
    return fact_jobs.freshness_reasons(rows, F.expr(_AS_OF), 86400 * 200).select("id", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {FACTS}, a AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS fact_id, unnest([l_shipdate + INTERVAL 1 DAY, l_shipdate + INTERVAL 5 DAY]) AS t, 'verified' AS action FROM lineitem WHERE l_linenumber = 1),
h AS (SELECT id AS fact_id, created_at AS t, 'extracted' AS action, 'lifecycle' AS origin FROM facts UNION ALL SELECT id, verified_at, 'verified', 'lifecycle' FROM facts UNION ALL SELECT id, published_at, 'published', 'lifecycle' FROM facts
  UNION ALL SELECT id, superseded_at, 'superseded', 'lifecycle' FROM facts UNION ALL SELECT fact_id, t, action, 'review' FROM a)
SELECT fact_id, strftime(t, '%Y-%m-%d') AS at_day, action, max(origin) AS origin FROM h WHERE t IS NOT NULL GROUP BY ALL""")
def e11_fact_history(spark, sf):
    first = table(spark, sf, "lineitem").where("l_linenumber = 1")
    day = F.col("l_shipdate").cast("timestamp")
    done = first.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("fact_id"), F.explode(F.array(day + F.expr("INTERVAL 1 DAY"), day + F.expr("INTERVAL 5 DAYS"))).alias("at"), F.lit("verified").alias("action"))
    return fact_jobs.fact_history(shapes.facts(spark, sf), done).select("fact_id", F.date_format("at", "yyyy-MM-dd").alias("at_day"), "action", "origin")


@query("""WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY l_shipdate, l_linenumber, act) AS n FROM (SELECT l_orderkey::VARCHAR AS fact_id, l_shipdate, l_linenumber, l_linenumber::VARCHAR AS id, ['publish', 'review', 'reject', 'correct'][l_suppkey % 4 + 1] AS act FROM lineitem)),
r AS (SELECT DISTINCT fact_id, 0::BIGINT AS n, 'verified' AS status, '' AS refused FROM a UNION ALL
  SELECT r.fact_id, a.n, CASE WHEN act = 'publish' AND status = 'verified' THEN 'published' WHEN act = 'review' AND status IN ('verified', 'published') THEN 'needs_review' WHEN act = 'reject' AND status IN ('needs_review', 'verified') THEN 'revoked' WHEN act = 'correct' AND status = 'published' THEN 'superseded' ELSE status END,
    CASE WHEN (act = 'publish' AND status = 'verified') OR (act = 'review' AND status IN ('verified', 'published')) OR (act = 'reject' AND status IN ('needs_review', 'verified')) OR (act = 'correct' AND status = 'published') THEN refused WHEN refused = '' THEN id ELSE refused || ',' || id END
  FROM r JOIN a ON a.fact_id = r.fact_id AND a.n = r.n + 1)
SELECT fact_id, arg_max(status, n) AS status, arg_max(refused, n) AS refused FROM r GROUP BY 1""")
def e12_replay_reviews(spark, sf):
    names = F.array(*[F.lit(a) for a in ("publish", "review", "reject", "correct")])
    rows = table(spark, sf, "lineitem")
    facts = rows.select(F.col("l_orderkey").cast("string").alias("id"), F.lit("verified").alias("status")).distinct()
    acts = rows.select(F.col("l_orderkey").cast("string").alias("fact_id"), F.col("l_shipdate").cast("timestamp").alias("at"), F.col("l_linenumber").cast("long").alias("action_id"), F.element_at(names, (F.col("l_suppkey") % 4 + 1).cast("int")).alias("action"))
    return fact_jobs.replay_reviews(facts, acts).select("fact_id", "status", F.array_join("refused", ",").alias("refused"))


@query(f"""WITH {RULES}, s AS (SELECT p_partkey AS entity_id, p_partkey % 5 AS topic_id, ['A', 'N', 'R'][p_partkey % 3 + 1] AS predicate FROM part)
SELECT DISTINCT s.*, source_id FROM s JOIN rules r ON r.topic_id = s.topic_id AND r.predicate = s.predicate AND (subject_entity_id IS NULL OR subject_entity_id = entity_id) AND status = 'active' AND coalesce(valid_from <= {_AS_OF}, true) AND coalesce(valid_until > {_AS_OF}, true)""")
def c5_authority_match(spark, sf):
    subjects = table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), (F.col("p_partkey") % 5).alias("topic_id"), F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("predicate"))
    return answers.authority_match(subjects, shapes.rules(spark, sf), F.expr(_AS_OF))


@query("""SELECT l_orderkey AS fact_id, l_linenumber AS line, o_orderkey AS version_id, c_custkey AS doc_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 <> 1""")
def c6_evidence_bundles(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("fact_id"), F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("version_id"))
    orders = table(spark, sf, "orders")
    versions = orders.select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("document_id"))
    current = F.when(F.col("o_orderkey") % 3 == 1, -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))  # one in three versions is an old one
    documents = orders.select(F.col("o_custkey").alias("doc_id"), current.alias("current_version_id"))
    facts = orders.select(F.col("o_orderkey").alias("id"))
    return answers.evidence_bundles(facts, lines, versions, documents).select("fact_id", "line", "version_id", "doc_id")




@query(r"""WITH n AS (SELECT DISTINCT lower(p_name) AS alias, p_type AS resource FROM part), q AS (SELECT DISTINCT replace(alias, 'e', 'a') AS phrase FROM n),
p AS (SELECT phrase, resource, alias, string_split(phrase, ' ') AS w, string_split(alias, ' ') AS v, levenshtein(phrase, alias) AS d FROM q JOIN n ON abs(length(phrase) - length(alias)) <= 2 AND len(string_split(phrase, ' ')) = len(string_split(alias, ' '))),
s AS (SELECT phrase, resource, max(CASE WHEN d = 0 THEN 1.0::DOUBLE ELSE 1 - d / greatest(length(phrase), length(alias))::DOUBLE END) AS score, max(d = 0) AS exact FROM p
  WHERE d = 0 OR (d <= 2 AND length(phrase) >= 8 AND list_bool_and(list_transform(range(1, len(v) + 1), lambda i: length(v[i]) > 3 OR v[i] = w[i]))) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY score DESC, resource) AS place, lead(score) OVER (PARTITION BY phrase ORDER BY score DESC, resource) AS next FROM s),
b AS (SELECT phrase, max(CASE WHEN place = 1 THEN resource END) AS top, max(CASE WHEN place = 1 THEN exact END) AS exact, max(CASE WHEN place = 1 THEN score >= 0.8 AND (next IS NULL OR score - next >= 0.08) END) AS clear, string_agg(resource, ',' ORDER BY place) FILTER (place <= 3) AS names FROM r GROUP BY 1)
SELECT phrase || ' 2024 ne zaman' AS normalized, CASE WHEN clear THEN top END AS resource, CASE WHEN clear THEN 2024 END AS year, CASE WHEN clear THEN CASE WHEN exact THEN 'alias' ELSE 'spelling' END END AS method,
  CASE WHEN NOT coalesce(clear, false) THEN 'no_single_topic' END AS reason, CASE WHEN coalesce(clear, false) THEN '' ELSE coalesce(names, '') END AS suggestions FROM q LEFT JOIN b USING (phrase)""")
def c10_resolve_queries(spark, sf):
    said = table(spark, sf, "part").select(F.lower("p_name").alias("alias"), F.col("p_type").alias("resource")).distinct()
    asked = said.select(F.concat(F.regexp_replace("alias", "e", "a"), F.lit(" 2024 ne zaman")).alias("normalized"))
    return answers.resolve_queries(asked, said.withColumn("predicate", F.lit("p")), 2024).withColumn("suggestions", F.array_join("suggestions", ","))


_TRIGRAMS = "list_distinct(flatten(list_transform(list_filter(string_split({0}, ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


@query(f"""WITH s AS (SELECT DISTINCT lower(p_name) AS alias, lower(p_type) AS resource FROM part), q AS (SELECT lower(c_mktsegment) AS query FROM customer UNION SELECT alias[1:12] FROM s),
a AS (SELECT alias, resource, {_TRIGRAMS.format('alias')} AS t FROM s), b AS (SELECT query, {_TRIGRAMS.format('query')} AS t FROM q WHERE length(query) BETWEEN 3 AND 240),
ag AS (SELECT alias, resource, len(t) AS n, unnest(t) AS g FROM a), bg AS (SELECT query, len(t) AS n, unnest(t) AS g FROM b),
m AS (SELECT query, resource, alias, count(*) / (any_value(bg.n) + any_value(ag.n) - count(*))::DOUBLE AS near FROM ag JOIN bg USING (g) GROUP BY ALL),
f AS (SELECT query, resource, max(near) AS similarity FROM m WHERE near > 0.3 OR len(list_filter(list_filter(string_split(query, ' '), lambda w: w <> ''), lambda w: NOT list_contains(string_split(alias, ' '), w))) = 0 GROUP BY ALL)
SELECT query, resource, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, resource) AS place FROM f) WHERE place <= 5""")
def c11_search_aliases(spark, sf):
    said = table(spark, sf, "part").select(F.lower("p_name").alias("alias"), F.lower("p_type").alias("resource")).distinct()
    asked = table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("query")).union(said.select(F.substring("alias", 1, 12)))
    return answers.search_aliases(asked, said).withColumn("similarity", F.round("similarity", 6))


_MONTHS = "['Ocak', 'Şubat', 'Mart', 'Nisan', 'Mayıs', 'Haziran', 'Temmuz', 'Ağustos', 'Eylül', 'Ekim', 'Kasım', 'Aralık']"
_DAY = f"day({{0}}) || ' ' || {_MONTHS}[month({{0}})] || ' ' || year({{0}})"


@query(f"""SELECT l_orderkey AS o, l_linenumber AS l, l_partkey AS p, CASE (l_orderkey + l_linenumber) % 7 WHEN 0 THEN l_quantity::INT || ',5' WHEN 1 THEN CASE WHEN l_quantity < 10 THEN '' ELSE (l_quantity::INT // 10) || '.' END || CASE WHEN l_quantity < 10 THEN l_quantity::INT::VARCHAR ELSE lpad((l_quantity::INT % 10)::VARCHAR, 1, '0') || '00' END || ',75 TRY'
  WHEN 2 THEN {_DAY.format('l_shipdate')} WHEN 3 THEN {_DAY.format('l_shipdate')} || ' – ' || {_DAY.format('(l_shipdate + INTERVAL 9 DAY)')} WHEN 4 THEN CASE WHEN l_quantity < 20 THEN 'Evet' ELSE 'Hayır' END WHEN 5 THEN {_DAY.format('(l_shipdate + INTERVAL 9200 DAY)')} || ' 13:30' END AS shown FROM lineitem""")
def h16_format_value(spark, sf):
    """Numbers, money with and without thousands, days, ranges, yes and no, times, and a link, which has no text."""
    case, whole, none = ((F.col("l_orderkey") + F.col("l_linenumber")) % 7).cast("int"), F.col("l_quantity").cast("int"), F.lit(None).cast("string")
    day = lambda add: F.date_format(F.date_add("l_shipdate", add), "yyyy-MM-dd")
    text = F.when(case == 0, F.concat(whole.cast("string"), F.lit(".5"))).when(case.isin(2, 3), day(0)).when(case == 4, F.when(F.col("l_quantity") < 20, "true").otherwise("false")).when(case == 5, F.concat(day(9200), F.lit("T10:30:00Z"))).otherwise("https://x.org")
    amount = F.concat(F.when(whole < 10, whole).otherwise(whole * 100).cast("string"), F.lit(".75"))
    kinds = F.array(*[F.lit(k) for k in ("number", "money", "date", "date_range", "boolean", "datetime", "url")])
    value = F.struct(F.element_at(kinds, case + 1).alias("type"), text.alias("value"), day(0).alias("start"), day(9).alias("end"), amount.alias("amount"), F.lit("TRY").alias("currency"), none.alias("schema_key"), none.alias("json"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("p"), answers.format_value(value).alias("shown"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') || ',' || strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-05') || ',' || strftime(o_orderdate, '%Y-%m-09') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS days FROM orders""")
def h6_parse_dates(spark, sf):
    """Single days, a list of two, and a range inside a month."""
    months = F.array(*[F.lit(m) for m in ("ocak", "subat", "mart", "nisan", "mayis", "haziran", "temmuz", "agustos", "eylul", "ekim", "kasim", "aralik")])
    day, kind = F.col("o_orderdate"), F.col("o_orderkey") % 4
    numeric = lambda d: F.date_format(d, "dd.MM.yyyy")
    month = F.concat_ws(" ", F.element_at(months, F.month(day)), F.year(day).cast("string"))
    text = F.when(kind == 0, numeric(day)).when(kind == 1, F.concat_ws(" ", F.dayofmonth(day).cast("string"), month)).when(kind == 2, F.concat(numeric(day), F.lit("-"), numeric(F.date_add(day.cast("date"), 3)))).otherwise(F.concat(F.lit("5-9 "), month))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(parse_dates(text), ",").alias("days"))


@query(f"""SELECT event_id::VARCHAR AS id, event_type AS title, event_type AS category, strftime(ts, '%Y-%m-%d %H:%M:%S') AS published_at, CASE WHEN event_id % 2 = 0 THEN 'official' ELSE 'event' END AS origin FROM events WHERE event_type = 'view' ORDER BY ts DESC, id LIMIT 50""")
def f4_combine_feed(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("title"), F.col("event_type").alias("category"), F.col("ts").cast("timestamp").alias("published_at"))
    out = feed.combine_feed(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), now(), "view", 50)
    return out.withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH b AS (SELECT max(o_orderdate) AS t, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders WHERE o_orderkey % 5 = 0)
SELECT log, id FROM (SELECT 'line' AS log, l_orderkey || '-' || l_linenumber AS id, row_number() OVER (ORDER BY l_shipdate DESC, l_orderkey || '-' || l_linenumber DESC) AS n FROM lineitem, b WHERE l_shipdate < b.t) WHERE n <= 50
UNION ALL SELECT 'order', id FROM (SELECT o_orderkey::VARCHAR AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders, b WHERE o_orderdate < b.t OR (o_orderdate = b.t AND o_orderkey < b.k)) WHERE n <= 50""")
def f5_recent_activity(spark, sf):
    """The page after the newest order whose key ends in 0 or 5; many rows share its day."""
    one = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_shipdate").cast("timestamp").alias("at"))
    two = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("at"))
    last = two.where("id % 5 = 0").orderBy(F.desc("at"), F.desc("id")).first()
    at, key = (last.at, last.id) if last else (None, None)
    return feed.recent_activity({"line": one, "order": two}, F.lit(at), before_id={"order": F.lit(key)}).select("log", "id")


@query("""SELECT document_id, id, place FROM (SELECT o_custkey AS document_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders) WHERE place <= 20""")
def f6_edition_history(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    return feed.edition_history(rows).select("document_id", "id", "place")


@query("""SELECT event_id, count(*) FILTER (id % 2 = 0) > 0 AS stale, arg_max(id, (t, id::VARCHAR))::VARCHAR AS primary_report_id, count(DISTINCT src) AS n_sources FROM (SELECT o_custkey AS event_id, o_orderkey AS id, o_orderdate AS t, 's' || (o_orderkey % 4) AS src FROM orders) GROUP BY 1""")
def d13_public_events(spark, sf):
    day = F.col("o_orderdate").cast("timestamp")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("event_id"), F.col("o_orderkey").cast("string").alias("report_id"), F.concat(F.lit("s"), (F.col("o_orderkey") % 4).cast("string")).alias("source_id"), F.col("o_orderstatus").alias("title"), day.alias("published_at"), day.alias("discovered_at"))
    old = spark.createDataFrame([("s0",), ("s2",)], "source_id string")
    out = feed.public_events(rows, rows.select("event_id", F.lit("supported").alias("status")).distinct(), old, now())
    return out.select("event_id", "stale", "primary_report_id", F.size("sources").cast("long").alias("n_sources"))


_SHOWN = """x AS (SELECT DISTINCT l_partkey AS event_id, l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS report_id, l_orderkey AS k, l_linenumber AS n, l_suppkey % 5 AS s, 'f' || (l_suppkey % 7) AS family, l_returnflag AS predicate, 'event' AS scope, (l_quantity::INT % 4)::VARCHAR AS value, l_shipdate AS d, l_tax >= 0.07 AS correction FROM lineitem),
rep AS (SELECT *, CASE WHEN k % 7 <> 0 THEN d END AS pub, CASE WHEN k % 3 = 0 THEN repeat('x', 400) ELSE 'Haber X ' END || report_id || ' değer ' || value || '.' AS body FROM x WHERE k % 11 <> 0 AND k % 13 <> 0 AND k % 17 <> 0 AND k % 19 <> 0 AND s <> 4 AND (k % 7 = 0 OR d <= TIMESTAMP '1998-01-01')),
m AS (SELECT *, NOT (coalesce(EXISTS (SELECT 1 FROM rep n WHERE n.event_id = e.event_id AND n.k = e.k AND n.d > e.d), false) OR EXISTS (SELECT 1 FROM rep n WHERE n.event_id = e.event_id AND n.family = e.family AND n.predicate = e.predicate AND n.report_id <> e.report_id AND n.correction AND n.d > e.d)) AS active FROM rep e),
c AS (SELECT event_id, predicate, scope, value, bool_and(k % 23 <> 0) AS exact, count(*) AS evidence, count(*) FILTER (active) AS active_evidence, count(DISTINCT family) FILTER (active) AS families FROM m GROUP BY ALL),
cl AS (SELECT *, CASE WHEN active_evidence = 0 THEN 'superseded' WHEN count(*) FILTER (active_evidence > 0) OVER (PARTITION BY event_id, predicate, scope) > 1 THEN 'conflicting' WHEN families >= 2 THEN 'supported' ELSE 'weakly_supported' END AS status FROM c)"""


def _view(spark, sf):
    """lineitem as reports of parts; some are official, tests, on foreign or odd addresses, or of the future, some quotes are misplaced."""
    k, line, supplier = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")
    rows = table(spark, sf, "lineitem").select("l_partkey", k, line, supplier, "l_returnflag", "l_quantity", "l_shipdate", "l_tax").distinct()
    rid, value, day = F.concat_ws("-", k, line, supplier), (F.col("l_quantity").cast("int") % 4).cast("string"), F.col("l_shipdate").cast("timestamp")
    head = F.when(k % 3 == 0, F.repeat(F.lit("x"), 400)).otherwise("Haber \U0001f600 ")
    site = F.when(k % 17 == 0, "http://s0.org/").when(k % 19 == 0, "https://s0.org:8443/").otherwise(F.concat(F.lit("https://S"), (supplier % 5).cast("string"), F.lit(".org/")))
    reports = rows.select(F.col("l_partkey").alias("event_id"), rid.alias("report_id"), (supplier % 5).alias("source_id"), F.concat(F.lit("t"), rid).alias("title"), F.concat(head, rid, F.lit(" değer "), value, F.lit(".")).alias("text"), F.concat(site, rid).alias("canonical_url"), F.when(k % 7 != 0, day).alias("published_at"), F.when(k % 11 == 0, "v").alias("official_version_id"), (k % 13 == 0).alias("fixture"))
    start = F.when(k % 3 == 0, 400).otherwise(9) + F.length(rid) + 1 + F.when(k % 23 == 0, 1).otherwise(0)
    quote = F.concat(F.lit("değer "), value)
    known = rows.select(F.col("l_partkey").alias("event_id"), rid.alias("report_id"), k.cast("string").alias("key"), F.concat(F.lit("f"), (supplier % 7).cast("string")).alias("family"), F.col("l_returnflag").alias("predicate"), F.lit("event").alias("scope"), value.alias("value"), day.alias("as_of"), (F.col("l_tax") >= 0.07).alias("correction"), day.alias("correction_as_of"), day.alias("discovered_at"), F.lit(None).cast("string").alias("official_version_id"), quote.alias("quote"), start.alias("start"), (start + F.length(quote)).alias("end"))
    sources = spark.sql("""SELECT * FROM VALUES (0, 's0', array('s0.org'), 3600, TIMESTAMP '1997-12-31 22:30:00', null, 0), (1, 's1', array('s1.org'), 600, TIMESTAMP '1997-12-31 23:29:00', null, 0), (2, 's2', array('a.org', 's2.org'), 3600, TIMESTAMP '1997-12-31 23:00:00', 'lost', 0),
      (3, 's3', array('s3.org'), 600, TIMESTAMP '1997-12-31 23:31:00', null, 0), (4, 's4', array('other.org'), 600, TIMESTAMP '1997-12-31 23:59:00', null, 0) AS t(source_id, name, hosts, interval_seconds, checked_at, error, failures)""")
    return public.public_view(reports, sources, known, F.expr("TIMESTAMP '1998-01-01 00:00:00'"))


@query(f"""WITH {_SHOWN}, b AS (SELECT event_id, arg_min(report_id, (-coalesce(epoch(pub), 0), report_id)) AS primary_report_id, strftime(max(CASE s WHEN 0 THEN TIMESTAMP '1997-12-31 22:30:00' WHEN 1 THEN TIMESTAMP '1997-12-31 23:29:00' WHEN 2 THEN TIMESTAMP '1997-12-31 23:00:00' ELSE TIMESTAMP '1997-12-31 23:31:00' END), '%H:%M') AS checked, count(*) AS reports, bool_or(s IN (1, 2)) AS stale FROM rep GROUP BY 1),
f AS (SELECT event_id, bool_or(status = 'conflicting') AS conflicts, count(*) FILTER (status <> 'superseded') AS claims FROM cl WHERE exact GROUP BY 1)
SELECT event_id, primary_report_id, 't' || primary_report_id AS title, checked, reports, stale, coalesce(conflicts, false) AS conflicts, coalesce(claims, 0) AS claims FROM b LEFT JOIN f USING (event_id)""")
def d13_event_view(spark, sf):
    return _view(spark, sf).events.withColumn("checked", F.date_format("checked_at", "HH:mm")).drop("checked_at", "published_at")


@query(f"""WITH {_SHOWN} SELECT event_id, report_id, s AS source_id, strftime(pub, '%Y-%m-%d') AS published, s IN (1, 2) AS stale, CASE WHEN k % 3 = 0 THEN repeat('x', 300) || '…' ELSE replace(body, 'X', '😀') END AS excerpt FROM rep""")
def d13_event_sources(spark, sf):
    return _view(spark, sf).sources.select("event_id", "report_id", "source_id", F.date_format("published_at", "yyyy-MM-dd").alias("published"), "stale", "excerpt")


@query(f"""WITH {_SHOWN} SELECT event_id, predicate, scope, value, status, evidence, active_evidence, families FROM cl WHERE exact AND status <> 'superseded'""")
def d13_event_claims(spark, sf):
    return _view(spark, sf).claims.drop("claim_id")


_CATEGORY = r"""CASE WHEN regexp_matches({0}, '\b(?:the|les)\b') THEN 'dunya' WHEN regexp_matches({0}, '\b(?:der|die|los)\b') THEN 'ekonomi'"""


@query(rf"""WITH n AS (SELECT doc_id, {_N.replace('text', 'text[1:80]')} AS title, {_N} AS body FROM documents)
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'spor' ELSE coalesce({_CATEGORY.format('title')} END, CASE WHEN doc_id % 5 = 1 THEN 'gundem' WHEN doc_id % 7 = 0 THEN 'egitim' END, {_CATEGORY.format('body')} ELSE 'gundem' END) END AS category FROM n""")
def b7_news_category(spark, sf):
    kind = F.when(F.col("doc_id") % 5 == 0, "sports").when(F.col("doc_id") % 5 == 1, "crime").otherwise("general")
    source = F.when(F.col("doc_id") % 7 == 0, "yok").otherwise("x")
    rows = table(spark, sf, "documents").select("doc_id", normalize_text(F.substring("text", 1, 80)).alias("title"), normalize_text("text").alias("body"))
    return rows.select("doc_id", news_category(F.col("title"), F.col("body"), kind, source, (("dunya", "the|les"), ("ekonomi", "der|die|los"))).alias("category"))


@query("""WITH RECURSIVE t AS (SELECT p_partkey AS topic_id, CASE WHEN p_partkey % 10 = 3 THEN p_partkey + 4 WHEN p_partkey % 10 = 7 THEN p_partkey - 4 WHEN p_partkey > 1 THEN p_partkey - 1 - p_partkey % 7 END AS parent_id FROM part),
w AS (SELECT topic_id, topic_id AS x, [topic_id] AS path, false AS cycle FROM t UNION ALL SELECT w.topic_id, t.parent_id, list_append(path, t.parent_id), list_contains(path, t.parent_id) FROM w JOIN t ON t.topic_id = w.x JOIN t u ON u.topic_id = t.parent_id WHERE NOT cycle)
SELECT topic_id, CASE WHEN NOT max(cycle) THEN max(len(path)) - 1 END::INT AS depth, max(cycle) AS cycle FROM w GROUP BY 1""")
def g6_topic_cycles(spark, sf):
    """Long paths to roots, and pairs of topics that are each other's parents."""
    key = F.col("p_partkey")
    parent = F.when(key % 10 == 3, key + 4).when(key % 10 == 7, key - 4).when(key > 1, key - 1 - key % 7)
    return answers.topic_cycles(table(spark, sf, "part").select(key.alias("topic_id"), parent.alias("parent_id")))


#: Topics of a tree of eight children each; every hundredth top is a circle of three.
_TREE = "t AS (SELECT c_custkey AS topic_id, CASE WHEN c_custkey % 100 IN (1, 2) THEN c_custkey + 1 WHEN c_custkey % 100 = 3 THEN c_custkey - 2 WHEN c_custkey > 8 THEN c_custkey // 8 END AS parent_id FROM customer)"


def _tree(spark, sf):
    key = F.col("c_custkey")
    parent = F.when((key % 100).isin(1, 2), key + 1).when(key % 100 == 3, key - 2).when(key > 8, F.floor(key / 8))
    return table(spark, sf, "customer").select(key.alias("topic_id"), parent.cast("long").alias("parent_id"))


@query(f"""WITH RECURSIVE {_TREE}, w AS (SELECT topic_id, parent_id AS ancestor_id, 1 AS depth FROM t WHERE parent_id IS NOT NULL UNION ALL SELECT w.topic_id, t.parent_id, depth + 1 FROM w JOIN t ON t.topic_id = w.ancestor_id WHERE t.parent_id IS NOT NULL AND depth < 40)
SELECT topic_id, ancestor_id, min(depth)::INT AS depth FROM w GROUP BY ALL""")
def g6_topic_ancestors(spark, sf):
    """All ancestors of all topics, circles among them."""
    return answers.topic_ancestors(_tree(spark, sf))


@query(f"""WITH RECURSIVE {_TREE}, c AS (SELECT c_custkey AS topic_id, c_custkey * 8 + c_nationkey % 8 AS parent_id FROM customer UNION SELECT c_custkey, c_nationkey FROM customer UNION SELECT c_custkey, c_custkey FROM customer WHERE c_nationkey = 0),
a AS (SELECT topic_id AS x, parent_id AS up FROM t),
z AS (SELECT x, up, 1 AS depth FROM a WHERE up IS NOT NULL UNION ALL SELECT z.x, a.up, depth + 1 FROM z JOIN a ON a.x = z.up WHERE a.up IS NOT NULL AND depth < 40)
SELECT DISTINCT topic_id, parent_id FROM c WHERE topic_id = parent_id OR EXISTS (SELECT 1 FROM z WHERE z.x = c.parent_id AND z.up = c.topic_id)""")
def g6_refused_parents(spark, sf):
    """Topics moved under a child, under a small topic, under themselves."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    rows = table(spark, sf, "customer")
    changes = rows.select(key.alias("topic_id"), (key * 8 + nation % 8).alias("parent_id")).unionByName(rows.select(key.alias("topic_id"), nation.alias("parent_id"))).unionByName(rows.where(nation == 0).select(key.alias("topic_id"), key.alias("parent_id")))
    return answers.refused_parents(_tree(spark, sf), changes)


@query("""SELECT p_type AS resource, 'entity' AS gap FROM part WHERE p_partkey % 4 = 0 GROUP BY 1 UNION ALL SELECT p_type, 'topic' FROM part WHERE p_size % 7 = 0 GROUP BY 1 UNION ALL SELECT p_type, 'authority' FROM part WHERE p_size % 5 = 1 GROUP BY 1
UNION ALL SELECT p_type, 'answer' FROM part GROUP BY 1 HAVING max(p_size) < 50 UNION ALL SELECT DISTINCT 'https://x/' || CASE WHEN p_partkey % 9 = 0 THEN 'Fixture/' ELSE '' END || p_partkey, 'fixture_document' FROM part WHERE p_partkey % 9 = 0""")
def c9_catalog_gaps(spark, sf):
    part = table(spark, sf, "part")
    rows = part.select(F.col("p_type").alias("resource"), F.col("p_partkey").alias("entity_id"), F.col("p_size").alias("topic_id"), (F.col("p_size") % 5).alias("predicate"))
    known = rows.where("topic_id % 5 <> 1").select("topic_id", "predicate", F.lit("active").alias("status"))
    given = part.select(F.col("p_type").alias("resource"), F.when(F.col("p_size") == 50, "x").alias("value"))
    documents = part.select(F.concat(F.lit("https://x/"), F.when(F.col("p_partkey") % 9 == 0, "Fixture/").otherwise(""), F.col("p_partkey").cast("string")).alias("canonical_url"))
    return answers.catalog_gaps(rows, rows.where("entity_id % 4 <> 0"), rows.where("topic_id % 7 <> 0").select("topic_id").distinct(), known, rows.select("resource", F.col("entity_id").alias("fact_id")), given, documents)


@query(f"""WITH {FACTS} SELECT DISTINCT id FROM facts WHERE status = 'verified' AND subject_entity_id % 3 = 0""")
def c8_verified_from_provider(spark, sf):
    rows = shapes.facts(spark, sf)
    work = rows.select(F.col("id").alias("fact_id"), F.when(F.col("subject_entity_id") % 3 == 0, "rules").otherwise("model").alias("provider"), F.lit("verified").alias("decision"))
    return fact_jobs.verified_from_provider(rows, work, "rules").select("id").distinct()


@query("""WITH a AS (SELECT event_id AS attempt_id, user_id % 40 AS idempotency_key, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, ts FROM events)
SELECT attempt_id, idempotency_key, status FROM (SELECT *, row_number() OVER (PARTITION BY idempotency_key, status ORDER BY ts, attempt_id) AS n FROM a WHERE idempotency_key >= 5) WHERE status = 'failed' OR n = 1""")
def j1_record_extractions(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("attempt_id"), (F.col("user_id") % 40).alias("idempotency_key"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.col("ts").alias("at"))
    done = rows.where("idempotency_key < 5").select("idempotency_key")
    return fact_jobs.record_extractions(rows, done).select("attempt_id", "idempotency_key", "status")
