"""Queries over told events: claims in texts, checks of analyses and candidates, timelines, registries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tanik.functions import spans, vocab
from tanik.operators import answers, claims, events, facts as fact_jobs, grounding
from tanik.plans import shapes
from tanik.plans.news import EVENTS, EVIDENCE, evidence, saved_features
from tanik.plans.query import query
from tanik.plans.shapes import at_minutes, now
from tanik.session import saved, shared_folder, table
from tanik.sources import reports as report_jobs

#: The first two sentences of a told accident; the whole text of a document follows.
PLACE = "Ankara Eskişehir yolunda zincirleme kaza oldu."
STORY = f"""st AS (SELECT doc_id, '{PLACE} ' || 'Kazada ' || (doc_id % 7 + 2) || ' araç çarpıştı, ' || (doc_id % 9 + 11) || ' kişi yaralandı.' || chr(10) || text AS text,
  'Kazada ' || (doc_id % 7 + 2) || ' araç çarpıştı, ' || (doc_id % 9 + 11) || ' kişi yaralandı.' AS second, {len(PLACE)} AS first_end FROM documents)"""


def stories(spark, sf):
    """documents as reports of a road accident with numbers of their own."""
    number = lambda k, add: (F.col("doc_id") % k + add).cast("string")
    second = F.concat(F.lit("Kazada "), number(7, 2), F.lit(" araç çarpıştı, "), number(9, 11), F.lit(" kişi yaralandı."))
    return table(spark, sf, "documents").select("doc_id", F.lit("Kaza").alias("title"), F.concat(F.lit(f"{PLACE} "), second, F.lit("\n"), F.col("text")).alias("text"))


@query(f"""WITH {STORY} SELECT doc_id, 'vehicle_count' AS predicate, 'event' AS scope, (doc_id % 7 + 2)::VARCHAR AS value, first_end + 1 AS "start", first_end + 1 + length(second) AS "end", second AS quote FROM st
UNION ALL SELECT doc_id, 'injury_count', 'event', (doc_id % 9 + 11)::VARCHAR, first_end + 1, first_end + 1 + length(second), second FROM st
UNION ALL SELECT doc_id, 'event_occurred', 'event', '"traffic_accident"', 0, first_end, '{PLACE}' FROM st
UNION ALL SELECT doc_id, 'reported_location', 'road:ankara-eskisehir', '"ankara-eskisehir"', 0, first_end, '{PLACE}' FROM st""")
def h11_analyze(spark, sf):
    rows = stories(spark, sf).select("doc_id", F.explode(spans.analyze(F.col("title"), F.col("text"))["claims"]).alias("c")).select("doc_id", "c.*")
    return rows.where(F.col("predicate").isin("event_occurred", *vocab.COUNTED) | F.col("scope").startswith("road:")).select("doc_id", "predicate", "scope", "value", "start", "end", "quote")


@query(f"""WITH {STORY} SELECT doc_id, 'city:ankara,city:eskisehir,road:ankara-eskisehir' AS entities, 'traffic_accident' AS kind FROM st""")
def h10_extract_entities(spark, sf):
    a = spans.analyze(F.col("title"), F.col("text"))
    rows = stories(spark, sf).select("doc_id", a.alias("a")).select("doc_id", "a.kind", F.filter("a.entities", lambda e: e["text"].isin("Ankara", "Eskişehir") | (e["kind"] == "road")).alias("e"))
    return rows.select("doc_id", F.array_join(F.transform("e", lambda e: F.concat_ws(":", e["kind"], e["value"])), ",").alias("entities"), "kind")


@query(f"""WITH {STORY} SELECT doc_id, CASE doc_id % 8 WHEN 1 THEN 'claim_grounding_failed' WHEN 2 THEN 'claim_predicate_not_grounded' WHEN 3 THEN 'claim_number_not_grounded' WHEN 4 THEN 'entity_not_grounded'
  WHEN 5 THEN 'claim_boolean_not_grounded' WHEN 6 THEN 'event_type_not_grounded' WHEN 7 THEN 'entity_mapping_not_grounded' END AS error, CASE WHEN doc_id % 8 = 0 THEN 2 END AS claims FROM st""")
def b10_ground_analysis(spark, sf):
    """Own counts of each report, with one forged part in seven of eight."""
    rows = stories(spark, sf).withColumn("id", F.col("doc_id").cast("string"))
    rows = saved(rows)
    which = F.col("report_id").cast("long") % 8
    kept = F.filter("claims", lambda c: c["predicate"].isin("vehicle_count", "injury_count"))
    forged = lambda c: (
        c.withField("start", F.when(which == 1, c["start"] + 1).otherwise(c["start"])).withField("value", F.when(which.isin(2, 3), (c["value"].cast("int") + 1).cast("string")).when(which == 5, "true").when(which == 6, F.lit('"fire"')).otherwise(c["value"]))
        .withField("predicate", F.when(which == 3, "casualties").when(which == 5, "road_closed").when(which == 6, "event_occurred").otherwise(c["predicate"]))
        .withField("type", F.when(which == 5, "boolean").when(which == 6, "text").otherwise(c["type"]))
    )
    entity = F.when(which == 4, F.struct(F.lit("city").alias("kind"), F.lit("atlantis").alias("value"), F.lit("Atlantis").alias("text"))).when(which == 7, F.struct(F.lit("city").alias("kind"), F.lit("konya").alias("value"), F.lit("Ankara").alias("text"))).otherwise(F.struct(F.lit("city").alias("kind"), F.lit("ankara").alias("value"), F.lit("Ankara").alias("text")))
    given = grounding.own_analyses(rows).withColumn("claims", F.transform(kept, forged)).withColumn("entities", F.array(entity))
    out = grounding.ground_analysis(rows, given)
    return out.select(F.col("report_id").cast("long").alias("doc_id"), "error", F.when(F.col("error").isNull(), F.size("claims")).alias("claims"))


_TITLES = "['2026-YKS: Sınav Sonuçları Açıklandı', '2026-YKS:  Yerleştirme Sonuçları Açıklandı', '2026-YKS: Tercihlerin Alınması', '2026-YKS: Tercihlerin Alınması', 'Sınav Sonuçları']"
_RANGE = "Adaylar tercihlerini, 5 Ağustos 2026 - 12 Ağustos 2026 tarihleri arasında"


@query(f"""WITH v AS (SELECT o_orderkey AS version_id, o_orderkey % 5 AS k, o_clerk AS lead FROM (SELECT o_orderkey, 'x' || o_custkey || ' ' AS o_clerk FROM orders)), t AS (SELECT *, regexp_replace({_TITLES}[k + 1], '\\s+', ' ', 'g') AS title FROM v)
SELECT version_id, CASE k WHEN 1 THEN 'yks_yerlestirme' ELSE 'yks' END AS entity_key, CASE WHEN k < 2 THEN 'results_status' ELSE 'preference_period' END AS predicate, CASE WHEN k < 2 THEN 'announced' END AS value, CASE WHEN k = 2 THEN '2026-08-05' END AS first_day,
  length(lead) AS "start", length(lead) + CASE WHEN k < 2 THEN length(title) ELSE {len(_RANGE)} END AS "end" FROM t WHERE k < 3""")
def h13_rule_candidates(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("version_id"), (F.col("o_orderkey") % 5).cast("int").alias("k"), F.concat(F.lit("x"), F.col("o_custkey").cast("string"), F.lit(" ")).alias("lead"))
    title = F.element_at(F.expr(f"array({_TITLES[1:-1]})"), F.col("k") + 1)
    said = F.when(F.col("k") < 2, F.regexp_replace(title, r"\s+", " ")).when(F.col("k") == 2, F.lit(_RANGE)).otherwise(F.lit(_RANGE.replace("5 Ağustos", "31 Şubat")))
    out = grounding.rule_candidates(rows.select("version_id", title.alias("title"), F.concat("lead", said, F.lit(".")).alias("raw_text")))
    return out.select("version_id", "entity_key", "predicate", F.col("value.value").alias("value"), F.col("value.start").alias("first_day"), "start", "end")


@query(f"""WITH {EVIDENCE}, p AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY discovered, report_id) AS pos FROM ev),
x AS (SELECT k.event_id, k.pos AS k, e.pos, e.report_id, e.family, e.predicate, e.scope, e.value, e.official,
    NOT EXISTS (SELECT 1 FROM p n WHERE n.event_id = k.event_id AND n.pos <= k.pos AND n.key = e.key AND n.discovered > e.discovered)
    AND NOT EXISTS (SELECT 1 FROM p n WHERE n.event_id = k.event_id AND n.pos <= k.pos AND n.family = e.family AND n.predicate = e.predicate AND n.scope = e.scope AND n.report_id <> e.report_id AND n.correction AND n.fixed > e.as_of) AS active
  FROM p k JOIN p e ON e.event_id = k.event_id AND e.pos <= k.pos),
c AS (SELECT event_id, k, predicate, scope, value, count(*) AS evidence, count(*) FILTER (active) AS live, count(DISTINCT family) FILTER (active) AS families, bool_or(active AND official IS NOT NULL) AS o FROM x GROUP BY ALL),
s AS (SELECT *, CASE WHEN live = 0 THEN 'superseded' WHEN count(*) FILTER (live > 0) OVER (PARTITION BY event_id, k, predicate, scope) > 1 THEN 'conflicting' WHEN families >= 2 OR o THEN 'supported' ELSE 'weakly_supported' END AS status FROM c),
l AS (SELECT *, lag(status) OVER w AS was, lag(evidence) OVER w AS had FROM s WINDOW w AS (PARTITION BY event_id, predicate, scope, value ORDER BY k))
SELECT l.event_id, p.report_id, l.predicate, l.scope, l.value, status, evidence, l.predicate || ':' || status AS change FROM l JOIN p ON p.event_id = l.event_id AND p.pos = l.k WHERE was IS DISTINCT FROM status OR had IS DISTINCT FROM evidence""")
def e8_claim_timeline(spark, sf):
    from pyspark.sql import Window as W

    rows = evidence(spark, sf)
    rows = rows.withColumn("position", F.row_number().over(W.partitionBy("event_id").orderBy("discovered_at", "report_id")))
    return claims.claim_timeline(rows.withColumn("correction_as_of", F.when(F.col("correction"), F.col("correction_as_of"))))


@query(f"""WITH RECURSIVE {EVENTS}, b AS (SELECT min(doc_id) AS low, max(doc_id) AS high FROM documents)
SELECT 'trial' AS namespace, id AS report_id, event_id, decision, round(score, 6) AS score FROM ev JOIN g USING (id), b WHERE (doc_id - low) * 3 > high - low""")
def g5_rebuild_namespace(spark, sf):
    """Reports in a second namespace that holds those of the first third of all times already."""
    rows = saved_features(spark, sf)
    low, high = rows.agg(F.min("at"), F.max("at")).first()
    early = rows.where(F.col("at") <= F.lit(low) + (F.lit(high) - F.lit(low)) / 3) if low is not None else rows
    done = saved(events.cluster_reports(early)).select(F.lit("trial").alias("namespace"), "report_id", "event_id")
    return events.rebuild_namespace(rows, done, "trial").select("namespace", "report_id", "event_id", "decision", F.round("score", 6).alias("score"))


_CASES = ("'verified'", "'rejected:source_not_trusted'", "'needs_review:historical_document_version'", "'rejected:evidence_not_exact'", "'needs_review:no_contextual_authority'", "'rejected:predicate_not_grounded'", "'needs_review:reference_period_not_grounded'", "'rejected:value_not_deterministically_grounded'", "'needs_review:negation_or_correction_context'")


@query(f"""SELECT l_orderkey AS o, l_linenumber AS l, [{', '.join(_CASES)}][(l_orderkey + l_linenumber) % 9 + 1] AS decision FROM lineitem""")
def b11_validate_candidates(spark, sf):
    out = _decided(spark, sf)
    return out.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.when(F.col("decision") == "verified", F.col("decision")).otherwise(F.concat_ws(":", "decision", F.get("reasons", 0))).alias("decision"))


@query(f"""WITH d AS (SELECT [{', '.join(_CASES)}][(l_orderkey + l_linenumber) % 9 + 1] AS d FROM lineitem)
SELECT split_part(d, ':', 1) AS decision, split_part(d, ':', 2) AS reason, count(*) AS candidates FROM d WHERE d <> 'verified' GROUP BY ALL
UNION ALL SELECT 'verified', r, count(*) FROM (SELECT unnest(['official_source', 'exact_evidence', 'structured_locator', 'contextual_authority', 'typed_value', 'explicit_period']) AS r FROM d WHERE d = 'verified') GROUP BY ALL""")
def b16_review_queue(spark, sf):
    return fact_jobs.review_queue(_decided(spark, sf))


def _decided(spark, sf):
    """A stated quantity of each line, sound or wrong in one of eight ways."""
    case = (F.col("l_orderkey") + F.col("l_linenumber")) % 9
    word, year = F.concat(F.lit("madde"), F.col("l_partkey").cast("string")), F.year("l_shipdate").cast("string")
    whole = F.col("l_quantity").cast("int").cast("string")
    number = F.concat(whole, F.lit(",5"))
    quote = F.concat(word, F.when(case == 6, F.lit("")).otherwise(F.concat(F.lit(" "), year)), F.lit(" donemi "), F.when(case == 5, "tutari ").otherwise("miktari "), number, F.when(case == 8, " iptal").otherwise(""))
    none, lead = F.lit(None).cast("string"), F.lit("ön bilgi 😀 ")
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (case != 1).alias("source_active"), F.lit(True).alias("trusted"), F.lit("d").alias("document_id"), F.lit("d").alias("version_document_id"), F.lit("v").alias("version_id"), F.when(case == 2, "w").otherwise("v").alias("current_version_id"),
        F.lit("active").alias("document_status"), now().alias("fetched_at"), now().alias("published_at"), F.concat(lead, quote, F.lit(".")).alias("raw_text"), F.lit("baslik").alias("folded_title"), quote.alias("quote"), quote.alias("folded_quote"),
        F.when(case == 3, 11).otherwise(12).alias("start"), (F.length(quote) + F.when(case == 3, 11).otherwise(12)).alias("end"), F.lit(None).cast("int").alias("page"), number.alias("value_text"), number.alias("folded_value_text"), F.array().cast("array<string>").alias("warnings"),
        F.array(F.struct(F.lit(0).alias("start"), (F.length(quote) + 13).alias("end"), F.lit(None).cast("int").alias("page"), none.alias("folded_heading"), F.concat(F.lit("on bilgi "), quote).alias("folded_text"))).alias("blocks"), F.lit(True).alias("known_keys"), (case != 4).alias("authorized"),
        F.array(word).alias("aliases"), F.array().cast("array<string>").alias("ambiguous_when"), F.array(F.lit("miktari")).alias("cues"), F.array(F.lit("bedeli")).alias("other_cues"), F.lit("adet").alias("unit"), F.lit("adet").alias("predicate_unit"), F.array(F.lit("number")).alias("value_types"),
        F.struct(F.lit("number").alias("type"), F.concat(whole, F.when(case == 7, ".6").otherwise(".5")).alias("value"), *[none.alias(n) for n in ("start", "end", "amount", "currency", "schema_key", "json")]).alias("value"),
        F.create_map().cast("map<string,array<string>>").alias("lexicon"), year.alias("reference_period"), year.alias("expected_period"), none.alias("correction_of"))
    return fact_jobs.validate_candidates(rows, now())


@query("""SELECT 's' || s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS reliability, CASE WHEN s_suppkey % 2 = 0 THEN 60 ELSE 900 END AS poll_seconds, 30 AS max_reports, s_acctbal >= 0 AS active FROM supplier""")
def a1_read_registry(spark, sf):
    """supplier written as a registry of sources, settings left out where they are the usual ones, and read back."""
    folder = f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}"
    key = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(F.concat(F.lit("s"), key.cast("string")).alias("id"), F.col("s_name").alias("name"), F.when(key % 3 == 0, 0.9).alias("reliability"), F.when(key % 2 == 0, 60).alias("poll_seconds"), F.when(F.col("s_acctbal") < 0, False).alias("active"))
    rows.write.json(folder)
    return report_jobs.read_registry(spark, folder, lines=True).select("id", "reliability", "poll_seconds", "max_reports", "active")


@query("""WITH o AS (SELECT o_custkey AS event_id, o_orderkey AS id, o_orderdate AS t, o_orderpriority AS p FROM orders),
t AS (SELECT event_id::VARCHAR AS event_id, strftime(min(t), '%Y-%m-%d') AS first_day, strftime(max(t), '%Y-%m-%d') AS last_day, count(*) AS reports, count(DISTINCT p) AS claims FROM o GROUP BY 1)
SELECT 'main' AS namespace, event_id, first_day, last_day, reports, claims, reports AS evidence, reports AS updates FROM t""")
def a5_event_tables(spark, sf):
    """orders of a customer as one event's snapshot, written as flat tables and read back."""
    rows = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("event_id"), F.col("o_orderkey").cast("string").alias("report_id"), F.col("o_orderdate").cast("timestamp").alias("published_at"), F.col("o_orderpriority").alias("p"))
    told = rows.groupBy("event_id", F.col("p").alias("claim_id")).agg(F.collect_list(F.struct("report_id", F.lit("q").alias("quote"))).alias("evidence")).groupBy("event_id").agg(F.collect_list(F.struct("claim_id", "evidence")).alias("claims"))
    none = F.lit(None).cast("timestamp")
    base = rows.groupBy("event_id").agg(F.collect_list(F.struct("report_id", none.alias("occurred_at"), "published_at", F.col("published_at").alias("discovered_at"))).alias("reports"), F.collect_list(F.struct(F.concat(F.lit("u"), "report_id").alias("update_id"), F.col("published_at").alias("at"))).alias("timeline"))
    folder = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    snapshots = saved(base.join(told, "event_id").withColumn("kind", F.lit("general")))
    for _ in range(2):
        report_jobs.write_event_tables(snapshots, "main", folder)
    store = report_jobs.event_store(spark, snapshots, folder)
    read = lambda name: store.read(name).withColumnRenamed("batch", "namespace")
    n = lambda name: read(name).groupBy("event_id").agg(F.count("*").alias({"event_reports": "reports"}.get(name, name)))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    out = read("events").select("namespace", "event_id", day("range_start").alias("first_day"), day("range_end").alias("last_day"))
    for name in ("event_reports", "claims", "evidence", "updates"):
        out = out.join(n(name), "event_id")
    return out


@query("""WITH a AS (SELECT p_partkey AS resource, p_brand AS g, 2024 + p_partkey % 2 AS year, p_size % 3 <> 0 AS told FROM part) SELECT a.resource, a.year, b.resource AS related FROM a JOIN a b ON a.g = b.g AND a.year = b.year AND b.told AND a.resource <> b.resource""")
def j4_related_answers(spark, sf):
    rows = table(spark, sf, "part")
    given = rows.select(F.col("p_partkey").alias("resource"), (F.col("p_partkey") % 2 + 2024).cast("int").alias("year"), F.when(F.col("p_size") % 3 != 0, "x").alias("value"))
    return answers.related_answers(given, rows.select(F.col("p_partkey").alias("resource"), F.col("p_brand").alias("group")))


@query("""SELECT p_partkey, '/' || lower(p_brand) || '-' || p_partkey || '/' || (1890 + p_partkey % 150) || '/' || p_size AS path, CASE WHEN p_partkey % 150 >= 10 AND p_partkey % 2 = 0 THEN p_partkey END AS resource FROM part""")
def h20_routes(spark, sf):
    """Public paths of all parts, and what they lead to; odd parts are no resources, years before 1900 lead nowhere."""
    rows = table(spark, sf, "part").select("p_partkey", F.lower("p_brand").alias("brand"), F.col("p_size").cast("string").alias("size"), (F.col("p_partkey") % 150 + 1890).alias("year"))
    known = rows.where("p_partkey % 2 = 0").select(F.concat_ws("-", "brand", F.col("p_partkey").cast("string")).alias("group"), F.col("size").alias("event"), F.col("p_partkey").alias("resource"))
    asked = rows.select("p_partkey", answers.canonical_path(F.concat_ws("-", "brand", F.col("p_partkey").cast("string")), F.col("year"), F.col("size")).alias("path"))
    return answers.resource_for_route(asked, known).select("p_partkey", "path", "resource")


@query("""SELECT event_id, year(ts + INTERVAL 3 HOUR) AS year FROM (SELECT event_id, ts + to_days((event_id % 400)::INT) AS ts FROM events)""")
def h20_turkish_year(spark, sf):
    from tanik.functions.text import turkish_year

    later = F.col("ts").cast("timestamp") + F.make_dt_interval(days=(F.col("event_id") % 400).cast("int"))
    return table(spark, sf, "events").select("event_id", turkish_year(later).alias("year"))


@query("""WITH o AS (SELECT o_custkey AS event_id, arg_min(o_orderpriority, o_orderkey) AS kind, min(o_orderdate) AS made FROM orders GROUP BY 1)
SELECT 'kind_changed' AS violation, event_id, NULL::VARCHAR AS update_id FROM o WHERE event_id % 5 = 0 UNION ALL SELECT 'created_at_changed', event_id, NULL FROM o WHERE event_id % 7 = 0
UNION ALL SELECT 'lost_update', o_custkey, o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 11 = 0""")
def g4_changed_events(spark, sf):
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("event_id")).agg(F.min_by("o_orderpriority", "o_orderkey").alias("kind"), F.min("o_orderdate").alias("created_at"), F.collect_list("o_orderkey").alias("keys"))
    was = rows.select("event_id", "kind", "created_at", F.transform("keys", lambda k: k.cast("string")).alias("updates"))
    kept = F.transform(F.filter("keys", lambda k: k % 11 != 0), lambda k: k.cast("string"))
    day = F.col("created_at").cast("timestamp")
    changed = rows.select("event_id", F.when(F.col("event_id") % 5 == 0, F.concat("kind", F.lit("!"))).otherwise(F.col("kind")).alias("kind"), F.when(F.col("event_id") % 7 == 0, day + F.expr("INTERVAL 1 DAY")).otherwise(day).alias("created_at"), kept.alias("updates"))
    return events.changed_events(was.withColumn("created_at", day), changed)


@query(f"""SELECT o_orderkey AS version_id, sha256('["' || o_orderkey || '","rules","v1","100000","p1","' || o_orderpriority || '","grounding-v1"]') AS extraction_key FROM orders""")
def h9_extraction_key(spark, sf):
    from tanik.operators.versions import extraction_key

    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("version_id"), extraction_key(F.col("o_orderkey"), F.lit("rules"), F.lit("v1"), F.lit(100000), F.lit("p1"), F.col("o_orderpriority"), F.lit("grounding-v1")).alias("extraction_key"))


_FOLD = "trim(regexp_replace(strip_accents(lower(text)), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_FOLD}) AS folded FROM documents")
def h2_fold_turkish(spark, sf):
    from tanik.functions.text import fold_turkish

    return table(spark, sf, "documents").select("doc_id", F.md5(fold_turkish("text").cast("binary")).alias("folded"))


@query("""SELECT source_id, url, last_title, first_at, items FROM (SELECT source AS source_id, 'https://x/' || (doc_id % 97) AS url, arg_max(doc_id, doc_id) AS last_title, min(doc_id) AS first_at, count(*) AS items FROM documents GROUP BY 1, 2)""")
def g2_distinct_items(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("source").alias("source_id"), F.concat(F.lit("https://x/"), (F.col("doc_id") % 97).cast("string")).alias("url"), F.col("doc_id").alias("last_title"), F.col("doc_id").alias("position"))
    return report_jobs.distinct_items(rows, ["source_id", "url"], "position").select("source_id", "url", "last_title", F.col("first_position").alias("first_at"), "items")
