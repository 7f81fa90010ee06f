"""Candidate ladder, answers, queries, reviews, robots, versions, streams."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tanik.operators import answers, facts, limits, versions
from tanik.sources import urls
from tanik.streaming import jobs

NOW = datetime(2026, 9, 10, 12)


def candidate(spark, **changes):
    text = "YKS tercih tarihleri: 27 Ağustos-3 Eylül 2026"
    value = "named_struct('type','date_range','value',cast(null as string),'start','2026-08-27','end','2026-09-03','amount',cast(null as string),'currency',cast(null as string),'schema_key',cast(null as string),'json',cast(null as string))"
    fields = {
        "source_active": "true", "trusted": "true", "document_id": "'d'", "version_document_id": "'d'", "version_id": "'v'", "current_version_id": "'v'", "document_status": "'active'", "fetched_at": "timestamp'2026-09-01 00:00:00'", "published_at": "cast(null as timestamp)",
        "raw_text": f"'{text}'", "folded_title": "'yks 2026'", "quote": f"'{text}'", "folded_quote": "'yks tercih tarihleri: 27 agustos-3 eylul 2026'", "start": "0", "end": str(len(text)), "page": "cast(null as int)", "value_text": "'27 Ağustos-3 Eylül 2026'", "folded_value_text": "'27 agustos-3 eylul 2026'",
        "warnings": "cast(array() as array<string>)", "blocks": f"array(named_struct('start',0,'end',{len(text)},'page',cast(null as int),'folded_heading',cast(null as string),'folded_text','yks tercih tarihleri'))", "known_keys": "true", "authorized": "true", "aliases": "array('yks')", "ambiguous_when": "cast(array() as array<string>)",
        "cues": "array('tercih tarihleri')", "other_cues": "cast(array('ucret') as array<string>)", "unit": "cast(null as string)", "predicate_unit": "cast(null as string)", "value_types": "array('date_range')", "value": value, "lexicon": "cast(map() as map<string,array<string>>)", "reference_period": "'2026'", "expected_period": "'2026'", "correction_of": "cast(null as string)",
    } | changes
    row = spark.range(1).select(*[F.expr(v).alias(k) for k, v in fields.items()])
    r = facts.validate_candidates(row, F.lit(NOW)).first()
    return r.decision, r.reasons[0]


def test_candidate_ladder(spark):
    assert candidate(spark) == ("verified", "official_source")
    assert candidate(spark, trusted="false") == ("rejected", "source_not_trusted")
    assert candidate(spark, start="1") == ("rejected", "evidence_not_exact")
    assert candidate(spark, authorized="false") == ("needs_review", "no_contextual_authority")
    assert candidate(spark, aliases="array('kpss')") == ("needs_review", "entity_not_grounded")
    assert candidate(spark, reference_period="'2025'", expected_period="'2025'") == ("needs_review", "reference_period_not_grounded")
    assert candidate(spark, folded_value_text="'28 agustos-3 eylul 2026'")[1] in ("value_label_relation_ambiguous", "value_not_deterministically_grounded")
    assert candidate(spark, warnings="array('table_span')") == ("needs_review", "table_span")


def test_reviews(spark):
    rows = spark.createDataFrame([("f", "verified"), ("g", "superseded")], "id string, status string")
    acts = spark.createDataFrame([("f", NOW, 1, "publish"), ("f", NOW, 2, "publish"), ("f", NOW + timedelta(1), 3, "review"), ("g", NOW, 4, "publish")], "fact_id string, at timestamp, action_id long, action string")
    assert {r.fact_id: (r.status, r.refused) for r in facts.replay_reviews(rows, acts).collect()} == {"f": ("needs_review", ["2"]), "g": ("superseded", ["4"])}


def test_queries(spark):
    names = spark.createDataFrame([("pref", "date", "yks tercih"), ("app", "date", "kpss basvuru")], "resource string, predicate string, alias string")
    asked = spark.createDataFrame([("yks tercih ne zaman",), ("yks tercjh 2025",), ("yks tercih 2025 2026",), ("gecen yks tercih",), ("yks tercih ucreti",), ("bambaska konu",)], "normalized string")
    found = {r.normalized: (r.resource, r.year, r.method) for r in answers.resolve_queries(asked, names, 2026).collect()}
    assert found["yks tercih ne zaman"] == ("pref", 2026, "alias") and found["yks tercjh 2025"] == ("pref", 2025, "spelling")
    assert all(found[q][0] is None for q in found if q not in ("yks tercih ne zaman", "yks tercjh 2025"))


def test_values(spark):
    row = lambda **v: spark.range(1).select(F.from_json(F.lit(__import__("json").dumps(v)), facts.VALUE).alias("v"))
    shown = lambda **v: row(**v).select(answers.format_value(F.col("v")).alias("x")).first().x
    assert shown(type="money", amount="1234567.50", currency="TRY") == "1.234.567,50 TRY"
    assert shown(type="date", value="2026-09-03") == "3 Eylül 2026"
    assert shown(type="datetime", value="2026-09-03T21:30:00Z") == "4 Eylül 2026 00:30"
    fine = lambda **v: row(**v).select(facts.value_is_valid(F.col("v")).alias("x")).first().x
    assert fine(type="date", value="2026-02-28") and not fine(type="date", value="2026-02-30") and not fine(type="money", amount="01", currency="TRY") and fine(type="json", schema_key="a.b", json="{}")


def test_robots(spark):
    body = "User-agent: *\nDisallow: /p\nAllow: /p/open$\nDisallow: /*.pdf\n\nUser-agent: tanik\nDisallow: /only\nCrawl-delay: 1.5"
    files = spark.createDataFrame([("a.org", body)], "host string, body string")
    rows = spark.createDataFrame([(u,) for u in ("https://a.org/p/x", "https://a.org/p/open", "https://a.org/x.pdf", "https://a.org/only", "https://b.org/p")], "url string")
    found = {r.url: r.allowed for r in urls.robots_filter(rows, files, "other").collect()}
    assert list(found.values()).count(False) == 2 and not found["https://a.org/p/x"] and not found["https://a.org/x.pdf"]
    found = {r.url: (r.allowed, r.delay) for r in urls.robots_filter(rows, files, "Tanik").collect()}
    assert found["https://a.org/only"] == (False, 1.5) and found["https://a.org/p/x"] == (True, 1.5)


def test_versions_and_stream_agree(spark, tmp_path):
    rows = [("s", "u", k, c, NOW + timedelta(minutes=m)) for k, (c, m) in enumerate([("A", 0), ("B", 10), ("A", 20), ("C", 5)])]
    obs = spark.createDataFrame(rows, "source_id string, canonical_url string, observation_id long, content_hash string, fetched_at timestamp").withColumn("arrival", F.col("observation_id")).withColumn("title", F.lit("t"))
    kept = versions.reject_stale(obs).where("accepted")
    assert [r.outcome for r in versions.detect_versions(kept).orderBy("fetched_at").collect()] == ["new_document", "new_version", "new_version"]
    state = versions.current_documents(kept).first()
    assert (state.versions, state.observations, state.current_hash) == (2, 3, "A")
    for k in range(4):
        obs.where(F.col("arrival") == k).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    run = jobs.stream_versions(stream).writeStream.format("memory").queryName("versions").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(120)
    found = {r.observation_id: r.outcome for r in spark.table("versions").collect()}
    assert found[0] == "new_document" and len(found) == 4


def test_anchored_limits(spark):
    assert jobs.anchored([0, 1_000_000, 2_000_000, 11_000_000], 2, 10)[0] == [True, True, False, True]
    rows = spark.createDataFrame([("k", n, NOW + timedelta(seconds=s)) for n, s in enumerate((0, 1, 2, 11))], "key string, request_id long, at timestamp")
    assert [r.allowed for r in limits.limit_windows(rows, 2, 10).orderBy("request_id").collect()] == [True, True, False, True]


def test_actions_of_one_time_and_number_go_by_name(spark):
    rows = spark.createDataFrame([("f", "published")], "id string, status string")
    acts = spark.createDataFrame([("f", 1, "review"), ("f", 1, "correct")], "fact_id string, action_id long, action string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    for order in (acts, acts.orderBy("action"), acts.orderBy(F.desc("action"))):
        assert facts.replay_reviews(rows, order).first()[1:] == ("superseded", ["1"])


def test_ancestors_of_topics(spark):
    chain = [(k, k - 1) for k in range(1, 40)] + [(0, None)]  # a path of 39 steps
    rows = spark.createDataFrame(chain + [(100, 101), (101, 102), (102, 100), (103, 100), (200, 999), (201, None), (1, 0), (300, 300), (None, 5)], "topic_id long, parent_id long")
    got = {(r.topic_id, r.ancestor_id): r.depth for r in answers.topic_ancestors(rows).collect()}
    want = {(k, j): k - j for k in range(40) for j in range(k)}
    want |= {(a, b): d for a, some in {100: (101, 102, 100), 101: (102, 100, 101), 102: (100, 101, 102), 103: (100, 101, 102)}.items() for d, b in enumerate(some, 1)}
    assert got == want | {(200, 999): 1, (300, 300): 1}
    changes = spark.createDataFrame([(0, 39), (39, 0), (7, 7), (201, 200), (5, 4), (4, 5), (None, 1), (1, None)], "topic_id long, parent_id long")
    assert sorted(map(tuple, answers.refused_parents(rows, changes).collect())) == [(0, 39), (4, 5), (7, 7)]
    assert answers.topic_ancestors(rows.where("false")).count() == 0
