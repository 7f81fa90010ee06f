"""Answers, authorities and related answers where topics and groups hold many rows."""

from datetime import datetime

from pyspark.sql import functions as F

from tanik.operators import answers
from tanik.operators.joins import paired, small

NOW = datetime(2026, 9, 10)
RULE = "topic_id string, predicate string, subject_entity_id string, source_id int, status string, valid_from timestamp, valid_until timestamp"
FACT = "id string, subject_entity_id string, topic_id string, predicate string, reference_period string, authority_source_id int, status string, value struct<value:string>, verified_at timestamp, valid_until timestamp"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def rules(spark, *rows):
    return spark.createDataFrame([(*r, "active", None, None) for r in rows], RULE)


def test_blocks_join_as_a_join_does(spark):
    left = spark.range(40).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("x"))
    right = spark.range(30).select((F.col("id") % 4).alias("k"), F.col("id").alias("y"))
    wanted = sorted(map(str, left.join(right, "k").collect()))
    assert sorted(map(str, paired(left, right, ["k"], 3).collect())) == wanted == sorted(map(str, paired(left, right, ["k"]).collect()))
    assert "broadcast" in plan(left.join(small(right), "k")).lower() and "broadcast" not in plan(left.join(small(right, 29), "k")).lower()


def test_authorities_are_distinct_before_they_meet(spark):
    live = rules(spark, ("t", "p", None, 1), ("t", "p", None, 1), ("t", "p", None, 2), ("t", "p", "a", 1), ("t", "p", "a", 3), ("t", "q", "a", 4))
    subjects = spark.createDataFrame([("a", "t", "p"), ("a", "t", "p"), ("b", "t", "p"), ("b", "t", "q")], "entity_id string, topic_id string, predicate string")
    out = answers.authority_match(subjects, live, F.lit(NOW))
    assert sorted((r.entity_id, r.source_id) for r in out.collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2)]
    assert plan(out).startswith("Union")  # the pairs themselves are not made distinct


def asked(spark, *rows):
    return spark.createDataFrame(rows, "resource string, entity_id string, topic_id string, predicate string, year string")


def test_resources_of_several_subjects(spark):
    live = rules(spark, ("t", "p", None, 1), ("t", "p", None, 2), ("t", "q", "b", 3), ("t", "q", "b", 1))
    resources = asked(spark, ("r", "a", "t", "p", "2026"), ("r", "b", "t", "q", "2026"), ("s", "a", "t", "p", "2026"), ("n", "z", "u", "p", "2026"))
    day = datetime(2026, 9, 1)
    fact = lambda i, entity, predicate, source, status, value: (i, entity, "t", predicate, "2026", source, status, (value,), day, None)
    facts = spark.createDataFrame([fact("f", "a", "p", 1, "published", "x"), fact("g", "b", "q", 3, "verified", "y"), fact("h", "a", "p", 9, "verified", "z")], FACT)
    shown = spark.createDataFrame([("f", "X", None, None, True)], "fact_id string, shown string, start_day date, end_day date, evidence_healthy boolean")
    points = spark.createDataFrame([(1, True, True), (2, True, False), (3, False, True)], "source_id int, healthy boolean, complete boolean")
    told = answers.resolve_answers(resources, live, facts, shown, points, F.lit(NOW))
    # two values hide r; h has no authority, so s has one value; n has no source
    assert {r.resource: (r.state, r.fact_id, r.stale) for r in told.collect()} == {"r": ("needs_review", None, True), "s": ("current", "f", False), "n": ("no_verified_fact", None, True)}
    assert "by_all" in plan(told)  # facts are held against rules, resources are not paired with sources
    read = points.select("source_id", F.when(F.col("source_id") > 1, F.lit(day)).alias("successful_at"))
    bundles = spark.createDataFrame([("f", 1, 1, "t", "u", None, "e", None, "h")], "fact_id string, version_id int, document_id int, title string, url string, published_at timestamp, excerpt string, page int, heading string")
    got = {r.resource: r for r in answers.explain_answers(told, resources, live, read, bundles, F.lit(NOW)).collect()}
    assert {k: (r.authority, r.checked_at, len(r.evidence)) for k, r in got.items()} == {"r": ([1, 2, 3], day, 0), "s": ([1, 2], day, 1), "n": ([], None, 0)}


def test_invalid_answers_read_only_their_evidence(spark):
    told = spark.createDataFrame([("a", "y", "current", "f", "v"), ("b", "y", "current", "g", "v"), ("c", "y", "future_announced", None, None), ("d", "y", "current", "f", None), ("e", "y", "expired", "g", "v")], "resource string, year string, state string, fact_id string, value string")
    proven = spark.createDataFrame([("f",), ("f",), ("x",)], "fact_id string")
    out = answers.invalid_answers(told, proven)
    assert {r.resource: r.problem for r in out.collect()} == {"b": "missing_evidence", "c": "missing_fact", "d": "missing_value"}
    assert "LeftSemi" in plan(out)


def test_related_answers_of_a_large_group(spark):
    told = spark.range(30).select(F.col("id").alias("resource"), F.lit(2026).alias("year"), F.when(F.col("id") % 3 > 0, "x").alias("value"))
    out = answers.related_answers(told, told.select("resource", F.lit("g").alias("group")))
    assert out.count() == 30 * 20 - 20 and "_left" in plan(out)
