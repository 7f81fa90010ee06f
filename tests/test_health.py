"""Crawl counts of sources and explained answers in odd cases."""

from datetime import datetime

from pyspark.sql import functions as F

from tanik.operators import answers, health

DAY = datetime(2026, 9, 10)


def test_source_counts(spark):
    sources = spark.createDataFrame([(1, 2, 9), (2, 2, 9), (3, 2, 9), (4, 2, 9)], "source_id int, max_reports int, max_pages int")
    endpoints = spark.createDataFrame([(1, "a", True, None), (1, "b", True, "x"), (3, "a", False, None), (3, "b", None, "x")], "source_id int, url string, visited boolean, problem string")
    found = spark.createDataFrame([(1, "u", 1), (1, "v", 2), (1, None, 3), (2, "u", 1), (2, "v", 2), (2, "u", 3), (4, "u", 1), (4, "v", 2), (4, "w", 3)], "source_id int, url string, position int")
    responses = spark.createDataFrame([(1, "u", True, True, None, None, True), (1, "v", True, None, "drift", DAY, True), (1, "w", None, None, None, None, None), (2, "u", True, False, None, DAY, None)], "source_id int, url string, fetched boolean, not_modified boolean, problem string, published_at timestamp, date_problem boolean")
    got = {r.source_id: tuple(r)[1:] for r in health.source_crawl_stats(sources, endpoints, found, responses, F.lit(datetime(2026, 9, 11))).collect()}
    assert got[1] == (2, 2, 1, 1, 2, 1, 1, 1, 1, False)  # at the limit, and nothing came after
    assert got[2] == (2, 1, 0, 0, 0, 0, 0, 0, 0, True)  # a repeat came after; the one report is too old
    assert got[3] == (0,) * 9 + (True,) and got[4] == (2,) + (0,) * 8 + (True,)
    assert sorted(map(tuple, health.crawl_errors(endpoints, responses).collect())) == [(1, "b", "x"), (1, "v", "drift"), (1, "w", "report_failed")]
    empty = [df.where("false") for df in (endpoints, found, responses)]
    assert health.source_crawl_stats(sources, *empty).where("discovered > 0 OR bounded").count() == 0


def test_explained_answers(spark):
    told = spark.createDataFrame([("r", "2026", "current", "f"), ("s", "2026", "no_verified_fact", None)], "resource string, year string, state string, fact_id string")
    resources = spark.createDataFrame([("r", "2026", 1, 1, "p"), ("s", "2026", 2, 2, "p")], "resource string, year string, entity_id int, topic_id int, predicate string")
    rules = spark.createDataFrame([(1, "p", None, 7, "active"), (1, "p", 1, 8, "active"), (1, "p", 9, 9, "active")], "topic_id int, predicate string, subject_entity_id int, source_id int, status string").withColumn("valid_from", F.lit(None).cast("timestamp")).withColumn("valid_until", F.col("valid_from"))
    points = spark.createDataFrame([(7, DAY), (7, datetime(2027, 1, 1)), (8, datetime(2026, 9, 1)), (9, datetime(2020, 1, 1)), (8, None)], "source_id int, successful_at timestamp")
    bundles = spark.createDataFrame([("f", "v2", None, 3), ("f", "v1", "Baş", None), ("f", "v1", "Baş", None), ("g", "v", None, None)], "fact_id string, version_id string, heading string, page int")
    for name in ("document_id", "title", "url", "excerpt"):
        bundles = bundles.withColumn(name, F.lit("x"))
    bundles = bundles.withColumn("published_at", F.lit(None).cast("timestamp"))
    got = {r.resource: r for r in answers.explain_answers(told, resources, rules, points, bundles, F.lit(datetime(2026, 9, 20))).collect()}
    assert got["r"].checked_at == datetime(2026, 9, 1) and got["r"].authority == [7, 8]
    assert [(e.version_id, e.locator) for e in got["r"].evidence] == [("v1", "Baş"), ("v2", "Sayfa 3")]
    assert got["s"].checked_at is None and got["s"].authority == [] and got["s"].evidence == []
