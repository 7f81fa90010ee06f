"""Every query runs on the smallest tables, and equals its twin there."""

from datetime import date, datetime

import duckdb
import pytest

from tanik import registry

from conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Long on the twin's side.
CHECKED = ("e1_detect_versions", "e3_current_documents", "d7_assess_coverage", "c7_supersession", "d2_claim_status", "d3_fact_conflicts", "c5_authority_match", "h5_parse_news_date", "b3_robots", "c2_strong_pairs", "a7_parse_feeds", "a8_parse_articles", "a9_parse_blocks", "h14_extract_quotes", "h15_text_links", "h11_analyze", "b10_ground_analysis", "b11_validate_candidates", "e8_claim_timeline", "c10_resolve_queries", "j3_resolve_answers", "g6_topic_cycles", "i1_stream_reports", "i4_stream_counts", "i5_stream_limits")


@pytest.fixture(scope="module")
def twin():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def test_every_query_has_a_name_and_most_have_a_twin():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and registry.FLAGSHIP in registry.QUERIES


def plain(value):
    """A value as both engines print it."""
    if value is None or isinstance(value, (bool, str)):
        return str(value)
    if isinstance(value, (datetime, date)):
        return value.replace(tzinfo=None).isoformat() if isinstance(value, datetime) else value.isoformat()
    return str(value) if isinstance(value, int) else str(round(float(value), 9))


@pytest.mark.parametrize("name", CHECKED)
def test_twins(spark, twin, name):
    found, wanted = registry.QUERIES[name](spark, SMALL), twin.sql(registry.ORACLES[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    place = [wanted.columns.index(c) for c in found.columns]
    assert sorted(tuple(map(plain, r)) for r in found.collect()) == sorted(tuple(plain(r[k]) for k in place) for r in wanted.fetchall())


def test_streamed_events_are_those_of_a_batch(spark):
    """Reports of the smallest tables arrive in order of time, in three batches."""
    batch = {r.report_id: r.event_id for r in registry.QUERIES["e7_cluster_reports"](spark, SMALL).collect()}
    assert {r.report_id: r.event_id for r in registry.QUERIES["i3_stream_events"](spark, SMALL).collect()} == batch


def test_flagship(spark):
    found = registry.QUERIES[registry.FLAGSHIP](spark, SMALL).toPandas()
    assert len(found) and found["score"].between(0, 1).all()
