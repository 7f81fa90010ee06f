"""The public view of events: which reports are shown, and claims that rest on them alone."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tanik.operators.public import public_view

NOW = datetime(2026, 9, 10, 12)
REPORT = "event_id string, report_id string, source_id string, title string, text string, canonical_url string, published_at timestamp, official_version_id string, fixture boolean"
SOURCE = "source_id string, name string, hosts array<string>, interval_seconds int, checked_at timestamp, error string, failures int"
EVIDENCE = "event_id string, report_id string, key string, family string, predicate string, scope string, value string, as_of timestamp, correction boolean, correction_as_of timestamp, discovered_at timestamp, official_version_id string, quote string, start int, end int"


def view(spark, reports, evidence, sources=(("s", "S", ["a.org"], 600, NOW, None, None), ("t", "T", ["b.org"], 600, None, None, 0))):
    table = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return public_view(table(reports, REPORT), table(sources, SOURCE), table(evidence, EVIDENCE), F.lit(NOW))


def report(rid, text="\U0001f600 2 kişi", url="https://A.org/x", at=NOW, source="s", official=None, fixture=None, event="e"):
    return (event, rid, source, f"title {rid}", text, url, at, official, fixture)


def told(rid, value, quote, start, family, event="e"):
    return (event, rid, rid, family, "injury_count", "event", value, NOW, False, None, NOW, None, quote, start, start + len(quote) if start is not None else None)


def test_only_public_reports_count(spark):
    hidden = [report("o", official="v"), report("x", fixture=True), report("h", url="http://a.org/x"), report("p", url="https://a.org:8443/x"), report("u", url="https://u@a.org/x"), report("n", url="https://c.org/x"), report("f", at=NOW + timedelta(hours=1)), report("z", source="none"), report("w", url=None)]
    shown = [report("a", at=NOW - timedelta(hours=1)), report("b", url="https://a.org:443/y"), report("c", at=None, url="https://b.org/", source="t", text=None), report("b", url="https://a.org:443/y")]
    evidence = [told("a", "2", "2 kişi", 3, "f1"), told("b", "2", "2 kişi", 3, "f2"), told("o", "9", "2 kişi", 3, "f3"), told("c", "7", "2 kişi", 3, "f4"), told("a", "5", "kişi 2", 3, "f1")]
    out = view(spark, hidden + shown + [report("lone", official="v", event="g")], evidence)
    event = out.events.collect()
    assert [tuple(r) for r in event] == [("e", "b", "title b", NOW, NOW, 3, True, True, 1)]  # values whose quotes are not there are not shown, but contradict
    assert sorted((r.report_id, r.stale, r.excerpt) for r in out.sources.collect()) == [("a", False, "\U0001f600 2 kişi"), ("b", False, "\U0001f600 2 kişi"), ("c", True, None)]
    assert [(r.value, r.families, r.evidence, r.status) for r in out.claims.collect()] == [("2", 2, 2, "conflicting")]
    alone = view(spark, hidden + shown, evidence[:3])  # the official report's value does not count
    assert [(r.value, r.status) for r in alone.claims.collect()] == [("2", "supported")] and not alone.events.first().conflicts


def test_long_excerpts_and_no_reports(spark):
    out = view(spark, [report("a", text="x" * 299 + "\U0001f600y"), report("b", text="x" * 300)], [])
    assert {r.report_id: r.excerpt for r in out.sources.collect()} == {"a": "x" * 299 + "…", "b": "x" * 300}
    assert out.events.first().claims == 0 and out.claims.count() == 0
    assert view(spark, [], []).events.count() == 0
