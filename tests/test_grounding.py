"""Checks of analyses from outside, rule candidates, timelines and providers."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tanik.operators import claims, events, grounding

STORY = "Ankara Eskişehir yolunda zincirleme kaza oldu. Kazada 3 araç çarpıştı, 2 kişi yaralandı."
BASE = datetime(2026, 9, 10, 9)


def reports(spark, texts):
    return spark.createDataFrame([(f"r{k}", "Kaza", t) for k, t in enumerate(texts)], "id string, title string, text string")


def test_own_analyses_are_grounded(spark):
    rows = reports(spark, [STORY, "", None, "Olay 1 Eylül 2026 saat 10:00 oldu. Yangın söndürüldü.", "Düzeltme: 4 kişi yaralandı."])
    own = grounding.own_analyses(rows)
    found = {r.report_id: r for r in grounding.ground_analysis(rows, own).collect()}
    assert {k: r.error for k, r in found.items()} == {f"r{k}": None for k in range(5)}
    assert [c.correction for c in found["r4"].claims if c.predicate == "injury_count"] == [True]
    assert grounding.ground_analysis(rows, own.limit(0)).count() == 0
    assert {r.report_id for r in grounding.analyzed(rows).collect()} == set(found)


@pytest.mark.parametrize(
    "change, error",
    [
        ({}, None),
        ({"start": "c.start + 1"}, "claim_grounding_failed"),
        ({"quote": "'nothing'"}, "claim_predicate_not_grounded"),
        ({"predicate": "'hurt'", "value": "'5'"}, "claim_number_not_grounded"),
        ({"predicate": "'road_closed'", "type": "'boolean'", "value": "'true'"}, "claim_boolean_not_grounded"),
        ({"predicate": "'event_occurred'", "type": "'text'", "value": "'\"fire\"'"}, "event_type_not_grounded"),
        ({"predicate": "'said'", "type": "'text'", "value": "'\"istanbul\"'"}, "claim_text_not_grounded"),
        ({"predicate": "'on'", "type": "'datetime'", "value": "'\"2026-01-01T00:00:00Z\"'"}, "claim_date_not_grounded"),
    ],
)
def test_forged_claims_are_refused(spark, change, error):
    rows = reports(spark, [STORY])
    fields = ", ".join(f"'{n}', {change.get(n, 'c.' + n)}" for n in ("predicate", "scope", "type", "value", "value_text", "quote", "start", "end", "correction", "as_of"))
    given = grounding.own_analyses(rows).withColumn("claims", F.expr(f"transform(filter(claims, c -> c.predicate = 'injury_count'), c -> named_struct({fields}))"))
    row = grounding.analyzed(rows, lambda _: given).first()
    assert row.error == error and (row.claims is None) == (error is not None)


def test_forged_occurrence_and_times(spark):
    rows = reports(spark, [STORY + " 5 Ocak 2026 10:00"])
    given = grounding.own_analyses(rows)
    late = given.withColumn("occurred_at", F.lit(BASE)).withColumn("occurrence_text", F.lit("1 Ocak 2026"))
    assert grounding.ground_analysis(rows, late).first().error == "occurrence_not_grounded"
    told = given.withColumn("claims", F.transform("claims", lambda c: c.withField("as_of", F.lit("2026-01-01")).withField("correction", F.lit(True))))
    assert all(c.as_of is None and not c.correction for c in grounding.ground_analysis(rows, told).first().claims)


def test_rule_candidates(spark):
    said = "Adaylar tercihlerini, 5 Ağustos 2026 - 12 Ağustos 2026 tarihleri arasında yapar."
    rows = [
        ("a", " 2026-YKS:  Sınav Sonuçları Açıklandı ", "😀 2026-YKS: Sınav Sonuçları Açıklandı."),
        ("b", "2026-YKS: Sınav Sonuçları Açıklandı", "başka"),
        ("c", "2026-YKS: Tercihlerin Alınması", "é" + said),
        ("d", "2025-YKS: Tercihlerin Alınması", said),
        ("e", "2026-YKS: Tercihlerin Alınması", said.replace("12 Ağustos", "1 Ağustos")),
        ("f", None, None),
    ]
    found = {r.version_id: r for r in grounding.rule_candidates(spark.createDataFrame(rows, "version_id string, title string, raw_text string")).collect()}
    assert set(found) == {"a", "c"}
    assert (found["a"].entity_key, found["a"].predicate, found["a"].value.value, found["a"].start, found["a"].end) == ("yks", "results_status", "announced", 3, 38)
    assert (found["c"].value.start, found["c"].value.end, found["c"].start) == ("2026-08-05", "2026-08-12", 1)


def test_candidates_of_a_provider_get_document_offsets(spark):
    rows = spark.createDataFrame([(1, "aaaa fee bbbb fee", [(0, 9), (9, 17)]), (2, "x" * 30, [(0, 30)])], "document_id long, raw_text string, blocks array<struct<start:int,end:int>>")

    def fees(frames):
        for pdf in frames:
            out = [(d, w, t.index("fee"), t.index("fee") + 3, "fee") for d, w, t in zip(pdf["document_id"], pdf["window"], pdf["text"]) if "fee" in t]
            yield pd.DataFrame(out, columns=["document_id", "window", "start", "end", "word"])

    found = sorted((r.document_id, r.start, r.end) for r in grounding.extract_candidates(rows, fees, "start int, end int, word string", 10).collect())
    assert found == [(1, 5, 8), (1, 14, 17)]


def test_timeline_equals_reconciling_every_prefix(spark):
    import numpy as np

    draw = np.random.default_rng(3)
    rows = [("e", k, f"r{k:02}", f"k{draw.integers(0, 14)}", f"f{draw.integers(0, 3)}", "p", "s", str(draw.integers(0, 3)), int(draw.integers(0, 40)), bool(draw.random() < 0.3), k, "v" if draw.random() < 0.05 else None) for k in range(40)]
    made = [(e, p, r, key, f, pr, sc, v, BASE + timedelta(minutes=a), c, BASE + timedelta(minutes=a) if c else None, BASE + timedelta(minutes=d), o) for e, p, r, key, f, pr, sc, v, a, c, d, o in rows]
    table = spark.createDataFrame(made, "event_id string, position int, report_id string, key string, family string, predicate string, scope string, value string, as_of timestamp, correction boolean, correction_as_of timestamp, discovered_at timestamp, official_version_id string").cache()
    want, was = [], {}
    for k in range(40):
        now = {r.value: (r.status, r.evidence) for r in claims.reconcile_claims(table.where(F.col("position") <= k).coalesce(1)).collect()} if k % 4 == 3 or k < 6 else None
        want.append(now)
    state, found = {}, {}
    for r in claims.claim_timeline(table).collect():
        found.setdefault(int(r.report_id[1:]), []).append((r.value, (r.status, r.evidence)))
    for k, now in enumerate(want):
        for value, s in found.get(k, []):
            assert state.get(value) != s
            state[value] = s
        assert now is None or state == now, k


def test_assigned_reports_keep_their_events(spark):
    import numpy as np

    draw, n = np.random.default_rng(5), 80
    rows = spark.createDataFrame([(f"r{k:02}", f"k{k}", BASE + timedelta(minutes=k), BASE + timedelta(minutes=k)) for k in range(n)], "id string, key string, published_at timestamp, discovered_at timestamp")
    scored = [(f"r{a:02}", f"r{b:02}", float(draw.choice([0.7, 0.72, 0.8, 0.95, 1.0]))) for a in range(n) for b in range(a + 1, n) if draw.random() < 0.03]
    edges = spark.createDataFrame(scored, "a string, b string, score double")
    whole = {r.report_id: r.event_id for r in events.cluster_reports(rows, edges).collect()}
    early = events.cluster_reports(rows.where("id < 'r50'"), edges.where("b < 'r50'")).select("report_id", "event_id")
    late = {r.report_id: r.event_id for r in events.cluster_reports(rows, edges, segment=7, assigned=early).collect()}
    assert late == {k: v for k, v in whole.items() if k >= "r50"}
    held = early.withColumn("namespace", F.lit("trial"))
    again = events.rebuild_namespace(rows, held, "trial", edges).collect()
    assert {r.report_id: r.event_id for r in again} == late and {r.namespace for r in again} == {"trial"}
    assert {r.report_id for r in events.rebuild_namespace(rows, held, "other", edges).collect()} == set(whole)
