"""The accident story, its negative twins, and order-exact clustering."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tanik.functions import spans
from tanik.functions.text import normalize_text, word_set
from tanik.operators import claims, events, pairs
from tanik.operators.components import connected_components

BASE = datetime(2026, 9, 10, 9)
COPY = "Ankara Eskişehir yolunda zincirleme kaza oldu. Kazada 3 araç çarpıştı, 2 kişi yaralandı. Ekipler olay yerinde inceleme yaptı, trafik akışı kontrollü sağlandı, sürücüler alternatif güzergahlara yönlendirildi."
FOUR = "Ankara Eskişehir yolunda zincirleme kaza oldu. Kazada 4 yaralı olduğu bildirildi."
FIX = "Ankara Eskişehir yolunda zincirleme kaza oldu. Düzeltme: 4 kişi yaralandı, sayı güncellendi."


def story(spark, rows):
    raw = spark.createDataFrame([(f"r{n}", key, source, text, BASE + timedelta(minutes=m)) for n, (key, source, text, m) in enumerate(rows)], "id string, key string, source_id string, text string, at timestamp")
    raw = raw.withColumn("a", spans.analyze(F.lit("Kaza"), F.col("text"))).withColumn("n", normalize_text(F.concat(F.lit("Kaza "), F.col("text"))))
    return raw.select("id", "key", "source_id", F.col("a.kind").alias("kind"), "at", F.col("at").alias("published_at"), F.col("at").alias("discovered_at"), F.transform("a.entities", lambda e: F.struct(e["kind"].alias("kind"), e["value"].alias("value"))).alias("entities"), word_set(F.col("n")).alias("tokens"), word_set(normalize_text("text")).alias("body_tokens"), F.sha2("text", 256).alias("content_hash"), "a.claims")


@pytest.fixture(scope="module")
def accident(spark):
    return story(spark, [("ka", "a", COPY, 0), ("kb", "b", COPY, 5), ("kc", "c", FOUR, 10), ("ka", "a", FIX, 60)]).cache()


def test_story_is_one_event(spark, accident):
    found = events.cluster_reports(accident).collect()
    assert len({r.event_id for r in found}) == 1 and {r.decision for r in found} == {"created", "joined"}
    assert found[0].event_id == events.event_id("ka")
    again = events.cluster_reports(accident.unionAll(accident.where("id = 'r0'")))
    assert again.count() == 4


def test_story_claims(spark, accident):
    rows = accident.withColumn("event_id", F.lit("e")).withColumn("agency", F.lit(None).cast("string")).withColumn("source_family", F.lit(None).cast("string"))
    families = {r.report_id: r.family for r in events.evidence_families(rows).collect()}
    assert families == {"r0": "unknown:a", "r1": "unknown:a", "r2": "unknown:c", "r3": "unknown:a"}

    def status(limit):
        told = rows.where(F.col("id") < limit).join(events.evidence_families(rows).withColumnRenamed("report_id", "id"), ["event_id", "id"]).withColumn("c", F.explode("claims"))
        evidence = told.select("event_id", F.col("id").alias("report_id"), "key", "family", "c.predicate", "c.scope", "c.value", F.col("at").alias("as_of"), "c.correction", F.when(F.col("c.correction"), F.col("at")).alias("correction_as_of"), "discovered_at", F.lit(None).cast("string").alias("official_version_id"))
        return {r.value: r.status for r in claims.reconcile_claims(evidence).where("predicate = 'injury_count'").collect()}

    assert status("r2") == {"2": "weakly_supported"}
    assert status("r3") == {"2": "conflicting", "4": "conflicting"}
    assert status("r9") == {"2": "superseded", "4": "supported"}


def test_other_district_and_other_day_are_other_events(spark):
    place = "Ankara {} ilçesinde kaza oldu. Kazada 3 araç çarpıştı, 2 kişi yaralandı."
    rows = story(spark, [("k1", "a", place.format("Sincan"), 0), ("k2", "b", place.format("Polatlı"), 5)])
    assert len({r.event_id for r in events.cluster_reports(rows).collect()}) == 2
    scored = pairs.score_pairs(spark.createDataFrame([("r0", "r1")], "a string, b string"), rows).first()
    assert scored.reasons == ["incompatible_district"] and scored.score == 0
    late = story(spark, [("k1", "a", COPY, 0), ("k2", "b", COPY, 3 * 24 * 60)])
    assert len({r.event_id for r in events.cluster_reports(late).collect()}) == 2


def test_component_replay_equals_global_replay(spark):
    import numpy as np

    draw = np.random.default_rng(4)
    n = 60
    rows = spark.createDataFrame([(f"r{k:02}", f"k{k}", BASE + timedelta(minutes=k), BASE + timedelta(minutes=k)) for k in range(n)], "id string, key string, published_at timestamp, discovered_at timestamp")
    scored = [(f"r{a:02}", f"r{b:02}", float(draw.choice([0.7, 0.72, 0.8, 0.95, 1.0]))) for a in range(n) for b in range(a + 1, n) if draw.random() < 0.03]
    edges = spark.createDataFrame(scored, "a string, b string, score double")
    near = {}
    for a, b, s in scored:
        near.setdefault(a, []).append((b, s))
        near.setdefault(b, []).append((a, s))
    member = {}
    for k in range(n):
        best = {}
        for other, s in near.get(f"r{k:02}", []):
            if other in member:
                best[member[other]] = max(best.get(member[other], 0), s)
        event, _ = events.choose(best)
        member[f"r{k:02}"] = event or events.event_id(f"k{k}")
    found = {r.report_id: r.event_id for r in events.cluster_reports(rows, edges).collect()}
    assert found == member


def test_events_are_not_limited_and_replayed_in_segments(spark):
    import numpy as np

    draw, n = np.random.default_rng(8), 1203
    when = lambda k: BASE + timedelta(minutes=int(k))
    rows = spark.createDataFrame([(f"r{k:04}", f"k{k}", when(k), when(k)) for k in range(n)], "id string, key string, published_at timestamp, discovered_at timestamp")
    chain = spark.createDataFrame([(f"r{k:04}", f"r{k + 1:04}", 0.95) for k in range(n - 1)], "a string, b string, score double")
    found = events.cluster_reports(rows, chain).collect()
    assert len(found) == n and {r.event_id for r in found} == {events.event_id("k0")} and sorted(r.position for r in found) == list(range(n))
    mixed = {(a, b): float(draw.choice([0.7, 0.72, 0.8, 0.95, 1.0])) for a, b in ((int(b - min(b, draw.integers(1, 30))), b) for b in range(1, 120) for _ in range(2)) if a < b}
    edges = spark.createDataFrame([(f"r{a:04}", f"r{b:04}", s) for (a, b), s in mixed.items()], "a string, b string, score double")
    member = {}
    for k in range(120):
        best = {}
        for (a, b), s in mixed.items():
            if b == k:
                best[member[a]] = max(best.get(member[a], 0), s)
        member[k] = events.choose(best)[0] or events.event_id(f"k{k}")
    some = rows.where("id < 'r0120'")
    assert {r.report_id: r.event_id for r in events.cluster_reports(some, edges, segment=25).collect()} == {f"r{k:04}": e for k, e in member.items()}


def test_families_equal_an_ordered_scan(spark):
    import numpy as np

    draw = np.random.default_rng(9)
    base = [[f"w{draw.integers(0, 60)}" for _ in range(40)] for _ in range(6)]
    rows = []
    for k in range(90):
        words = [w for w in base[k % 6] if draw.random() > 0.05] + [f"x{draw.integers(0, 9)}" for _ in range(draw.integers(0, 3))]
        rows.append((f"e{k % 2}", f"r{k:02}", BASE + timedelta(minutes=int(draw.integers(0, 20))), f"h{draw.integers(0, 60)}", sorted(set(words if k % 7 else words[:5])), "AA" if k % 11 == 0 else None, "own" if k % 5 == 0 else None, f"s{k}"))
    want, seen = {}, {"e0": [], "e1": []}
    for event, rid, _, content, body, agency, owner, source in sorted(rows, key=lambda r: (r[2], r[1])):
        words = set(body)
        own = f"agency:{agency}" if agency else f"owner:{owner}" if owner else f"unknown:{source}"
        want[rid] = next((f for c, w, f in seen[event] if c == content or (min(len(w), len(words)) >= 15 and len(w & words) >= 0.85 * len(w | words))), own)
        seen[event].append((content, words, want[rid]))
    table = spark.createDataFrame(rows, "event_id string, id string, discovered_at timestamp, content_hash string, body_tokens array<string>, agency string, source_family string, source_id string")
    assert {r.report_id: r.family for r in events.evidence_families(table).collect()} == want


def test_long_bodies_are_compared_whole(spark, tmp_path):
    from tanik.registry import QUERIES

    shared = [f"a{k}" for k in range(1000, 2200)]
    texts = [" ".join([*shared, *(f"{end}{k}" for k in range(1000, 2000))]) for end in "yz"]
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts, 10)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert len({r.event_id for r in QUERIES["e7_cluster_reports"](spark, str(tmp_path)).collect()}) == 2


def test_candidates_are_explained(spark, tmp_path):
    from tanik.registry import QUERIES

    text = " ".join(f"word{k}" for k in range(30))
    spark.createDataFrame([(k, text, "en", "s", len(text)) for k in (10, 13, 17)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((int(r.a), int(r.b), r.score, r.reasons.split(",")[0]) for r in QUERIES["c12_explain_pairs"](spark, str(tmp_path)).collect())
    assert found == [(a, b, 0.95, "syndicated_body") for a, b in ((10, 13), (10, 17), (13, 17))]


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 105), (105, 103), (7, 7), (200, 200)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 1 for k in range(1, 41)}, 100: 100, 105: 100, 103: 100, 200: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_component_rounds_keep_estimates_small(spark):
    """A checkpoint carries on Spark's size estimate; rounds of self-joins must not square it again and again."""
    names = list(range(64))
    random.Random(5).shuffle(names)
    found = connected_components(spark.createDataFrame(list(zip(names, names[1:])), "a long, b long"))
    assert {(r.node, r.component) for r in found.collect()} == {(n, 0) for n in names}
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 32


def reports_of_a_hot_entity(spark, n=360):
    """Half of all reports name one team, at all times; the rest name some of twenty people."""
    import numpy as np

    draw = np.random.default_rng(12)
    words = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(n):
        things = [("team", "hot")] if k % 2 else [("person", f"p{draw.integers(0, 20)}")]
        if draw.random() < 0.5:
            things.append(("city", f"c{draw.integers(0, 3)}"))
        if draw.random() < 0.2:
            things.append(("road", f"d{draw.integers(0, 2)}"))
        minutes = int(draw.integers(0, 60 * 24 * 6)) if k % 3 else 3000 + int(draw.integers(0, 90))  # a third within an hour and a half
        tokens = sorted(set(draw.choice(words, int(draw.integers(1, 12))).tolist()))
        rows.append((f"r{k:04}", f"k{k % 350}", f"kind{k % 2}" if k % 17 else None, BASE + timedelta(minutes=minutes) if k % 23 else None, things, tokens, tokens[:3]))
    return spark.createDataFrame(rows, "id string, key string, kind string, at timestamp, entities array<struct<kind:string,value:string>>, tokens array<string>, body_tokens array<string>")


def test_a_hot_entity_loses_no_pair(spark):
    from pyspark.sql import functions as F

    from tanik.operators import pairs

    rows = reports_of_a_hot_entity(spark).cache()
    every = rows.select(F.col("id").alias("a")).crossJoin(rows.select(F.col("id").alias("b"))).where("a < b")
    want = {(r.a, r.b): r.score for r in pairs.score_pairs(every, rows).where("score >= 0.7").collect()}
    for block in (8, 1024):
        scored = pairs.score_pairs(pairs.candidate_pairs(rows, block=block), rows).where("score >= 0.7")
        assert {(r.a, r.b): r.score for r in scored.collect()} == want and len(want) > 1000
    raised = {(r.a, r.b) for r in pairs.score_pairs(every.withColumn("sim", F.lit(1.0)), rows, "sim").where("score >= 0.7").collect()}
    outside = pairs.candidate_pairs(rows, outside=True, block=8).withColumn("sim", F.lit(1.0))
    specific = {(r.a, r.b) for r in pairs.score_pairs(outside, rows, "sim").where("score >= 0.7").collect()}
    assert specific <= raised and specific > set(want)


def test_no_cell_outgrows_its_block(spark):
    from pyspark.sql import functions as F

    from tanik.operators import pairs

    rows = spark.range(4000).select(F.format_string("r%05d", "id").alias("id"), F.lit("hot").alias("value"), (F.lit(BASE) + F.make_interval(mins=(F.col("id") % 5000).cast("int"))).alias("at"))
    left, right = pairs.grid(rows, ["value"], 36, 100)
    sizes = [side.groupBy("cell").count().agg(F.max("count"), F.sum("count")).first() for side in (left, right)]
    assert all(most < 160 for most, _ in sizes)
    assert left.join(right.select(F.col("id").alias("other"), "cell", F.col("at").alias("to")), "cell").where("id < other AND abs(cast(at AS double) - cast(to AS double)) <= 129600").count() == sum(min(3999 - k, 2160) for k in range(4000))


def test_similarity_from_outside(spark):
    """A pair between the borders joins with a similarity; one above them does not use it; other values are errors."""
    rows = spark.createDataFrame([("a", "k1", "x", BASE, [("team", "t")], ["m", "n"]), ("b", "k2", "x", BASE + timedelta(hours=20), [("team", "t")], ["o", "p"]), ("c", "k3", "x", BASE + timedelta(hours=1), [("team", "t")], ["q", "r"])], "id string, key string, kind string, at timestamp, entities array<struct<kind:string,value:string>>, tokens array<string>").withColumn("body_tokens", F.col("tokens"))
    plain = {(r.a, r.b): round(r.score, 6) for r in pairs.strong_pairs(rows).collect()}
    assert plain == {("a", "c"): 0.75}
    told = spark.createDataFrame([("a", "b", 0.6), ("a", "c", 0.0)], "a string, b string, similarity double")
    assert {(r.a, r.b): round(r.score, 6) for r in pairs.strong_pairs(rows, similarity=told).collect()} == {("a", "b"): 0.71, ("a", "c"): 0.75}
    for wrong in (-0.1, 1.5):
        with pytest.raises(Exception, match="outside"):
            pairs.strong_pairs(rows, similarity=spark.createDataFrame([("a", "b", wrong)], told.schema))


def test_pairs_of_a_city_that_a_similarity_lifts(spark):
    """Seven of seventeen words in common and one city score 0.61, 0.71 with a full similarity."""
    rows = spark.createDataFrame([(i, k, "x", BASE + timedelta(minutes=m), [("city", "c")], words) for i, k, m, words in (("a", "k1", 0, [f"long{n}" for n in range(5)] + list("abcdefg")), ("b", "k2", 9, [f"other{n}" for n in range(5)] + list("abcdefg")))], "id string, key string, kind string, at timestamp, entities array<struct<kind:string,value:string>>, tokens array<string>").withColumn("body_tokens", F.col("tokens"))
    assert pairs.strong_pairs(rows).isEmpty()
    told = spark.createDataFrame([("a", "b", 1.0)], "a string, b string, similarity double")
    assert [round(r.score, 6) for r in pairs.strong_pairs(rows, similarity=told).collect()] == [0.714706]


def test_rows_of_a_search_are_dealt_out_once(spark):
    rows = spark.range(50).select(F.format_string("r%02d", "id").alias("id"), F.lit("v").alias("value"), (F.lit(BASE) + F.make_interval(mins=(F.col("id") * 30).cast("int"))).alias("at"))
    near = pairs._near(rows, ["value"], 6)
    assert sorted((r.a, r.b) for r in near.collect()) == [(f"r{a:02}", f"r{b:02}") for a in range(50) for b in range(a + 1, 50) if b - a <= 12]
    assert "ReusedExchange" in near._jdf.queryExecution().executedPlan().toString()


def test_words_and_their_numbers_give_the_same(spark, accident):
    numbered = accident.withColumns({c: pairs.word_numbers(F.col(c)) for c in ("tokens", "body_tokens")})
    scored = lambda rows: sorted((r.a, r.b, r.score) for r in pairs.strong_pairs(rows).collect())
    assert scored(numbered) == scored(accident) and len(scored(accident)) == 6
    told = lambda rows: sorted(events.evidence_families(rows.withColumn("event_id", F.lit("e")).withColumn("agency", F.lit(None).cast("string")).withColumn("source_family", F.lit(None).cast("string"))).collect())
    assert told(numbered) == told(accident)


def test_saved_features_hold_words_once_as_numbers(spark):
    from tanik.plans import news

    rows = news.saved_features(spark, "/root/testdata/sf0.001")
    assert dict(rows.dtypes)["tokens"] == "array<bigint>" and rows.where("tokens <> body_tokens").isEmpty()
