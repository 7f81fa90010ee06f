"""Claims of an event reconciled: which evidence still counts and what that makes of each value.

Evidence rows: event_id, report_id, key, family, predicate, scope, value (canonical JSON), as_of,
correction (boolean), correction_as_of, discovered_at, official_version_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tanik.functions.ids import json_hash

# --- fixed values: how far each sign raises or lowers the confidence in an event, and its importance
FLOOR, FAMILY, FRESH, RELIABLE, PLACED, OFFICIAL, CONTRADICTED, UNKNOWN = 0.15, 0.12, 0.1, 0.1, 0.1, 0.2, 0.2, 0.03
MOST_FAMILIES, FRESH_SECONDS = 4, 86400
BY_SCORE, BY_REPORT, BY_UPDATE, BY_PLACE, MOST_REPORTS, MOST_UPDATES = 0.5, 0.025, 0.025, 0.125, 10, 5

BY_FAMILY = ("event_id", "family", "predicate", "scope")


def mark_superseded(evidence: DataFrame) -> DataFrame:
    """Adds ``active``: false where a newer revision of the same report, or a later correction by another
    report of the same family on the same predicate and scope, exists.

    Corrections are first reduced to the two latest of different reports in each group, so a group with
    very many claims is joined to two values, not to itself.
    """
    fixes = evidence.where("correction AND correction_as_of IS NOT NULL").groupBy(*BY_FAMILY, "report_id").agg(F.max("correction_as_of").alias("as_of"))
    latest = F.slice(F.sort_array(F.collect_list(F.struct("as_of", "report_id")), asc=False), 1, 2).alias("fixes")
    fixes = fixes.withColumn("place", F.row_number().over(W.partitionBy(*BY_FAMILY).orderBy(F.desc("as_of"), F.desc("report_id")))).where("place <= 2").groupBy(*BY_FAMILY).agg(latest)
    newest = evidence.groupBy("event_id", "key").agg(F.max("discovered_at").alias("newest"))
    rows = evidence.join(fixes, list(BY_FAMILY), "left").join(newest, ["event_id", "key"], "left")
    fixed = F.coalesce(F.exists("fixes", lambda f: (f["report_id"] != F.col("report_id")) & (f["as_of"] > F.col("as_of"))), F.lit(False))
    return rows.withColumn("active", ~(fixed | F.coalesce(F.col("newest") > F.col("discovered_at"), F.lit(False)))).drop("fixes", "newest")


def reconcile_claims(evidence: DataFrame) -> DataFrame:
    """One row per (event, predicate, scope, value): claim_id, status, evidence counts.

    superseded: nothing active; conflicting: another value of the same predicate and scope is active;
    supported: two families or an official version; otherwise weakly_supported.
    """
    rows = evidence if "active" in evidence.columns else mark_superseded(evidence)
    by = ("event_id", "predicate", "scope", "value")
    live = F.col("active")
    grouped = rows.groupBy(*by).agg(F.count("*").alias("evidence"), F.count_if(live).alias("active_evidence"), F.countDistinct(F.when(live, F.col("family"))).alias("families"), F.max(F.coalesce(live & F.col("official_version_id").isNotNull(), F.lit(False))).alias("official"))
    rivals = F.count_if(F.col("active_evidence") > 0).over(W.partitionBy("event_id", "predicate", "scope"))
    status = F.when(F.col("active_evidence") == 0, "superseded").when(rivals > 1, "conflicting").when((F.col("families") >= 2) | F.col("official"), "supported").otherwise("weakly_supported")
    claim = json_hash(F.col("event_id"), F.col("predicate"), F.col("scope"), F.col("value"))
    return grouped.withColumn("status", status).withColumn("claim_id", claim).select("claim_id", *by, "status", "evidence", "active_evidence", "families")


def confidence_signals(reports: DataFrame, claims: DataFrame, entities: DataFrame, updates: DataFrame, now) -> DataFrame:
    """Confidence and importance of each event at the time ``now``.

    ``reports``: event_id, report_id, family, source_reliability, published_at, modified_at,
    discovered_at, official_version_id. ``claims``: event_id, predicate, scope, status. ``entities``:
    event_id, kind. ``updates``: event_id, at. An event without active claims scores 0.
    """
    at = now.cast("double")
    dated = F.coalesce("modified_at", "published_at").cast("double")
    hour = lambda c: F.count_if(at - F.col(c).cast("double") < 3600)
    r = reports.groupBy("event_id").agg(
        F.count("*").alias("reports"), F.countDistinct("family").alias("families"), F.countDistinct(F.when(F.col("family").startswith("unknown:"), F.col("family"))).alias("unknown_origins"),
        F.count("official_version_id").alias("official_reports"), F.max(F.when(dated <= at, dated)).alias("freshest"), F.avg("source_reliability").alias("source_reliability"), hour("discovered_at").alias("reports_last_hour"))
    c = claims.groupBy("event_id").agg(F.count_if(F.col("status") != "superseded").alias("active_claims"), F.count_if(F.col("status") == "supported").alias("supported_claims"), F.countDistinct(F.when(F.col("status") == "conflicting", F.concat_ws(":", "predicate", "scope"))).alias("contradictions"))
    e = entities.groupBy("event_id").agg(F.max(F.when(F.col("kind").isin("road", "district", "location"), 1.0).when(F.col("kind") == "city", 0.5).otherwise(0.0)).alias("geographic_specificity"))
    u = updates.groupBy("event_id").agg(hour("at").alias("updates_last_hour"))
    rows = r.join(c, "event_id", "left").join(e, "event_id", "left").join(u, "event_id", "left")
    rows = rows.fillna(0, ["active_claims", "supported_claims", "contradictions", "updates_last_hour"]).fillna(0.0, ["geographic_specificity"])
    fresh = F.coalesce(F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0.0), at - F.col("freshest")) / FRESH_SECONDS), F.lit(0.0))
    rows = rows.withColumn("freshness", fresh)
    raw = FLOOR + F.least("families", F.lit(MOST_FAMILIES)) * FAMILY + F.col("freshness") * FRESH + F.col("source_reliability") * RELIABLE + F.col("geographic_specificity") * PLACED + F.when(F.col("official_reports") > 0, OFFICIAL).otherwise(0.0) - F.col("contradictions") * CONTRADICTED - F.col("unknown_origins") * UNKNOWN
    rows = rows.withColumn("raw", F.when(F.col("active_claims") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).otherwise(0.0))
    weight = F.col("raw") * BY_SCORE + F.least("reports_last_hour", F.lit(MOST_REPORTS)) * BY_REPORT + F.least("updates_last_hour", F.lit(MOST_UPDATES)) * BY_UPDATE + F.col("geographic_specificity") * BY_PLACE
    return rows.select("event_id", "reports", "families", "unknown_origins", "official_reports", "active_claims", "supported_claims", "freshness", "reports_last_hour", "updates_last_hour", "contradictions", "geographic_specificity", "source_reliability", F.round("raw", 3).alias("score"), F.round(F.least(F.lit(1.0), weight), 3).alias("importance"))


def claim_timeline(evidence: DataFrame) -> DataFrame:
    """(event_id, report_id, predicate, scope, value, status, evidence, change): what each report changed.

    ``evidence`` as above with ``position``, the report's place in its event. A claim changes with a
    report if it is new, or its status or number of evidence rows differs from before. A piece of evidence
    counts from its own report to the first report that supersedes it, so states are running sums over
    these two moments, and a claim that others contradict turns where the number of live values passes one:
    nothing is replayed, and no event is gathered in one task. correction_as_of is a row's as_of or null.
    """
    group, claim = ("event_id", "predicate", "scope"), ("event_id", "predicate", "scope", "value")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    never = F.lit(1 << 60)
    later = lambda by, order: W.partitionBy(*by).orderBy(order).rangeBetween(1, W.unboundedFollowing)
    rows = evidence.withColumn("seen", micros("discovered_at")).withColumn("told", micros("as_of"))
    fixing = F.when(F.col("correction") & F.col("correction_as_of").isNotNull(), F.col("position"))
    revised = F.min("position").over(later(("event_id", "key"), "seen"))
    fixed = F.min(fixing).over(later(BY_FAMILY, "told"))
    rows = rows.withColumn("until", F.least(F.coalesce(revised, never), F.coalesce(fixed, never)))
    official = F.col("official_version_id").isNotNull()
    lives = F.col("until") > F.col("position")
    moment = lambda at, e, sign: F.struct(at.alias("at"), F.lit(e).alias("evidence"), F.when(lives, F.lit(sign)).otherwise(0).alias("active"), F.when(lives & official, F.lit(sign)).otherwise(0).alias("official"))
    moments = rows.select(*claim, "family", F.explode(F.array(moment(F.col("position").cast("long"), 1, 1), moment(F.col("until").cast("long"), 0, -1))).alias("m")).where(F.col("m.at") < never).select(*claim, "family", "m.*")
    # families count while any of their evidence does
    by_family = moments.groupBy(*claim, "family", "at").agg(*[F.sum(c).alias(c) for c in ("evidence", "active", "official")])
    held = F.sum("active").over(W.partitionBy(*claim, "family").orderBy("at"))
    by_family = by_family.withColumn("now", held).withColumn("families", (F.col("now") > 0).cast("int") - ((F.col("now") - F.col("active")) > 0).cast("int"))
    steps = by_family.groupBy(*claim, "at").agg(*[F.sum(c).alias(c) for c in ("evidence", "active", "official", "families")])
    running = W.partitionBy(*claim).orderBy("at")
    states = steps.select(*claim, "at", *[F.sum(c).over(running).alias(c) for c in ("evidence", "active", "official", "families")])
    turned = states.withColumn("live", (F.col("active") > 0).cast("int")).withColumn("live", F.col("live") - F.coalesce(F.lag("live").over(running), F.lit(0)))
    counts = turned.groupBy(*group, "at").agg(F.sum("live").alias("turned"))
    counts = counts.withColumn("rivals", F.sum("turned").over(W.partitionBy(*group).orderBy("at")))
    # moments at which the whole group begins or ends to contradict itself concern all of its claims
    split = counts.where(((F.col("rivals") > 1) != ((F.col("rivals") - F.col("turned")) > 1))).select(*group, "at")
    every = states.unionByName(states.select(*claim).distinct().join(split, list(group)).join(states.select(*claim, "at"), [*claim, "at"], "left_anti"), allowMissingColumns=True)
    filled = every.select(*claim, "at", *[F.last(c, True).over(running).alias(c) for c in ("evidence", "active", "official", "families")]).where("evidence > 0")
    known = filled.join(counts.select(*group, "at", "rivals"), [*group, "at"])
    status = F.when(F.col("active") == 0, "superseded").when(F.col("rivals") > 1, "conflicting").when((F.col("families") >= 2) | (F.col("official") > 0), "supported").otherwise("weakly_supported")
    known = known.withColumn("status", status)
    before = F.struct(F.lag("status").over(running).alias("status"), F.lag("evidence").over(running).alias("evidence"))
    changed = known.withColumn("before", before).where(~F.equal_null("before.status", "status") | ~F.equal_null("before.evidence", "evidence"))
    places = rows.groupBy("event_id", F.col("position").cast("long").alias("at")).agg(F.min("report_id").alias("report_id"))
    return changed.join(places, ["event_id", "at"]).select("event_id", "report_id", "predicate", "scope", "value", "status", "evidence", F.concat_ws(":", "predicate", "status").alias("change"))
