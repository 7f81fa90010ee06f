"""Logged questions to current, grounded answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tanik.operators.joins import paired, small
from tanik.session import saved

#: Words of a question that do not name its subject.
QUESTION_WORDS = ("ne", "zaman", "mi", "mu", "aciklandi", "aciklandimi", "aciklanacak", "tarihi", "tarihleri", "nedir", "icin", "bu", "yil", "basliyor", "baslayacak")


def _live_rules(rules: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Distinct rules that hold now: (topic_id, predicate, source_id) for all entities, and (..., entity_id) for one where none for all says so."""
    live = rules.where((F.col("status") == "active") & F.coalesce(F.col("valid_from") <= now, F.lit(True)) & F.coalesce(F.col("valid_until") > now, F.lit(True)))
    live = live.select("topic_id", "predicate", F.col("subject_entity_id").alias("entity_id"), "source_id")
    every = live.where("entity_id IS NULL").drop("entity_id").distinct()
    return every, live.where("entity_id IS NOT NULL").distinct().join(every, ["topic_id", "predicate", "source_id"], "left_anti")


def authority_match(subjects: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    """(subject columns, source_id): sources that may speak on (topic_id, predicate, entity_id) now.

    A rule with a null entity holds for all; its time range is half open. Rules of one entity are joined
    on it as well, so only rules for all entities meet every subject of their topic and predicate, cell by cell.
    Both sides are made distinct before they meet, so the pairs, which can be very many, are not dealt out again.
    """
    every, own = _live_rules(rules, now)
    subjects = subjects.distinct()
    columns = [*subjects.columns, "source_id"]
    return subjects.join(own, ["topic_id", "predicate", "entity_id"]).select(*columns).unionByName(paired(subjects, every, ["topic_id", "predicate"]).select(*columns))


def evidence_bundles(facts: DataFrame, evidence: DataFrame, versions: DataFrame, documents: DataFrame) -> DataFrame:
    """fact to evidence to version to document, where the version is the document's current one.

    Facts are few; the versions that they need are cut down first.
    """
    cited = evidence.join(facts.select(F.col("id").alias("fact_id")), "fact_id", "left_semi")
    needed = versions.join(cited.select("version_id").distinct(), "version_id", "left_semi")
    return cited.join(needed, "version_id").join(documents, (F.col("document_id") == F.col("doc_id")) & (F.col("current_version_id") == F.col("version_id")))


def resolve_answers(resources: DataFrame, rules: DataFrame, facts: DataFrame, publishable: DataFrame, endpoints: DataFrame, now: Column) -> DataFrame:
    """(resource, year, state, fact_id, value, verified_at, stale) for every resource and year.

    ``resources``: resource, entity_id, topic_id, predicate, year. ``facts`` as in facts, id and
    authority_source_id included. ``publishable``: fact_id, shown (the value as text), start_day,
    end_day, evidence_healthy: facts that pass all publication checks. ``endpoints``: source_id,
    healthy, complete. A fact under review, or two values, hide any answer. The newest verified
    published fact counts; days are compared in Europe/Istanbul. Without one: superseded or expired if
    all are, monitored_absence where every endpoint is healthy and complete, else no_verified_fact.

    Facts are held against the rules of their own source, and gathered before they meet resources, so no
    resource is ever paired with all sources of its topic.
    """
    key, subject = ["resource", "year"], ["entity_id", "topic_id", "predicate"]
    every, own = _live_rules(rules, now)
    said = F.lit(True)
    facts = facts.select(F.col("id").alias("fact_id"), F.col("subject_entity_id").alias("entity_id"), "topic_id", "predicate", F.col("reference_period").alias("year"), F.col("authority_source_id").alias("source_id"), "status", F.to_json("value").alias("value"), "verified_at", "valid_until")
    facts = facts.join(small(every.withColumn("by_all", said)), ["topic_id", "predicate", "source_id"], "left").join(small(own.withColumn("by_own", said)), ["topic_id", "predicate", "source_id", "entity_id"], "left")
    told = facts.where("by_all OR by_own").drop("by_all", "by_own", "source_id").join(publishable, "fact_id", "left")
    best = F.when((F.col("status") == "published") & F.col("shown").isNotNull(), F.struct("verified_at", "fact_id"))
    shown = F.when(F.col("status").isin("verified", "published"), F.col("value"))
    told = told.groupBy(*subject, "year").agg(
        F.max(F.col("status") == "needs_review").alias("review"), F.min(shown).alias("least"), F.max(shown).alias("most"),
        F.max_by(F.struct("fact_id", "shown", "verified_at", "start_day", "end_day", "evidence_healthy"), best).alias("best"), F.max(best).alias("rank"),
        F.count_if(F.col("status") == "published").alias("published"), F.count_if((F.col("status") == "published") & F.coalesce(F.col("valid_until") <= now, F.lit(False))).alias("ended"),
        F.count_if(F.col("status") == "superseded").alias("superseded"))
    # what the endpoints of all sources say of a topic, and of an entity, is known before any resource is joined
    points = endpoints.groupBy("source_id").agg(F.bool_and("healthy").alias("healthy"), F.bool_and("complete").alias("complete"))
    watched = lambda live, by, name: small(live.join(points, "source_id").groupBy(*by).agg(F.bool_and("healthy").alias(f"healthy_{name}"), F.bool_and("complete").alias(f"complete_{name}")))
    both = lambda c: F.bool_and(F.coalesce(F.col(f"{c}_all") & F.col(f"{c}_own"), f"{c}_all", f"{c}_own")).alias(c)
    rows = resources.select(*subject, "year", "resource").distinct().join(told, [*subject, "year"], "left")
    rows = rows.join(watched(every, ["topic_id", "predicate"], "all"), ["topic_id", "predicate"], "left").join(watched(own, subject, "own"), subject, "left")
    rows = rows.groupBy(*key).agg(
        F.max("review").alias("review"), (F.min("least") != F.max("most")).alias("differ"), F.max_by("best", "rank").alias("best"), F.max("rank").isNotNull().alias("found"),
        F.sum("published").alias("published"), F.sum("ended").alias("ended"), F.sum("superseded").alias("superseded"), both("healthy"), both("complete"))
    day = F.to_date(F.from_utc_timestamp(now, "Europe/Istanbul"))
    hidden = F.coalesce(F.col("review"), F.lit(False)) | F.coalesce("differ", F.lit(False))
    good = F.coalesce("found", F.lit(False)) & ~hidden
    healthy = F.coalesce("healthy", F.lit(False))
    state = (
        F.when(hidden, "needs_review")
        .when(good & F.coalesce(F.col("best.start_day") > day, F.lit(False)), "future_announced")
        .when(good & F.coalesce(F.col("best.end_day") < day, F.lit(False)), "expired")
        .when(good, "current")
        .when((F.coalesce("published", F.lit(0)) > 0) & (F.col("published") == F.col("ended")), "expired")
        .when((F.coalesce("superseded", F.lit(0)) > 0) & (F.col("published") == 0), "superseded")
        .when(healthy & F.coalesce("complete", F.lit(False)) & (F.coalesce("published", F.lit(0)) == 0), "monitored_absence")
        .otherwise("no_verified_fact")
    )
    pick = lambda name: F.when(good, F.col(f"best.{name}"))
    stale = F.when(good, ~F.col("best.evidence_healthy")).otherwise(~healthy)
    return rows.select(*key, state.alias("state"), pick("fact_id").alias("fact_id"), pick("shown").alias("value"), pick("verified_at").alias("verified_at"), stale.alias("stale"))


def explain_answers(answers: DataFrame, resources: DataFrame, rules: DataFrame, endpoints: DataFrame, bundles: DataFrame, now: Column) -> DataFrame:
    """Adds ``checked_at``, ``authority`` and ``evidence`` to answers as of ``resolve_answers``.

    checked_at: when the longest unchecked endpoint of the authorities was last read with success (``endpoints``:
    source_id, successful_at; later times than ``now`` do not count), null if none was. authority: the
    sources that may answer, in order. evidence: (version_id, document_id, title, url, published_at, excerpt,
    locator) of the shown fact in order, from ``bundles`` (fact_id, version_id, document_id, title, url,
    published_at, excerpt, page, heading, as joined by ``evidence_bundles``); empty where no fact is shown. Only
    the bundles of shown facts are dealt out.
    """
    key, subject = ["resource", "year"], ["entity_id", "topic_id", "predicate"]
    every, own = _live_rules(rules, now)
    read = endpoints.where(F.col("successful_at") <= now).groupBy("source_id").agg(F.min("successful_at").alias("read_at"))
    lists = lambda live, by, name: small(live.join(read, "source_id", "left").groupBy(*by).agg(F.min("read_at").alias(f"read_{name}"), F.sort_array(F.collect_set("source_id")).alias(name)))
    asked = resources.select(*key, F.struct(*subject).alias("s")).distinct().groupBy(*key).agg(F.collect_list("s").alias("subjects"))
    place = F.when(F.col("page").isNotNull(), F.concat(F.lit("Sayfa "), F.col("page").cast("string"))).otherwise(F.coalesce("heading", F.lit("Belgedeki ilgili bölüm")))
    item = F.struct("version_id", "document_id", "title", "url", "published_at", "excerpt", place.alias("locator"))
    answers = saved(answers)
    shown = small(answers.where("fact_id IS NOT NULL").select("fact_id").distinct())
    proof = bundles.join(shown, "fact_id", "left_semi").groupBy("fact_id").agg(F.array_sort(F.collect_set(item)).alias("evidence"))
    none = F.array().cast(proof.schema["evidence"].dataType)
    rows = answers.where("fact_id IS NOT NULL").join(proof, "fact_id", "left").select(*answers.columns, F.coalesce("evidence", none).alias("evidence"))
    rows = rows.unionByName(answers.where("fact_id IS NULL").withColumn("evidence", none)).join(asked, key, "left")
    # the lists of sources, which can be long, come last and are never dealt out, but for resources of several subjects
    rows = rows.withColumn("several", F.coalesce(F.size("subjects") > 1, F.lit(False)))
    named = lambda df: df.join(lists(every, ["topic_id", "predicate"], "all"), ["topic_id", "predicate"], "left").join(lists(own, subject, "own"), subject, "left").withColumn("checked_at", F.least("read_all", "read_own"))
    one = named(rows.where("NOT several").withColumn("s", F.get("subjects", F.lit(0))).select(*answers.columns, "evidence", "s.*"))
    one = one.withColumn("authority", F.when(F.col("own").isNull(), F.col("all")).otherwise(F.sort_array(F.concat("own", F.coalesce("all", F.slice("own", 1, 0))))))
    more = named(rows.where("several").select(*key, F.explode("subjects").alias("s")).distinct().select(*key, "s.*"))
    more = more.groupBy(*key).agg(F.min("checked_at").alias("checked_at"), F.array_union(F.flatten(F.collect_set("all")), F.flatten(F.collect_set("own"))).alias("authority"))
    more = rows.where("several").join(more.withColumn("authority", F.sort_array("authority")), key, "left")
    out = [F.coalesce("authority", F.array().cast(f"array<{dict(every.dtypes)['source_id']}>")).alias("authority"), "evidence"]
    return one.select(*answers.columns, "checked_at", *out).unionByName(more.select(*answers.columns, "checked_at", *out))


def related_answers(answers: DataFrame, groups: DataFrame) -> DataFrame:
    """(resource, year, related): other answered resources of the same group and year.

    As many rows as there are such pairs; those of a large group are made cell by cell.
    """
    rows = answers.join(groups, "resource")
    other = rows.where(F.col("value").isNotNull()).select("group", "year", F.col("resource").alias("related"))
    return paired(rows.select("resource", "group", "year"), other, ["group", "year"]).where("resource <> related").select("resource", "year", "related")


def answer_quality(answers: DataFrame) -> DataFrame:
    """(state, answers): how many answers are in each state."""
    return answers.groupBy("state").agg(F.count("*").alias("answers"))


def invalid_answers(answers: DataFrame, proven: DataFrame) -> DataFrame:
    """(resource, year, problem): shown answers without a fact, without a value, or whose fact nothing proves.

    ``answers`` as of ``resolve_answers``; ``proven``: fact_id of facts with evidence in a current version.
    """
    shown = saved(answers.where(F.col("state").isin("current", "future_announced")).select("resource", "year", "fact_id", "value"))
    asked = small(shown.where("fact_id IS NOT NULL").select("fact_id").distinct())
    known = proven.select("fact_id").join(asked, "fact_id", "left_semi").distinct().withColumn("proven", F.lit(True))
    problem = F.when(F.col("fact_id").isNull(), "missing_fact").when(F.col("value").isNull(), "missing_value").when(F.col("proven").isNull(), "missing_evidence")
    return shown.join(known, "fact_id", "left").withColumn("problem", problem).where("problem IS NOT NULL").select("resource", "year", "problem")


def _third(length: Column, n: int) -> tuple[Column, Column]:
    """(start from 1, length) of the n-th of three parts of a phrase of a length."""
    size = F.floor(length / 3).cast("int")
    return size * n + 1, (length - 2 * size if n == 2 else size).cast("int")


def _parts_of_alias(alias: Column) -> Column:
    length = F.length(alias)
    parts = [F.struct(length.alias("of"), F.lit(n).alias("n"), F.substring(alias, *_third(length, n)).alias("text")) for n in range(3)]
    return F.array(*parts)


def _parts_of_query(phrase: Column) -> Column:
    """The parts that an alias within two edits can share, for every length it can have."""
    lengths = [F.length(phrase) + d for d in range(-2, 3)]
    cut = lambda of, n, move: F.struct(of.alias("of"), F.lit(n).alias("n"), F.substring(phrase, _third(of, n)[0] + move, _third(of, n)[1]).alias("text"))
    parts = [F.when((of >= 3) & (_third(of, n)[0] + move >= 1), cut(of, n, move)) for of in lengths for n in range(3) for move in range(-2, 3)]
    return F.array_distinct(F.array_compact(F.array(*parts)))


def resolve_queries(queries: DataFrame, aliases: DataFrame, default_year: int, stop: tuple[str, ...] = QUESTION_WORDS) -> DataFrame:
    """(normalized, resource, year, method, reason, suggestions) of distinct normalised queries.

    ``queries``: normalized. ``aliases``: resource, predicate, alias (normalised). Word counts must be
    equal; short words must be equal; up to two edits are forgiven in eight letters or more. The best must
    reach 0.8 and lead by 0.08. Two phrases within two edits share one of the three parts of either, moved
    by two letters at most, so queries and aliases are joined on such parts and not pair by pair.
    """
    asked = queries.select("normalized").where("normalized IS NOT NULL").distinct()
    text = F.regexp_replace("normalized", r"\bzamam\b", "zaman")
    years = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b((?:19|20|21)[0-9]{2})\b"), F.lit(1)))
    words = F.filter(F.split(text, " "), lambda w: (w != "") & ~w.isin(list(stop)) & ~w.rlike("^(?:19|20|21)[0-9]{2}$"))
    asked = asked.select("normalized", text.alias("text"), years.alias("years"), words.alias("words"), F.array_join(words, " ").alias("phrase"))
    asked = asked.withColumn("vague", (F.col("text") == "") | (F.size("years") > 1) | F.col("text").rlike(r"\b(?:gecen|gelecek|onceki|sonraki)\b"))
    names = aliases.select("resource", "predicate", "alias", F.split("alias", " ").alias("alias_words"))
    longest = F.greatest(F.length("phrase"), F.length("alias"))
    some = asked.where("NOT vague").select("normalized", "phrase", "words")
    exact = some.join(names, F.col("phrase") == F.col("alias"))
    near = some.select("normalized", "phrase", "words", F.explode(_parts_of_query(F.col("phrase"))).alias("part")).join(names.withColumn("part", F.explode(_parts_of_alias(F.col("alias")))), "part").drop("part")
    pairs = exact.unionByName(near.where((F.size("words") == F.size("alias_words")) & (F.abs(F.length("phrase") - F.length("alias")) <= 2))).distinct()
    fixed = F.forall(F.arrays_zip(F.col("alias_words").alias("a"), F.col("words").alias("w")), lambda p: (F.length(p["a"]) > 3) | (p["a"] == p["w"]))
    edits = F.levenshtein("phrase", "alias", 2)
    score = F.when(F.col("phrase") == F.col("alias"), 1.0).when(fixed & (F.length("phrase") >= 8) & (edits >= 0), 1 - edits / longest)
    scored = pairs.withColumn("score", score).where("score > 0").groupBy("normalized", "resource").agg(F.max("score").alias("score"), F.first("predicate").alias("predicate"), F.max(F.col("phrase") == F.col("alias")).alias("exact"))
    best = scored.groupBy("normalized").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), F.col("resource"), "predicate", "exact"))), 1, 3).alias("best"))
    rows = asked.join(best, "normalized", "left")
    top, second = F.get("best", F.lit(0)), F.get("best", F.lit(1))
    clear = F.coalesce((-top["minus"] >= 0.8) & (second.isNull() | (second["minus"] - top["minus"] >= 0.08)), F.lit(False))
    wants = F.when(F.col("text").rlike(r"\b(?:ucret|ucreti|para|kac tl)\b"), "application_fee").when(F.col("text").rlike(r"\b(?:sart|sartlari|kosul|kosullari)\b"), "conditions")
    other = wants.isNotNull() & (top["predicate"] != wants)
    reason = F.when(F.col("vague"), "unclear_query").when(~clear, "no_single_topic").when(other, "no_source_for_kind")
    year = F.when(F.size("years") > 0, F.get("years", F.lit(0)).cast("int")).otherwise(F.lit(default_year))
    fine = reason.isNull()
    names = F.coalesce(F.transform("best", lambda b: b["resource"]), F.array().cast("array<string>"))
    return rows.select("normalized", F.when(fine, top["resource"]).alias("resource"), F.when(fine, year).alias("year"), F.when(fine, F.when(top["exact"], "alias").otherwise("spelling")).alias("method"), reason.alias("reason"), F.when(~fine & ~F.col("vague"), names).otherwise(F.array().cast("array<string>")).alias("suggestions"))


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces of each word, padded with two spaces before and one after."""
    padded = lambda w: F.concat(F.lit("  "), w, F.lit(" "))
    cut = lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, 3))
    return F.array_distinct(F.flatten(F.transform(F.filter(F.split(text, " "), lambda w: w != ""), lambda w: cut(padded(w)))))


def search_aliases(queries: DataFrame, aliases: DataFrame, least: float = 0.3, most: int = 5) -> DataFrame:
    """(query, resource, similarity): the best five resources of each distinct query of 3 to 240 characters.

    An alias fits if its trigram similarity is over ``least`` or it holds all words of the query. Both
    tables are joined through shared trigrams, whole words included, not row by row.
    """
    asked = queries.select("query").distinct().where(F.length("query").between(3, 240)).withColumn("q", trigrams(F.col("query")))
    names = aliases.select("resource", "alias", trigrams(F.col("alias")).alias("t")).distinct()
    shared = asked.select("query", F.size("q").alias("nq"), F.explode("q").alias("g")).join(names.select("resource", "alias", F.size("t").alias("nt"), F.explode("t").alias("g")), "g").groupBy("query", "nq", "resource", "alias", "nt").agg(F.count("*").alias("n"))
    near = F.col("n") / (F.col("nq") + F.col("nt") - F.col("n"))
    words = F.filter(F.split("query", " "), lambda w: w != "")
    holds = F.size(F.array_except(words, F.split("alias", " "))) == 0
    found = shared.withColumn("similarity", near).where((F.col("similarity") > least) | holds).groupBy("query", "resource").agg(F.max("similarity").alias("similarity"))
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "resource"))
    return found.withColumn("place", place).where(F.col("place") <= most).drop("place")


def format_value(v: Column) -> Column:
    """A tagged value as Turkish text; null for url and json."""
    names = F.array(*[F.lit(m) for m in ("Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran", "Temmuz", "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık")])
    day = lambda d: F.concat(F.dayofmonth(d).cast("string"), F.lit(" "), F.element_at(names, F.month(d)), F.lit(" "), F.year(d).cast("string"))
    date = lambda c: day(F.try_to_date(c, "yyyy-MM-dd"))
    local = F.from_utc_timestamp(v["value"].try_cast("timestamp"), "Europe/Istanbul")
    whole, rest = F.substring_index(v["amount"], ".", 1), F.when(F.contains(v["amount"], F.lit(".")), F.concat(F.lit(","), F.substring_index(v["amount"], ".", -1))).otherwise("")
    money = F.concat(F.regexp_replace(whole, "(?<=[0-9])(?=(?:[0-9]{3})+$)", "."), rest, F.lit(" "), v["currency"])
    return (
        F.when(v["type"] == "date", date(v["value"]))
        .when(v["type"] == "date_range", F.concat(date(v["start"]), F.lit(" – "), date(v["end"])))
        .when(v["type"] == "datetime", F.concat(day(local), F.lit(" "), F.date_format(local, "HH:mm")))
        .when(v["type"] == "money", money)
        .when(v["type"] == "number", F.replace(v["value"], F.lit("."), F.lit(",")))
        .when(v["type"] == "boolean", F.when(v["value"] == "true", "Evet").otherwise("Hayır"))
        .when(v["type"].isin("status", "string"), v["value"])
    )


def catalog_gaps(resources: DataFrame, entities: DataFrame, topics: DataFrame, rules: DataFrame, published: DataFrame | None = None, answers: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """(resource, gap): catalogue resources without a known entity, topic or authority.

    With ``published`` (resource, fact_id) and ``answers`` (resource, value) also resources that have a
    published fact and yet no answer; with ``documents`` (canonical_url) also documents of test fixtures,
    by their URL.
    """
    gap = lambda df, name: df.select("resource", F.lit(name).alias("gap")).distinct()
    no_entity = resources.join(entities.select("entity_id"), "entity_id", "left_anti")
    no_topic = resources.join(topics.select("topic_id"), "topic_id", "left_anti")
    no_rule = resources.join(rules.where("status = 'active'").select("topic_id", "predicate").distinct(), ["topic_id", "predicate"], "left_anti")
    out = gap(no_entity, "entity").unionByName(gap(no_topic, "topic")).unionByName(gap(no_rule, "authority"))
    if published is not None and answers is not None:
        out = out.unionByName(gap(published.join(answers.where("value IS NOT NULL"), "resource", "left_anti"), "answer"))
    if documents is not None:
        out = out.unionByName(gap(documents.where(F.lower("canonical_url").rlike("fixture|[./]test[./]")).select(F.col("canonical_url").alias("resource")), "fixture_document"))
    return out


def topic_cycles(topics: DataFrame) -> DataFrame:
    """(topic_id, depth, cycle): steps to the root of each topic, or a circle, which has no depth.

    ``topics``: topic_id, parent_id. Every topic jumps to the ancestor of its ancestor, so after k rounds
    paths of 2**k steps are known; what has not reached a root after as many steps as there are topics
    never will. A parent that is not in the table counts as a root's parent: the path ends there.
    """
    known = topics.select("topic_id", "parent_id").distinct()
    own = known.select(F.col("topic_id").alias("up"))
    paths = saved(known.join(own, F.col("parent_id") == F.col("up"), "left").select("topic_id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    steps, most = 1, paths.count()
    while steps <= most and not paths.where("up IS NOT NULL").isEmpty():
        over = paths.select(F.col("topic_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        paths = saved(paths.join(over, "up", "left").select("topic_id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        steps *= 2
    cycle = F.col("up").isNotNull()
    return paths.select("topic_id", F.when(~cycle, F.col("depth")).cast("int").alias("depth"), cycle.alias("cycle"))


def topic_ancestors(topics: DataFrame) -> DataFrame:
    """(topic_id, ancestor_id, depth): every ancestor of each topic and the fewest steps to it.

    ``topics``: topic_id, parent_id; a topic may have several parents. A topic of a circle is an ancestor of
    itself, at the length of the circle. A parent that is not in the table is an ancestor without parents.
    Round k joins what is known within 2**k steps to the ends of paths of just 2**k steps, so the rounds are
    the logarithm of the longest shortest path; a round without new pairs is the last.
    """
    links = topics.where("topic_id IS NOT NULL AND parent_id IS NOT NULL").select("topic_id", F.col("parent_id").alias("ancestor_id")).distinct()
    known, jumps = saved(links.withColumn("depth", F.lit(1).cast("long"))), saved(links)
    steps, pairs, before = 1, known.count(), -1
    while pairs != before:
        over = jumps.select("topic_id", F.col("ancestor_id").alias("via"))
        further = over.join(known.withColumnRenamed("topic_id", "via"), "via").select("topic_id", "ancestor_id", (F.col("depth") + steps).alias("depth"))
        known = saved(known.unionByName(further).groupBy("topic_id", "ancestor_id").agg(F.min("depth").alias("depth")))
        jumps = saved(over.join(jumps.withColumnRenamed("topic_id", "via"), "via").select("topic_id", "ancestor_id").distinct())
        steps, pairs, before = steps * 2, known.count(), pairs
    return known.select("topic_id", "ancestor_id", F.col("depth").cast("int").alias("depth"))


def refused_parents(topics: DataFrame, changes: DataFrame) -> DataFrame:
    """(topic_id, parent_id) of changes that would make a topic its own ancestor, each judged on ``topics`` alone."""
    asked = changes.where("topic_id IS NOT NULL AND parent_id IS NOT NULL").select("topic_id", "parent_id").distinct()
    above = topic_ancestors(topics).select(F.col("topic_id").alias("parent_id"), F.col("ancestor_id").alias("topic_id"))
    return asked.join(above, ["topic_id", "parent_id"], "left_semi").unionByName(asked.where("topic_id = parent_id")).distinct()


def canonical_path(group: Column, year: Column, event: Column) -> Column:
    """The public path of an answer."""
    return F.concat(F.lit("/"), F.concat_ws("/", group, year.cast("string"), event))


def resource_for_route(routes: DataFrame, resources: DataFrame) -> DataFrame:
    """Adds ``resource`` to routes (path): the resource (resource, group, event) with that path in any year, or null."""
    part = lambda k: F.regexp_extract("path", "^/([^/]+)/((?:19|20|21)[0-9]{2})/([^/]+)$", k)
    rows = routes.withColumn("_group", part(1)).withColumn("_event", part(3))
    named = resources.select(F.col("group").alias("_group"), F.col("event").alias("_event"), "resource")
    return rows.join(named, ["_group", "_event"], "left").drop("_group", "_event")
