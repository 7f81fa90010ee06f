"""Not-modified revisits of a web archive resolved to the response they confirm.

An as-of join: for each revisit the latest earlier full response with the same canonical URL. Time is
cut into slices of about equal numbers of records, more of them for a larger table. The last response of each
(URL, slice) is a grouped maximum; carrying it over the few slices of a URL gives what each slice
starts with; inside a slice an ordered window finds the rest. No URL, however frequent, has to be
sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tanik.session import saved

#: Fields of a not-modified answer that replace those of the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not name a resource.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|sessionid"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. or m. and default port, path, sorted query without tracking; no scheme or fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: ~p.rlike(f"^({TRACKING})(=|$)") & (p != "")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def _lower_names(headers: Column) -> Column:
    """Header names in lower case; fields of one name have their different values in one, joined by commas."""
    entries = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("name"), e["key"].alias("key"), e["value"].alias("value"))))
    names = F.array_distinct(F.transform(entries, lambda e: e["name"]))
    values = lambda n: F.array_distinct(F.transform(F.filter(entries, lambda e: e["name"] == n), lambda e: e["value"]))
    value = lambda n: F.when(F.size(values(n)) == 1, F.element_at(values(n), 1)).otherwise(F.array_join(values(n), ", "))
    return F.coalesce(F.map_from_arrays(names, F.transform(names, value)), F.create_map().cast("map<string,string>"))


def _slice(at: Column, cuts: list[float], parts: int) -> Column:
    """The slice of a time: between two cuts, each such stretch in ``parts`` of equal time."""
    edges = F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>")
    place = F.size(F.filter(edges, lambda e: e < at))
    low, high = F.coalesce(F.get(edges, place - 1), at), F.coalesce(F.get(edges, place), at)
    inside = F.when(high > low, F.floor((at - low) / (high - low) * parts)).otherwise(0)
    return (place.cast("long") * parts + F.least(inside, F.lit(parts - 1))).cast("long")


def resolve_revisits(records: DataFrame, slices: int = 256, per_slice: int = 1_000_000) -> DataFrame:
    """One row for each revisit: record_id, canonical_url, status, base_id, merged_headers.

    ``records``: record_id, url, ts, kind ('response' or 'revisit'), status_code, headers
    (map<string,string>); other columns are ignored. A full response is kind 'response' with status
    200. "Earlier" is by (ts, record_id). ``status``: resolved (entity tags agree weakly, or without
    tags on both sides the last-modified dates agree), mismatch, unverifiable (no common validator), or
    no_base. Headers are merged only when resolved: the response's, with the permitted fields of the
    revisit in place of its own; names in lower case. Rows with a null url or ts have no base and are
    no base. Repeated rows each count; an empty table gives an empty one. Records of one URL at the very
    same time stay together in one task.
    """
    rows = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), "ts", "kind", "status_code", _lower_names(F.col("headers")).alias("headers"))
    rows = rows.where("kind = 'revisit' OR (kind = 'response' AND status_code = 200)")
    at = F.col("ts").cast("double")
    cuts, total = rows.agg(F.percentile_approx(at, [n / slices for n in range(slices + 1)], 1000), F.count("*")).first()
    rows = rows.withColumn("slice", _slice(at, sorted(set(cuts or [])), max(1, -(-total // (slices * per_slice)))))
    base = F.when(F.col("kind") == "response", F.struct("record_id", "headers"))
    rows = saved(rows.withColumn("base", base))

    order = F.struct("ts", "record_id")
    usable = rows.where("url_key IS NOT NULL AND ts IS NOT NULL")
    ends = usable.groupBy("url_key", "slice").agg(F.max_by("base", F.when(F.col("base").isNotNull(), order)).alias("end"))
    carried = ends.withColumn("carried", F.last("end", True).over(W.partitionBy("url_key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)))
    inside = F.last("base", True).over(W.partitionBy("url_key", "slice").orderBy("ts", "record_id").rowsBetween(W.unboundedPreceding, -1))
    found = usable.withColumn("inside", inside).where("kind = 'revisit'").join(carried.drop("end"), ["url_key", "slice"])
    found = found.withColumn("base", F.coalesce("inside", "carried")).select("record_id", "url_key", "headers", "base")
    lost = rows.where("kind = 'revisit' AND (url_key IS NULL OR ts IS NULL)").select("record_id", "url_key", "headers", F.lit(None).cast(found.schema["base"].dataType).alias("base"))
    found = found.unionByName(lost)

    stored, fresh = F.col("base.headers"), F.col("headers")
    tags = stored["etag"].isNotNull() & fresh["etag"].isNotNull()
    dates = stored["last-modified"].isNotNull() & fresh["last-modified"].isNotNull()
    agrees = F.when(tags, _weak(stored["etag"]) == _weak(fresh["etag"])).when(dates, stored["last-modified"] == fresh["last-modified"])
    status = F.when(F.col("base").isNull(), "no_base").when(agrees.isNull(), "unverifiable").when(agrees, "resolved").otherwise("mismatch")
    merged = F.map_concat(F.map_filter(stored, lambda k, v: ~k.isin(*PERMITTED) | ~F.coalesce(F.array_contains(F.map_keys(fresh), k), F.lit(False))), F.map_filter(fresh, lambda k, v: k.isin(*PERMITTED)))
    return found.withColumn("status", status).select("record_id", F.col("url_key").alias("canonical_url"), "status", F.col("base.record_id").alias("base_id"), F.when(F.col("status") == "resolved", merged).alias("merged_headers"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A capture log made of crawled pages: each page is stored once and asked for again later.

    The second visit comes after the next pages of the crawl were stored, and carries the validators
    of its own page; every fourth page has no entity tag, every seventh visit has a weak one.
    """
    html = F.coalesce("html", F.lit(""))
    etag = F.concat(F.lit('"'), F.md5(html), F.lit('"'))
    seconds = F.lit(1704067200) + F.col("page_id") * 60
    modified = F.concat(F.lit("day "), (F.length(html) % 97).cast("string"))
    first = F.map_filter(F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.length(html).cast("string"), F.lit("ETag"), F.when(F.col("page_id") % 4 != 0, etag), F.lit("Last-Modified"), modified, F.lit("Date"), seconds.cast("string")), lambda k, v: v.isNotNull())
    later = seconds + 30 + (F.col("page_id") % 5) * 86400
    weak = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("W/"), etag)).when(F.col("page_id") % 4 != 0, etag)
    again = F.map_filter(F.create_map(F.lit("etag"), weak, F.lit("last-modified"), modified, F.lit("date"), later.cast("string"), F.lit("server"), F.lit("edge")), lambda k, v: v.isNotNull())
    one = pages.select((F.col("page_id") * 2).alias("record_id"), "url", F.timestamp_seconds(seconds).alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status_code"), first.alias("headers"))
    two = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", F.timestamp_seconds(later).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status_code"), again.alias("headers"))
    return one.unionByName(two)


def digest(pages: DataFrame) -> DataFrame:
    """The resolved revisits of ``records_of_pages``, headers as sorted text."""
    found = resolve_revisits(records_of_pages(pages))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("merged_headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "; ")
    return found.select("record_id", "canonical_url", "status", "base_id", F.coalesce(text, F.lit("")).alias("headers"))
