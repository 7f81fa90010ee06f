"""Anchored request limits in batch: windows found by doubled links, so no key is one group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tanik.session import saved

#: Slices of a window's length. Requests of a key that lie in one window are spread over so many groups.
SLICES = 64
_END = (1 << 63) - 1


def _links(times: DataFrame, slices: DataFrame, micros: int) -> DataFrame:
    """(key, t, next): the first time of the key at ``t + micros`` or later.

    It lies ``SLICES`` slices on, at the same place or later, or is the first time of a later slice. Both
    are offered in one descending scan of each slice, where the least offer so far is the answer.
    """
    asked = slices.select("key", (F.col("s") + SLICES).alias("s"), F.lit(None).cast("long").alias("lo"), F.lit(True).alias("asks"))
    later = W.partitionBy("key").orderBy(F.desc("s"), F.desc("asks")).rowsBetween(W.unboundedPreceding, W.currentRow)
    beyond = asked.unionByName(slices.select("key", "s", "lo", F.lit(False).alias("asks"))).withColumn("lo", F.min("lo").over(later)).where("asks AND lo IS NOT NULL")
    none = F.lit(None).cast("long")
    offers = times.select("key", "s", F.col("t").alias("place"), F.col("t").alias("offer"), none.alias("origin"))
    offers = offers.unionByName(beyond.select("key", "s", F.lit(_END).alias("place"), F.col("lo").alias("offer"), none.alias("origin")))
    asks = times.select("key", (F.col("s") + SLICES).alias("s"), (F.col("t") + micros).alias("place"), none.alias("offer"), F.col("t").alias("origin"))
    down = W.partitionBy("key", "s").orderBy(F.desc("place"), F.asc_nulls_first("origin")).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = offers.unionByName(asks).withColumn("next", F.min("offer").over(down))
    return found.where("origin IS NOT NULL AND next IS NOT NULL").select("key", F.col("origin").alias("t"), "next")


def _reached(begins: DataFrame, links: DataFrame) -> DataFrame:
    """(key, t) of all times that a chain of links leads to from ``begins``.

    After k rounds all times within 2**k links are known and each link spans 2**k, so the rounds are the
    logarithm of the longest chain; a round that adds nothing is the last.
    """
    reached, jumps, known = saved(begins), saved(links), -1
    while (n := reached.count()) != known:
        known = n
        reached = saved(reached.unionByName(reached.join(jumps, ["key", "t"]).select("key", F.col("next").alias("t"))).distinct())
        jumps = saved(jumps.join(jumps.select("key", F.col("t").alias("next"), F.col("next").alias("far")), ["key", "next"]).select("key", "t", F.col("far").alias("next")))
    return reached


def window_begins(times: DataFrame, seconds: int) -> tuple[DataFrame, DataFrame]:
    """Begins (key, t) of the windows of times (key, t, s), and the slices (key, s, lo, hi) of the times.

    A window opens at the first time after the last one ended. A time with none in the window's length
    before it opens one for sure; the others are those that links from such a time lead to.
    """
    micros = seconds * 1_000_000
    slices = saved(times.groupBy("key", "s").agg(F.min("t").alias("lo"), F.max("t").alias("hi")))
    before = F.lag("hi").over(W.partitionBy("key").orderBy("s"))
    sure = slices.withColumn("before", before).where(F.col("before").isNull() | (F.col("lo") - F.col("before") >= micros)).select("key", F.col("lo").alias("t"))
    return _reached(sure, _links(times, slices, micros)), slices


def limit_windows(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """(key, request_id, allowed) of requests (key, request_id, at): anchored windows of each key, in batch.

    A window opens at a key's first request after the last window ended; the first ``limit`` requests in it
    are allowed, by time and id. Repeated rows are requests of their own. Without a key or a time a request
    is in no window, and ``allowed`` is null. The only groups that hold a whole key are its slices of time,
    one row each, as many as the time spans.
    """
    micros = seconds * 1_000_000
    width = F.lit(micros // SLICES)
    slice_of = lambda t: ((t - F.pmod(t, width)) / width).cast("long")
    rows = requests.select("key", "request_id", F.unix_micros(F.col("at").cast("timestamp")).alias("t"))
    usable: Column = F.col("key").isNotNull() & F.col("t").isNotNull()
    counted = rows.where(usable).groupBy("key", "t", "request_id").agg(F.count("*").alias("copies")).withColumn("s", slice_of(F.col("t")))
    counted = saved(counted)
    begins, slices = window_begins(counted.select("key", "t", "s").distinct(), seconds)
    # A slice is shorter than a window, so at most one window begins in it; the one before it may still last.
    own = begins.select("key", slice_of(F.col("t")).alias("s"), F.col("t").alias("own"))
    earlier = F.last("own", ignorenulls=True).over(W.partitionBy("key").orderBy("s").rowsBetween(W.unboundedPreceding, -1))
    windows = slices.join(own, ["key", "s"], "left").withColumn("earlier", earlier).select("key", "s", "own", "earlier")
    placed = counted.join(windows, ["key", "s"]).withColumn("begin", F.when(F.col("own") <= F.col("t"), F.col("own")).otherwise(F.col("earlier")))
    # Only the first rows of a window can be allowed; Spark cuts each task's rows to them before it deals them out.
    order = W.partitionBy("key", "begin").orderBy("t", "request_id")
    first = placed.select("key", "begin", "t", "request_id", "copies").withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    left = first.withColumn("left", limit - F.sum("copies").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("copies")).select(F.col("key").alias("_key"), F.col("t").alias("_t"), F.col("request_id").alias("_id"), "left")
    same = (F.col("key") == F.col("_key")) & (F.col("t") == F.col("_t")) & F.col("request_id").eqNullSafe(F.col("_id"))
    told = counted.join(left, same, "left")
    each = told.select("key", "request_id", "left", F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    allowed = F.coalesce(F.col("copy") <= F.col("left"), F.lit(False))
    outside = rows.where(~usable).select("key", "request_id", F.lit(None).cast("boolean").alias("allowed"))
    return each.select("key", "request_id", allowed.alias("allowed")).unionByName(outside)
