"""Hard negatives by Fagin's threshold algorithm over integer inner products.

Candidates are dealt into shards. A shard keeps for each dimension its rows sorted by that component.
For an anchor, lists are read from the top where the anchor's component is positive and from the bottom
where it is negative; every row met is scored at once on its whole vector (random access). The best
score of a row not met yet is at most the threshold: the sum of the anchor's components times the
values last read. Reading stops once the threshold is strictly below the last place of each window of
scores, as an equal score with a smaller id could still enter, or below the window itself.

Positives come first, from shards of the anchor's label; then each positive's score makes a window for
the negatives. A shard is built once and read once; anchors stream past it, and only each shard's best go
on to be merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tanik.llm.vectors import smallest_ids
from tanik.session import saved

#: Rows read from each list before the first look at the threshold; doubled each time.
STEP = 16
#: Scores up to this are exact in double precision.
_EXACT = 2**53


class Lists:
    """The rows of a shard by each dimension."""

    def __init__(self, points: np.ndarray, order: np.ndarray | None = None):
        self.points = points
        #: Row numbers (dimension, place), least component first.
        self.order = np.argsort(points, axis=0, kind="stable").T.astype(np.int32) if order is None else order
        self.largest = int(np.abs(points).max(initial=0))
        self.floats = points.astype(np.float64)

    def read(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(rows not met before, their scores, threshold) until every row was met."""
        n, dims = self.points.shape
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen = np.zeros(n, bool)
        exact = len(anchor) * self.largest * int(np.abs(anchor).max(initial=0)) < _EXACT
        values, vector = (self.floats, anchor.astype(np.float64)) if exact else (self.points, anchor)
        at, step = 0, STEP
        while at < n:
            end = min(n, at + step)
            met = np.zeros(n, bool)
            met[self.order[up, n - end : n - at].ravel()] = True
            met[self.order[down, at:end].ravel()] = True
            if not len(up) and not len(down):
                met[at:end] = True  # all scores are 0: any order will do
            fresh = np.flatnonzero(met & ~seen)
            seen[fresh] = True
            last = self.points[self.order[up, n - end], up].tolist() + self.points[self.order[down, end - 1], down].tolist()
            bound = sum(a * v for a, v in zip(anchor[up].tolist() + anchor[down].tolist(), last))
            yield fresh, (values[fresh] @ vector).astype(np.int64), bound
            at, step = end, 2 * step


def best_in_windows(lists: Lists, anchor: np.ndarray, windows: list[tuple[int | None, int | None]], count: int, fits: np.ndarray, ids: list[list[int]], own: int) -> list[list[tuple[int, int]]]:
    """For each window (least, most) of scores its ``count`` best (score, id) among rows that fit, ties to the smaller id.

    ``ids``: of each row the smallest ids that share it; ``own`` is never found.
    """
    best: list[list[tuple[int, int]]] = [[] for _ in windows]
    open_ = [True] * len(windows)
    for rows, scores, bound in lists.read(anchor):
        good = fits[rows]
        rows, scores = rows[good], scores[good]
        for w, (least, most) in enumerate(windows):
            if not open_[w]:
                continue
            inside = np.ones(len(rows), bool) if least is None else (scores >= least) & (scores <= most)
            near, worth = rows[inside], scores[inside]
            if len(near) > count:  # rows below the count-th score, other than ties, cannot enter
                cut = np.partition(worth, len(worth) - count - 1)[len(worth) - count - 1]  # one more: the anchor's own row may be among them
                near, worth = near[worth >= cut], worth[worth >= cut]
            found = [(s, i) for s, r in zip(worth.tolist(), near.tolist()) for i in ids[r] if i != own]
            best[w] = sorted(best[w] + found, key=lambda f: (-f[0], f[1]))[:count]
            full = len(best[w]) == count and bound < best[w][-1][0]
            open_[w] = not (full or (least is not None and bound < least))
        if not any(open_):
            break
    return best


def _built(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("first", "ascending")])
    points = np.asarray(pa.concat_arrays(rows.column("vector").chunks).flatten(), np.int64).reshape(rows.num_rows, -1)
    lists = Lists(points)
    labels = np.asarray(rows.column("label"), np.int64)
    ids = [list(map(int, x)) for x in rows.column("ids").to_pylist()]
    return pa.table({"shard": [rows.column("shard")[0].as_py()], "points": [points.tobytes()], "width": pa.array([points.shape[1]], pa.int32()), "lists": [lists.order.tobytes()], "labels": [labels.tobytes()], "ids": pa.array([ids], pa.list_(pa.list_(pa.int64())))})


_SHARD = "shard string, points binary, width int, lists binary, labels binary, ids array<array<long>>"
_FOUND = "anchor_id long, least long, most long, score long, id long"


def _searched(count: int, other_labels: bool):
    """Streams over (a shard, then its anchors); rows of one shard follow each other."""

    def run(batches):
        shard, lists, labels, ids = None, None, None, None
        for batch in batches:
            out: list[tuple] = []
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    if row["points"] is not None:
                        shard, width = row["shard"], row["width"]
                        points = np.frombuffer(row["points"], np.int64).reshape(-1, width)
                        lists = Lists(points, np.frombuffer(row["lists"], np.int32).reshape(width, -1))
                        labels, ids = np.frombuffer(row["labels"], np.int64), row["ids"]
                    elif shard == row["shard"]:
                        anchor = np.array(row["vector"], np.int64)
                        fits = (labels != row["label"]) if other_labels else (labels == row["label"])
                        windows = [(w["least"], w["most"]) for w in row["windows"]] if other_labels else [(None, None)]
                        for (least, most), best in zip(windows, best_in_windows(lists, anchor, windows, count, fits, ids, row["anchor_id"])):
                            out += [(row["anchor_id"], least, most, s, i) for s, i in best]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor_id", "least", "most", "score", "id"])

    return run


def _passed(shards: DataFrame, asked: DataFrame, count: int, other_labels: bool) -> DataFrame:
    """What each shard finds for the anchors that ask it."""
    empty = "cast(null as array<struct<least:long,most:long>>)"
    served = shards.select("*", F.lit(None).cast("long").alias("anchor_id"), F.lit(None).cast("long").alias("label"), F.lit(None).cast("array<long>").alias("vector"), F.expr(empty).alias("windows"))
    asking = asked.select("shard", *[F.lit(None).cast(shards.schema[c].dataType).alias(c) for c in shards.columns[1:]], "anchor_id", "label", "vector", "windows")
    stream = served.unionAll(asking).repartition("shard").sortWithinPartitions("shard", F.col("points").isNull())
    return stream.mapInArrow(_searched(count, other_labels), _FOUND)


def _places(found: DataFrame, by: list[str], count: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= count)


def integer_rows(rows: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """(key, label, vector of floor(scale * x)) of the rows that take part; of one key the least label and vector count."""
    v = F.col(f"`{vector}`")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    small = F.forall(v, lambda x: F.abs(x.cast("double")) * scale < F.lit(2.0**28) / F.sqrt(F.size(v)))
    good = rows.where(F.coalesce(fine, F.lit(False))).where(small).where(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull())
    good = good.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{label}`").cast("long").alias("label"), whole.alias("vector"))
    return good.groupBy("key").agg(F.min(F.struct("label", "vector")).alias("v")).select("key", "v.label", "v.vector")


def mine(rows: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, per_shard: int = 8192) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Each row where ``anchors`` (over the column ``key``) holds is an anchor; its positives are its best
    ``positives`` other rows of the label, and for each the best ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score come out. Higher scores first, ties to
    the smaller key.

    Rows with a null key or label, a null or empty vector, or null or non-finite components take no part;
    nor do rows so large (scale * |x| of 2^28 / sqrt(length) or more) that a hundred times a score could leave a long. Of
    repeated keys one row counts, that with the least label, then vector. Vectors of different lengths
    have no product and never meet. Equal vectors of a label become one row with the few smallest keys
    that a result can need, so copies cost nothing. An empty table gives an empty result.
    """
    if not 0 <= low <= high:
        raise ValueError("a window needs 0 <= low <= high")
    all_rows = saved(integer_rows(rows, key, vector, label, scale))
    spare = max(positives, negatives) + 1
    points = saved(smallest_ids(all_rows.select("label", "vector", F.col("key").alias("id")), ["label", "vector"], "id", spare).select("label", "vector", "ids", F.element_at("ids", 1).alias("first"), F.size("vector").alias("length")))
    anchored = all_rows.where(anchors).select(F.col("key").alias("anchor_id"), "label", "vector", F.size("vector").alias("length"))
    no_windows = F.expr("cast(array() as array<struct<least:long,most:long>>)")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cut = F.ceil(F.count("*") / per_shard).cast("long").alias("shards")

    def named(by: list[str]) -> Column:
        return F.concat_ws(":", *by, "part").alias("shard")

    def dealt(by: list[str]) -> tuple[DataFrame, DataFrame]:
        """Shards of the points within each value of ``by``, and how many there are."""
        sizes = points.groupBy(*by).agg(cut)
        placed = points.join(sizes, by).withColumn("part", F.pmod(F.xxhash64("first"), F.col("shards")))
        return placed.select(named(by), "vector", "label", "ids", "first").groupBy("shard").applyInArrow(_built, _SHARD), sizes

    def asking(who: DataFrame, sizes: DataFrame, by: list[str], windows: Column) -> DataFrame:
        return who.join(sizes, by).withColumn("part", each("shards")).select(named(by), "anchor_id", "label", "vector", windows.alias("windows"))

    built, sizes = dealt(["length", "label"])
    same = _passed(built, asking(anchored, sizes, ["length", "label"], no_windows), positives, False)
    same = saved(_places(same, ["anchor_id"], positives).select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    # below 0 the window is empty; at most one window for each positive
    ranged = same.where("positive_score >= 0").select("*", F.expr(f"named_struct('least', (positive_score * {low} + 99) div 100, 'most', (positive_score * {high}) div 100)").alias("window"))
    wanted = ranged.groupBy("anchor_id").agg(F.sort_array(F.collect_set("window")).alias("windows"))
    built, sizes = dealt(["length"])
    other = _passed(built, asking(anchored.join(wanted, "anchor_id"), sizes, ["length"], F.col("windows")), negatives, True)
    other = _places(other, ["anchor_id", "least", "most"], negatives)
    found = ranged.select("anchor_id", "positive_id", "positive_score", "window.least", "window.most").join(other, ["anchor_id", "least", "most"])
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(rows: DataFrame) -> DataFrame:
    """``embeddings`` with the planted labels: every seventh row goes to the next of ten."""
    return rows.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))


def digest(rows: DataFrame) -> DataFrame:
    """Hard negatives of every row whose vec_id is divisible by 100."""
    return mine(relabelled(rows), F.col("key") % 100 == 0)
