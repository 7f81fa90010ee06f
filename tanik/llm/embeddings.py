"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside cells.

Equal vectors of a label become one point with a count. Centres are fitted on a bounded sample; then
every point is assigned to its nearest centre, its home. Two points within the linking angle can have
different homes only if each lies near the border between the two cells: for unit vectors at most
d apart, a point can have a partner at home in cell c only if (x.h - x.c) <= d * |h - c|, h being its
own centre. Each point visits all cells for which that holds, so no link is lost. A point's links
are counted in its home cell alone, hence once. Labels of about equal size share their centres, as many
as let the fewest rows travel. The home and the visiting side of a cell are both cut into blocks: one
group is one home block against one visiting block, and the links of a point are added up afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tanik.llm.vectors import as_double, matrix, usable
from tanik.operators.components import connected_components
from tanik.session import saved


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that very large or small components neither overflow nor vanish."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def spherical_kmeans(rows: np.ndarray, cells: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centres of unit rows; an empty cell takes the row that fits its own centre least."""
    centres = rows[np.random.default_rng(seed).choice(len(rows), min(cells, len(rows)), replace=False)]
    for _ in range(rounds):
        near = rows @ centres.T
        home, fit = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, rows)
        size = np.linalg.norm(sums, axis=1)
        for c in np.flatnonzero(size < 1e-9):
            worst = int(fit.argmin())
            sums[c], fit[worst], size[c] = rows[worst], 2.0, 1.0
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def _visits(x: np.ndarray, centres: np.ndarray, gap: np.ndarray, apart: float) -> tuple[np.ndarray, np.ndarray]:
    """(home of each row, which cells each row visits)."""
    near = x @ centres.T
    home = near.argmax(axis=1)
    lead = near[np.arange(len(x)), home][:, None] - near
    visits = lead <= apart * gap[home] + 1e-9
    visits[np.arange(len(x)), home] = True
    return home, visits


def _gaps(centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))


def fitted_centres(rows: np.ndarray, n: int, apart: float, block: int, most: int | None = None) -> np.ndarray | None:
    """The centres for a label of ``n`` points like ``rows`` that send the fewest rows to blocks; None is one cell.

    Each home row goes to all visiting blocks of its cell, each visiting row to all home blocks. More
    cells make fewer blocks but more visits, which the sample tells.
    """
    best, least, cells = None, 2 * n * max(1.0, n / block), 2
    while cells <= min(most or len(rows), len(rows) // 4, 2 * n // block):  # a centre needs some rows of the sample
        centres = spherical_kmeans(rows, cells)
        gap = _gaps(centres)
        visits = sum(int(_visits(rows[at : at + 1024], centres, gap, apart)[1].sum()) for at in range(0, len(rows), 1024)) / len(rows)
        sent = n * max(1.0, n * visits / cells / block) + n * visits * max(1.0, n / cells / block)
        if sent < least:
            best, least = centres, sent
        cells *= 2
    return best


def _assigned(centres: dict[int, np.ndarray], apart: float, step: int = 1024):
    gaps = {level: _gaps(c) for level, c in centres.items()}

    def run(batches):
        for batch in batches:
            levels = np.asarray(batch.column("level"))
            for level in np.unique(levels).tolist():
                rows = np.flatnonzero(levels == level)
                for at in range(0, len(rows), step):
                    part = batch.take(pa.array(rows[at : at + step]))
                    who, cell, home = np.arange(part.num_rows), np.zeros(part.num_rows, int), np.zeros(part.num_rows, int)
                    if level in centres:
                        home, visits = _visits(unit(matrix(part.column("vector"))), centres[level], gaps[level], apart)
                        who, cell = np.nonzero(visits)
                    taken = part.take(pa.array(who))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell, pa.int32()), pa.array(cell == home[who])], [*batch.schema.names, "cell", "at_home"])

    return run


def joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent`` (each node's smallest known member, itself a root) after links between the nodes a and b."""
    while True:
        pa_, pb = parent[a], parent[b]
        apart = pa_ != pb
        if not apart.any():
            return parent
        a, b, pa_, pb = a[apart], b[apart], pa_[apart], pb[apart]
        np.minimum.at(parent, np.maximum(pa_, pb), np.minimum(pa_, pb))
        while (parent != parent[parent]).any():
            parent = parent[parent]


def _linked(least: float, step: int = 512):
    """Per (label, cell, home block, visiting block): links of home points to visiting points, and edges that join what they join."""

    def run(key, homes: pa.Table, others: pa.Table) -> pa.Table:
        points, counts, a, b = [], [], [], []
        if homes.num_rows and others.num_rows:
            left, right = np.asarray(homes.column("point")), np.asarray(others.column("point"))
            mine, theirs = unit(matrix(homes.column("vector"))), unit(matrix(others.column("vector")))
            copies = np.asarray(others.column("copies"), np.int64)
            nodes, place = np.unique(np.concatenate([np.asarray(homes.column("first")), np.asarray(others.column("first"))]), return_inverse=True)
            own, other, parent = place[: len(left)], place[len(left) :], np.arange(len(nodes))
            links = np.zeros(len(left), np.int64)
            for at in range(0, len(mine), step):
                close = mine[at : at + step] @ theirs.T >= least
                close &= left[at : at + step][:, None] != right[None, :]
                links[at : at + step] = close @ copies
                x, y = np.nonzero(close)
                parent = joined(parent, own[at + x], other[y])
            some, led = np.flatnonzero(links), np.flatnonzero(parent != np.arange(len(nodes)))
            points, counts, a, b = left[some], links[some], nodes[led], nodes[parent[led]]
        n, m = len(points), len(a)
        return pa.table({"point": pa.array([*points, *[None] * m], pa.int64()), "links": pa.array([*counts, *[None] * m], pa.int64()), "a": pa.array([*[None] * n, *a], pa.int64()), "b": pa.array([*[None] * n, *b], pa.int64())})

    return run


def _known(points: DataFrame, least: float, sample: int, per_cell: int, block: int) -> DataFrame:
    """(label, vector, n_links, component_id) of points (label, vector, first, copies, point) of one length."""
    # Labels beyond per_cell points number at most points / per_cell; the level is the octave of their size.
    large = points.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > per_cell).withColumn("level", F.ceil(F.log2(F.col("n") / per_cell)).cast("int"))
    large = saved(large)
    leveled = points.join(large.select("label", "level"), "label", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    apart = float(np.sqrt(max(0.0, 2 - 2 * least)))
    levels = large.groupBy("level").agg(F.max("n").alias("n")).collect()  # octaves of sizes: some dozens at most
    centres = {}
    for level, n in levels:
        drawn = leveled.where(F.col("level") == level).select("vector", "point", "first").orderBy(F.xxhash64("first"), "first", "point").limit(max(1, sample // len(levels))).select("vector").toArrow()
        fitted = fitted_centres(unit(matrix(drawn.column("vector"))), n, apart, block)
        if fitted is not None:
            centres[level] = fitted
    kind = points.schema["label"].dataType.simpleString()
    placed = saved(leveled.select("label", "vector", "first", "copies", "point", "level").mapInArrow(_assigned(centres, apart), f"label {kind}, vector array<double>, first long, copies long, point long, level int, cell int, at_home boolean"))
    cut = lambda n: F.greatest(F.lit(1), F.ceil(n / block)).cast("int")
    sizes = placed.groupBy("label", "cell").agg(cut(F.count_if("at_home")).alias("homes"), cut(F.count("*")).alias("visitors")).where("visitors > 1")
    dealt = placed.join(sizes, ["label", "cell"], "left").withColumn("homes", F.coalesce("homes", F.lit(1))).withColumn("visitors", F.coalesce("visitors", F.lit(1)))
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("point"), F.col(n)).cast("int")
    by = ["label", "cell", "block", "other"]
    homes = dealt.where("at_home").select("label", "cell", mine("homes").alias("block"), blocks("visitors").alias("other"), "vector", "first", "point")
    others = dealt.select("label", "cell", blocks("homes").alias("block"), mine("visitors").alias("other"), "vector", "first", "copies", "point")
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  own columns for each side
    found = saved(fresh(homes).groupBy(*by).cogroup(fresh(others).groupBy(*by)).applyInArrow(_linked(least), "point long, links long, a long, b long"))
    groups = connected_components(found.where("a IS NOT NULL").select("a", "b")).withColumnRenamed("node", "first")
    links = found.where("point IS NOT NULL").groupBy("point").agg(F.sum("links").alias("links"))
    known = points.join(links, "point", "left").join(groups, "first", "left")
    return known.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id"))


def near_duplicates(rows: DataFrame, least: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label", sample: int = 8192, per_cell: int = 2048, block: int = 2048) -> DataFrame:
    """(key, n_links, component_id, kept): every row of the input, one representative kept per group.

    Rows are compared only when labels are equal and not null. Null, empty or zero vectors, and those
    with null or non-finite components, link with nothing; so do rows with a null key, whose component
    is null. Repeated keys are one row each and count as one point per different vector. Vectors of
    different lengths have no cosine and never link; each length is compared on its own. ``sample``
    bounds the rows on which centres are fitted; every row is assigned and compared. ``block`` bounds
    both sides of a group.
    """
    all_rows = rows.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"), F.when(usable(F.col(f"`{vector}`")), as_double(F.col(f"`{vector}`"))).alias("vector"))
    all_rows = saved(all_rows)
    good = all_rows.where("vector IS NOT NULL AND label IS NOT NULL AND id IS NOT NULL")
    points = good.groupBy("label", "vector").agg(F.min("id").cast("long").alias("first"), F.count("*").alias("copies"))
    points = saved(points.withColumn("point", F.monotonically_increasing_id()))
    lengths = [r.n for r in points.select(F.size("vector").alias("n")).distinct().orderBy("n").collect()]
    known = None
    for n in lengths or [0]:
        part = _known(points if len(lengths) < 2 else points.where(F.size("vector") == n), least, sample, per_cell, block)
        known = part if known is None else known.unionAll(part)
    out = all_rows.join(known, ["label", "vector"], "left")
    out = out.withColumn("linkable", F.col("id").isNotNull())
    links = F.when(F.col("linkable"), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long")
    component = F.when(F.col("linkable"), F.coalesce("component_id", F.col("id").cast("long")))
    return out.select(F.col("id").alias(key), links.alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
