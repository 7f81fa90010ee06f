"""Hard negatives against all products, and odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tanik.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows, every=100):
    """Brute force over rows (vec_id, embedding, label) with different ids."""
    good = {}
    for key, vector, label in rows:
        if key is None or label is None or not vector or any(x is None or not math.isfinite(x) for x in vector):
            continue
        good[key] = ((label + 1) % 10 if key % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in vector])
    out = set()
    for a in (k for k in good if k % every == 0):
        label, vector = good[a]
        scores = sorted((-sum(x * y for x, y in zip(vector, v)), k, lab == label) for k, (lab, v) in good.items() if k != a and len(v) == len(vector))
        for p, positive, _ in [s for s in scores if s[2]][:5]:
            inside = [(s, k) for s, k, same in scores if not same and -80 * p <= -100 * s <= -100 * p][:5]
            out |= {(a, positive, n, k, -p, -s) for n, (s, k) in enumerate(inside, 1)}
    return out


def found(df):
    rows = [tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def vectors(n, dims, seed, spread=0.3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, dims))
    return [(k, (centres[k % 6] * 0.1 + draw.normal(size=dims) * spread * 0.1).astype(np.float32).tolist(), int(draw.integers(0, 4))) for k in range(n)]


def test_equals_all_products(spark):
    rows = vectors(900, 12, 1)
    table = spark.createDataFrame(rows, SCHEMA)
    want = expected(rows)
    assert len(want) > 100 and found(negatives.digest(table)) == want
    assert found(negatives.mine(negatives.relabelled(table), F.col("key") % 100 == 0, per_shard=64)) == want


def test_copies_ties_and_odd_rows(spark):
    rows = vectors(300, 4, 2)
    rows += [(1000 + k, [0.25, -0.5, 0.0, 1.0], k % 3) for k in range(400)]  # one vector in most rows
    rows += [(2000, None, 1), (2001, [None, 1.0, 1.0, 1.0], 1), (2002, [float("nan")] * 4, 1), (2003, [float("inf")] * 4, 2), (2100, [0.0] * 4, 1), (2200, [0.5, 0.5, 0.5, 0.5], None), (None, [1.0] * 4, 1), (2300, [], 1), (2400, [1.0, 2.0], 1), (2401, [1.0, 2.0], 2), (2402, [1.0, 2.5], 1)]
    table = spark.createDataFrame(rows, SCHEMA)
    want = expected(rows)
    clashing = table.withColumn("shard", F.lit("x")).withColumn("score", F.lit(1)).withColumn("id", F.lit(2))
    assert found(negatives.digest(clashing)) == want and {a for a, *_ in want} >= {1000, 2100, 2400}
    assert found(negatives.mine(negatives.relabelled(table.union(table)), F.col("key") % 100 == 0, per_shard=50)) == want  # repeated rows
    assert negatives.digest(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        negatives.mine(table, F.col("key") > 0, low=120)


def test_reading_stops_early():
    """Spiky vectors: the threshold falls below the fifth place long before all rows are met."""
    draw = np.random.default_rng(3)
    points = (draw.pareto(1.5, size=(20000, 3)) * 100).astype(np.int64)
    lists, anchor = negatives.Lists(points), np.array([5, 1, 2])
    met = 0
    for rows, _, bound in lists.read(anchor):
        met += len(rows)
        if bound < np.sort(points @ anchor)[-5]:
            break
    best = negatives.best_in_windows(lists, anchor, [(None, None)], 5, np.ones(20000, bool), [[k] for k in range(20000)], -1)[0]
    order = sorted(range(20000), key=lambda k: (-int(points[k] @ anchor), k))[:5]
    assert met < 5000 and [k for _, k in best] == order


def test_large_components_stay_exact():
    lists = negatives.Lists(np.array([[2**27 - 1, 1], [2**27 - 1, 2], [1, 1]]))
    best = negatives.best_in_windows(lists, np.array([2**27 + 1, 1]), [(None, None)], 2, np.ones(3, bool), [[7], [8], [9]], -1)[0]
    assert best == [((2**27 - 1) * (2**27 + 1) + 2, 8), ((2**27 - 1) * (2**27 + 1) + 1, 7)]
