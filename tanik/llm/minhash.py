"""Near-duplicate documents by min-max hashing of word shingles, confirmed on whole sets.

Each of 60 permutations gives two values, the least and the greatest hash of the set, so 60
evaluations make a signature of 120. Bands of 5 values propose pairs: at a similarity of 0.85 a pair
shares none of the 24 bands with probability 8e-7. Documents with equal sets become one class first.
Proposed pairs are then confirmed on the whole sets in three steps, each of which only looks at pairs
that the steps before have not already put into one component:

1. every class against the smallest member of one of its buckets,
2. all pairs of small buckets,
3. inside large buckets, in blocks: what is compared stays inside a task, and only links that join two
   components come out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tanik.llm.common import released, small_batches
from tanik.operators.components import connected_components
from tanik.session import saved

PERMUTATIONS, ROWS, WORDS = 60, 5, 5
BANDS = 2 * PERMUTATIONS // ROWS
#: Buckets up to this size give all their pairs as rows; larger ones are compared inside tasks.
SMALL = 6
#: Classes of a large bucket in one block.
BLOCK = 512
#: Bits of the filter that saves making sets of documents which no pair needs.
FILTER_BITS = 1 << 24
#: Entries kept of the memory of words, per worker process; it is dropped when full.
MEMORY = 200_000

_draw = np.random.default_rng(2024)
_A = _draw.integers(1 << 62, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _draw.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_words = _Words()  # one for each worker process


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _Q
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct 5-word shingles of a whole text; A-Z in lower case.

    With fewer words the whole sequence is one shingle; without words there is none.
    """
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - WORDS + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(w))):
        h = h * _P + w[k : k + n]
    return np.unique(_mixed(h + np.uint64(min(WORDS, len(w)))))


def signature(found: np.ndarray) -> np.ndarray:
    """Least values of all permutations, then greatest values."""
    low, high = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(found), 2048):
        values = _A[:, None] * found[None, at : at + 2048] + _B[:, None]
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return np.concatenate([low, high])


def bands(values: np.ndarray) -> np.ndarray:
    """One 64-bit bucket number for each band; the band is part of it."""
    h = np.arange(BANDS, dtype=np.uint64) * _P
    for column in values.reshape(BANDS, ROWS).T:
        h = _mixed(h * _P + column)
    return h.view(np.int64)


def _signed(batches):
    for batch in batches:
        count, keys, found = [], [], []
        for text in batch.column("text").cast(pa.binary()):
            s = shingles(text.as_py() or b"")
            count.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()))
            found.append(bands(signature(s)) if len(s) else None)
        key = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(count, pa.int64()), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(found, pa.list_(pa.int64()))], ["id", "n_shingles", "k1", "k2", "bands"])
    _words.clear()  # the worker process goes on with other work


def _wanted(bits: np.ndarray):
    def run(batches):
        for batch in batches:
            at = np.asarray(batch.column("bit"), np.int64)
            batch = batch.filter(pa.array((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1))
            sets = [shingles(t.as_py() or b"").view(np.int64) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "set"])
        _words.clear()

    return run


def _sets(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, set) of at least the documents in ids.

    The filter is a bitmap of fixed size over hashes of the ids; it only saves work, as other
    documents that pass are dropped by the joins.
    """
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[np.asarray(words.column("word"), np.int64)] = np.asarray(words.column("bits"), np.int64).view(np.uint64)
    return texts.where("id IS NOT NULL").select("id", "text", bit.alias("bit")).mapInArrow(released(_wanted(bits)), "id long, set array<long>").dropDuplicates(["id", "set"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets are similar enough."""
    one, two = (sets.select(F.col("id").alias(k), F.col("set").alias(f"set_{k}")) for k in "ab")
    both = pairs.join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(100 * shared >= percent * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b").distinct()


def _joined(rows: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links between different components among the rows of one block pair; two blocks: only across."""
    ids, side = rows.column("rep").to_pylist(), np.asarray(rows.column("block"), np.int64)
    column = rows.column("set").combine_chunks()
    flat, cut = np.asarray(column.flatten(), np.int64), np.r_[0, np.cumsum(np.asarray(column.value_lengths(), np.int64))]
    size, owner = np.diff(cut), np.repeat(np.arange(len(ids)), np.diff(cut))
    order = np.argsort(flat, kind="stable")
    posted = owner[order]
    starts = np.flatnonzero(np.r_[True, flat[order][1:] != flat[order][:-1]]) if len(flat) else np.empty(0, np.int64)
    ends = np.r_[starts[1:], len(flat)]
    number = np.empty(len(flat), np.int64)
    number[order] = np.repeat(np.arange(len(starts)), ends - starts)
    _, root = np.unique(np.asarray(rows.column("component"), np.int64), return_inverse=True)
    blocks = np.unique(side)
    most = np.bincount(root).argmax()
    links = []
    for k in np.flatnonzero(root != most):  # pairs inside the largest component need no look
        other = root != root[k]
        if len(blocks) > 1:
            other &= side != side[k]
        if not other.any():
            continue
        lists = [posted[starts[u] : ends[u]] for u in number[cut[k] : cut[k + 1]] if ends[u] - starts[u] > 1]
        if not lists:
            continue
        shared = np.bincount(np.concatenate(lists), minlength=len(ids))
        for m in np.flatnonzero(other & (100 * shared >= percent * (size[k] + size - shared))):
            if root[m] != root[k]:
                links.append((min(ids[k], ids[m]), max(ids[k], ids[m])))
                root[root == root[m]] = root[k]
    return links


def _blocks(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        a, b = zip(*links) if (links := _joined(rows, percent)) else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _with_component(rows: DataFrame, groups: DataFrame, column: str, out: str) -> DataFrame:
    known = groups.select(F.col("node").alias(column), F.col("component").alias(out))
    return rows.join(known, column, "left").withColumn(out, F.coalesce(out, column))


def link_documents(docs: DataFrame, percent: int = 85, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row; kept: the smallest key of its component.

    Two documents are linked when 100 * shared shingles >= percent * shingles of either. Null, empty
    and blank texts have no shingles and link with nothing. Rows that share a key are one document. A
    row with a null key links with nothing; its component is null and it is kept. Keys are whole
    numbers. An empty table gives an empty one; other columns are left out.
    """
    texts = small_batches(docs).select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    signed = saved(texts.mapInArrow(released(_signed), "id long, n_shingles long, k1 long, k2 long, bands array<long>"))
    classes = saved(signed.where("n_shingles > 0 AND id IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")))

    dealt = classes.select("rep", F.explode("bands").alias("bucket")).distinct()
    sizes = dealt.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("members")).where("members > 1")
    members = saved(dealt.join(sizes, "bucket"))

    first = saved(members.where("rep <> hub").groupBy("rep").agg(F.min("hub").alias("a")).select("a", F.col("rep").alias("b")))
    sets = saved(_sets(texts, members.select(F.col("rep").alias("id"))))
    links = saved(_confirmed(first, sets, percent))
    groups = connected_components(links)

    # all pairs of small buckets, at most SMALL * (SMALL - 1) / 2 of each
    small = members.where(F.col("members") <= SMALL).groupBy("bucket").agg(F.array_sort(F.collect_list("rep")).alias("reps"))
    ends = F.flatten(F.transform("reps", lambda a, i: F.transform(F.slice("reps", i + 2, SMALL), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = small.select(F.explode(ends).alias("pair")).select("pair.*").distinct().join(first, ["a", "b"], "left_anti")
    pairs = _with_component(_with_component(pairs, groups, "a", "ca"), groups, "b", "cb").where("ca <> cb").select("a", "b")
    links = saved(links.union(_confirmed(pairs, sets, percent)))
    groups = connected_components(links)

    # In a large bucket most classes are in one component by now; pairs inside it need no look, so its
    # blocks only meet those of the other classes.
    large = _with_component(members.where(F.col("members") > SMALL), groups, "rep", "component")
    shares = large.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = shares.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("total"), F.count("*").alias("components")).where("components > 1")
    mixed = mixed.select("bucket", F.col("top.component").alias("major"), F.ceil(F.col("top.n") / BLOCK).alias("majors"), F.ceil((F.col("total") - F.col("top.n")) / BLOCK).alias("minors"))
    large = large.join(mixed, "bucket").withColumn("own", F.col("component") == F.col("major"))
    large = large.withColumn("block", F.when(F.col("own"), F.pmod(F.xxhash64("rep"), "majors")).otherwise(F.col("majors") + F.pmod(F.xxhash64("rep"), "minors")))
    met = F.when(F.col("own"), F.sequence(F.col("majors"), F.col("majors") + F.col("minors") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("majors") + F.col("minors") - 1))
    meets = F.transform(met, lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j")))
    tasks = large.select("bucket", "rep", "component", "block", F.explode(meets).alias("meet")).join(sets.withColumnRenamed("id", "rep"), "rep")
    found = tasks.groupBy("bucket", "meet").applyInArrow(_blocks(percent), "a long, b long")
    groups = saved(connected_components(links.union(saved(found.distinct()))))

    named = saved(_with_component(classes.select("k1", "k2", "rep"), groups, "rep", "component").select("k1", "k2", "component"))
    usable = F.col("id").isNotNull() & (F.col("n_shingles") > 0)
    out = signed.select("id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(usable, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
