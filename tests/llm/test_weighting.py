"""Context-tree weighting against a plain recursive one, sums to one, and odd rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tanik.llm import weighting


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", lowered)


class Plain:
    """The model by its definition: one node for each context, bit path and depth, weighted by recursion."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for text in texts:
            for context, byte in self.read(text):
                for bit in range(8):
                    path = (byte | 256) >> (8 - bit)
                    for d in range(depth + 1):
                        node = (context[depth - d :], path)
                        self.counts[node][byte >> (7 - bit) & 1] += 1
                        if d:
                            self.children[context[depth - d + 1 :], path].add(node)
        self.logs = {}

    def read(self, text):
        raw = b"\xff" * self.depth + " ".join(words_of(text)).encode() + b"\xff"
        return [(raw[n - self.depth : n], raw[n]) for n in range(self.depth, len(raw))]

    def kt(self, node):
        zeros, ones = self.counts[node]
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)

    def weighted(self, node):
        if node not in self.logs:
            own = self.kt(node)
            if len(node[0]) < self.depth:
                own = math.log(0.5) + float(np.logaddexp(own, sum(map(self.weighted, self.children[node]))))
            self.logs[node] = own
        return self.logs[node]

    def one(self, context, path, d=0):
        node = (context[self.depth - d :], path)
        zeros, ones = self.counts[node]
        p = (ones + 0.5) / (zeros + ones + 1)
        deeper = (context[self.depth - d - 1 :], path)
        if d == self.depth or not sum(self.counts.get(deeper, (0,))):
            return p
        stop = math.exp(math.log(0.5) + self.kt(node) - self.weighted(node))
        return stop * p + (1 - stop) * self.one(context, path, d + 1)

    def log10(self, context, byte):
        ones = ((self.one(context, (byte | 256) >> (8 - bit)), byte >> (7 - bit) & 1) for bit in range(8))
        return sum(math.log10(p if b else 1 - p) for p, b in ones)

    def score(self, text):
        return sum(self.log10(c, b) for c, b in self.read(text))


def expected(rows, depth=5):
    learned = [text for key, text in rows if key is None or zlib.crc32(str(key).encode()) % 10]
    counts = Counter(w for text in learned for w in [*words_of(text), None])
    total, model = sum(counts.values()), Plain(learned, depth)
    out = []
    for key, text in rows:
        tokens = [*words_of(text), None]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in tokens)
        out.append((key, key is not None and zlib.crc32(str(key).encode()) % 10 == 0, len(tokens), sum(counts[w] > 0 for w in tokens), total, base, model.score(text)))
    return out


def same(found, want):
    order = lambda r: (r[0] is not None, r[0] or 0, r[6])
    found, want = sorted((tuple(r)[:7] for r in found), key=order), sorted(want, key=order)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    for a, b in zip(found, want):
        assert a[5:] == pytest.approx(b[5:], rel=1e-5)


ROWS = [(k, t) for k, t in enumerate(["The cat sat.", "the cat  sat\ton the mat", "", None, " \n", "zebra \x1c\xa0 é", "THE END the end", "a" * 700, "mat cat sat " * 90, "\x00 ünlü şehir 😀", *["the cat sat on it"] * 12])]


def test_equals_the_plain_model(spark):
    table = spark.createDataFrame(ROWS, "doc_id long, text string")
    same(weighting.digest(table.repartition(3)).collect(), expected(ROWS))


def test_blocks_and_parts_change_nothing(spark):
    rows = [*ROWS, (None, "no key"), (3, "key again"), (3, "key again")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("x")).withColumn("score", F.lit(1)).withColumn("kept", F.lit(2))
    learn = ~F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    for depth in (3, 5):
        found = weighting.score(table, learn, depth=depth, block=150, per_part=100).select("doc_id", ~F.col("learned"), "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
        same(found, expected(rows, depth))
    assert weighting.digest(table.limit(0)).count() == 0
    nothing = weighting.score(table.limit(2), F.lit(False)).collect()  # nothing learned: every bit has 1/2
    assert [r.bits_per_byte for r in nothing] == pytest.approx([8, 8])


def test_continuations_sum_to_one():
    """All 256 bytes after contexts seen and not seen, through the array form."""
    draw = np.random.default_rng(5)
    taught = np.array([int.from_bytes(bytes(draw.integers(97, 100, 6).tolist())) for _ in range(400)], np.uint64)
    seen, counts = np.unique(taught, return_counts=True)
    for context in (int(seen[0]) >> 8, int(seen[7]) >> 8, 0x7A6162636163):
        context &= (1 << 40) - 1
        every = np.array([context << 8 | b for b in range(256)], np.uint64)
        grams = np.union1d(seen, every)
        amounts = np.zeros(len(grams), np.int64)
        amounts[np.searchsorted(grams, seen)] = counts
        tree = weighting.Deep(grams, amounts, 5)
        nodes = tree.upper()[0]
        # upper levels that leave half to what is below
        logs = tree.log10(nodes, np.full(len(nodes), 0.2), np.full(len(nodes), 0.5), np.full(len(nodes), 0.3))
        assert (10.0 ** logs[np.searchsorted(grams, every)]).sum() == pytest.approx(1)


def test_log_gamma():
    for x in (0.5, 1.0, 2.5, 17.0, 12345.5, 3e9):
        assert weighting.log_gamma(np.array([x]), np.log)[0] == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)


def test_held_out_texts_score_above_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in weighting.digest(docs).collect() if r.held_out]
    assert len(held) > 50 and sum(r.score for r in held) > sum(r.base_score for r in held)
