"""Text quality: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

A word gives two hashes: of its letters in lower case, and of its shape (case pattern and the
punctuation around it). Features are single words and pairs of neighbours of both, and whether a
word repeats its predecessor, hashed into one vector space. A document is the counts of its features
divided by their root sum of squares, so texts of any length compare.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tanik.llm.common import fold, small_batches

BITS = 18
#: Entries kept of the memory of words, per worker process; it is dropped when full.
MEMORY = 600_000


class _Words(dict):
    """word -> index into the arrays of letter and shape hashes."""

    def __init__(self):
        super().__init__()
        self.letters, self.shapes = [], []

    def __missing__(self, word: str) -> int:
        core = re.sub(r"^\W+|\W+$", "", word)
        case = "U" if core.isupper() and len(core) > 1 else "T" if core[:1].isupper() else "l" if core.islower() else "d" if core[:1].isdigit() else "m" if core else "-"
        shape = f"{case}|{word[: word.find(core[0])] if core else word}|{word[word.rfind(core[-1]) + 1 :] if core else ''}"
        self.letters.append(zlib.crc32(core.lower().encode("utf-8", "replace")))
        self.shapes.append(zlib.crc32(shape.encode("utf-8", "replace"), 7))
        self[word] = len(self.letters) - 1
        return self[word]


_words = _Words()  # one for each worker process
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hash(values: np.ndarray, salt: int) -> np.ndarray:
    mixed = (values + np.uint64(salt)) * _MIX
    return ((mixed ^ (mixed >> np.uint64(29))) * _MIX >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    """The feature numbers of a whole text, with repeats; empty for a text without words."""
    global _words
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64)
    if len(_words) > MEMORY:
        _words = _Words()
    known = np.fromiter(map(_words.__getitem__, words), np.int64, len(words))
    uniques, at = np.unique(known, return_inverse=True)
    letters = np.array([_words.letters[k] for k in uniques], np.uint64)[at]
    shapes = np.array([_words.shapes[k] for k in uniques], np.uint64)[at]
    pair = lambda h: (h[:-1] << np.uint64(31)) ^ h[1:]
    again = (letters[1:] == letters[:-1]).astype(np.uint64)
    return np.concatenate([_hash(letters, 1), _hash(shapes, 2), _hash(pair(letters), 3), _hash(pair(shapes), 4), _hash(again, 5)])


def sparse(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, values): counts over the root sum of their squares."""
    index, count = np.unique(found, return_counts=True)
    return index, count / max(1e-12, np.sqrt((count.astype(float) ** 2).sum()))


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, passes: int = 3) -> np.ndarray:
    """Weights by the per-coordinate FTRL-proximal update; the last entry is the intercept."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    share = min(max(np.mean([y for *_, y in examples] or [0.5]), 0.02), 0.98)
    weigh = {1: 0.5 / share, 0: 0.5 / (1 - share)}  # both labels count alike
    order = np.random.default_rng(11)
    for _ in range(passes):
        for k in order.permutation(len(examples)):
            index, value, label = examples[k]
            index, value = np.append(index, size - 1), np.append(value, 1.0)
            zi, ni = z[index], n[index]
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value * weigh[label]
            z[index] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[index] = ni + g * g
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2)).astype(np.float32)


def _vectors(batches):
    for batch in batches:
        rows = [sparse(features(t.as_py())) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array([i.astype(np.int32) for i, _ in rows], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in rows], pa.list_(pa.float32())), batch.column("label")], ["index", "value", "label"])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", label: str = "quality", most: int = 6000) -> np.ndarray:
    """Weights learned from labelled documents where ``learn`` (over key) holds.

    Bounded sample: at most ``most`` labelled rows, those with the smallest hash of the key, whatever
    the size of the tables. Rows with a null key or a label other than 0 or 1 are not used; a key
    labelled twice counts with its larger label, once; of several rows of a key the smallest text counts. Without usable rows all weights are 0.
    """
    chosen = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(f"`{key}`").alias("key")).agg(F.max(label).cast("int").alias("label"))
    chosen = chosen.where("key IS NOT NULL").where(learn).orderBy(F.xxhash64("key"), "key").limit(most)
    texts = small_batches(docs).select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    once = texts.join(F.broadcast(chosen), "key").groupBy("key", "label").agg(F.min("text").alias("text"))
    rows = once.select("text", "label").mapInArrow(_vectors, "index array<int>, value array<float>, label int")
    table = rows.toArrow()  # at most `most` keys
    lists = zip(table.column("index"), table.column("value"), table.column("label").to_pylist())
    examples = [(np.asarray(i.values, np.int64), np.asarray(v.values, float), y) for i, v, y in lists]
    examples.sort(key=lambda e: (len(e[0]), e[0].tobytes(), e[2]))
    return train(examples)


def _scored(weights: np.ndarray, out: str):
    body, intercept = weights[:-1], float(weights[-1])

    def run(batches):
        for batch in batches:
            scores = []
            for text in batch.column("text"):
                index, value = sparse(features(text.as_py()))
                scores.append(1 / (1 + np.exp(-np.clip(float(body[index] @ value) + intercept, -35, 35))))
            yield pa.RecordBatch.from_arrays([*(c for n, c in zip(batch.schema.names, batch.columns) if n != "text"), pa.array(scores, pa.float64())], [*(n for n in batch.schema.names if n != "text"), out])

    return run


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", key: str = "doc_id", out: str = "score") -> DataFrame:
    """key and the probability of good quality, 0 to 1, of every row.

    A null, empty or blank text gets the score of the intercept alone. Repeated rows and null keys
    stay; an empty table gives an empty one; other columns are left out.
    """
    kind = docs.schema[key].dataType.simpleString()
    return small_batches(docs).select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("text")).mapInArrow(_scored(weights, out), f"`{key}` {kind}, `{out}` double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; one third of the keys is held out."""
    weights = fit(docs, labels, fold(F.col("key"), 3) != 1)
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return score(docs, weights).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
