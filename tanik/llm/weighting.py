"""Language-model scores by context-tree weighting over bytes.

The model reads a text's words, lower-cased, with one space between them and an end mark. A byte is
eight binary decisions down a tree of its bits; each of these has a context tree of its own over the bytes
before. A node holds the zeros and ones that the training texts show there; its Krichevsky-Trofimov
estimate and those of its subtree are weighted half and half, at every depth. So the posterior weights
mix the estimates of all depths into one probability, by which each byte has a code length. Where
training never saw a context, the next shallower one decides; the probabilities of all continuations
sum to one.

At scale nothing is held whole. Texts are packed into blocks of a few megabytes. A block asks for each
of its different grams (context and byte) and words once, packed by hash into parts; a part adds up
the counts of all blocks and answers each. Different grams only go on to the tree, split by their
nearest three bytes, deeper levels in arrays, the three upper levels as grouped sums over all parts.
What travels grows with the text, and no part of it lies in one place.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from tanik.llm.common import fold, released, small_batches
from tanik.session import saved

#: The byte after the last word; no UTF-8 text holds it. It also stands before the first.
END = b"\xff"
#: Levels of the tree that all parts share; deeper ones lie whole in one part.
TOP = 3
HALF = math.log(0.5)
#: A gram of this depth and the number of its piece fit one number of 64 bits.
MOST_DEPTH = 5


def log_gamma(x, log: Callable):
    """ln Gamma(x) for x > 0, of arrays or columns: Stirling's series eight steps up."""
    rising = 1.0
    for k in range(8):
        rising = rising * (x + k)
    y = x + 8.0
    inverse = 1.0 / (y * y)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse * (1 / 1680 - inverse / 1188)))) / y
    return (y - 0.5) * log(y) - y + 0.5 * math.log(2 * math.pi) + series - log(rising)


def log_kt(zeros, ones, log: Callable):
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5, log) + log_gamma(ones + 0.5, log) - log_gamma(zeros + ones + 1.0, log) - math.log(math.pi)


def _nodes(keys: np.ndarray, counts: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node of each entry, first entry of each node, zeros, ones); entries are sorted context * 256 + byte."""
    fresh = np.ones(len(keys), bool)
    np.not_equal(keys[1:] >> np.uint64(8 - bit), keys[:-1] >> np.uint64(8 - bit), out=fresh[1:])
    first = np.flatnonzero(fresh)
    one = ((keys >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)
    total = np.add.reduceat(counts, first)
    ones = np.add.reduceat(counts * one, first)
    return np.cumsum(fresh) - 1, first, total - ones, ones


class Deep:
    """The levels TOP to ``depth`` over sorted different grams with their counts.

    A gram is a number: the nearest byte before first, then those farther back, last the byte itself.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int):
        self.grams, self.depth = grams, depth
        keys, amounts, self.levels = grams, counts.astype(np.int64), []
        for _ in range(depth - TOP):
            shorter, place = np.unique(keys >> np.uint64(16) << np.uint64(8) | keys & np.uint64(255), return_inverse=True)
            self.levels.append((keys, amounts, place))
            keys, amounts = shorter, np.bincount(place, amounts, len(shorter)).astype(np.int64)
        self.levels.append((keys, amounts, None))

    def bit(self, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the ``bit``-th decision: (probability of a one below TOP, whether seen there) for each gram, and of
        the nodes at TOP their number (context * 256 + path of bits), zeros, ones, ln of the weighted probability."""
        p = seen = step = to_node = below = None  # of each node at the deepest level; ``step``: its ancestor at the level reached
        for level, (keys, amounts, _) in enumerate(self.levels):
            node, first, zeros, ones = _nodes(keys, amounts, bit)
            kt = log_kt(zeros.astype(float), ones.astype(float), np.log)
            p1 = (ones + 0.5) / (zeros + ones + 1.0)
            known = zeros + ones > 0
            if level == 0:
                weighted, p, seen, to_node = kt, p1, known, node
                step = np.arange(len(first))
            else:
                place = self.levels[level - 1][2]
                up = node[place[below[0]]]  # the parent of each node one level deeper
                children = np.bincount(up, below[1], len(first))
                weighted = np.logaddexp(HALF + kt, HALF + children)
                stop = np.exp(HALF + kt - weighted)
                step = up[step]
                p = np.where(seen, stop[step] * p1[step] + (1 - stop[step]) * p, p1[step])
                seen = known[step]
            below = (first, weighted)
        numbers = (keys[first] >> np.uint64(8) << np.uint64(8)) | ((keys[first] & np.uint64(255) | np.uint64(256)) >> np.uint64(8 - bit))
        return p[to_node], seen[to_node], numbers, zeros, ones, below[1]

    def upper(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of the node one level above TOP, zeros, ones, sum of ln weighted of the nodes at TOP below it)."""
        numbers, zeros, ones, logs = zip(*(self.bit(b)[2:] for b in range(8)))
        numbers = np.concatenate(numbers)
        parents, place = np.unique(numbers >> np.uint64(16) << np.uint64(8) | numbers & np.uint64(255), return_inverse=True)
        add = lambda parts: np.bincount(place, np.concatenate(parts), len(parents))
        return parents, add(zeros).astype(np.int64), add(ones).astype(np.int64), add(logs)

    def log10(self, numbers: np.ndarray, base: np.ndarray, slope: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """log10 of each gram's probability, given for the sorted nodes above TOP what the upper levels make of
        a probability p below: base + slope * p, or ``stop`` where training has nothing below."""
        shift, total = np.uint64(8 * (self.depth + 1 - (TOP - 1))), np.zeros(len(self.grams))
        for bit in range(8):
            p, seen = self.bit(bit)[:2]
            node = (self.grams >> shift << np.uint64(8)) | ((self.grams & np.uint64(255) | np.uint64(256)) >> np.uint64(8 - bit))
            at = np.searchsorted(numbers, node)
            one = np.where(seen, base[at] + slope[at] * p, stop[at])
            total += np.log10(np.where(self.grams >> np.uint64(7 - bit) & np.uint64(1), one, 1 - one))
        return total


def _pack(values: np.ndarray | bytes) -> bytes:
    return zstandard.compress(values if isinstance(values, bytes) else values.tobytes(), 1)


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), kind)


def _hash(values: np.ndarray, parts: int) -> np.ndarray:
    return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)


class Block:
    """Pieces of texts: their words, and their grams with the piece of each.

    A gram and its piece are one number, so that one plain sort brings equal grams together and what is
    summed over them is read in order.
    """

    def __init__(self, raw: bytes, lengths: list[int], learned: list[bool], depth: int):
        words, at, sizes = [], 0, []
        for n in lengths:  # a piece: ``depth`` bytes of context, words, then a space or the end
            own = raw[at + depth : at + n - 1].split()
            at += n
            if raw[at - 1] == END[0]:
                own.append(b"")
            words += own
            sizes.append(len(own))
        self.learned = np.array(learned, bool)
        self.words = list(dict.fromkeys(words))
        number = dict(zip(self.words, range(len(self.words))))
        self.word = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        self.word_piece = np.repeat(np.arange(len(lengths)), sizes)

        wide = np.frombuffer(raw, np.uint8).astype(np.uint64)
        keys = wide[depth:].copy()
        for back in range(1, depth + 1):
            keys |= wide[depth - back : len(wide) - back] << np.uint64(8 * (depth + 1 - back))
        inside = np.ones(len(wide), bool)
        starts = np.cumsum([0, *lengths])[:-1]
        for k in range(depth):
            inside[starts + k] = False
        keys = keys[inside[depth:]] << np.uint64(16)
        keys |= np.repeat(np.arange(len(lengths), dtype=np.uint64), np.array(lengths) - depth)
        keys.sort()
        self.gram_piece = (keys & np.uint64(0xFFFF)).astype(np.int64)
        keys >>= np.uint64(16)
        fresh = np.ones(len(keys), bool)
        np.not_equal(keys[1:], keys[:-1], out=fresh[1:])
        self.starts = np.flatnonzero(fresh)
        self.grams = keys[self.starts]

    def word_counts(self) -> np.ndarray:
        """How often the learned pieces hold each different word."""
        return np.bincount(self.word[self.learned[self.word_piece]], minlength=len(self.words)).astype(np.uint32)

    def gram_counts(self) -> np.ndarray:
        return np.add.reduceat(self.learned[self.gram_piece], self.starts, dtype=np.uint32)

    def summed(self, logs: np.ndarray) -> np.ndarray:
        """The sum over each piece of a value of each different gram."""
        each = np.repeat(logs, np.diff(self.starts, append=len(self.gram_piece)))
        return np.bincount(self.gram_piece, each, len(self.learned))


def _by_part(of: np.ndarray) -> dict[int, np.ndarray]:
    """The places of each part's entries, in order."""
    order = np.argsort(of, kind="stable")
    different, starts = np.unique(of[order], return_index=True)
    return dict(zip(different.tolist(), np.split(order, starts[1:])))


def _word_parts(words: list[bytes], parts: int) -> dict[int, np.ndarray]:
    return _by_part(np.array([zlib.crc32(w) % parts for w in words], np.int64))


def _cut(text: str, depth: int, most: int) -> Iterator[bytes]:
    """A text's pieces with their contexts; words are never cut."""
    words = text.encode("utf-8", "replace").lower().split()
    if len(text) < most // 4:  # at most four bytes a character
        yield END * depth + b" ".join(words) + END
        return
    before, at = END * depth, 0
    while True:
        end, size = at, 0
        while end < len(words) and (end == at or size < most):
            size += len(words[end]) + 1
            end += 1
        last = end == len(words)
        body = b" ".join(words[at:end]) + (END if last else b" ")
        yield before + body
        if last:
            return
        before, at = (before + body)[-depth:], end


_BLOCK = "block long, part int, data binary, lengths array<int>, texts array<long>, learned array<boolean>, grams binary, gram_counts binary, words binary, word_counts binary"


def _blocks(depth: int, parts: int, most: int):
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 4]
    names = [f.split()[0] for f in _BLOCK.split(", ")]

    def asked(block: int, pieces: list[tuple[bytes, int, bool, dict]], kept: pa.DataType) -> pa.RecordBatch:
        """The row with a block's pieces and a row for each part that it asks."""
        raw, lengths, learned = b"".join(p[0] for p in pieces), [len(p[0]) for p in pieces], [p[2] for p in pieces]
        made = Block(raw, lengths, learned, depth)
        words, word_counts, grams, gram_counts = made.words, made.word_counts(), made.grams, made.gram_counts()
        rows = [(block, -1, _pack(raw), lengths, [p[1] for p in pieces], learned, *[None] * 4, [p[3] for p in pieces])]
        of_words, of_grams, none = _word_parts(words, parts), _by_part(_hash(grams, parts)), np.empty(0, np.int64)
        for part in sorted({*of_words, *of_grams}):
            w, g = of_words.get(part, none), of_grams.get(part, none)
            rows.append((block, part, *[None] * 4, _pack(grams[g]), _pack(gram_counts[g]), _pack(b" ".join([words[n] for n in w.tolist()])), _pack(word_counts[w]), None))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [*kinds, pa.list_(kept)])], [*names, "kept"])

    def run(batches):
        pieces, size, made, row, base, kept = [], 0, 0, 0, 0, None
        for batch in batches:
            kept = batch.schema.field("kept").type
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for task, text, learn, names_ in zip(*(part.column(n).to_pylist() for n in ("task", "text", "learn", "kept"))):
                    base = task << 33
                    for piece in _cut(text or "", depth, most):
                        if size and (size + len(piece) > most or len(pieces) > 0xFFFF):
                            yield asked(base + made, pieces, kept)
                            pieces, size, made = [], 0, made + 1
                        pieces.append((piece, base + row, learn, names_))
                        size += len(piece)
                    row += 1
        if pieces:
            yield asked(base + made, pieces, kept)

    return run


def _words_in(row: dict) -> list[bytes]:
    return zstandard.decompress(row["words"]).split(b" ") if len(_unpack(row["word_counts"], np.uint32)) else []


def _merged(parts: int, depth: int):
    """A part's counts: answers about words to each block, its different grams to the tree, and totals."""

    def run(rows: pa.Table) -> pa.Table:
        asked = rows.to_pylist()
        part, total = asked[0]["part"], Counter()
        for row in asked:
            for word, n in zip(_words_in(row), _unpack(row["word_counts"], np.uint32).tolist()):
                if n:
                    total[word] += n
        out = [(None, part, None, None, sum(total.values()), len(total))]
        for row in asked:
            out.append((row["block"], part, None, _pack(np.array([total[w] for w in _words_in(row)], np.int64)), None, None))
        grams = np.concatenate([_unpack(row["grams"], np.uint64) for row in asked])
        counts = np.concatenate([_unpack(row["gram_counts"], np.uint32) for row in asked])
        different, place = np.unique(grams, return_inverse=True)
        summed = np.bincount(place, counts, len(different)).astype(np.int64)
        to = _hash(different >> np.uint64(8 * (depth + 1 - TOP)), parts)
        for tree in np.unique(to).tolist():
            mine = to == tree
            out.append((int(tree), part, _pack(different[mine]), _pack(summed[mine]), None, None))
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["to", "part", "grams", "counts", "tokens", "different"])

    return run


def _tree(rows: list[dict], depth: int) -> tuple[Deep, np.ndarray]:
    """The tree over the rows' grams, and the place of each row's grams in it."""
    grams = np.concatenate([_unpack(r["grams"], np.uint64) for r in rows])
    counts = np.concatenate([_unpack(r["counts"], np.int64) for r in rows])
    order = np.argsort(grams)
    place = np.empty(len(grams), np.int64)
    place[order] = np.arange(len(grams))
    return Deep(grams[order], counts[order], depth), place


def _upper(depth: int):
    def run(rows: pa.Table) -> pa.Table:
        nodes, zeros, ones, logs = _tree(rows.to_pylist(), depth)[0].upper()
        return pa.table({"tree": np.full(len(nodes), rows.column("to")[0].as_py(), np.int64), "node": nodes.astype(np.int64), "zeros": zeros, "ones": ones, "below": logs})

    return run


def _answered(depth: int):
    """log10 probabilities of a tree's grams, for the parts that asked."""

    def run(key, rows: pa.Table, top: pa.Table) -> pa.Table:
        asked = rows.to_pylist()
        found = []
        if asked:
            top = top.sort_by("node")
            tree, place = _tree(asked, depth)
            logs = tree.log10(np.asarray(top.column("node"), np.uint64), *(np.asarray(top.column(n), float) for n in ("base", "slope", "stop")))[place]
            at = 0
            for row in asked:
                n = len(_unpack(row["grams"], np.uint64))
                found.append((row["part"], row["grams"], _pack(logs[at : at + n].astype(np.float32))))
                at += n
        kinds = [pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*found) if found else [()] * 3, kinds)], ["part", "grams", "logs"])

    return run


def _told(key, asked: pa.Table, known: pa.Table) -> pa.Table:
    """The answers of a part to each block, in the order of the block's grams."""
    found = []
    if asked.num_rows and known.num_rows:
        grams = np.concatenate([_unpack(g, np.uint64) for g in known.column("grams").to_pylist()])
        logs = np.concatenate([_unpack(g, np.float32) for g in known.column("logs").to_pylist()])
        order = np.argsort(grams)
        grams, logs = grams[order], logs[order]
        for block, mine in zip(asked.column("block").to_pylist(), asked.column("grams").to_pylist()):
            found.append((block, key[0].as_py(), _pack(logs[np.searchsorted(grams, _unpack(mine, np.uint64))])))
    return pa.table([pa.array(c, k) for c, k in zip(zip(*found) if found else [()] * 3, [pa.int64(), pa.int32(), pa.binary()])], ["block", "part", "logs"])


_SCORED = "text long, learned boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double"


def _scored(depth: int, parts: int, tokens: int, different: int):
    """A block's texts from its own pieces and the answers to it."""

    def run(rows: pa.Table) -> pa.Table:
        asked = rows.to_pylist()
        body = next(r for r in asked if r["part"] < 0)
        block = Block(zstandard.decompress(body["data"]), body["lengths"], body["learned"], depth)
        of_grams, of_words = _by_part(_hash(block.grams, parts)), _word_parts(block.words, parts)
        logs, counts = np.zeros(len(block.grams)), np.zeros(len(block.words))
        for row in asked:
            if row["logs"] is not None and row["part"] in of_grams:
                logs[of_grams[row["part"]]] = _unpack(row["logs"], np.float32)
            if row["counts"] is not None and row["part"] in of_words:
                counts[of_words[row["part"]]] = _unpack(row["counts"], np.int64)
        n = len(body["lengths"])
        base = np.log10((counts + 0.1) / (tokens + 0.1 * (different + 1)))
        sums = lambda values: np.bincount(block.word_piece, values[block.word], n)
        return pa.table({
            "text": pa.array(body["texts"], pa.int64()), "kept": rows.column("kept").filter(pc.is_valid(rows.column("kept"))).combine_chunks().flatten(), "learned": pa.array(body["learned"]), "n_bytes": np.bincount(block.gram_piece, minlength=n).astype(np.int64), "n_tokens": np.bincount(block.word_piece, minlength=n).astype(np.int64),
            "n_known": sums(counts > 0).astype(np.int64), "base_score": sums(base), "score": block.summed(logs),
        })

    return run


def _whole(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``run`` of one group, after which the worker gives back memory."""

    def wrapped(rows: pa.Table) -> pa.Table:
        return next(released(lambda one: iter([run(one)]))(rows))

    return wrapped


def _weights(nodes: DataFrame) -> DataFrame:
    """Adds to nodes (zeros, ones, below) their probability of a one, the weight of stopping there, and ln weighted."""
    kt = log_kt(F.col("zeros").cast("double"), F.col("ones").cast("double"), F.log)
    high, low = F.greatest("own", "rest"), F.least("own", "rest")
    nodes = nodes.withColumn("own", HALF + kt).withColumn("rest", HALF + F.col("below")).withColumn("weighted", high + F.log1p(F.exp(low - high)))
    total = F.col("zeros") + F.col("ones")
    return nodes.select("node", "zeros", "ones", "weighted", (total > 0).alias("seen"), ((F.col("ones") + 0.5) / (total + 1.0)).alias("p"), F.exp(F.col("own") - F.col("weighted")).alias("w"))


def _shared_levels(upper: DataFrame) -> DataFrame:
    """(node, base, slope, stop) for each node two bytes deep: what the upper levels make of a probability below."""
    sums = [F.sum(c).alias(c) for c in ("zeros", "ones")]
    two = saved(_weights(upper.groupBy("node").agg(*sums, F.sum("below").alias("below"))))
    parent = (F.shiftright("node", 16) * 256 + F.col("node").bitwiseAND(255)).alias("node")
    above = lambda level: _weights(level.select(parent, "zeros", "ones", F.col("weighted").alias("below")).groupBy("node").agg(*sums, F.sum("below").alias("below")))
    one = saved(above(two))  # at most 256 * 255 nodes
    none = above(one)  # at most 255
    named = lambda level, n: level.select(F.col("node").alias(f"node{n}"), *[F.col(c).alias(f"{c}{n}") for c in ("seen", "p", "w")])
    path = F.col("node2").bitwiseAND(255)
    every = named(two, 2).withColumn("node1", F.shiftright("node2", 16) * 256 + path).withColumn("node0", path)
    every = every.join(F.broadcast(named(one, 1)), "node1").join(F.broadcast(named(none, 0)), "node0")
    c = F.col
    base1, slope1 = c("w1") * c("p1") + (1 - c("w1")) * c("w2") * c("p2"), (1 - c("w1")) * (1 - c("w2"))
    stop1 = F.when(c("seen2"), c("w1") * c("p1") + (1 - c("w1")) * c("p2")).otherwise(c("p1"))
    root = lambda x: c("w0") * c("p0") + (1 - c("w0")) * x
    return every.select(c("node2").alias("node"), root(base1).alias("base"), ((1 - c("w0")) * slope1).alias("slope"), F.when(c("seen1"), root(stop1)).otherwise(c("p0")).alias("stop"))


def score(docs: DataFrame, learn: Column, text: str = "text", keep: tuple[str, ...] = ("doc_id",), depth: int = 5, block: int = 4_000_000, per_part: int = 8_000_000) -> DataFrame:
    """The kept columns, ``learned``, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row.

    The model learns from the rows where ``learn`` holds (null: it does). ``score`` is its log10 probability of
    the text's words and end, ``bits_per_byte`` the code length over the bytes read, and ``base_score`` that
    of a smoothed unigram model over the same words. ``depth``: bytes of context, TOP to MOST_DEPTH. ``block``:
    bytes of text of one block; a longer text is cut between words into pieces that know the bytes before
    them, a longer word is a piece of its own. ``per_part``: bytes of text behind one part of the counts.

    A null or empty text is the end alone. Every row gives one row, repeated rows and null keys included; an
    empty table gives an empty one; the other columns are left out.
    """
    if not TOP <= depth <= MOST_DEPTH:
        raise ValueError(f"depth must be {TOP} to {MOST_DEPTH}")
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`"))).alias("n")).first().n or 0
    parts = max(1, -(-int(size) // per_part))
    kept = ", ".join(f"`{k}`: {docs.schema[k].dataType.simpleString()}" for k in keep)
    rows = docs.select(F.spark_partition_id().cast("long").alias("task"), F.col(f"`{text}`").alias("text"), F.coalesce(learn, F.lit(True)).alias("learn"), F.struct(*[F.col(f"`{k}`") for k in keep]).alias("kept"))
    blocks = saved(small_batches(rows).mapInArrow(released(_blocks(depth, parts, block)), f"{_BLOCK}, kept array<struct<{kept}>>"))

    asked = blocks.where("part >= 0")
    merged = asked.select("block", "part", "grams", "gram_counts", "words", "word_counts").groupBy("part").applyInArrow(_whole(_merged(parts, depth)), "to long, part int, grams binary, counts binary, tokens long, different long")
    merged = saved(merged)
    tokens, different = merged.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("different"), F.lit(0))).first()

    trees = merged.where("grams IS NOT NULL").select("to", "part", "grams", "counts")
    upper = saved(trees.groupBy("to").applyInArrow(_whole(_upper(depth)), "tree long, node long, zeros long, ones long, below double"))
    top = upper.select("tree", "node").join(_shared_levels(upper), "node")
    answers = trees.groupBy("to").cogroup(top.groupBy("tree")).applyInArrow(_answered(depth), "part int, grams binary, logs binary")
    told = asked.select("block", "part", "grams").groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_told, "block long, part int, logs binary")

    own = blocks.where("part < 0").select("block", "part", "data", "lengths", "texts", "learned", "kept", F.lit(None).cast("binary").alias("logs"), F.lit(None).cast("binary").alias("counts"))
    words = merged.where("grams IS NULL AND to IS NOT NULL").select(F.col("to").alias("block"), "part", "counts")
    together = own.unionByName(told, allowMissingColumns=True).unionByName(words, allowMissingColumns=True)
    pieces = together.groupBy("block").applyInArrow(_whole(_scored(depth, parts, tokens, different)), f"{_SCORED}, kept struct<{kept}>")
    sums = [F.sum(c).alias(c) for c in ("n_bytes", "n_tokens", "n_known", "base_score", "score")]
    texts = pieces.groupBy("text").agg(F.first("kept").alias("kept"), F.first("learned").alias("learned"), *sums)
    bits = -F.col("score") / math.log10(2) / F.col("n_bytes")
    return texts.select("kept.*", "learned", "n_bytes", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))


def digest(docs: DataFrame) -> DataFrame:
    """Scores of all documents; one tenth of the keys is held out."""
    held = F.coalesce(fold(F.col("doc_id"), 10) == 0, F.lit(False))
    found = score(docs, ~held)
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
