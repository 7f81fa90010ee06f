"""Tokenised documents packed into fixed-length sequences by best-fit decreasing.

Tokenising yields one narrow row for each piece (no text, no ids), so what is dealt out afterwards is
small. Pieces are dealt evenly into shards of about ``per_shard`` pieces; each shard is packed on
its own, longest piece first, always into the open sequence that it fills tightest. A segment tree
over the remaining capacities finds that sequence in logarithmic time. A shard mixes all lengths, so
it loses about one half-filled sequence against packing everything at once.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from tanik.llm.bpe import alphabet_bytes
from tanik.llm.common import released, small_batches
from tanik.session import saved

#: The pattern by which byte-level vocabularies cut a text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bytes of text whose different words are tokenised together (a longer text on its own).
TOGETHER = 4 << 20

#: Different words in one call of the rank coder.
CALL = 50_000

#: White space next to a space.
_RUN = re.compile(r" \s|\s ")

#: What Python and the pattern take for white space, but the space.
_WHITE = r"\x{09}-\x{0d}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

#: Texts in which some space is not between two other characters.
_UNEVEN = rf"^ | $| [ {_WHITE}]|[{_WHITE}] "

#: Put between words of one call: a character that no other joins, as these begin with a letter, a mark or one space and end in no white space.
_BETWEEN = "\x0b"
_ALONE = rf"^$|^[{_WHITE}]|^ [ {_WHITE}]|[ {_WHITE}]$|\x{{0b}}"


class TextCoder:
    """Ids of whole texts with a byte-level vocabulary in which a word takes the one space before it.

    A space between two other characters always begins a new word there, so texts are cut at such
    spaces. The different parts of many texts are tokenised once, and their ids dealt out by number.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # the ids follow the order of the merges, so they serve as ranks; this coder is quick on words
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        added = {token.content for token in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(alphabet_bytes()[c] for c in token): n for token, n in vocabulary.items() if token not in added}
        self.words = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.added = tuple(added)
        self.between = ranks[_BETWEEN.encode()]

    def _alone(self, part: str) -> np.ndarray:
        if len(part) > 100 or any(token in part for token in self.added):
            return np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4")
        return np.array(self.words.encode_ordinary(part), "<u4")

    def _table(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, lengths): the ids of parts in any order, and where each part's are."""
        alone = pc.or_(pc.match_substring_regex(parts, _ALONE), pc.greater(pc.utf8_length(parts), 100))
        for token in self.added:
            alone = pc.or_(alone, pc.match_substring(parts, token))
        alone = alone.to_numpy(zero_copy_only=False)
        found, size, starts, lengths = [], 0, np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        plain = np.flatnonzero(~alone)
        for at in range(0, len(plain), CALL):
            some = plain[at : at + CALL]
            text = pc.binary_join(pa.ListArray.from_arrays([0, len(some)], parts.take(pa.array(some))), _BETWEEN)[0].as_py()
            ids = np.array(self.words.encode_ordinary(text), "<u4")
            ends = np.append(np.flatnonzero(ids == self.between), len(ids))
            starts[some] = begin = np.append(0, ends[:-1] + 1)
            starts[some] += size
            lengths[some] = ends - begin
            found.append(ids)
            size += len(ids)
        for n, part in zip(odd := np.flatnonzero(alone), parts.take(pa.array(odd)).to_pylist()):
            ids = self._alone(part)
            starts[n], lengths[n] = size, len(ids)
            found.append(ids)
            size += len(ids)
        return np.concatenate([*found, np.empty(0, "<u4")]), starts, lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, as 32-bit integers, and where each text's begin (and the last one's end); null: empty."""
        texts = texts.fill_null("")
        uneven = pc.match_substring_regex(texts, _UNEVEN)
        cut = pc.split_pattern(pc.if_else(uneven, "", texts), " ")
        words, ends = cut.flatten(), cut.value_lengths().to_numpy().cumsum(dtype=np.int64)
        first = np.zeros(len(words), bool)
        first[np.append(0, ends[:-1])[: len(ends)]] = True
        heads, tails = words.filter(pa.array(first)).dictionary_encode(), words.filter(pa.array(~first)).dictionary_encode()
        # uneven texts, each so far an empty head, get their parts one by one
        split = [(n, self._cut(texts[n].as_py())) for n in np.flatnonzero(uneven.to_numpy(zero_copy_only=False))]
        rest = pa.array([part for _, found in split for part in found], texts.type).dictionary_encode()
        of = np.repeat(np.array([n for n, _ in split], np.int64), [len(found) for _, found in split])
        spaced = pc.binary_join_element_wise(pa.scalar(" ", texts.type), tails.dictionary, pa.scalar("", texts.type))
        ids, starts, lengths = self._table(pa.concat_arrays([heads.dictionary, spaced, rest.dictionary]))
        part = np.empty(len(words), np.int64)
        part[first] = heads.indices.to_numpy()
        part[~first] = tails.indices.to_numpy() + len(heads.dictionary)
        part = np.insert(part, ends[of], rest.indices.to_numpy() + len(heads.dictionary) + len(spaced))
        ends = ends + np.bincount(of, minlength=len(texts)).cumsum()
        sizes = lengths[part]
        last = sizes.cumsum()
        where = np.repeat(starts[part] - last + sizes, sizes)
        where += np.arange(len(where))
        return ids[where], np.append(0, last[ends - 1])

    @staticmethod
    def _cut(text: str) -> list[str]:
        if not text:
            return []
        words = text.split(" ")
        parts = words[:1] + [" " + w for w in words[1:]]
        if text[-1] == " " or text[0] == " " or _RUN.search(text):
            joined = parts[:1]
            for w, part in zip(words[1:], parts[1:]):
                # next to other white space the space may belong to a longer run
                if not w or w[:1].isspace() or joined[-1][-1:].isspace() or not joined[-1]:
                    joined[-1] += part
                else:
                    joined.append(part)
            return [part for part in joined if part]
        return parts


@cache
def coder(path: str) -> TextCoder:
    """One for each worker process and vocabulary."""
    return TextCoder(path)


def together(texts: pa.Array, most: int = TOGETHER) -> list[tuple[int, int]]:
    """(from, to) of runs of texts of at most about ``most`` bytes, or of one longer text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    runs, at, size = [], 0, 0
    for n, more in enumerate(sizes.tolist()):
        if n > at and size + more > most:
            runs.append((at, n))
            at, size = n, 0
        size += more
    return [*runs, (at, len(sizes))] if len(sizes) else []


def pieces_of(ids: bytes, most: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of each piece: whole sequences, the shorter rest first."""
    total = len(ids) // 4
    cuts = [0, *range(total % most or most, total + 1, most)] if total > most else [0, total]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(cuts, cuts[1:])]


def _pieces(path: str, most: int, end: int):
    tail = struct.pack("<I", end)

    def run(batches):
        code = coder(path)
        for batch in batches:
            for at, to in together(batch.column("text")):
                part = batch.slice(at, to - at)
                ids, starts = code.encode(part.column("text"))
                rows = [(n, k, *piece) for n, (a, b) in enumerate(zip(starts, starts[1:])) for k, piece in enumerate(pieces_of(ids[a:b].tobytes() + tail, most))]
                n, k, start, length, crc = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(n)), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["key", "piece", "start", "length", "ids_crc32"])

    return run


class OpenSequences:
    """A segment tree over remaining capacities 0..most; each leaf lists the sequences with that much left."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, left: int, sequence: int) -> None:
        self.open[left].append(sequence)
        node = left + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Removes and returns (sequence, its capacity) with the least capacity of at least ``length``."""
        count, node = self.count, length + self.size
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # up to the first full right neighbour
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        left = node - self.size
        while node:
            count[node] -= 1
            node >>= 1
        return self.open[left].pop(), left


def best_fit(lengths: list[int], most: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each length; the lengths must be in descending order."""
    opened, made, placed = OpenSequences(most), 0, []
    for length in lengths:
        found = opened.take(length)
        if found is None:
            found, made = (made, most), made + 1
        sequence, left = found
        placed.append((sequence, most - left))
        if left > length:
            opened.add(left - length, sequence)
    return placed


def _packed(most: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("key", "ascending"), ("piece", "ascending"), ("start", "ascending")])
        placed = np.array(best_fit(rows.column("length").to_pylist(), most), np.int64).reshape(-1, 2)
        first = rows.column("shard")[0].as_py() << 40
        return rows.drop_columns(["shard"]).append_column("sequence_id", pa.array(placed[:, 0] + first)).append_column("offset", pa.array(placed[:, 1]))

    return run


def pack_documents(docs: DataFrame, path: str, most: int = 2048, end: int = 0, per_shard: int = 1 << 17, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids by the vocabulary file ``path`` and then ``end``; only longer ones than
    ``most`` are cut. A null or empty text is the one id ``end``. Repeated rows are packed as often as
    they come and a null key is kept; an empty table gives an empty one; other columns are left out.
    ``sequence_id`` numbers are not gapless; offsets within a sequence are.
    """
    kind = docs.schema[key].dataType.simpleString()
    pieces = small_batches(docs).select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(released(_pieces(path, most, end)), f"key {kind}, piece int, start long, length long, ids_crc32 long")
    pieces = saved(pieces)
    shards = max(1, -(-pieces.count() // per_shard))
    # by a number of the row, not by its key: repeated rows spread like all others (the pieces are saved, so the number stays)
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInArrow(_packed(most), f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return packed.withColumnRenamed("key", key)
