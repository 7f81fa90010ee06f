"""BPE encoding as a bounded-lookahead streaming transducer, and incremental decoding.

Two facts make the transducer exact. A token sequence is what the merge list produces if and only if
every two neighbours stay apart when only those two are encoded; so the last token of each prefix is
the one suffix that stays apart from the last token of what precedes it, and the whole encoding is
the chain of these last tokens. And a merge can only undo a later, hence higher-ranked, merge to its
left, so text to the right changes tokens no farther back than the longest chain of such merges: the
merge list's sufficient lookahead. Tokens that end farther back than that are final and are emitted;
the buffer is cut there, so memory does not grow with the text.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tanik.llm.common import small_batches

END = "</w>"
#: Entries kept of each memory of words and pairs, per worker process; they are dropped when full.
MEMORY = 600_000
#: Ids decoded at a time.
BLOCK = 4096


@cache
def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


@cache
def alphabet_bytes() -> dict[str, int]:
    """The byte for which each character stands."""
    return {c: b for b, c in byte_alphabet().items()}


class Merges:
    """A merge list with word ends: ids, ranks and the sufficient lookahead."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        alphabet = byte_alphabet().values()
        self.tokens = {*alphabet, *(c + END for c in alphabet), *(a + b for a, b in pairs)}
        self.longest = max(len(t.removesuffix(END)) for t in self.tokens)
        self.lookahead = self._sufficient_lookahead(pairs)
        self.known: dict[tuple[str, str], bool] = {}  #: what ``apart`` has found
        self.states: dict[str, str] = {}  #: the last token of short prefixes of words

    def _sufficient_lookahead(self, pairs: list[tuple[str, str]]) -> int:
        """Characters to the right that can still change a token.

        ``reach`` of a merge (a, b): how far to the left of b it can change tokens. Taking a away
        undoes a later merge whose right part ends with a; that frees the left part of that merge,
        and so on, each time with a higher rank. Ranks are visited from the last to the first.
        """
        best: dict[str, int] = {}
        most = 0
        for left, right in reversed(pairs):
            reach = len(left) + best.get(left, 0)
            body = right.removesuffix(END)
            most = max(most, reach + len(body))
            if body == right:
                for k in range(len(right)):
                    if best.get(right[k:], 0) < reach:
                        best[right[k:]] = reach
        return most + self.longest

    def merge(self, text: str, ended: bool) -> list[str]:
        """Plain merging of a short string, lowest rank first, leftmost first."""
        parts = list(text)
        if ended and parts:
            parts[-1] += END
        while len(parts) > 1:
            ranks = [self.ranks.get(pair, len(self.ranks)) for pair in zip(parts, parts[1:])]
            k = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[k] == len(self.ranks):
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def apart(self, left: str, right: str) -> bool:
        """Whether the two tokens stay two tokens side by side; left may be empty."""
        known = self.known.get((left, right))
        if known is None:
            if len(self.known) > MEMORY:
                self.known.clear()
            body = right.removesuffix(END)
            known = self.merge(left + body, body != right) == ([left, right] if left else [right])
            self.known[left, right] = known
        return known


class Transducer:
    """Encodes one word, given in pieces, and yields each token as soon as it is final."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.buffer = ""
        self.last = [""]  #: the last token of each prefix of the buffer; first the token before it
        self.limit = 2 * merges.lookahead + 64

    def _last(self, end: int) -> str:
        """The token with a word end that the whole buffer ends with."""
        for start in range(max(0, end - self.merges.longest), end):
            token = self.buffer[start:end] + END
            if token in self.merges.tokens and self.merges.apart(self.last[start], token):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def _path(self, end: int, token: str) -> list[str]:
        """The tokens of the buffer up to ``end``, of which ``token`` is the last."""
        found = [token]
        end -= len(token.removesuffix(END))
        while end > 0:
            found.append(self.last[end])
            end -= len(self.last[end])
        return found[::-1]

    def push(self, text: str) -> Iterator[str]:
        """Takes characters that are known not to be the word's last one."""
        for at in range(0, len(text), 64):
            start = len(self.buffer)
            self.buffer += text[at : at + 64]
            self._extend(start + 1, len(self.buffer))
            if len(self.buffer) > self.limit:
                yield from self._emit()

    def _extend(self, first: int, end: int) -> None:
        """The last tokens of the prefixes of the lengths first..end."""
        buffer, last, merges = self.buffer, self.last, self.merges
        tokens, longest, known, states = merges.tokens, merges.longest, merges.known, merges.states
        for n in range(first, end + 1):
            early = n <= 20 and not last[0]  # still at the word's start: words share such prefixes
            if early and (token := states.get(buffer[:n])):
                last.append(token)
                continue
            for start in range(max(0, n - longest), n):
                token = buffer[start:n]
                if token in tokens:
                    apart = known.get((last[start], token))
                    if apart is None:
                        apart = merges.apart(last[start], token)
                    if apart:
                        last.append(token)
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
            if early:
                if len(states) > MEMORY:
                    states.clear()
                states[buffer[:n]] = token

    def _emit(self) -> Iterator[str]:
        final, cut = len(self.buffer) - self.merges.lookahead, 0
        for token in self._path(len(self.buffer), self.last[-1]):
            if cut + len(token) > final:
                break
            cut += len(token)
            yield token
        self.buffer, self.last = self.buffer[cut:], self.last[cut:]

    def finish(self, text: str) -> Iterator[str]:
        """Takes the rest of the word, its last character included."""
        yield from self.push(text[:-1])
        self.buffer += text[-1]
        yield from self._path(len(self.buffer), self._last(len(self.buffer)))


class Decoder:
    """Ids to text, any number at a time, with constant state.

    ``pieces``: the bytes behind each id; ``gap`` comes between two. The bytes go through an incremental
    UTF-8 machine: a character may need several ids and comes out when its last byte is there; stray
    bytes become U+FFFD.
    """

    def __init__(self, pieces: list[bytes], gap: bytes = b""):
        self.pieces, self.gap, self.begun = pieces, gap, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: list[int]) -> str:
        raw = self.gap.join(map(self.pieces.__getitem__, ids))
        if self.begun and ids:
            raw = self.gap + raw
        self.begun |= bool(ids)
        return self.utf8.decode(raw)

    def finish(self) -> str:
        return self.utf8.decode(b"", final=True)


def _bytes_of(token: str) -> bytes:
    body = token.removesuffix(END)
    return bytes(alphabet_bytes().get(c, 63) for c in body) + (b" " if body != token else b"")


class WordCoder:
    """Encodes whole texts word by word; short words are remembered, within a bound."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        strings = {i: t for t, i in (self.merges.ids | self.merges.added).items()}
        #: Of each id its token as the library shows it, and the bytes behind it with a space at a word's end.
        self.shown = [strings.get(i, "").encode() for i in range(max(strings) + 1)]
        self.bytes = [_bytes_of(strings.get(i, "")) for i in range(len(self.shown))]
        self.special = regex.compile("|".join(map(regex.escape, self.merges.added)) or r"(?!)")
        #: The vocabulary's own pattern; its white space is the Unicode property.
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
        self.gaps = regex.compile(r"\p{White_Space}+")
        self.table = {b: c for b, c in byte_alphabet().items() if chr(b) != c}
        self.known: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def encode_word(self, word: str) -> bytes:
        """Ids of one word as little-endian 32-bit integers."""
        found = self.known.get(word)
        if found is None:
            plain = word if word.isascii() and word.isprintable() else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table)
            found = b"".join([self.merges.ids[token].to_bytes(4, "little") for token in Transducer(self.merges).finish(plain)])
            if len(word) <= 40:
                if len(self.known) > MEMORY:
                    self.known.clear()
                self.known[word] = found
        return found

    def encode_chunk(self, chunk: str) -> bytes:
        """The same of a text without white space."""
        found = self.chunks.get(chunk)
        if found is None:
            parts = [self.encode_word(word) for word in self.words.findall(chunk)]
            found = parts[0] if len(parts) == 1 else b"".join(parts)
            if len(chunk) <= 40:
                if len(self.chunks) > MEMORY:
                    self.chunks.clear()
                self.chunks[chunk] = found
        return found

    def _plain(self, text: str) -> list[bytes]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")  # white space for split(), not for the pattern
        known = self.chunks.get
        return [known(c) or self.encode_chunk(c) for c in (self.gaps.split(text) if odd else text.split()) if c]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        found, at = [], 0
        for match in self.special.finditer(text) if "<|" in text else ():
            found += self._plain(text[at : match.start()])
            found.append(struct.pack("<I", self.merges.added[match[0]]))
            at = match.end()
        found += self._plain(text[at:] if at else text)
        return b"".join(found)

    def decoded(self, ids: bytes, spaced: bool = True) -> Iterator[str]:
        """The text of ids in parts: as the library shows it, or with ``spaced`` false the bytes behind the tokens."""
        decoder = Decoder(self.shown, b" ") if spaced else Decoder(self.bytes)
        for at in range(0, len(ids), 4 * BLOCK):
            yield decoder.push(np.frombuffer(ids[at : at + 4 * BLOCK], "<u4").tolist())
        yield decoder.finish()


@cache
def coder(path: str) -> WordCoder:
    """One for each worker process and vocabulary."""
    return WordCoder(path)


def _encoded(path: str, text: str, keep: list[str]):
    def run(batches):
        words = coder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [words.encode(t or "") for t in part.column(text).to_pylist()]
                shown = ["".join(words.decoded(i)).encode() for i in ids]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(ids, pa.binary()), pa.array(shown, pa.binary())], [*keep, "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ``ids`` (little-endian 32-bit integers as binary) and ``decoded`` (UTF-8 as binary) of every row.

    A null or empty text has no ids and an empty decoded text. Rows are taken as they come: repeated
    and null keys stay, an empty table gives an empty one, other columns are left out.
    """
    kind = docs.schema[key].dataType.simpleString()
    return small_batches(docs).select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(_encoded(path, text, [key]), f"`{key}` {kind}, ids binary, decoded binary")


def _digested(path: str):
    def run(batches):
        words = coder(path)
        for batch in batches:
            count, ids_sha, text_sha = [], [], []
            for text in batch.column("text"):
                ids = words.encode(text.as_py() or "")
                sha = hashlib.sha256()
                for shown in words.decoded(ids):
                    sha.update(shown.encode())
                count.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the hashes of ids and decoded text, computed where the ids are made."""
    return small_batches(docs).select("doc_id", "text").mapInArrow(_digested(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
