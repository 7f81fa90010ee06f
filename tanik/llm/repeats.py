"""Repeated passages over all documents: common-prefix intervals of enhanced suffix arrays.

Only text near a shared short string can hold a repeat, so the work narrows in steps:

1. Every window of ``least`` bytes names its anchor, the 20-byte string in it with the least hash.
   Equal windows have equal anchors. Anchors are dealt by hash, packed in blocks without their text.
2. Anchors whose hash occurs in two documents are kept; each stands for a run of adjacent windows.
3. The bytes of these runs are dealt by anchor, every different run of a stretch of input once. There the
   suffixes are sorted and common-prefix lengths taken; an interval of the common-prefix tree at least
   ``least`` long holds all occurrences of a window, and the first of them becomes the window's name.
   A document's windows then are stretches of consecutive names, wherever its own runs ended.
4. What the first names cover of a document with a larger key is what repeats (``repeated_spans``).
   ``maximal_repeats`` goes on: stretches of names, each different one once, are strings over whole
   passages, so their suffixes are sorted by the first document, a stack scan gives the intervals of the
   common-prefix tree, and each interval that differs to its left is a maximal repeat of any length.

Work on a passage that very many documents hold stays small: of the copies inside one stretch of input
only the smallest key is sent on, the others refer to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from tanik.llm.common import released, released_group, small_batches
from tanik.llm.minhash import FILTER_BITS
from tanik.session import saved

GRAM = 20
#: Bytes whose anchors are found at once; positions inside such a piece fit into 20 bits.
PIECE = 1 << 18
_MASK = np.uint64((1 << 20) - 1)
_TABLE = np.random.default_rng(77).integers(0, 1 << 63, 256, dtype=np.uint64)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_P), n, 1 << 64))


def _grams(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each position: a polynomial, made by doubling."""
    parts, width = {1: _TABLE[raw]}, 1
    while width * 2 <= GRAM:
        h = parts[width]
        parts[width * 2] = h[:-width] * _power(width) + h[width:]
        width *= 2
    h, done = parts[width], width
    for k in (8, 4, 2, 1):
        if (GRAM - width) & k:
            size = len(h) - k
            h = h[:size] * _power(k) + parts[k][done : done + size]
            done += k
    h = (h ^ (h >> np.uint64(31))) * _Q
    return h ^ (h >> np.uint64(29))


def anchors(raw: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of ``least`` bytes: the place of its anchor, and all hashes; at most 2**20 bytes."""
    h = _grams(raw)
    low = (h & ~_MASK) | np.arange(len(h), dtype=np.uint64)  # the first of equal ones wins
    span, width = least - GRAM + 1, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    return (low & _MASK).astype(np.int64), h


def _pieces(texts: Iterable[bytes], least: int):
    """Lists of (number of the text, start in it, bytes): pieces of bounded size, all windows in one of them."""
    held, size = [], 0
    for n, text in enumerate(texts):
        if len(text) < least:
            continue
        for at in range(0, len(text) - least + 1, PIECE):
            part = text[at : at + PIECE + least - 1]
            held.append((n, at, part))
            size += len(part)
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _windows(held, least: int):
    """For a piece: the windows inside one document, with their anchors and hashes."""
    raw = np.frombuffer(b"".join(p for *_, p in held), np.uint8)
    length = np.array([len(p) for *_, p in held])
    begin = np.r_[0, np.cumsum(length)[:-1]]
    at, h = anchors(raw, least)
    inside = np.zeros(len(at) + 1, np.int64)
    ends = begin + length - least + 1
    np.add.at(inside, begin, 1)
    np.add.at(inside, np.minimum(ends, len(at)), -1)
    start = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    part = np.searchsorted(begin, start, "right") - 1
    return raw, begin, start, part, at[start], h


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the row before it, in any column."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _planes(values: np.ndarray) -> bytes:
    """Fixed-width numbers byte plane by byte plane, which compresses well."""
    values = np.ascontiguousarray(values)
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _numbers(raw: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(dtype).reshape(-1)


def _dealt(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
    """One row for each bucket, each column's numbers in one binary value."""
    order = np.argsort(bucket, kind="stable")
    cut = np.r_[_starts(bucket[order]), len(order)]
    rows = [order[a:b] for a, b in zip(cut[:-1], cut[1:])]
    packed = {name: pa.array([_planes(values[o]) for o in rows], pa.binary()) for name, values in columns.items()}
    return pa.table({"bucket": pa.array(bucket[order][cut[:-1]].astype(np.int64)), **packed})


def _read(rows: pa.Table, name: str, dtype) -> np.ndarray:
    parts = [_numbers(x, dtype) for x in rows.column(name).to_pylist() if x]
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def _spread(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((keys.astype(np.int64).view(np.uint64) * _P) >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)


#: Names of windows: document, version, start of the first of ``counts`` windows, and the same of their first occurrence.
_NAMED = {"docs": np.int64, "versions": np.int32, "starts": np.int64, "counts": np.int64, "first_docs": np.int64, "first_versions": np.int32, "first_starts": np.int64}
_NAMED_SCHEMA = "bucket long, " + ", ".join(f"{n} binary" for n in _NAMED)
_RUNS = "offsets", "spots", "more", "raw"
_RUNS_SCHEMA = _NAMED_SCHEMA + ", " + ", ".join(f"{n} binary" for n in _RUNS)


def _first_anchors(doc: np.ndarray, place: np.ndarray, h: np.ndarray, buckets: int):
    """Anchors of a stretch of input as one row a bucket: of each anchor the smallest and largest document.

    The documents between these two are known to share it: they come as places without a hash, dealt by document.
    """
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort([doc, h, bucket])
    order = order[_starts(h[order], doc[order])]  # one place stands for all of its document
    cut = _starts(h[order])
    ends = np.zeros(len(order), bool)
    ends[cut] = ends[np.r_[cut[1:], len(order)] - 1] = True
    asked, known = order[ends], order[~ends]
    yield _dealt(bucket[asked], {"hashes": (h[asked] >> np.uint64(32)).astype("<u4"), "docs": doc[asked], "places": place[asked]})
    if len(known):
        rows = _dealt(_spread(doc[known], buckets), {"docs": doc[known], "places": place[known]})
        yield rows.add_column(1, "hashes", pa.array([b""] * rows.num_rows, pa.binary()))


def _anchored(least: int, buckets: int, stretch: int):
    def run(batches):
        docs, places, hashes, size = [], [], [], 0
        for batch in batches:
            ids = np.asarray(batch.column("id"), np.int64)
            for held in _pieces((t.as_py() or b"" for t in batch.column("text").cast(pa.binary())), least):
                raw, begin, start, part, at, h = _windows(held, least)
                new = _starts(at, part)
                at, part = at[new], part[new]
                docs.append(ids[np.array([n for n, *_ in held])[part]])
                places.append(at - begin[part] + np.array([a for _, a, _ in held])[part])
                hashes.append(h[at])
                size += len(raw)
                if size > stretch:
                    for rows in _first_anchors(*map(np.concatenate, (docs, places, hashes)), buckets):
                        yield from rows.to_batches()
                    docs, places, hashes, size = [], [], [], 0
        if docs:
            for rows in _first_anchors(*map(np.concatenate, (docs, places, hashes)), buckets):
                yield from rows.to_batches()

    return run


def _shared(rows: pa.Table) -> pa.Table:
    """The anchors of a bucket whose hash occurs in two documents."""
    known = np.array([not x for x in rows.column("hashes").to_pylist()], bool)
    asked, rest = rows.filter(pa.array(~known)), rows.filter(pa.array(known))
    h = _read(asked, "hashes", "<u4")  # a bucket's hashes share their rest; a clash only costs work
    doc, place = _read(asked, "docs", np.int64), _read(asked, "places", np.int64)
    order = np.lexsort([doc, h])
    cut = _starts(h[order])
    size = np.diff(np.r_[cut, len(h)])
    keep = order[np.repeat(doc[order[cut]] < doc[order[cut + size - 1]], size)]
    return pa.table({"id": np.concatenate([doc[keep], _read(rest, "docs", np.int64)]), "place": np.concatenate([place[keep], _read(rest, "places", np.int64)])})


def _bit(key) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)), F.lit(0)).cast("long")


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over hashes of the ids; it only keeps texts that no id needs out of a join."""
    words = ids.select(_bit("id").alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[np.asarray(words.column("word"), np.int64)] = np.asarray(words.column("bits"), np.int64).view(np.uint64)
    return bits


def _selected(bits: np.ndarray, name: str, wanted: bool, text: str, squeezed: bool):
    """Rows whose bit in the column ``name`` is as wanted, without that column; texts compressed for a shuffle."""
    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            at = np.asarray(batch.column(name), np.int64)
            hit = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            batch = batch.filter(pa.array(hit == wanted)).drop_columns([name])
            if squeezed:
                small = [None if (t := x.as_py()) is None else squeeze(t) for x in batch.column(text).cast(pa.binary())]
                batch = batch.set_column(batch.schema.get_field_index(text), text, pa.array(small, pa.binary()))
            yield batch

    return run


def _texts(column: pa.Array, squeezed: bool) -> list[bytes | None]:
    found = column.cast(pa.binary()).to_pylist()
    if squeezed:
        expand = zstandard.ZstdDecompressor().decompress
        found = [x if x is None else expand(x) for x in found]
    return found


def _packed(found: list[tuple], least: int, parts: int, groups: int):
    """The different runs of a stretch of input, dealt by anchor; copies in larger documents refer to the smallest."""
    strings: dict[bytes, int] = {}
    of = np.array([strings.setdefault(s, len(strings)) for f in found for s in f[0]], np.int64)
    doc, version, start, spot, h = (np.concatenate([f[k] for f in found]) for k in range(1, 6))
    size = np.array([len(s) for s in strings], np.int64)
    order = np.lexsort([start, version, doc, of])
    order = order[_starts(of[order], doc[order], version[order], start[order])]
    cut = _starts(of[order])
    first = np.repeat(order[cut], np.diff(np.r_[cut, len(order)]))  # of each run the smallest equal one
    later = doc[order] > doc[first]
    sent, copies, model = order[~later], order[later], first[later]
    more = np.zeros(len(size), bool)
    more[of[copies]] = True
    # copies, whole stretches of them as one
    again = np.lexsort([start[copies], version[copies], doc[copies]])
    copies, model = copies[again], model[again]
    count = size[of[copies]] - least + 1
    if len(copies):
        shift = start[copies] - start[model]
        gap = np.r_[True, start[copies][1:] != start[copies][:-1] + count[:-1]].cumsum()
        new = _starts(gap, doc[copies], version[copies], doc[model], version[model], shift)
        one, two = copies[new], model[new]
        rows = _dealt(-1 - _spread(doc[one], groups), {"docs": doc[one], "versions": version[one], "starts": start[one], "counts": np.add.reduceat(count, new), "first_docs": doc[two], "first_versions": version[two], "first_starts": start[two]})
        for name in _RUNS:
            rows = rows.append_column(name, pa.nulls(rows.num_rows, pa.binary()))
        yield from rows.to_batches()
    # ``sent`` is ordered by string; one row for each bucket of strings
    home = (h[sent[_starts(of[sent])]] % np.uint64(parts)).astype(np.int64)
    spots = spot[sent[_starts(of[sent])]]
    text, by = list(strings), np.argsort(home, kind="stable")
    edge = np.r_[_starts(home[by]), len(by)]
    begin = np.r_[_starts(of[sent]), len(sent)]
    out: dict[str, list] = {n: [] for n in ("bucket", *_NAMED, *_RUNS)}
    for a, b in zip(edge[:-1], edge[1:]):
        u = by[a:b]
        times = begin[u + 1] - begin[u]
        k = sent[np.repeat(begin[u], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        values = {"docs": doc[k], "versions": version[k], "starts": start[k], "counts": np.repeat(np.arange(len(u)), times), "offsets": size[u], "spots": spots[u].astype(np.int32), "more": more[u].astype(np.int8)}
        out["bucket"].append(int(home[u[0]]))
        out["raw"].append(b"".join([text[x] for x in u]))
        for name in (*_NAMED, "offsets", "spots", "more"):
            out[name].append(_planes(values[name]) if name in values else None)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    out["raw"] = [squeeze(x) for x in out["raw"]]
    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if n == "bucket" else pa.binary()) for n, v in out.items()], list(out))


def _runs(least: int, parts: int, groups: int, stretch: int):
    """The bytes of the runs of windows around the kept anchors."""

    def run(batches):
        found, held_bytes = [], 0
        for batch in batches:
            ids, versions = np.asarray(batch.column("id"), np.int64), np.asarray(batch.column("version"), np.int32)
            wanted = [np.asarray(p.values, np.int64) for p in batch.column("places")]
            texts = (zstandard.ZstdDecompressor().decompress(x.as_py()) for x in batch.column("text"))
            asked: dict[int, np.ndarray] = {}
            for held in _pieces(texts, least):
                raw, begin, start, part, at, h = _windows(held, least)
                cut = _starts(at, part)
                last = np.r_[cut[1:], len(at)] - 1
                number = np.array([n for n, *_ in held])
                base = np.array([a for _, a, _ in held]) - begin  # from the piece to the document
                edge = np.searchsorted(part[cut], np.arange(len(held) + 1))
                hit = np.zeros(len(cut), bool)
                for k, n in enumerate(number.tolist()):
                    own = at[cut[edge[k] : edge[k + 1]]]
                    mine = wanted[n] - base[k]
                    mine = mine[(mine >= begin[k]) & (mine < begin[k] + len(held[k][2]) - GRAM + 1)]
                    hashes = np.unique(np.concatenate([asked.get(n, np.empty(0, np.uint64)), h[mine]]))
                    if len(held) == 1 or k == len(number) - 1:
                        asked[n] = hashes  # a long text goes on in the next piece
                    hit[edge[k] : edge[k + 1]] = np.isin(h[own], hashes)
                c, e = cut[hit], last[hit]
                if len(c):
                    whole, a, b = raw.tobytes(), start[c], start[e] + least
                    found.append(([whole[x:y] for x, y in zip(a.tolist(), b.tolist())], ids[number[part[c]]], versions[number[part[c]]], a + base[part[c]], at[c] - a, h[at[c]]))
                    held_bytes += int((b - a).sum())
                if held_bytes > stretch:
                    yield from _packed(found, least, parts, groups)
                    found, held_bytes = [], 0
        if found:
            yield from _packed(found, least, parts, groups)

    return run


class SuffixArray:
    """The sorted suffixes (of at least ``least`` bytes) of many short strings, and their common prefixes."""

    def __init__(self, raw: bytes, length: np.ndarray, least: int):
        begin = np.r_[0, np.cumsum(length)[:-1]]
        count = length - least + 1
        owner = np.repeat(np.arange(len(length)), count)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        at, left = begin[owner] + offset, length[owner] - offset
        wide = -(-int(length.max()) // 8)
        text = np.frombuffer(raw + b"\0" * (8 * wide), np.uint8)
        eight = np.lib.stride_tricks.sliding_window_view(text, 8)
        words = []
        for k in range(wide):
            word = eight[at + 8 * k].copy().view(">u8").reshape(-1).astype(np.uint64)
            spare = np.clip(8 * (k + 1) - left, 0, 8).astype(np.uint64)  # bytes past the end count as 0
            word = np.where(spare == 8, np.uint64(0), word >> (spare * np.uint64(8) % np.uint64(64)) << (spare * np.uint64(8) % np.uint64(64)))
            words.append(word)
        order = np.lexsort([left, *words[::-1]])
        self.owner, self.offset, left = owner[order], offset[order], left[order]
        common = np.zeros(max(0, len(order) - 1), np.int64)
        alive = np.ones(len(common), bool)
        for word in words:
            w = word[order]
            x = w[1:] ^ w[:-1]
            same = np.full(len(x), 8)
            some = x != 0
            same[some] = (63 - np.floor(np.log2(x[some].astype(np.longdouble))).astype(np.int64)) // 8
            common += np.where(alive, same, 0)
            alive &= ~some
        #: common[i]: bytes that suffixes i and i + 1 begin with alike.
        self.common = np.minimum(common, np.minimum(left[1:], left[:-1]))


def intervals(common: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(first, last, length) of every interval of the common-prefix tree of at least ``least``: one stack scan."""
    out, stack = [], []
    for k, d in enumerate([*common.tolist(), 0]):
        begin = k
        while stack and stack[-1][0] > d:
            length, begin = stack.pop()
            out.append((begin, k, length))
        if d >= least and (not stack or stack[-1][0] < d):
            stack.append((d, begin))
    return out


def _names(least: int, groups: int, everything: bool):
    """The first occurrence of every window of a bucket's runs; with ``everything`` also of firsts and inside documents."""

    def run(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        named = {n: _read(rows, n, t) for n, t in _NAMED.items()}
        if bucket < 0:  # copies of runs of the same stretch of input
            return _dealt(np.full(len(named["docs"]), -1 - bucket), named).append_column("copied", pa.array([True]))
        # equal runs are one string
        expand = zstandard.ZstdDecompressor().decompress
        number: dict[bytes, int] = {}
        to, shift, spots, more = [], [0], [], []
        for part in range(rows.num_rows):
            raw, ends = expand(rows.column("raw")[part].as_py()), np.cumsum(_numbers(rows.column("offsets")[part].as_py(), np.int64)).tolist()
            to += [number.setdefault(raw[a:b], len(number)) for a, b in zip([0, *ends], ends)]
            shift.append(len(to))
            spots.append(_numbers(rows.column("spots")[part].as_py(), np.int32))
            more.append(_numbers(rows.column("more")[part].as_py(), np.int8))
        strings, to = list(number), np.array(to, np.int64)
        each = [len(_numbers(x, np.int64)) for x in rows.column("counts").to_pylist()]
        of = to[named["counts"] + np.repeat(shift[:-1], each)]
        size, spot, many = np.array([len(s) for s in strings], np.int64), np.zeros(len(strings), np.int64), np.zeros(len(strings), bool)
        spot[to] = np.concatenate(spots)
        np.logical_or.at(many, to, np.concatenate(more) > 0)
        doc, version, start = named["docs"], named["versions"], named["starts"]
        order = np.lexsort([start, version, doc, of])
        order = order[_starts(of[order], doc[order], version[order], start[order])]
        cut = np.r_[_starts(of[order]), len(order)]
        lead, high = order[cut[:-1]], np.maximum.reduceat(doc[order], cut[:-1])
        copied = many.copy()
        many |= doc[lead] < high
        # all windows of all strings; a window's first occurrence is given as a window of a string's smallest run
        count = size - least + 1
        base = np.cumsum(count) - count
        owner = np.repeat(np.arange(len(strings)), count)
        offset = np.arange(len(owner)) - base[owner]
        first, shared = np.arange(len(owner)), many[owner]
        # windows in two strings need two strings around one anchor
        around: dict[bytes, list[int]] = {}
        for u, (s, k) in enumerate(zip(strings, spot.tolist())):
            around.setdefault(s[k : k + GRAM], []).append(u)
        mixed = np.array([u for us in around.values() if len(us) > 1 for u in us], np.int64)
        if len(mixed):
            suffixes = SuffixArray(b"".join([strings[u] for u in mixed]), size[mixed], least)
            w = base[mixed[suffixes.owner]] + suffixes.offset
            begin = np.flatnonzero(np.r_[True, suffixes.common < least])
            run_of, own = lead[owner[w]], np.diff(np.r_[begin, len(w)])
            place = np.lexsort([start[run_of] + offset[w], version[run_of], doc[run_of]])
            rank = np.empty(len(w), np.int64)
            rank[place] = np.arange(len(w))
            first[w] = np.repeat(w[place[np.minimum.reduceat(rank, begin)]], own)
            two = (np.minimum.reduceat(doc[run_of], begin) < np.maximum.reduceat(high[owner[w]], begin)) | (np.maximum.reduceat(copied[owner[w]].astype(np.int8), begin) > 0)
            shared[w] = np.repeat(two, own)
        model = lead[owner[first]]
        place = start[model] + offset[first]
        new = _starts(owner, doc[model], version[model], place - offset, shared)
        length = np.diff(np.r_[new, len(owner)])[shared[new]]
        new = new[shared[new]]
        times = cut[owner[new] + 1] - cut[owner[new]]
        which = np.repeat(new, times)
        k = order[np.repeat(cut[owner[new]], times) + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)]
        out = {"docs": doc[k], "versions": version[k], "starts": start[k] + offset[which], "counts": np.repeat(length, times), "first_docs": doc[model[which]], "first_versions": version[model[which]], "first_starts": place[which]}
        if not everything:
            keep = out["first_docs"] < out["docs"]
            out = {n: v[keep] for n, v in out.items()}
        dealt = _dealt(_spread(out["docs"], groups), out)
        return dealt.append_column("copied", pa.array(np.zeros(dealt.num_rows, bool)))

    return run


def _named(docs: DataFrame, least: int, text: str, key: str, everything: bool, bucket_bytes: int, bucket_runs: int, stretch: int):
    """(copies, tags, named windows, groups): steps 0 to 3 of ``docs``."""
    rows = small_batches(docs).select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    tagged = rows.withColumn("tag", F.xxhash64("text"))
    sums = saved(tagged.select("id", "tag", F.octet_length("text").cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("hash")))
    total = sums.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    firsts = saved(sums.where(F.col("n") >= least).groupBy("n", "hash").agg(F.min("id").alias("first"), F.count("*").alias("rows")).where("rows > 1"))
    copies = saved(sums.join(firsts, ["n", "hash"]).where("id > first").select("id", "tag", "first", "n").distinct())
    # different texts under one key are told apart by their place in ``tags``; nearly always there are none
    tags = saved(sums.groupBy("id").agg(F.min("tag").alias("x"), F.max("tag").alias("y")).where("x <> y").select("id").join(sums, "id").groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("tags")))

    found = rows.mapInArrow(released(_anchored(least, buckets, stretch)), "bucket long, hashes binary, docs binary, places binary").groupBy("bucket").applyInArrow(released_group(_shared), "id long, place long")
    places = found.groupBy("id").agg(F.collect_list("place").alias("places"))
    if not everything:
        places = places.join(copies.select("id").distinct().join(tags, "id", "left_anti"), "id", "left_anti")
    places = saved(places.join(tags, "id", "left"))
    kept = places.agg(F.sum(F.size("places"))).first()[0] or 0
    parts, groups = (max(1, -(-kept // bucket_runs)),) * 2
    squeezed = tagged.withColumn("bit", _bit("id")).mapInArrow(released(_selected(_bitmap(places), "bit", True, "text", True)), "id long, text binary, tag long")
    joined = squeezed.join(places, "id").select("id", "text", F.coalesce(F.array_position("tags", F.col("tag")), F.lit(0)).cast("int").alias("version"), "places")
    runs = joined.mapInArrow(released(_runs(least, parts, groups, stretch)), _RUNS_SCHEMA)
    named = runs.groupBy("bucket").applyInArrow(released_group(_names(least, groups, everything)), _NAMED_SCHEMA + ", copied boolean")
    return copies, tags, named, groups


def _covered(least: int):
    """What the named windows of a bucket's documents cover: spans that neither overlap nor touch."""

    def run(rows: pa.Table) -> pa.Table:
        doc, version, a, count = (_read(rows, n, _NAMED[n]) for n in ("docs", "versions", "starts", "counts"))
        order = np.lexsort([a, version, doc])
        doc, version, a, b = doc[order], version[order], a[order], (a + count)[order] + least - 1
        own = _starts(doc, version)
        number = np.zeros(len(doc), np.int64)
        number[own] = 1
        number = number.cumsum()
        wide = int(b.max()) + 1 if len(b) else 1
        reach = np.maximum.accumulate(b + number * wide) - number * wide  # the farthest end so far in the document
        new = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (a[1:] > reach[:-1])]) if len(doc) else np.empty(0, np.int64)
        ends = np.maximum.reduceat(reach, new) if len(new) else reach
        rows = _starts(number[new]) if len(new) else new
        edge = pa.array(np.r_[rows, len(new)].astype(np.int32))
        lists = lambda v: pa.ListArray.from_arrays(edge, pa.array(v.astype(np.int64)))
        return pa.table({"id": doc[new][rows], "version": version[new][rows], "starts": lists(a[new]), "ends": lists(ends)})

    return run


def repeated_spans(docs: DataFrame, least: int = 50, text: str = "text", key: str = "doc_id", bucket_bytes: int = 1 << 23, bucket_runs: int = 20_000, stretch: int = 1 << 22) -> DataFrame:
    """(id, spans): the bytes of each key's documents that repeat a passage of a smaller key, where there are any.

    ``spans``: array of (tag, starts, ends): byte spans in order that neither overlap nor touch, of the
    rows whose text has the ``xxhash64`` tag, or of all the key's rows where tag is null. A later copy of
    a whole text has one span. Null keys and texts take no part. Keys are whole numbers. ``bucket_bytes``:
    text behind each task of step 2; ``bucket_runs``: runs in each task of step 3; ``stretch``: input
    whose equal runs are sent once.
    """
    copies, tags, named, _ = _named(docs, least, text, key, False, bucket_bytes, bucket_runs, stretch)
    spans = named.groupBy("bucket").applyInArrow(released_group(_covered(least)), "id long, version int, starts array<long>, ends array<long>")
    spans = spans.join(tags, "id", "left").select("id", F.get("tags", F.col("version") - 1).alias("tag"), "starts", "ends")
    whole = copies.join(tags, "id", "left").select("id", F.when(F.col("tags").isNotNull(), F.col("tag")).alias("tag"), F.array(F.lit(0).cast("long")).alias("starts"), F.array("n").alias("ends"))
    return saved(spans.unionByName(whole).groupBy("id").agg(F.collect_list(F.struct("tag", "starts", "ends")).alias("spans")))


def _applied(docs: DataFrame, key: str, least: int, text: str, each, kinds: str) -> DataFrame:
    """``each(text column, spans column or None, compressed)`` over all rows.

    Texts of rows without spans are not dealt out: a bitmap tells them apart where they are read.
    """
    spans = repeated_spans(docs, least, text, key)
    bits = _bitmap(spans)
    pad = "_" * (1 + max(map(len, docs.columns)))  # longer than the table's own names
    bit, mine = f"bit{pad}", f"spans{pad}"
    marked = docs.withColumn(bit, _bit(F.col(f"`{key}`").cast("long")))
    own = lambda small: ", ".join(f"`{n}` {'binary' if small and n == text else t}" for n, t in docs.dtypes)
    tagged = docs.withColumn(bit, _bit(F.col(f"`{key}`").cast("long"))).withColumn(f"tag{pad}", F.xxhash64(F.col(f"`{text}`")))
    found = tagged.mapInArrow(released(_selected(bits, bit, True, text, True)), own(True) + f", `tag{pad}` long").join(spans.select(F.col("id").alias(f"id{pad}"), F.col("spans").alias(mine)), F.col(f"`{key}`").cast("long") == F.col(f"id{pad}"), "left")
    fits = F.get(F.filter(mine, lambda s: s["tag"].isNull() | (s["tag"] == F.col(f"tag{pad}"))), 0)
    found = found.withColumn(f"starts{pad}", fits["starts"]).withColumn(f"ends{pad}", fits["ends"]).drop(mine, f"id{pad}", f"tag{pad}")
    rest = marked.mapInArrow(released(_selected(bits, bit, False, text, False)), own(False))
    return found.mapInArrow(released(each(text, f"starts{pad}", f"ends{pad}")), kinds).unionAll(rest.mapInArrow(released(each(text, None, None)), kinds))


def _cut(text: bytes, starts: list[int], ends: list[int]) -> bytes:
    at, kept = 0, []
    for a, b in zip(starts, ends):
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def _slices(batches, text: str, starts: str | None, ends: str | None, rows: int = 256):
    """(part, texts, span starts, span ends) of small parts of batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            spans = [[x or [] for x in part.column(n).to_pylist()] if n else [[]] * part.num_rows for n in (starts, ends)]
            yield part, _texts(part.column(text), starts is not None), *spans


def _digested(text: str, starts: str | None, ends: str | None):
    def run(batches):
        for part, texts, begins, stops in _slices(batches, text, starts, ends):
            size, gone, runs, sha = [], [], [], []
            for raw, a, b in zip(texts, begins, stops):
                raw = raw or b""
                kept = _cut(raw, a, b)
                size.append(len(raw))
                gone.append(len(raw) - len(kept))
                runs.append(len(a))
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, gone, runs)), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def digest(docs: DataFrame, least: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the hash of what is kept, of every document."""
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _applied(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", least, "text", _digested, kinds)


def _cleaned(text: str, starts: str | None, ends: str | None):
    def run(batches):
        for part, texts, begins, stops in _slices(batches, text, starts, ends):
            out = [raw if raw is None or not a else _cut(raw, a, b).decode("utf-8", "ignore").encode() for raw, a, b in zip(texts, begins, stops)]
            part = part.drop_columns([starts, ends]) if starts else part
            yield part.set_column(part.schema.get_field_index(text), text, pa.array(out, pa.binary()).cast(pa.string()))

    return run


def remove_repeats(docs: DataFrame, least: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The same rows and columns with every repeated passage cut from all but the smallest key.

    A character of which only a part is cut is dropped. A null text stays null, a row with a null key
    stays as it is. Rows of one key are one document each: what they share with each other stays.
    """
    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return _applied(docs, key, least, text, _cleaned, kinds)


def _redealt(groups: int):
    """Copies dealt by the document they refer to."""

    def run(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            columns = {n: _read(rows, n, t) for n, t in _NAMED.items()}
            yield from _dealt(_spread(columns["first_docs"], groups), columns).to_batches()

    return run


def _resolved(groups: int):
    """Copies of runs with the names that the windows of their models have."""

    def run(key, named: pa.Table, copies: pa.Table) -> pa.Table:
        c, m = ({n: _read(rows, n, t) for n, t in _NAMED.items()} for rows in (copies, named))
        own = np.stack([np.r_[m["docs"], c["first_docs"]], np.r_[m["versions"], c["first_versions"]]], axis=1)
        number = np.unique(own, axis=0, return_inverse=True)[1].reshape(-1)
        wide = max(1, *(int((v[a] + v["counts"]).max()) + 1 for v, a in ((m, "starts"), (c, "first_starts")) if len(v[a])))
        begin, asked = number[: len(m["docs"])] * wide + m["starts"], number[len(m["docs"]) :] * wide + c["first_starts"]
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], (begin + m["counts"])[order]
        low, high = np.searchsorted(end, asked, "right"), np.searchsorted(begin, asked + c["counts"], "left")
        times = np.maximum(0, high - low)
        k = np.repeat(np.arange(len(asked)), times)
        j = low[k] + np.arange(len(k)) - np.repeat(np.cumsum(times) - times, times)
        a, b = np.maximum(asked[k], begin[j]), np.minimum(asked[k] + c["counts"][k], end[j])
        n = order[j]
        out = {"docs": c["docs"][k], "versions": c["versions"][k], "starts": c["starts"][k] + a - asked[k], "counts": b - a, "first_docs": m["first_docs"][n], "first_versions": m["first_versions"][n], "first_starts": m["first_starts"][n] + a - begin[j]}
        return _dealt(_spread(out["docs"], groups), out)

    return run


def _stretches(least: int):
    """Unbroken stretches of repeated windows, each as the list of the names in it.

    ``names``: (document, version, start, windows) of each part, big-endian, so that equal beginnings sort together.
    """

    def run(rows: pa.Table) -> pa.Table:
        v = {n: _read(rows, n, t) for n, t in _NAMED.items()}
        order = np.lexsort([v["starts"], v["versions"], v["docs"]])
        order = order[_starts(*(v[n][order] for n in ("docs", "versions", "starts")))]
        v = {n: x[order] for n, x in v.items()}
        ends = v["starts"] + v["counts"]
        broken = np.r_[True, v["starts"][1:] != ends[:-1]].cumsum()
        part = _starts(broken, v["docs"], v["versions"], v["first_docs"], v["first_versions"], v["first_starts"] - v["starts"])
        count = np.add.reduceat(v["counts"], part)
        names = np.stack([v["first_docs"][part], v["first_versions"][part], v["first_starts"][part], count], axis=1).astype(">i8")
        new = _starts(broken[part], v["docs"][part], v["versions"][part])
        edge, head = np.r_[new, len(part)], part[new]
        return pa.table({"id": v["docs"][head], "version": v["versions"][head], "start": v["starts"][head], "length": np.add.reduceat(count, new) + least - 1, "names": pa.array([names[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary())})

    return run


def _by_first(groups: int):
    """Each different stretch once for every bucket of first documents in it."""

    def run(batches):
        for batch in batches:
            which, bucket = [], []
            for n, raw in enumerate(batch.column("names").to_pylist()):
                homes = np.unique(_spread(np.frombuffer(raw, ">i8")[::4], groups))
                which += [n] * len(homes)
                bucket += homes.tolist()
            taken = batch.take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), *taken.columns], ["bucket", *taken.schema.names])

    return run


def _alike(one: bytes, two: bytes) -> int:
    """Windows that two lists of names begin with alike."""
    total = 0
    for at in range(0, min(len(one), len(two)), 32):
        if one[at : at + 24] != two[at : at + 24]:
            break
        a, b = (int.from_bytes(x[at + 24 : at + 32]) for x in (one, two))
        total += min(a, b)
        if a != b:
            break
    return total


def _tree(least: int, groups: int):
    """Maximal repeats among the different stretches: (group, length, stretch, offset) of all occurrences.

    A suffix begins where some stretch enters a part of a first document; suffixes that begin with one
    window are sorted by how long they go on and how they go on after that.
    """

    def run(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        lists, stretch = rows.column("names").to_pylist(), np.asarray(rows.column("stretch"), np.int64)
        low, high = np.asarray(rows.column("low"), np.int64), np.asarray(rows.column("high"), np.int64)
        parts = np.array([len(x) // 32 for x in lists], np.int64)
        table = np.frombuffer(b"".join(lists), ">i8").astype(np.int64).reshape(-1, 4)
        owner, first_part = np.repeat(np.arange(len(lists)), parts), np.cumsum(parts) - parts
        turn = np.arange(len(table)) - first_part[owner]
        offset = table[:, 3].cumsum() - table[:, 3]
        offset -= offset[first_part][owner]
        # what a part comes after: a window, or something that is nowhere else
        previous = np.roll(table, 1, axis=0)
        before = np.c_[previous[:, :2], previous[:, 2] + previous[:, 3] - 1]
        before[turn == 0] = np.c_[np.full((turn == 0).sum(), -1), np.zeros((turn == 0).sum(), np.int64), np.flatnonzero(turn == 0)]
        side = np.unique(before, axis=0, return_inverse=True)[1].reshape(-1) + 1
        again = (turn > 0) & (table == previous).all(axis=1)  # a text that repeats itself back to back begins once
        mine = np.flatnonzero((_spread(table[:, 0], groups) == bucket) & ~again)
        tails = [lists[owner[p]][32 * (turn[p] + 1) :] for p in mine]
        ranked = {t: n for n, t in enumerate(sorted(set(tails)))}
        tail = np.array([ranked[t] for t in tails], np.int64)
        text = np.unique(table[mine, :2], axis=0, return_inverse=True)[1].reshape(-1)
        wide = int((table[:, 2] + table[:, 3]).max()) + 1
        begin = text * wide + table[mine, 2]
        entries = np.unique(begin)
        a, b = np.searchsorted(entries, begin), np.searchsorted(entries, begin + table[mine, 3])
        part = np.repeat(np.arange(len(mine)), b - a)
        entry = a[part] + np.arange(len(part)) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
        inside = entries[entry] - begin[part]
        goes = table[mine, 3][part] - inside
        order = np.lexsort([tail[part], goes, entry])
        part, entry, inside, goes = part[order], entry[order], inside[order], goes[order]
        at = mine[part]
        who, off = owner[at], offset[at] + inside
        left = np.where(inside > 0, 0, side[at])
        apart = (inside == 0) & (turn[at] == 0) & (low[who] < high[who])  # several occurrences, no two after one window
        full = (table[:, 3].cumsum()[first_part[who] + parts[who] - 1] - np.r_[0, table[:, 3].cumsum()][first_part[who]]) - off + least - 1
        common = np.minimum(goes[1:], goes[:-1])
        for k in np.flatnonzero((entry[1:] == entry[:-1]) & (goes[1:] == goes[:-1])).tolist():
            common[k] += _alike(tails[part[k]], tails[part[k + 1]])
        common = np.where(entry[1:] == entry[:-1], common + least - 1, 0)
        found = intervals(common, least)
        around = np.maximum(np.r_[0, common], np.r_[common, 0])
        found += [(k, k, int(full[k])) for k in np.flatnonzero(full > around).tolist()]  # a leaf may stand for many occurrences
        out: list[tuple[np.ndarray, int, int]] = []
        for x, y, length in found:
            k = slice(x, y + 1)
            if low[who[k]].min() < high[who[k]].max() and (apart[k].any() or left[k].min() < left[k].max()):
                out.append((np.arange(x, y + 1), length, int(low[who[k]].min())))
        times = [len(k) for k, *_ in out]
        k = np.concatenate([k for k, *_ in out]) if out else np.empty(0, np.int64)
        return pa.table({"bucket": np.full(len(k), bucket, np.int64), "group": np.repeat(np.arange(len(out)), times).astype(np.int64), "first_id": np.repeat(np.array([f for *_, f in out], np.int64), times), "length": np.repeat(np.array([n for _, n, _ in out], np.int64), times), "stretch": stretch[who[k]], "offset": off[k]})

    return run


def maximal_repeats(docs: DataFrame, least: int = 50, text: str = "text", key: str = "doc_id", bucket_bytes: int = 1 << 23, bucket_runs: int = 20_000, stretch: int = 1 << 22) -> DataFrame:
    """(bucket, group, first_id, id, start, length): all occurrences of every maximal repeat.

    A group is a string of at least ``least`` bytes that occurs in two documents and whose occurrences do
    not all go on alike, neither to the left nor to the right; (bucket, group) names it, first_id is its
    smallest key, start is in UTF-8 bytes. Copies of a whole text are occurrences like all others. Text
    that repeats itself back to back with a period under ``least`` is one string: groups begin where
    it begins, not in its midst. Null keys and texts take no part; an empty table gives an empty
    one. The listing is as large as the answer; ``repeated_spans`` needs only the names and stays small.
    """
    _, _, named, groups = _named(docs, least, text, key, True, bucket_bytes, bucket_runs, stretch)
    named = saved(named)
    plain, copied = named.where("NOT copied").drop("copied"), named.where("copied").drop("copied").mapInArrow(_redealt(groups), _NAMED_SCHEMA)
    resolved = plain.groupBy("bucket").cogroup(copied.groupBy("bucket")).applyInArrow(_resolved(groups), _NAMED_SCHEMA)
    members = saved(plain.unionByName(resolved).groupBy("bucket").applyInArrow(_stretches(least), "id long, version int, start long, length long, names binary"))
    different = saved(members.groupBy("names").agg(F.min("id").alias("low"), F.max("id").alias("high")).withColumn("stretch", F.monotonically_increasing_id()))
    dealt = different.mapInArrow(_by_first(groups), "bucket long, names binary, low long, high long, stretch long")
    found = dealt.groupBy("bucket").applyInArrow(_tree(least, groups), "bucket long, group long, first_id long, length long, stretch long, offset long")
    places = members.join(different.select("names", "stretch"), "names").select("stretch", "id", "start")
    return found.join(places, "stretch").select("bucket", "group", "first_id", "id", (F.col("start") + F.col("offset")).alias("start"), "length")
