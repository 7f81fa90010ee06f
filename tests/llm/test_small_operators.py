"""Corpus operators on small fixtures: exact rules, round trips, brute force, and odd rows."""

import hashlib
import random
import re
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tanik.llm import bpe, embeddings, hnsw, langid, packing, pii, quality, warc

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\x1c", "é" * 300, "a" * 5000, "<|endoftext|> x", "tab\t\n  new"]


def documents(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", 0, "x") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, key string")


def test_pii_matches_and_scores(spark):
    docs = documents(spark, ["mail a@b.co.uk 1.2.3.4 999.1.1.1 card 4111 1111 1111 1111; +1 (988) 555-2485 GB82 WEST 1234 5698 7654 32.", "éé a@b.c_d@e.f 1.2.3.4.5.6.7.8", *ODD])
    found = {r.doc_id: r for r in pii.digest(docs).collect()}
    assert found[0].spans == "email:5:14,ip:15:22,card:38:57,phone:59:76,iban:77:104"
    assert found[1].spans == "email:3:8,email:8:14,ip:15:22,ip:23:30"
    assert all(found[k].spans == "" and found[k].base_sha256 == hashlib.sha256(b"").hexdigest() for k in range(2, len(found)))
    scores = pii.find_pii(docs.where("doc_id = 0")).select(F.explode("pii_spans").alias("s")).select("s.kind", "s.score").collect()
    assert {r.kind: r.score for r in scores}["card"] == pytest.approx(0.9)
    clean = {r.doc_id: r.text for r in pii.redact(docs).select("doc_id", "text").collect()}
    assert clean[0] == "mail [EMAIL] [IP] 999.1.1.1 card [CARD]; [PHONE] [IBAN]." and clean[2] is None
    assert pii.digest(docs.limit(0)).count() == 0


def test_pii_very_many_matches(spark):
    """A megabyte of figures and addresses: places and redaction stay quick, and every span is at its place."""
    text = "".join(f"{n % 90 + 10}\n1.2.3.{n % 256} \U0001f600 a{n}@b.co; " for n in range(40000))
    docs = spark.createDataFrame([(1, text), (None, text[:2000]), (None, text[:2000])], "doc_id long, text string").withColumn("pii_spans", F.lit("own")).withColumn("chunks", F.lit(1))
    began = time.time()
    found = pii.digest(docs).orderBy("doc_id").collect()
    clean = pii.redact(docs.where("doc_id = 1")).first().text
    assert time.time() - began < 60 and [r.n_ip for r in found] == [r.n_email for r in found] and found[2].n_ip == 40000
    spans = [s.split(":") for s in found[2].spans.split(",")]
    assert all(re.fullmatch(r"a[0-9]+@b\.co" if kind == "email" else r"[0-9.]{7,9}", text[int(a) : int(b)]) for kind, a, b in spans)
    assert clean == "".join(f"{n % 90 + 10}\n[IP] \U0001f600 [EMAIL]; " for n in range(40000))


def test_packing_spreads_a_repeated_key(spark):
    """All rows of one key and of the null key: no shard gets more than its share."""
    docs = spark.createDataFrame([(7, "same text here")] * 600 + [(None, f"other {k}") for k in range(600)], "doc_id long, text string")
    found = packing.pack_documents(docs, BYTES, most=16, per_shard=100).collect()
    shards = {}
    for r in found:
        shards[r.sequence_id >> 40] = shards.get(r.sequence_id >> 40, 0) + 1
    assert len(shards) == 12 and max(shards.values()) < 160 and len(found) == 1200


def test_too_many_languages_are_an_error(spark):
    docs = spark.createDataFrame([(k, f"text {k}", f"l{k}") for k in range(30)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.fit(docs, F.lit(True), languages=20)


def test_pii_overlapping_spans_become_one(spark):
    texts = ["+1 2345 6789 0123 4111 1111 1111 1111@a.bc x", "x 4111 1111 1111 1111", "a@b.c" * 3, "1.1.1.1.1.1.1.1 +90 (555) 123 4567"]
    found = pii.find_pii(documents(spark, texts)).select("doc_id", "text", "pii_spans").collect()
    clean = {r.doc_id: r.text for r in pii.redact(documents(spark, texts)).collect()}
    for r in found:
        out, at = "", 0
        for s in sorted(r.pii_spans, key=lambda s: (s.start, s.end, s.kind)):
            if s.start >= at:
                out += r.text[at : s.start] + f"[{s.kind.upper()}]"
            at = max(at, s.end)
        assert clean[r.doc_id] == out + r.text[at:]


def test_bpe_equals_the_library(spark):
    library = Tokenizer.from_file(WORDS)
    draw = random.Random(3)
    texts = [*ODD, "Hello Wörld!! İstanbul ΟΔΟΣ it's 3.14", "ha" * 900 + "!" * 700, *("".join(draw.choice(["ing", "th", "a", "é", " ", "'s", "9", "<|endoftext|>"]) for _ in range(200)) for _ in range(40))]
    for r in bpe.encode(documents(spark, texts), WORDS).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)) == ids and r.decoded.decode() == library.decode(ids, skip_special_tokens=False)


def test_transducer_keeps_little():
    merges = bpe.Merges(WORDS)
    machine, library = bpe.Transducer(merges), Tokenizer.from_file(WORDS)
    text = "".join(random.Random(9).choice(["ha", "ing", "tion", "oo", "er"]) for _ in range(4000))
    out = []
    for at in range(0, len(text) - 1, 50):
        out += machine.push(text[at : min(at + 50, len(text) - 1)])
        assert len(machine.buffer) <= machine.limit + 64
    out += machine.finish(text[-1])
    assert [merges.ids[t] for t in out] == library.encode(text, add_special_tokens=False).ids


def test_readable_text_comes_back():
    coder = bpe.coder(WORDS)
    ids = coder.encode("ünlü şehir 😀 it's")
    assert "".join(coder.decoded(ids, spaced=False)).split() == ["ünlü", "şehir", "😀", "it", "'s"]


def test_decoder_holds_characters_until_they_are_whole():
    coder = bpe.coder(WORDS)
    ids = list(struct.unpack(f"<{len(raw) // 4}I", raw)) if (raw := coder.encode("𓀀 şşş 😀!" * 20)) else []
    one, all_ = bpe.Decoder(coder.bytes), bpe.Decoder(coder.bytes)
    parts = [one.push([i]) for i in ids]
    assert "".join(parts) + one.finish() == all_.push(ids) + all_.finish() and "\ufffd" not in "".join(parts) and "" in parts
    assert one.push([]) == "" and bpe.Decoder(coder.bytes).finish() == ""


def test_bpe_odd_rows(spark):
    rows = [(1, "one two"), (1, "one two"), (None, "x"), (2, None), (3, ""), (4, "\x1c\x1d"), (5, "long " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("own")).withColumn("n_tokens", F.lit(-1))
    found = bpe.digest(docs, WORDS).collect()
    library = Tokenizer.from_file(WORDS)
    for (_, text), count in zip(rows, [2, 2, 1, 0, 0, None, 9000]):
        ids = library.encode(text or "", add_special_tokens=False).ids
        same = [r for r in found if r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()]
        assert same and same[0].n_tokens == len(ids) and (count is None or len(ids) == count)
        assert same[0].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert sorted(str(r.doc_id) for r in found) == ["1", "1", "2", "3", "4", "5", "None"]
    assert bpe.encode(docs.limit(0), WORDS).count() == bpe.digest(docs.limit(0), WORDS).count() == 0


def test_packing_is_whole_and_gapless(spark):
    library = Tokenizer.from_file(BYTES)
    texts = [*ODD, "word " * 3000, "x y z"]
    rows = packing.pack_documents(documents(spark, [*texts, "x y z"]), BYTES).collect()
    for k, text in enumerate(texts):
        want = len(library.encode(text or "", add_special_tokens=False).ids) + 1
        mine = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.piece)
        assert sum(r.length for r in mine) == want and [r.start for r in mine] == list(np.cumsum([0, *(r.length for r in mine)])[:-1])
        assert all(r.length == 2048 for r in mine[1:])
    fill = {}
    for r in rows:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_packed_ids_are_those_of_the_library(spark):
    library = Tokenizer.from_file(BYTES)
    draw = random.Random(8)
    bits = ["the", " ", "  ", "\n", "\t ", "it's", "İstanbul", "ĠĊ", "😀", "é", "\u00a0", "3.14", "!!", "<|endoftext|>", "　", "x" * 130, "\x1c", "don'T", "ﬁ", "a\u0301"]
    texts = [*ODD, *("".join(draw.choice(bits) for _ in range(draw.randint(1, 60))) for _ in range(300)), " lead", "trail ", "x  y", "mixed case " * 900]
    rows = packing.pack_documents(documents(spark, texts), BYTES).collect()
    for r in rows:
        ids = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32


def test_packing_tokenises_new_words_together(monkeypatch):
    """Texts full of words not met before: the rank coder gets them many at a time, and all ids are those of the library."""

    class Counted:
        def __init__(self, words):
            self.words, self.calls = words, 0

        def encode_ordinary(self, text):
            self.calls += 1
            return self.words.encode_ordinary(text)

    draw, library = random.Random(5), Tokenizer.from_file(BYTES)
    texts = [" ".join("".join(draw.choice("abcdefgé,") for _ in range(9)) for _ in range(200)) for _ in range(100)]
    code = packing.coder(BYTES)
    monkeypatch.setattr(code, "words", counted := Counted(code.words))
    rows = [r for b in packing._pieces(BYTES, 2048, 0)([pa.record_batch({"key": list(range(100)), "text": texts})]) for r in b.to_pylist()]
    assert counted.calls < 100
    assert [r["ids_crc32"] for r in rows] == [zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for t in texts]


def test_ids_of_texts_encoded_together():
    """Odd and even texts of one batch keep their own ids and order, wherever the batch is cut."""
    library, draw = Tokenizer.from_file(BYTES), random.Random(6)
    bits = ["a", " ", "  ", "\n", "\x0b", "\x85", "é", "\u200b", " b", "c ", "'s", "x" * 101, "<|endoftext|>", "12"]
    texts = [*ODD, "\x0b", "a\x0bb c", "one\n", "\ntwo three", *("".join(draw.choice(bits) for _ in range(draw.randint(1, 30))) for _ in range(200)), None]
    ids, starts = packing.coder(BYTES).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for none in ([], [None], ["", None]):
        ids, starts = packing.coder(BYTES).encode(pa.array(none, pa.string()))
        assert len(ids) == 0 and starts.tolist() == [0] * (len(none) + 1)
    assert packing.together(pa.array(["aaa", None, "é", "b" * 9, "c", ""]), 5) == [(0, 3), (3, 4), (4, 6)]
    assert packing.together(pa.array([], pa.string())) == []


def test_packing_odd_rows_and_the_number_of_sequences(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string").withColumn("piece", F.lit("own"))
    rows = packing.pack_documents(docs, BYTES).collect()
    assert sorted((str(r.doc_id), r.length) for r in rows) == [("1", 3), ("1", 3), ("2", 1), ("None", 3)] and len({r.sequence_id for r in rows}) == 1
    assert packing.pack_documents(docs.limit(0), BYTES).count() == 0
    draw = random.Random(4)
    many = documents(spark, ["w " * draw.randint(1, 2500) for _ in range(600)])
    split = packing.pack_documents(many, BYTES, per_shard=100).collect()
    lengths = sorted((r.length for r in split), reverse=True)
    whole = len({s for s, _ in packing.best_fit(lengths, 2048)})
    assert whole <= len({r.sequence_id for r in packing.pack_documents(many, BYTES).collect()}) <= whole  # one shard is one global packing
    assert len({r.sequence_id for r in split}) <= whole + 2 * (len(lengths) // 100 + 1)  # one or two sequences for each shard
    assert whole <= -(-sum(lengths) // 2048) * 1.03 + 1


def test_best_fit_finds_the_tightest():
    draw = random.Random(2)
    lengths = sorted((draw.randint(1, 50) for _ in range(400)), reverse=True)
    left, want = [], []
    for n in lengths:
        fits = [b for b in range(len(left)) if left[b] >= n]
        b = min(fits, key=lambda b: left[b]) if fits else len(left)
        if not fits:
            left.append(50)
        left[b] -= n
        want.append(left[b])
    fill, got = {}, []
    for n, (s, _) in zip(lengths, packing.best_fit(lengths, 50)):
        fill[s] = fill.get(s, 50) - n
        got.append(fill[s])
    assert got == want


def test_quality_learns(spark):
    draw = random.Random(1)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    texts = [" ".join(word() for _ in range(40)) if k % 2 else " ".join(word().upper() + "!!" for _ in range(40)) for k in range(240)] + ODD
    labels = spark.createDataFrame([(k, k % 2) for k in range(240)] + [(None, 1), (3, None), (5, 1)], "doc_id long, quality int")
    rows = quality.classify(documents(spark, texts), labels).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 240]
    assert np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.95
    assert quality.classify(documents(spark, texts).limit(0), labels.limit(0)).count() == 0


def test_training_is_plain_ftrl():
    """The sparse update against the same update written out over dense vectors."""
    draw = np.random.default_rng(3)
    examples = []
    for k in range(60):
        index = np.unique(draw.integers(0, 1 << quality.BITS, 12))
        examples.append((index, draw.random(len(index)), int(k % 3 == 0)))
    alpha, beta, l1, l2 = 0.3, 1.0, 0.02, 0.1
    used = sorted({i for index, *_ in examples for i in index.tolist()})
    place = {i: n for n, i in enumerate(used)}
    z, n, last = [0.0] * (len(used) + 1), [0.0] * (len(used) + 1), len(used)
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha + l2)
    order = np.random.default_rng(11)
    share = np.mean([y for *_, y in examples])
    for _ in range(3):
        for k in order.permutation(len(examples)):
            index, value, y = examples[k]
            x = {**{place[i]: v for i, v in zip(index.tolist(), value.tolist())}, last: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v * (0.5 / share if y else 0.5 / (1 - share))
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
                n[i] += g * g
    found = quality.train(examples)
    assert np.allclose([found[i] for i in used], [weight(place[i]) for i in used], atol=1e-5) and found[-1] == pytest.approx(weight(last), abs=1e-5)


def test_quality_scores_are_sparse_dot_products(spark):
    weights = np.random.default_rng(2).normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    texts = ["A few Words, a few words!", "long text " * 20000, None, "", "A few Words, a few words!"]
    rows = [(1, texts[0]), (2, texts[1]), (3, None), (None, ""), (1, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(9))
    found = sorted((str(r.doc_id), r.score) for r in quality.score(docs, weights).collect())
    want = []
    for key, text in rows:
        counts = {}
        for f in quality.features(text).tolist():
            counts[f] = counts.get(f, 0) + 1
        size = sum(c * c for c in counts.values()) ** 0.5
        dot = sum(float(weights[f]) * c / size for f, c in counts.items()) + float(weights[-1])
        want.append((str(key), 1 / (1 + np.exp(-dot))))
    assert [k for k, _ in found] == sorted(k for k, _ in want) and np.allclose([s for _, s in found], [s for _, s in sorted(want)], atol=1e-5)


def test_language_probabilities_pool_every_byte():
    """States, labels and pooling against a plain loop over the bytes of each window."""
    model = {k: v.astype(float) for k, v in langid.new_model(3).items()}
    sig, H = lambda x: 1 / (1 + np.exp(-x)), langid.HIDDEN
    texts = ["short", "é" * 70 + " a longer text that fills some windows " * 4, ""]
    found = langid.document_probabilities(langid.new_model(3), texts)
    for text, p in zip(texts, found):
        raw, total = text.encode(), np.zeros(3)
        for at in range(0, len(raw), langid.WINDOW):
            row = list(raw[at : at + langid.WINDOW]) + [langid.PAD] * max(0, at + langid.WINDOW - len(raw))
            both = np.zeros((len(row), 2 * H))
            for d, order in ((0, range(len(row))), (1, range(len(row) - 1, -1, -1))):
                h, rec = np.zeros(H), model["rec"][d]
                for t in order:
                    x = model["in"][d][row[t]] + model["bias"][d]
                    gate = sig(x[: 2 * H] + h @ rec[:, : 2 * H])
                    h = (1 - gate[:H]) * h + gate[:H] * np.tanh(x[2 * H :] + (gate[H:] * h) @ rec[:, 2 * H :])
                    both[t, d * H : (d + 1) * H] = h
            for t in range(min(langid.WINDOW, len(raw) - at)):
                e = np.exp(both[t] @ model["out"] + model["shift"])
                total += e / e.sum()
        assert np.allclose(p, total / len(raw) if len(raw) else 0, atol=1e-4)


def test_language_odd_rows(spark):
    model = langid.new_model(2)
    docs = spark.createDataFrame([(1, "ab"), (1, "ab"), (2, "x " * 60000), (None, "q"), (3, "12 !"), (4, None)], "doc_id long, text string").withColumn("lang_pred", F.lit("own"))
    found = langid.identify(docs, model, ["aa", "bb"]).collect()
    assert sorted(str(r.doc_id) for r in found) == ["1", "1", "2", "3", "4", "None"] and all(0 <= r.lang_score <= 1 for r in found)
    assert {r.doc_id: r.lang_pred for r in found if r.doc_id in (3, 4)} == {3: "und", 4: "und"} and len({r.lang_score for r in found if r.doc_id == 1}) == 1


def test_language_learns(spark):
    draw = random.Random(1)
    say = lambda letters: " ".join("".join(draw.choice(letters) for _ in range(6)) for _ in range(30))
    rows = [(k, say("abcdef") if k % 2 else say("uvwxyzç"), "aa" if k % 2 else "bb") for k in range(160)] + [(900, None, "aa"), (901, "12 !", None), (None, "abcd", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in langid.classify(docs).collect()}
    assert found[900].lang_pred == found[901].lang_pred == "und" and found[900].score == 0
    assert np.mean([found[k].lang_pred == ("aa" if k % 2 else "bb") for k in range(160) if found[k].held_out]) > 0.9
    assert langid.classify(docs.limit(0)).count() == 0


def test_gradients():
    rows, label = np.random.default_rng(0).integers(0, 257, (4, 10)).astype(np.int16), np.array([0, 1, 2, 1])
    model = {k: v.astype(float) for k, v in langid.new_model(3).items()}
    _, grads = langid.gradients(model, rows, label)
    for name, at in (("rec", (0, 2, 3)), ("rec", (1, 1, 20)), ("out", (9, 1)), ("bias", (1, 5))):
        losses = []
        for step in (0.01, -0.01):
            moved = {**model, name: model[name].copy()}
            moved[name][at] += step
            losses.append(langid.gradients(moved, rows, label)[0])
        assert (losses[0] - losses[1]) / 0.02 == pytest.approx(grads[name][at], rel=0.02, abs=1e-6)


def test_documents_stay_where_no_language_is_labelled(spark):
    docs = documents(spark, ["a clean text", "ein anderer Text", "123 !!", None]).withColumn("lang", F.lit(None).cast("string"))
    found = langid.keep_known_languages(docs)
    assert found.columns == docs.columns and sorted((r.doc_id, r.text, r.lang) for r in found.collect()) == [(0, "a clean text", None), (1, "ein anderer Text", None)]


def test_every_labelled_language_is_learned(spark):
    rows = [(k, f"{chr(0x4E00 + k % 70) * 8} text", f"l{k % 70:02}") for k in range(140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, names = langid.fit(docs, F.lit(True), most=3)
    assert names == [f"l{k:02}" for k in range(70)] and model["shift"].shape == (70,)


def vectors(spark):
    draw = np.random.default_rng(5)
    base = draw.normal(size=(300, 8))
    rows = [(k, [float(x) for x in base[k % 250] + draw.normal(size=8) * (0.02 if k >= 250 else 0)], k % 3) for k in range(300)]
    rows += [(400 + k, rows[0][1], 0) for k in range(30)] + [(500, None, 0), (501, [0.0] * 8, 0), (502, [float("nan")] * 8, 0), (503, rows[1][1], None), (504, [None] * 8, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), rows


def test_vectors_link_like_brute_force(spark):
    df, rows = vectors(spark)
    good = {k: np.array(v, np.float32).astype(float) for k, v, label in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    label = {k: lb for k, _, lb in rows}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    links = {k: [j for j in good if j != k and k in good and label[j] == label[k] and label[k] is not None and cos(good[k], good[j]) >= 0.98] for k, *_ in rows}
    found = {r.vec_id: r for r in embeddings.near_duplicates(df, per_cell=40, block=16).collect()}
    assert {k: r.n_links for k, r in found.items()} == {k: len(v) for k, v in links.items()}
    for k in found:
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert found[k].component_id == min(seen) and found[k].kept == (min(seen) == k)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_vector_blocks_are_bounded_at_skew(spark, monkeypatch):
    draw, linked = np.random.default_rng(6), embeddings._linked
    base = draw.normal(size=(40, 8))
    rows = [(k, [float(x) for x in base[k % 40] + draw.normal(size=8) * 0.01], 0 if k < 500 else k) for k in range(700)]
    rows += [(0, [float(x) for x in base[0] * 3], 0), (0, [float(x) for x in base[1] * -1], 0)]

    def bounded(least):
        run = linked(least)

        def check(key, homes, others):
            assert max(homes.num_rows, others.num_rows) <= 120, "a group as large as its cell"
            return run(key, homes, others)

        return check

    monkeypatch.setattr(embeddings, "_linked", bounded)
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), per_cell=40, block=40).collect()
    x = np.array([np.array(v, np.float32).astype(float) for _, v, label in rows if label == 0])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.98).sum(axis=1) - 1
    want = sorted([(k, int(n)) for (k, _, label), n in zip([r for r in rows if r[2] == 0], links)] + [(k, 0) for k, _, label in rows if label])
    assert sorted((r.vec_id, r.n_links) for r in found) == want


def test_vectors_with_repeated_keys_and_other_lengths(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.0], 0), (3, [1.0, 0.0, 1.0, 0.0], 0), (4, [2.0, 0.0, 2.0, 0.0], 0), (5, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0), (7, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("links", F.lit(1)).withColumn("first", F.lit(1))
    found = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embeddings.near_duplicates(df).collect())
    assert found == [("1", 0, "1", True), ("1", 1, "1", True), ("2", 1, "1", False), ("3", 1, "3", True), ("4", 1, "3", False), ("5", 0, "5", True), ("7", 0, "7", True), ("None", 0, "None", True)]


def recall(rows, found, count=10):
    good = {k: np.array(v, np.float32).astype(float) for k, v in rows}
    keys, table = np.array(list(good)), np.array(list(good.values()))
    hits = total = 0
    for q in {r.query_id for r in found}:
        far = np.sqrt(((table - good[q]) ** 2).sum(axis=1))
        want = [int(k) for k in keys[np.lexsort([keys, far])] if k != q][:count]
        hits += len(set(want) & {r.vec_id for r in found if r.query_id == q})
        total += count
    return hits / total


def test_neighbours_in_shards_far_larger_than_the_search(spark):
    draw = np.random.default_rng(12)
    centres = draw.normal(size=(60, 24)) * 2
    points = centres[draw.integers(0, 60, 6000)] + draw.normal(size=(6000, 24)) * 0.7
    rows = [(k, [float(x) for x in p]) for k, p in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = hnsw.search(hnsw.index(df, per_shard=3000), df.where("vec_id % 100 = 0"), width=60).collect()  # 60 of 3,000 points kept
    assert recall(rows, found) >= 0.95


def test_neighbours_of_other_lengths_and_too_many(spark):
    rows = [(k, [float(k), 1.0], 0) for k in range(30)] + [(100, [1.0, 2.0, 3.0], 0), (200, [], 0), (None, [1.0, 1.0], 0), (0, [0.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("ids", F.lit(1))
    shards = hnsw.index(df)
    found = hnsw.search(shards, df.where("vec_id % 100 = 0")).collect()
    assert {r.query_id for r in found} == {0} and [r.vec_id for r in sorted(found, key=lambda r: r.rank)] == list(range(1, 11))
    with pytest.raises(ValueError):
        hnsw.search(shards, df, count=11)


def test_neighbours(spark):
    df, rows = vectors(spark)
    found = hnsw.search(hnsw.index(df, per_shard=90), df.where("vec_id % 10 = 0"), block=8).collect()
    good = {k: np.array(v, np.float32).astype(float) for k, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    hits = total = 0
    for q in {r.query_id for r in found}:
        want = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), k) for k, v in good.items() if k != q)[:10]
        got = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [g[0] for g in got] == list(range(1, 11)) and [(g[2], g[1]) for g in got] == sorted((g[2], g[1]) for g in got)
        hits += len({k for _, k in want} & {g[1] for g in got})
        total += 10
    assert hits / total >= 0.95
    assert hnsw.search(hnsw.index(df.limit(0)), df).count() == 0


def test_revisits(spark):
    rows = [
        (1, "http://www.a.org/x?utm_a=1&b=2#f", 10, "response", 200, {"ETag": '"1"', "Content-Type": "t", "Date": "d1"}),
        (2, "https://A.org/x?b=2", 20, "revisit", 304, {"etag": 'W/"1"', "date": "d2", "content-type": "other"}),
        (3, "http://a.org/x?b=2", 20, "response", 200, {"ETag": '"2"'}),
        (4, "http://a.org/x?b=2", 30, "revisit", 304, {"ETag": '"1"'}),
        (5, "http://a.org/y", 30, "revisit", 304, None),
        (6, "http://a.org/x?b=2", 15, "response", 404, {"ETag": '"9"'}),
        (7, None, 40, "revisit", 304, {"ETag": '"1"'}),
        (8, "http://a.org/x?b=2", None, "revisit", 304, {}),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, status_code int, headers map<string,string>")
    found = {r.record_id: r for r in warc.resolve_revisits(df).collect()}
    assert {k: (r.status, r.base_id) for k, r in found.items()} == {2: ("resolved", 1), 4: ("mismatch", 3), 5: ("no_base", None), 7: ("no_base", None), 8: ("no_base", None)}
    assert found[2].merged_headers == {"etag": 'W/"1"', "content-type": "t", "date": "d2"}
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_revisits_with_odd_headers_ties_and_repeats(spark):
    rows = [
        (1, "http://a.org/", 10, "response", 200, {"ETag": '"1"', "etag": '"1"', "Vary": "a", "vary": "b", "X": "old"}),
        (2, "http://a.org/", 10, "response", 200, {"ETag": '"2"'}),
        (3, "http://a.org/", 10, "revisit", 304, {"ETAG": '"2"', "Etag": '"2"'}),
        (4, "http://a.org", 20, "revisit", 304, {"last-modified": "x"}),
        (4, "http://a.org", 20, "revisit", 304, {"last-modified": "x"}),
        (0, "http://a.org/", 10, "revisit", 304, {"etag": '"1"'}),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, status_code int, headers map<string,string>").withColumn("slice", F.lit(1)).withColumn("base", F.lit(2))
    for slices in (1, 2, 256):
        found = sorted((r.record_id, r.status, r.base_id) for r in warc.resolve_revisits(df, slices, 2).collect())
        assert found == [(0, "no_base", None), (3, "resolved", 2), (4, "unverifiable", 2), (4, "unverifiable", 2)]
    first = warc.resolve_revisits(df.where("record_id <> 2 AND record_id <> 3").withColumn("headers", F.expr("CASE WHEN record_id = 4 THEN map('ETag', '\"1\"') ELSE headers END"))).where("record_id = 4").first()
    assert first.merged_headers == {"etag": '"1"', "vary": "a, b", "x": "old"}


def test_revisits_like_a_plain_search(spark):
    draw = random.Random(6)
    rows = [(k, f"http://h{draw.randint(0, 2)}.org/", draw.randint(0, 60), draw.choice(["response", "revisit"]), 200, {"etag": str(draw.randint(0, 3))}) for k in range(400)]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, status_code int, headers map<string,string>")
    want = {}
    for k, url, ts, kind, _, _ in rows:
        if kind == "revisit":
            earlier = [(t, j) for j, u, t, other, _, _ in rows if u == url and other == "response" and (t, j) < (ts, k)]
            want[k] = max(earlier)[1] if earlier else None
    assert {r.record_id: r.base_id for r in warc.resolve_revisits(df, 8, 10).collect()} == want
