"""Near-duplicates and repeats against brute force, and the pipeline."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tanik.llm import minhash, oracles, queries, repeats

SMALL = "/root/testdata/sf0.001"


def corpus(seed=1):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(2, 6))) for _ in range(300)]
    say = lambda n: [draw.choice(words) for _ in range(n)]
    base, line = say(120), " ".join(say(14))
    texts = []
    for k in range(60):
        w = list(base)
        for _ in range(draw.randint(0, 9)):
            w[draw.randrange(len(w))] = draw.choice(words)
        texts.append(" ".join(w))
    texts += [" ".join(say(draw.randint(1, 80))) + "\n" + (line if k % 3 == 0 else "") for k in range(60)]
    texts += [texts[70]] * 20 + [texts[3].upper(), None, "", " \n", "one two", "ONE  two", "x" * 30000, "x" * 29000, "ab" * 400]
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "e") for k, t in enumerate(texts)], "doc_id long, text string, id string")


def components(texts, percent):
    sets = []
    for t in texts:
        raw = (t or "").encode()
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in raw).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [root(k) for k in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("percent", [85, 80])
def test_links_equal_brute_force(spark, percent):
    texts = corpus()
    want, sizes = components(texts, percent)
    rows = {r.doc_id: r for r in minhash.link_documents(frame(spark, texts), percent).collect()}
    assert [rows[k].component_id for k in range(len(texts))] == want
    assert [rows[k].n_shingles for k in range(len(texts))] == sizes
    assert all(r.kept == (r.component_id == k) for k, r in rows.items())


def test_min_and_max_estimate_similarity():
    a = {f"w{k}".encode() for k in range(900)}
    draw = random.Random(0)
    one = minhash.signature(minhash._mixed(__import__("numpy").array(sorted(hash(x) & (2**64 - 1) for x in a), "u8")))
    keep = [x for x in sorted(a) if draw.random() < 0.9]
    two = minhash.signature(minhash._mixed(__import__("numpy").array(sorted(hash(x) & (2**64 - 1) for x in keep), "u8")))
    assert abs((one == two).mean() - len(keep) / len(a)) < 0.12


def cut(texts, least=50):
    seen, out = {}, []
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - least + 1):
            if seen.setdefault(raw[p : p + least], k) < k:
                gone[p : p + least] = b"\1" * least
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        runs = sum(1 for p in range(len(gone)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed):
    texts = corpus(seed)
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digest(frame(spark, texts)).collect()}
    assert [rows[k] for k in range(len(texts))] == cut(texts)


def repeats_of(texts, least=50):
    """{(length, occurrences)} of all maximal repeats in two documents: every pair of occurrences extended by hand."""
    windows, found = {}, set()
    for n, (_, x) in enumerate(texts):
        for p in range(len(x) - least + 1):
            windows.setdefault(x[p : p + least], []).append((n, p))
    for places in windows.values():
        for k, (n, p) in enumerate(places):
            for m, q in places[:k]:
                x, y = texts[n][1], texts[m][1]
                if p and q and x[p - 1] == y[q - 1]:
                    continue
                size = least
                while p + size < len(x) and q + size < len(y) and x[p + size] == y[q + size]:
                    size += 1
                found.add(x[p : p + size])
    out = set()
    for s in found:
        places = [(n, p) for n, p in windows[s[:least]] if texts[n][1][p : p + len(s)] == s]
        if len({texts[n][0] for n, _ in places}) > 1:
            out.add((len(s), tuple(sorted((texts[n][0], p) for n, p in places))))
    return out


def groups_of(spark, texts, **sizes):
    found = {}
    for r in repeats.maximal_repeats(spark.createDataFrame(texts, "doc_id long, text string"), **sizes).collect():
        found.setdefault((r.bucket, r.group, r.length, r.first_id), []).append((r.id, r.start))
    assert all(first == min(i for i, _ in v) for (*_, first), v in found.items())
    groups = [(length, tuple(sorted(v))) for (_, _, length, _), v in found.items()]
    assert len(groups) == len(set(groups))
    return set(groups)


def raw(texts):
    return [(k, (t or "").encode()) for k, t in texts if k is not None]


def test_a_long_passage_is_one_group(spark):
    draw = random.Random(5)
    say = lambda n: " ".join("".join(draw.choice("abcdeé") for _ in range(draw.randint(2, 6))) for _ in range(n))
    passage = say(200)[:600]
    texts = [(1, "1" + say(20) + "1" + passage + "1" + say(9)), (2, "2" + say(5) + "2" + passage), (3, passage + "3" + say(30))]
    groups = groups_of(spark, texts)
    assert [length for length, _ in groups] == [len(passage.encode())] and groups == repeats_of(raw(texts))


@pytest.mark.parametrize("sizes", [{}, {"bucket_runs": 40, "bucket_bytes": 2000, "stretch": 900}])
def test_groups_are_all_maximal_repeats_with_all_occurrences(spark, sizes):
    draw = random.Random(7)
    words = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(2, 6))) for _ in range(300)]
    say = lambda n: " ".join(draw.choice(words) for _ in range(n))
    a, b, base = say(40), say(40), say(70).split()
    texts = [(5, say(9) + a + b + say(5)), (7, say(3) + a + b + say(5)), (3, say(5) + a + say(9)), (9, b + say(7)), (0, a), (1, a), (2, a + "zz" + b), (4, a), (6, a + "." + a)]
    for k in range(10, 20):
        near = list(base)
        for _ in range(draw.randint(0, 4)):
            near[draw.randrange(len(near))] = draw.choice(words)
        texts.append((k, " ".join(near)))
    texts += [(30, None), (31, ""), (None, a), (32, say(60)), (32, b), (33, b)]
    assert groups_of(spark, texts, **sizes) == repeats_of(raw(texts))


def test_a_key_with_two_texts_harms_neither(spark):
    line = "this passage of more than fifty bytes stands in three of the documents"
    texts = [(0, "alpha " + line), (1, line + " beta"), (1, "zz nothing here"), (1, line + " beta"), (2, "zz nothing here"), (2, line)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in repeats.digest(df).collect())
    n = len(line)
    assert rows == [(0, n + 6, 0), (1, 15, 0), (1, n + 5, n), (1, n + 5, n), (2, 15, 0), (2, n, n)]


def test_any_column_names(spark):
    line = "this passage of more than fifty bytes stands in three of the documents"
    df = spark.createDataFrame([(0, line, 1, "a", [3], 4, "x"), (1, "b" + line, 1, None, None, 4, "y"), (2, None, 1, "c", [5], 4, None), (None, line, 2, "d", [6], 4, "z")], "id long, body string, spans int, _bit string, _id array<int>, tag int, text string")
    out = repeats.remove_repeats(df, text="body", key="id")
    assert out.columns == df.columns and sorted((str(r.id), r.body, r.spans, r._bit, r.text) for r in out.collect()) == [("0", line, 1, "a", "x"), ("1", "b", 1, None, "y"), ("2", None, 1, "c", None), ("None", line, 2, "d", "z")]


def test_empty_tables(spark):
    none = frame(spark, ["x"]).limit(0)
    assert minhash.link_documents(none).count() == repeats.digest(none).count() == 0


def test_null_keys_and_repeated_rows(spark):
    text = " ".join(f"word{k}" for k in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (None, None)], "doc_id long, text string")
    rows = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash.link_documents(df).collect())
    assert rows == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("None", "None", True), ("None", "None", True)]
    assert sorted((str(r.doc_id), r.n_removed) for r in repeats.digest(df).collect()) == [("1", 0), ("1", 0), ("2", len(text)), ("None", 0), ("None", 0)]


def left_of(text, earlier, least=50):
    """A text without the bytes of every window that an earlier text holds, whole characters only."""
    raw, gone = text.encode(), set()
    for p in range(len(raw) - least + 1):
        if any(raw[p : p + least] in t.encode() for t in earlier):
            gone.update(range(p, p + least))
    return bytes(c for k, c in enumerate(raw) if k not in gone).decode("utf-8", "ignore")


def test_pipeline_stages_take_odd_rows(spark):
    text = "the little house stands near the river and the old mill " * 4
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, text, "en", "s", 5), (3, None, "en", "s", None), (None, text + " x", "en", None, 1), (4, "", None, "s", 0), (5, "12 34", "en", "s", 5), (6, "mail a@b.co now please", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("spans", F.lit("own")).withColumn("bit", F.lit(1)).withColumn("component_id", F.lit(7))
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), SMALL)
        assert empty.count() == 0, name
        out = stage(spark, docs, SMALL)
        assert name == "packed" or out.columns == docs.columns
        kept = sorted(str(r.doc_id) for r in out.select("doc_id").distinct().collect())
        assert kept == {"language": ["1", "2", "6", "None"], "near_duplicates": ["1", "3", "4", "5", "6", "None"], "repeated_passages": ["1", "5", "6", "None"], "personal_data": ["1", "2", "3", "4", "5", "6", "None"], "packed": ["1", "2", "3", "4", "5", "6", "None"]}[name], name


def test_pipeline_stages(spark):
    """Each stage against a brute-force version of its rule, on what the stage before has kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).cache()
    names = docs.columns
    known = corpus_pipeline.language(spark, docs, SMALL).cache()
    assert known.columns == names and known.count() >= 0.9 * docs.count()
    kept = corpus_pipeline.near_duplicates(spark, known, SMALL).cache()
    before = sorted((r.doc_id, r.text) for r in known.collect())
    want, _ = components([t for _, t in before], 80)
    assert kept.columns == names and sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({before[k][0] for k in want})
    cleaned = corpus_pipeline.repeated_passages(spark, kept, SMALL).cache()
    texts = sorted((r.doc_id, r.text) for r in kept.collect())
    left = {d: left_of(t, [x for e, x in texts if e < d]) for d, t in texts}
    rows = {r.doc_id: r for r in cleaned.collect()}
    assert cleaned.columns == names and {d: r.text for d, r in rows.items()} == {d: t for d, t in left.items() if t.strip(" ")}
    assert all(r.n_chars == len(r.text) for r in rows.values())
    private = corpus_pipeline.personal_data(spark, cleaned, SMALL)
    assert private.columns == names and private.count() == cleaned.count()
    assert private.where(F.col("text").rlike("[a-z0-9]@[a-z0-9-]+[.][a-z]")).count() == 0
    packed = corpus_pipeline.packed(spark, private, SMALL)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert packed.select("doc_id").distinct().count() == private.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "personal_data", "packed"]


def test_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)] and set(oracles.ORACLES) <= set(queries.QUERIES)
