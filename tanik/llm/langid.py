"""Language of a text: a bidirectional gated recurrent network over bytes, written in numpy.

A text's bytes are cut into windows of 64, at whose ends the context ends. Each direction of the network reads a window from its own
end; at every byte the two states together label the language there. A document's probabilities are
the mean of those of all its bytes. The network is trained by backpropagation through time on windows
from a bounded sample of documents whose language is known.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tanik.llm.common import fold, give_back, released, small_batches
from tanik.llm.vectors import smallest_ids

WINDOW = 64
HIDDEN = 8
#: What a text without letters gets.
NONE = "und"
#: The padding symbol after the 256 bytes.
PAD = 256


def windows(text: str) -> np.ndarray:
    """The bytes of a whole text in rows of WINDOW, padded at the end."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    rows = np.full((-(-len(raw) // WINDOW), WINDOW), PAD, np.int16)
    rows.reshape(-1)[: len(raw)] = raw
    return rows


def new_model(classes: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Small random weights; the leading axis of in/rec/bias is the direction."""
    draw = np.random.default_rng(seed)
    model = {"in": draw.normal(0, 0.4, (2, PAD + 1, 3 * HIDDEN)), "rec": draw.normal(0, 0.35, (2, HIDDEN, 3 * HIDDEN)), "bias": np.zeros((2, 3 * HIDDEN)), "out": draw.normal(0, 0.3, (2 * HIDDEN, classes)), "shift": np.zeros(classes)}
    return {k: v.astype(np.float32) for k, v in model.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _read(model, d: int, rows: np.ndarray, keep: bool):
    """States (time, batch, HIDDEN) of direction d over byte rows (time, batch); with keep, what backward needs."""
    steps, batch = rows.shape
    h = np.zeros((batch, HIDDEN), np.float32)
    states, kept = np.empty((steps, batch, HIDDEN), np.float32), []
    table, rec, H = model["in"][d] + model["bias"][d], model["rec"][d], HIDDEN
    for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
        x = table[rows[t]]
        gates = _sigmoid(x[:, : 2 * H] + h @ rec[:, : 2 * H])
        z, r = gates[:, :H], gates[:, H:]
        c = np.tanh(x[:, 2 * H :] + (r * h) @ rec[:, 2 * H :])
        if keep:
            kept.append((t, h, z, r, c))
        h = h + z * (c - h)
        states[t] = h
    return states, kept


def probabilities(model, rows: np.ndarray) -> np.ndarray:
    """Label probabilities (batch, WINDOW, classes) of every byte of rows (batch, WINDOW)."""
    turned = np.ascontiguousarray(rows.T)
    both = [_read(model, d, turned, False)[0] for d in (0, 1)]
    logits = both[0] @ model["out"][:HIDDEN] + both[1] @ model["out"][HIDDEN:] + model["shift"]
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    return logits.transpose(1, 0, 2)


def gradients(model, rows: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all bytes and its gradients, through time in both directions."""
    turned, H = np.ascontiguousarray(rows.T), HIDDEN
    read = [_read(model, d, turned, True) for d in (0, 1)]
    states = np.concatenate([read[0][0], read[1][0]], axis=2)
    logits = states @ model["out"] + model["shift"]
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    real = (turned != PAD).astype(np.float32)
    total = max(1.0, float(real.sum()))
    at = np.arange(rows.shape[0])
    loss = -float((np.log(p[:, at, label] + 1e-9) * real).sum()) / total
    p[:, at, label] -= 1
    p *= (real / total)[:, :, None]
    grads = {k: np.zeros_like(v) for k, v in model.items()}
    grads["out"] = np.einsum("tbh,tbc->hc", states, p, optimize=True)
    grads["shift"] = p.sum(axis=(0, 1))
    back = p @ model["out"].T
    for d in (0, 1):
        rec = model["rec"][d]
        carry = np.zeros((rows.shape[0], H), np.float32)
        for t, before, z, r, c in reversed(read[d][1]):
            dh = back[t, :, d * H : (d + 1) * H] + carry
            dc = dh * z * (1 - c * c)
            dz = dh * (c - before) * z * (1 - z)
            mixed = dc @ rec[:, 2 * H :].T
            dr = mixed * before * r * (1 - r)
            gates = np.concatenate([dz, dr], axis=1)
            carry = dh * (1 - z) + mixed * r + gates @ rec[:, : 2 * H].T
            every = np.concatenate([gates, dc], axis=1)
            np.add.at(grads["in"][d], turned[t], every)
            grads["rec"][d][:, : 2 * H] += before.T @ gates
            grads["rec"][d][:, 2 * H :] += (r * before).T @ dc
            grads["bias"][d] += every.sum(axis=0)
    return loss, grads


def train(rows: np.ndarray, label: np.ndarray, classes: int, steps: int = 300, batch: int = 96, rate: float = 0.02) -> dict[str, np.ndarray]:
    """Adam steps on windows (n, WINDOW), each language as often as the others."""
    model, draw = new_model(classes), np.random.default_rng(3)
    groups = [np.flatnonzero(label == c) for c in range(classes)]
    m, v = ({k: np.zeros_like(x) for k, x in model.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = np.concatenate([draw.choice(g, -(-batch // classes)) for g in groups if len(g)])
        _, grads = gradients(model, rows[pick], label[pick])
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / (size + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            model[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def _sampled(per_text: int):
    def run(batches):
        for batch in batches:
            langs, raws = [], []
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                rows = windows(text.as_py() or "")
                for k in np.unique(np.linspace(0, len(rows) - 1, per_text).astype(int)) if len(rows) else ():
                    langs.append(lang)
                    raws.append(rows[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(raws, pa.binary()), pa.array(langs, pa.string())], ["raw", "lang"])

    return run


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", most: int = 1200, per_text: int = 6, languages: int = 1000) -> tuple[dict[str, np.ndarray], list[str]]:
    """A model and its language names, learned from documents where ``learn`` (over key) holds.

    Bounded sample: of every language the ``most`` documents with the smallest hash of the key, fewer
    beyond 64 languages so that all have about 64 * ``most`` at most, and of each ``per_text`` windows
    spread over the whole text. No language is left out: more than ``languages``
    are an error, as model and sample grow with them. Of several rows of a key the smallest text counts.
    """
    rows = small_batches(docs).select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    known = rows.where("key IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(learn)
    names = sorted(r.lang for r in known.select("lang").distinct().limit(languages + 1).collect())
    if len(names) > languages:
        raise ValueError(f"more than {languages} languages: the column holds something else, or the parameter is too small")
    if not names:
        return new_model(1), []
    most = max(1, min(most, 64 * most // len(names)))
    hashed = known.select("lang", F.struct(F.xxhash64("key").alias("h"), "key").alias("hashed"))
    chosen = smallest_ids(hashed, ["lang"], "hashed", most).select(F.explode("ids").alias("id")).select("id.key")
    once = known.join(F.broadcast(chosen.distinct()), "key").groupBy("key", "lang").agg(F.min("text").alias("text"))
    sample = once.select("text", "lang").mapInArrow(_sampled(per_text), "raw binary, lang string").toArrow()
    found = sorted((lang, raw) for lang, raw in zip(sample.column("lang").to_pylist(), sample.column("raw").to_pylist()))
    data = np.frombuffer(b"".join(raw for _, raw in found), np.int16).reshape(-1, WINDOW)
    place = {name: n for n, name in enumerate(names)}
    label = np.array([place[lang] for lang, _ in found])
    model = train(data, label, len(names))
    del sample, found, data, label
    give_back()  # the driver goes on with other stages
    return model, names


def document_probabilities(model, texts: list[str], block: int = 2048) -> np.ndarray:
    """(texts, classes): the mean over all bytes of each text; zeros for an empty one."""
    cut = [windows(t) for t in texts]
    total = np.zeros((len(texts), len(model["shift"])))
    rows = np.concatenate(cut) if cut else np.empty((0, WINDOW), np.int16)
    owner = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
    for at in range(0, len(rows), block):
        part = rows[at : at + block]
        p = probabilities(model, part) * (part != PAD)[:, :, None]
        np.add.at(total, owner[at : at + block], p.sum(axis=1))
    return total / np.maximum(1e-9, total.sum(axis=1, keepdims=True))


def _named(model, names: list[str], keep: list[str]):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [t or "" for t in part.column("lang_text").to_pylist()]
                p = document_probabilities(model, texts)
                best = p.argmax(axis=1) if names else np.zeros(len(texts), int)
                sure = [bool(names) and any(map(str.isalpha, t)) for t in texts]
                pred = [names[b] if s else NONE for b, s in zip(best, sure)]
                score = [float(min(1.0, p[n, b])) if s else 0.0 for n, (b, s) in enumerate(zip(best, sure))]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "lang_score"])

    return run


def identify(docs: DataFrame, model: dict[str, np.ndarray], names: list[str], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, ``lang_pred`` and ``lang_score`` of every row.

    ``und`` with score 0 where the text is null or has no letter, or no language was learned. Repeated
    rows and nulls in kept columns stay; an empty table gives an empty one.
    """
    rows = small_batches(docs).select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").alias("lang_text"))
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(released(_named(model, names, list(keep))), f"{kinds}, lang_pred string, lang_score double")


def _selected(model, names: list[str], least: float):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [t or "" for t in part.column("text").to_pylist()]
                p = document_probabilities(model, texts)
                fine = [any(map(str.isalpha, t)) and (not names or p[n].max() >= least) for n, t in enumerate(texts)]
                found = [lang or names[p[n].argmax()] if fine[n] and names else lang for n, lang in enumerate(part.column("lang").to_pylist())]
                yield part.set_column(part.schema.get_field_index("lang"), "lang", pa.array(found, pa.string())).filter(pa.array(fine))

    return run


def keep_known_languages(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows and columns of documents without texts that are in no learned language.

    Rejected: null texts, texts without a letter, and texts whose best language has a probability
    under ``least``; if no row has a lang, nothing can be learned and every text with a letter stays. A
    null lang is filled with the language found; others stay as they are.
    """
    model, names = fit(docs, F.lit(True))
    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return small_batches(docs).mapInArrow(released(_selected(model, names, least)), kinds)


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; one quarter of the keys is held out."""
    model, names = fit(docs, fold(F.col("key"), 4) != 2)
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return identify(docs, model, names).select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
