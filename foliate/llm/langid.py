"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in windows of ``STEPS`` bytes, all of them, each from either end by a gated cell:

    z = sigmoid(Ez[byte] + h Uz),  n = tanh(En[byte] + h Un),  h' = h + z (n - h)

The two states at a position give its language probabilities. A document's probabilities are the
mean of its positions'. The network is trained in numpy by backpropagation through time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

STEPS = 64
HIDDEN = 8
#: Windows run side by side.
WIDTH = 8192
#: Bounds of the training sample: texts in all, texts of each language, and characters of each text.
#: The more languages, the fewer texts of each; none is left out.
TEXTS = 1 << 18
TEXTS_PER_LANGUAGE = 1200
TEXT_CHARS = 256
TRAIN_STEPS = 300
TRAIN_WIDTH = 256
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """``cells``: for either direction (byte table, recurrent weights, start bias is in the table); ``out``: weights of both states and bias."""

    languages: tuple[str, ...]
    cells: tuple[tuple[np.ndarray, np.ndarray], ...] = ()
    out: tuple[np.ndarray, ...] = ()


def _start(languages: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Table and recurrent weights of either direction, then the output's two matrices and bias."""
    p = []
    for _ in range(2):
        p += [rng.normal(0, 0.3, (256, 2 * HIDDEN)), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 2 * HIDDEN))]
    p += [rng.normal(0, 0.3, (HIDDEN, languages)), rng.normal(0, 0.3, (HIDDEN, languages)), np.zeros(languages)]
    return [x.astype(np.float32) for x in p]


def _forward(x: np.ndarray, table: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States (steps + 1, width, hidden) and gates (steps, width, 2 hidden) over bytes (steps, width)."""
    h = np.zeros((len(x) + 1, x.shape[1], HIDDEN), np.float32)
    g = np.empty((len(x), x.shape[1], 2 * HIDDEN), np.float32)
    for t, own in enumerate(x):
        a = table[own] + h[t] @ weights
        a[:, :HIDDEN] *= 0.5
        np.tanh(a, out=a)
        a[:, :HIDDEN] = 0.5 * a[:, :HIDDEN] + 0.5
        g[t] = a
        h[t + 1] = h[t] + a[:, :HIDDEN] * (a[:, HIDDEN:] - h[t])
    return h, g


def _backward(x: np.ndarray, h: np.ndarray, g: np.ndarray, dh_out: np.ndarray, table: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of table and weights from those of the states (steps, width, hidden)."""
    dtable, dweights, dh = np.zeros_like(table), np.zeros_like(weights), np.zeros_like(h[0])
    da_all = np.empty_like(g)
    for t in range(len(x) - 1, -1, -1):
        dh = dh + dh_out[t]
        z, n = g[t][:, :HIDDEN], g[t][:, HIDDEN:]
        da = da_all[t]
        da[:, :HIDDEN] = dh * (n - h[t]) * z * (1 - z)
        da[:, HIDDEN:] = dh * z * (1 - n * n)
        dweights += h[t].T @ da
        dh = dh * (1 - z) + da @ weights.T
    flat, keys = da_all.reshape(-1, 2 * HIDDEN), x.reshape(-1)
    order = np.argsort(keys, kind="stable")
    new = np.flatnonzero(np.diff(keys[order], prepend=-1))
    dtable[keys[order][new]] = np.add.reduceat(flat[order], new, axis=0)
    return dtable, dweights


def train(texts: list[bytes], labels: list[int], languages: list[str], steps: int = TRAIN_STEPS, seed: int = 1) -> Model:
    """Adam on the cross entropy of every position's label."""
    rng = np.random.default_rng(seed)
    rows, marks = [], []
    for text, label in zip(texts, labels, strict=True):
        for at in range(0, max(1, len(text) - STEPS + 1), STEPS):
            rows.append(np.frombuffer(text[at : at + STEPS].ljust(STEPS), np.uint8))
            marks.append(label)
    data, marks = np.array(rows), np.array(marks)
    groups = [np.flatnonzero(marks == k) for k in range(len(languages))]
    p = _start(len(languages), rng)
    first, second = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for step in range(1, steps + 1):
        which = rng.integers(0, len(languages), TRAIN_WIDTH)
        pick = np.array([groups[k][rng.integers(len(groups[k]))] for k in which])
        x, y = np.ascontiguousarray(data[pick].T), marks[pick]
        one, two = _forward(x, p[0], p[1]), _forward(x[::-1], p[2], p[3])
        # At a position, the forward state has read it, and so has the backward state.
        hf, hb = one[0][1:], two[0][1:][::-1]
        logits = hf @ p[4] + hb @ p[5] + p[6]
        e = np.exp(logits - logits.max(2, keepdims=True))
        d = e / e.sum(2, keepdims=True)
        d[:, np.arange(len(y)), y] -= 1
        d /= d.shape[0] * d.shape[1]
        grads = [*_backward(x, *one, d @ p[4].T, p[0], p[1]), *_backward(x[::-1], *two, (d @ p[5].T)[::-1], p[2], p[3])]
        flat = d.reshape(-1, d.shape[2])
        grads += [hf.reshape(-1, HIDDEN).T @ flat, hb.reshape(-1, HIDDEN).T @ flat, flat.sum(0)]
        rate = 0.02 * min(1.0, step / 20, 2 * (1 - step / (steps + 1)))
        for k, grad in enumerate(grads):
            first[k] += 0.1 * (grad - first[k])
            second[k] += 0.005 * (grad * grad - second[k])
            p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.995**step)) + 1e-8)
    return Model(tuple(languages), ((p[0], p[1]), (p[2], p[3])), (p[4], p[5], p[6]))


def _states(x: np.ndarray, alive: np.ndarray, table: np.ndarray, weights: np.ndarray, order: range, out: np.ndarray) -> None:
    """States at every step; of step t only the first ``alive[t]`` columns are text."""
    width = x.shape[1]
    h, a, one = np.zeros((width, HIDDEN), np.float32), np.empty((width, 2 * HIDDEN), np.float32), np.empty((width, 2 * HIDDEN), np.float32)
    for t in order:
        n = alive[t]
        own, act, add = h[:n], a[:n], one[:n]
        np.take(table, x[t, :n], axis=0, out=act, mode="clip")
        np.matmul(own, weights, out=add)
        act += add
        np.tanh(act, out=act)
        # The gate's inputs are halved in table and weights: sigmoid(v) = (tanh(v / 2) + 1) / 2.
        gate, new = act[:, :HIDDEN], act[:, HIDDEN:]
        gate += 1
        new -= own
        new *= gate
        new *= 0.5
        own += new
        out[t, :n] = own


def _halved(array: np.ndarray) -> np.ndarray:
    out = array.copy()
    out[:, :HIDDEN] *= 0.5
    return out


def predict(raw: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """For each text, the sum of its positions' probabilities and how many positions each language labels."""
    docs, k = len(offsets) - 1, len(model.languages)
    sums, counts = np.zeros((docs, k)), np.zeros((docs, k), np.int64)
    pieces = -(-np.diff(offsets) // STEPS)
    owner = np.repeat(np.arange(docs), pieces)
    begins = offsets[owner] + STEPS * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    lengths = np.minimum(STEPS, offsets[owner + 1] - begins)
    cells = [(_halved(table), _halved(weights)) for table, weights in model.cells]
    padded = np.concatenate([raw, np.zeros(STEPS, np.uint8)])
    for at in range(0, len(owner), WIDTH):
        part = slice(at, at + WIDTH)
        order = np.argsort(-lengths[part], kind="stable")
        begin, length, who = begins[part][order], lengths[part][order], owner[part][order]
        x = np.ascontiguousarray(padded[begin[:, None] + np.arange(STEPS)].T)
        alive = [int(np.searchsorted(-length, -t, "left")) for t in range(STEPS)]
        states = [np.empty((STEPS, len(who), HIDDEN), np.float32) for _ in range(2)]
        _states(x, alive, *cells[0], range(STEPS), states[0])
        _states(x, alive, *cells[1], range(STEPS - 1, -1, -1), states[1])
        own, labels = np.zeros((len(who), k), np.float32), np.zeros((len(who), k), np.int64)
        for t in range(STEPS):
            n = alive[t]
            e = states[0][t, :n] @ model.out[0]
            e += states[1][t, :n] @ model.out[1]
            e += model.out[2]
            best = e.argmax(1)
            labels[np.arange(n), best] += 1
            np.exp(e - e[np.arange(n), best][:, None], out=e)
            e /= e.sum(1, keepdims=True)
            own[:n] += e
        for j in range(k):
            sums[:, j] += np.bincount(who, own[:, j], docs)
            counts[:, j] += np.bincount(who, labels[:, j], docs).astype(np.int64)
    return sums, counts


def training_sample(docs: DataFrame, per_language: int = TEXTS_PER_LANGUAGE, chars: int = TEXT_CHARS) -> list[tuple[str, str]]:
    """About ``per_language`` texts of each language at most, ``chars`` characters of each, from a hashed place.

    Only documents whose crc32(doc_id as text) mod 3 is not 1 and that have a language are taken.
    Repeated rows count once; so do texts with the same slice.
    """
    rows = docs.select("doc_id", "lang", "text").where("lang is not null and text is not null and text <> ''").where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 != 1)
    chance = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 30)) / float(1 << 30)
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(chance).alias("least")).orderBy("lang").collect()
    if not counts:
        return []
    per_language = max(1, min(per_language, TEXTS // len(counts)))
    share = docs.sparkSession.createDataFrame([(r["lang"], max(r["least"], min(1.0, 1.2 * per_language / r["n"]))) for r in counts], "lang string, share double")
    size = F.greatest(F.lit(1), F.length("text") - chars + 1).cast("long")
    cut = F.substring(F.col("text"), (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), size) + 1).cast("int"), F.lit(chars))
    picked = rows.join(F.broadcast(share), "lang").where(chance <= F.col("share")).select("lang", cut.alias("text"), chance.alias("at")).groupBy("lang", "text").agg(F.min("at").alias("at"))
    taken: dict[str, list[str]] = {}
    for r in picked.orderBy("at", "text").limit((2 * per_language + 8) * len(counts)).collect():
        if len(own := taken.setdefault(r["lang"], [])) < per_language:
            own.append(r["text"])
    return [(lang, text) for lang in sorted(taken) for text in taken[lang]]


def fit(docs: DataFrame) -> Model:
    """Trained on ``training_sample``; without any, a model that knows no language."""
    rows = training_sample(docs)
    languages = sorted({lang for lang, _ in rows})
    if not rows:
        return Model(())
    return train([t.encode() for _, t in rows], [languages.index(lang) for lang, _ in rows], languages)


def label(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score, n_positions, label_share)`` for each input row.

    ``score`` is the predicted language's pooled probability, ``label_share`` its share of the
    positions' labels. Texts that are null or have no letter are ``und`` with score 0; so are all
    texts if the model knows no language.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letters"))
    names = np.array([*model.languages, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            n = np.diff(offsets)
            known = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool) & bool(model.languages)
            if model.languages:
                sums, counts = predict(raw, offsets, model)
                best = np.where(known, sums.argmax(1), len(model.languages))
                at = np.minimum(best, len(model.languages) - 1)
                score, share = (np.where(known, x[np.arange(len(n)), at] / np.maximum(n, 1), 0.0) for x in (sums, counts))
            else:
                best, score, share = np.zeros(len(n), np.int64), np.zeros(len(n)), np.zeros(len(n))
            columns = [batch.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(n), pa.array(share)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "n_positions", "label_share"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, n_positions long, label_share double")


def identify(docs: DataFrame) -> DataFrame:
    """The query's rows: ``label`` with ``held_out``, which marks documents that training never saw."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    return label(docs, fit(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_positions", "label_share")
