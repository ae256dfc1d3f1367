"""Quality classifier by compression: which of two zstandard dictionaries fits a text better.

One dictionary is trained on texts labelled good, one on texts labelled bad. A text is cut into
blocks of ``BLOCK`` bytes, each compressed by either dictionary; the difference of the two summed
sizes, divided by the length, says which labelled texts it resembles. A logistic curve, fitted on
labelled texts that the dictionaries have not seen, turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed

BLOCK = 1024
LEVEL = 3
DICTIONARY_BYTES = 65536
#: Bound of the training sample: labelled documents of each class, and characters of each.
SAMPLE_PER_CLASS = 3000
SAMPLE_CHARS = 2048
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_AUTO if dictionary else zstandard.DICT_TYPE_RAWCONTENT
    made = zstandard.ZstdCompressionDict(dictionary or b" " * 8, dict_type=kind)
    made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=made, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)


def _sizes(texts, good: bytes, bad: bytes) -> np.ndarray:
    """For each text: size by the good dictionary, by the bad one, and without compression."""
    one, two = _compressor(good).compress, _compressor(bad).compress
    out = np.zeros((len(texts), 3))
    for i, text in enumerate(texts):
        a = b = 0
        for at in range(0, len(text), BLOCK):
            part = text[at : at + BLOCK]
            a += len(one(part))
            b += len(two(part))
        out[i] = a, b, len(text)
    return out


def _features(sizes: np.ndarray) -> np.ndarray:
    good, bad, raw = sizes.T
    difference, mean, length = (bad - good) / (raw + 64), (bad + good) / 2 / (raw + 64), np.log1p(np.minimum(raw, SAMPLE_CHARS))
    return np.column_stack([difference, mean, length, difference * length, mean * length, mean * mean, difference * mean])


def _scores(x: np.ndarray, model: Model) -> np.ndarray:
    z = (x - np.array(model.centre)) / np.array(model.scale)
    z = np.column_stack([np.ones(len(z)), z]) @ np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for a ridge logistic regression with an intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _dictionary(samples: list[bytes]) -> bytes:
    """Trained by zstandard; too few samples for that give their plain contents instead."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, chars: int = SAMPLE_CHARS) -> list[tuple[str, int, float]]:
    """At most ``per_class`` labelled texts of either class, a slice of ``chars`` characters of each.

    Only documents whose crc32(doc_id as text) mod 5 is not 0 are taken, in the order of a hash of
    their id; where the slice starts is hashed too. Each comes with the share of its class among all
    such labels over its share in the sample. A document labelled both ways counts once for each.
    """
    rest = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).distinct()
    counts = {r["quality"]: r["n"] for r in rest.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    chosen = [rest.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id")
    size = F.greatest(F.lit(1), F.length("text") - chars + 1).cast("long")
    cut = F.substring(F.col("text"), (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), size) + 1).cast("int"), F.lit(chars))
    rows = rows.select("doc_id", cut.alias("text")).groupBy("doc_id").agg(F.max("text").alias("text")).join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "quality").collect()
    taken = {q: max(1, sum(r["quality"] == q for r in rows)) for q in (0, 1)}
    return [(r["text"], r["quality"], counts[r["quality"]] / taken[r["quality"]]) for r in rows]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, chars: int = SAMPLE_CHARS) -> Model:
    """Dictionaries from three fifths of the sample, the curve from the rest.

    With no labels of one class, or none at all, every text gets the share of good labels as its
    score (0.5 without labels).
    """
    rows = training_sample(docs, labels, per_class, chars)
    rows = [(t.encode(), q, w) for t, q, w in rows]
    parts = {q: [t for t, k, _ in rows if k == q] for q in (0, 1)}
    learn = {q: [t for i, t in enumerate(parts[q]) if i % 5 < 3 and t] for q in (0, 1)}
    kept = [(t, q, w) for q in (0, 1) for t, w in ((t, w) for i, (t, w) in enumerate((t, w) for t, k, w in rows if k == q) if i % 5 >= 3)]
    if not learn[0] or not learn[1] or len({q for _, q, _ in kept}) < 2:
        share = np.clip((sum(q for _, q, _ in rows) + 0.5) / (len(rows) + 1), 1e-3, 1 - 1e-3)
        return Model(b"", b"", (float(np.log(share / (1 - share))), *[0.0] * 7), (0.0,) * 7, (1.0,) * 7)
    good, bad = _dictionary(learn[1]), _dictionary(learn[0])
    # A third of the texts once more by their first words: short texts need a curve of their own.
    more = [(t[: 16 << (i % 6)], q, w) for i, (t, q, w) in enumerate(kept)]
    kept = kept + more[::3]
    x, y = _features(_sizes([t for t, _, _ in kept], good, bad)), np.array([q for _, q, _ in kept], float)
    centre, scale = x.mean(0), x.std(0) + 1e-9
    w = _logistic((x - centre) / scale, y)
    # The sample holds both classes alike; the intercept moves to their true shares.
    true = {q: sum(v for _, k, v in rows if k == q) for q in (0, 1)}
    seen = {q: max(1, sum(k == q for _, k, _ in kept)) for q in (0, 1)}
    w[0] += np.log(true[1] / true[0]) - np.log(seen[1] / seen[0])
    return Model(good, bad, tuple(map(float, w)), tuple(map(float, centre)), tuple(map(float, scale)))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``score`` (0 to 1, higher: good likelier) and ``n_bytes``, ``good_bytes``, ``bad_bytes``.

    A null text scores like an empty one. One row for each input row; other columns are left out.
    """
    if clash := set(keep) & {"score", "n_bytes", "good_bytes", "bad_bytes"}:
        raise ValueError(f"columns to keep that the score adds: {sorted(clash)}; see accepted()")
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    kept = [f for f in rows.schema.fields if f.name != "text" or "text" in keep]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "good_bytes", "bad_bytes"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            sizes = _sizes(texts, model.good, model.bad)
            columns = [batch.column(f.name) for f in kept]
            columns += [pa.array(_scores(_features(sizes), model)), *(pa.array(sizes[:, i].astype(np.int64)) for i in (2, 0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), "score", "n_bytes", "good_bytes", "bad_bytes"])

    return rows.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns, whatever their names."""
    return score(packed(docs, "text"), model, keep=("row",)).where(F.col("score") >= threshold).select("row.*")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The query's rows: doc_id, held_out, score, predicted, and the sizes behind the score."""
    scored = score(docs, fit(docs, labels))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_bytes", "good_bytes", "bad_bytes")
