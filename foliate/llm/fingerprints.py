"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Every paragraph (line) hashes to a wide vector; a text's fingerprint is the sum of its paragraphs'
vectors, lane by lane, modulo a power of two. So their order doesn't matter, and a fingerprint follows
an edit by adding and subtracting paragraphs, without the rest of the text.

A vector has two parts. Eight lanes modulo 2^64 come from a cryptographic hash of the paragraph: they
tell whether two texts have the same paragraphs. 256 lanes modulo 2^16 hold the paragraph's runs of
three words, each as 1 or -1 in the lane that its hash names: the product of two such sums estimates
how many runs two texts share, with a standard error of about 1/16 of the texts' size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, powers

#: Lanes modulo 2^64, and lanes modulo 2^16.
WIDE, LANES = 8, 256
#: Words in a run.
RUN = 3
#: Bytes of text hashed at once.
SLICE = 1 << 20
#: Order buckets for each shuffle partition.
BUCKETS = 4
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Sums:
    """The vectors of n texts: ``wide`` (n x 8, modulo 2^64) and ``lanes`` (n x 256, modulo 2^16)."""

    def __init__(self, wide: np.ndarray, lanes: np.ndarray) -> None:
        self.wide, self.lanes = wide, lanes

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.wide + other.wide, self.lanes + other.lanes)

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.wide - other.wide, self.lanes - other.lanes)

    def __getitem__(self, at: slice | np.ndarray) -> Sums:
        return Sums(self.wide[at], self.lanes[at])

    def strings(self) -> list[str]:
        return [base64.b64encode(w.tobytes() + x.tobytes()).decode() for w, x in zip(self.wide, self.lanes, strict=True)]

    @staticmethod
    def of_strings(strings: list[str]) -> Sums:
        raw = np.frombuffer(b"".join(map(base64.b64decode, strings)), np.uint8).reshape(len(strings), WIDE * 8 + LANES * 2)
        return Sums(raw[:, : WIDE * 8].copy().view(np.uint64), raw[:, WIDE * 8 :].copy().view(np.uint16))

    @staticmethod
    def zero(n: int) -> Sums:
        return Sums(np.zeros((n, WIDE), np.uint64), np.zeros((n, LANES), np.uint16))

    @staticmethod
    def joined(parts: list[Sums]) -> Sums:
        return Sums(np.concatenate([p.wide for p in parts]), np.concatenate([p.lanes for p in parts]))


def _runs(texts: list[bytes]) -> np.ndarray:
    """Each text's lanes."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    up, down = powers(len(raw) + 1)
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(raw.astype(np.uint64) * up[: len(raw)], out=sums[1:])
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    n = len(start)
    if not n:
        return np.zeros((len(texts), LANES), np.uint16)
    word = mixed((sums[end] - sums[start]) * down[start])
    line = np.concatenate((np.cumsum(raw == 10)[start], -1 - np.arange(RUN)))
    here, hashes = line[:n], word.copy()
    for k in range(1, RUN):
        same = line[k : n + k] == here
        hashes += np.where(same, np.roll(word, -k) * np.uint64(_ODD[(k - 1) % 2] + 2 * k), np.uint64(0))
    first = np.concatenate(([True], here[1:] != here[:-1]))
    run = (line[RUN - 1 : n + RUN - 1] == here) | first  # in a line of fewer words, its first word stands for all of them
    hashes, of = mixed(hashes[run]), np.searchsorted(ends_of, start[run], "right")
    lane = (hashes & np.uint64(LANES - 1)).astype(np.int64)
    sign = 1 - 2 * ((hashes >> np.uint64(20)) & np.uint64(1)).astype(np.int64)
    found = np.bincount(of * LANES + lane, weights=sign, minlength=len(texts) * LANES)
    return found.astype(np.int64).reshape(len(texts), LANES).astype(np.uint16)


def _hashed(texts: list[str]) -> Sums:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    lines = [t.split(b"\n") for t in raw]
    digests = b"".join(hashlib.blake2b(x, digest_size=8 * WIDE).digest() for each in lines for x in each)
    at = np.cumsum([0, *map(len, lines)])[:-1]
    wide = np.add.reduceat(np.frombuffer(digests, np.uint64).reshape(-1, WIDE), at, axis=0)
    return Sums(wide, _runs(raw))


def lines_sums(texts: list[str]) -> Sums:
    """The vectors of texts by their lines, an empty text being one empty line."""
    parts, held, size = [], [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size > SLICE:
            parts.append(_hashed(held))
            held, size = [], 0
    if held:
        parts.append(_hashed(held))
    return Sums.joined(parts) if parts else Sums.zero(0)


def text_sums(texts: list[str]) -> Sums:
    """The vectors of whole texts; an empty text has no paragraphs, so its vector is zero."""
    found = lines_sums(texts)
    none = np.array([not t for t in texts], bool)
    found.wide[none] = 0
    return found


def likeness(a: Sums, b: Sums) -> np.ndarray:
    """From 0 to 1, row by row: twice the product over the sum of squares; 1 for equal fingerprints."""
    x, y = (s.lanes.view(np.int16).astype(np.float64) for s in (a, b))
    size = (x * x).sum(1) + (y * y).sum(1)
    shared = np.divide(2 * (x * y).sum(1), size, out=np.zeros(len(size)), where=size > 0)
    same = (a.wide == b.wide).all(1) & (a.lanes == b.lanes).all(1)
    return np.where(same, 1.0, np.clip(shared, 0.0, 1.0))


def edited(text: str, following: str) -> str:
    """``text``, its last half replaced by as many code points from the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edited_sums(own: Sums, texts: list[str], new: list[str], keep: list[int]) -> Sums:
    """The vectors of ``new`` texts that share at least the first ``keep`` code points with ``texts``: only what comes after the last line end before that is hashed."""
    cut = [t.rfind("\n", 0, k) + 1 for t, k in zip(texts, keep, strict=True)]
    gone, come = lines_sums([t[c:] for t, c in zip(texts, cut, strict=True)]), lines_sums([t[c:] for t, c in zip(new, cut, strict=True)])
    for sums, whole in ((gone, texts), (come, new)):
        sums.wide[np.array([not t for t in whole], bool)] = 0
    return own - gone + come


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in their order, each answered when the next one is there; the last of a bucket is a guard, which shows the next bucket's first text."""
    held: tuple[list, list, list, Sums] | None = None
    for batch in batches:
        ids, guard = batch.column("doc_id").to_pylist(), batch.column("guard").to_pylist()
        texts = [t or "" for t in batch.column("text").to_pylist()]
        if not texts:
            continue
        sums = text_sums(texts)
        if held:
            ids, guard, texts, sums = held[0] + ids, held[1] + guard, held[2] + texts, Sums.joined([held[3], sums])
        at = np.flatnonzero(~np.array(guard[:-1], bool))
        held = ids[-1:], guard[-1:], texts[-1:], sums[-1:]
        if len(at):
            mine = [texts[i] for i in at]
            new = [edited(texts[i], texts[i + 1]) for i in at]
            own, after = sums[at], edited_sums(sums[at], mine, new, [len(t) - len(t) // 2 for t in mine])
            columns = [[ids[i] for i in at], [len(t) for t in mine], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new], own.strings(), after.strings(), likeness(own, after), likeness(own, sums[at + 1])]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in RESULT.split(", ")])


def with_guards(docs: DataFrame) -> DataFrame:
    """``(bucket, guard, doc_id, h, text)``: rows dealt to buckets of descending doc_id (nulls last), and after each bucket a guard with the text of the next one's first row.

    Bounds are quantiles of doc_id. An id, or null, that fills several buckets is split by a hash of the
    text; the order of rows with one id is by that hash, then text. Only bounds and bucket numbers reach the driver.
    """
    spark = docs.sparkSession
    pieces = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids"), F.percentile_approx("doc_id", [i / pieces for i in range(1, pieces)], 100 * pieces).alias("bounds")).first()
    bounds = known["bounds"] or []
    of_null = max(1, pieces * (known["n"] - known["ids"]) // max(1, known["n"]))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    listed = F.lit(bounds) if bounds else F.array().cast("array<bigint>")
    above, equal = F.size(F.filter(listed, lambda b: b > F.col("doc_id"))), F.size(F.filter(listed, lambda b: b == F.col("doc_id")))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1) + F.pmod("h", F.lit(of_null))).otherwise(above + F.pmod("h", F.greatest(equal, F.lit(1))))
    rows = rows.select(bucket.cast("int").alias("bucket"), "doc_id", "h", "text")
    # The first row of each bucket: greatest id, greatest hash, least text.
    first = rows.groupBy(F.col("bucket").alias("at")).agg(F.max(F.struct(F.col("doc_id").alias("at_id"), F.col("h").alias("at_h"))).alias("x")).select("at", "x.*")
    used = sorted(r["at"] for r in first.select("at").collect())  # a row for each bucket
    after = spark.createDataFrame([(b, used[i - 1]) for i, b in enumerate(used)], "bucket int, before int")
    same = (F.col("bucket") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("h") == F.col("at_h"))
    heads = rows.join(F.broadcast(first), same).select("bucket", F.coalesce("text", F.lit("")).alias("text")).groupBy("bucket").agg(F.min("text").alias("text"))
    guards = heads.join(F.broadcast(after), "bucket").select(F.col("before").alias("bucket"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("h"), "text")
    return rows.withColumn("guard", F.lit(False)).unionByName(guards.withColumn("guard", F.lit(True)))


def audit(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` for each row of ``docs``.

    The edited text takes its last half from the start of the next document by descending doc_id, the
    last document's from the first one. A null text counts as empty, null ids come last, rows with one id follow each
    other by a hash of the text; repeated rows get rows of their own. Equal rows of one id pass through one task,
    a batch at a time. An empty table gives no rows; other columns are left out.
    """
    rows = with_guards(docs.select("doc_id", "text"))
    order = [F.col("bucket"), F.col("guard"), F.col("doc_id").desc_nulls_last(), F.col("h").desc(), F.coalesce("text", F.lit(""))]
    return rows.repartition("bucket").sortWithinPartitions(*order).select("doc_id", "text", "guard").mapInArrow(_pairs, RESULT)


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, times = batch.column("doc_id").to_pylist(), np.array(batch.column("times").to_pylist(), np.int64)
        sums = lines_sums(batch.column("paragraph").to_pylist())
        each: dict = {}
        for i, key in enumerate(ids):
            each.setdefault(key, []).append(i)
        total = [Sums((sums.wide[at] * times[at, None].astype(np.uint64)).sum(0, dtype=np.uint64)[None], (sums.lanes[at] * times[at, None].astype(np.uint16)).sum(0, dtype=np.uint16)[None]) for at in each.values()]
        if each:
            yield pa.RecordBatch.from_arrays([pa.array(list(each), pa.int64()), pa.array(Sums.joined(total).strings(), pa.string())], ["doc_id", "fingerprint"])


def _summed(table: pa.Table) -> pa.Table:
    sums = Sums.of_strings(table.column("fingerprint").to_pylist())
    one = Sums(sums.wide.sum(0, dtype=np.uint64)[None], sums.lanes.sum(0, dtype=np.uint16)[None])
    return pa.table([pa.array(table.column("doc_id").to_pylist()[:1], pa.int64()), pa.array(one.strings(), pa.string())], ["doc_id", "fingerprint"])


def changed(fingerprints: DataFrame, changes: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint)`` after paragraphs have come and gone: ``changes`` has ``(doc_id, paragraph, times)``, times -1 for one that is gone.

    Texts are not read. Changes of one batch are summed before they are shuffled. Rows with a null paragraph or
    times are left out; a doc_id without a fingerprint starts at zero, as an empty text does.
    """
    known = changes.where("paragraph is not null and times is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "paragraph", F.col("times").cast("long").alias("times"))
    both = fingerprints.select(F.col("doc_id").cast("long").alias("doc_id"), "fingerprint").unionByName(known.mapInArrow(_changes, "doc_id long, fingerprint string"))
    return both.groupBy("doc_id").applyInArrow(_summed, "doc_id long, fingerprint string")
