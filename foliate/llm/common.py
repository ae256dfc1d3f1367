"""Shared pieces: scratch tables that outlive executors, Arrow batch sizes, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialize, scratch_path  # noqa: F401
from ..sources.tables import read_table

#: Rows and bytes of an Arrow batch handed to a Python task: very long texts must not pile up.
ARROW_ROWS = 1000
ARROW_BYTES = 16 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session; the results do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def row_key(*cols: str) -> Column:
    """Tells rows apart that share an id but not a text; equal rows share it."""
    return F.xxhash64(*[F.col(c) for c in cols])


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """``names`` and the whole row as ``row``, so that no column of ``docs`` can clash with those that an operator adds."""
    column = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return docs.select(F.struct(*map(column, docs.columns)).alias("row"), *map(column, names))


def row_keys() -> list[Column]:
    """``k1`` and ``k2``: 128 bits that equal rows of doc_id and text share."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(9), "doc_id").alias("k2")]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets into them (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each; a longer row makes a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_BASE = 0x9E3779B97F4A7C15
_POWERS_KEPT = 2 << 20
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2^64.

    With ``c`` the running sums of byte times power, bytes i to j hash to (c[j] - c[i]) * inverse[i].
    """
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        if size > _POWERS_KEPT + 1:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return hashes ^ (hashes >> np.uint64(29))


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (a > b) edges."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """Connected components of an edge table ``(a long, b long)``.

    Returns ``(node, label)`` for every node that has an edge to another one; the label is the
    component's smallest node. Alternating large-star and small-star steps, each written to the
    shared folder; it ends when a step changes nothing. Null ends, loops and repeats are ignored.
    """
    now = edges.where("a is not null and b is not null and a <> b")
    now = materialize(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        now = materialize(_stars(now), "edges")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return ends.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
