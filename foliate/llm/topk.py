"""Exact top-k search by inner product, term at a time.

Vectors become sparse rows of whole weights (their components times 64, rounded down). A block of
candidates holds a postings list for each component that isn't zero in it. The queries come in
blocks of bounded size; each scatters its weighted postings into a dense array of scores, a term at
a time. The best of every block are selected, and the blocks' selections merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch_path

SCALE = 64
K = 20
#: Queries sent to all tasks at a time, and candidates whose scores are held at a time.
QUERY_BLOCK = 8192
CANDIDATE_BLOCK = 1 << 14


def usable(vector: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def weights(vectors: DataFrame) -> DataFrame:
    """``(vec_id, w array<long>)`` of the usable rows that have an id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("w"))


def _best(ids: np.ndarray, scores: np.ndarray, k: int, without: np.ndarray | None = None) -> np.ndarray:
    """Indices of the k highest scores, ties to smaller ids; those in ``without`` don't count."""
    left = 0 if without is None else len(without)
    if len(scores) > k + left:
        least = np.partition(scores, len(scores) - k - left)[len(scores) - k - left]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    if left:
        some = some[~np.isin(some, without)]
    return some[np.lexsort((ids[some], -scores[some].astype(np.int64)))[:k]]


class Postings:
    """A block of candidates by term: which of them have it, and their weights."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, terms: np.ndarray, values: np.ndarray):
        keep = values != 0
        rows, terms, values = rows[keep], terms[keep], values[keep]
        order = np.argsort(terms, kind="stable")
        rows, values = rows[order], values[order]
        found, begins = np.unique(terms[order], return_index=True)
        self.ids = ids
        self.lists: dict[int, tuple[slice | np.ndarray, np.ndarray]] = {}
        for t, i, j in zip(found.tolist(), begins.tolist(), np.append(begins[1:], len(order)).tolist(), strict=True):
            if 2 * (j - i) < len(ids):
                self.lists[t] = rows[i:j], values[i:j]
            else:  # a list of most candidates is kept with the others' zeros, and needs no places
                full = np.zeros(len(ids), np.int64)
                full[rows[i:j]] = values[i:j]
                self.lists[t] = slice(None), full
        self.small = {t: own.astype(np.int32) for t, (_, own) in self.lists.items() if len(own) and np.abs(own).max() < 1 << 15}
        #: What a candidate's weights add up to at most, in size.
        self.heaviest = int(np.bincount(rows, np.abs(values).astype(float), len(ids)).max(initial=0)) + 1
        self.order = np.argsort(ids, kind="stable")
        self.sorted = ids[self.order]
        self._part = {k: np.empty(len(ids), k) for k in (np.int32, np.int64)}
        self._out = {k: np.empty(len(ids), k) for k in (np.int32, np.int64)}

    def scores(self, query: int, weights: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Every candidate's score, and the places of those with the query's id. The array is used again for the next query."""
        # Whole numbers of 32 bits hold most scores; where they might not, 64 bits do.
        narrow = len(self.small) == len(self.lists) and self.heaviest * max(map(abs, weights), default=0) < 1 << 31
        kind = np.int32 if narrow else np.int64
        out, part = self._out[kind], self._part[kind]
        out[:] = 0
        for term, weight in enumerate(weights):
            if weight and term in self.lists:
                rows, values = self.lists[term]
                own = part[: len(values)]
                np.multiply(self.small[term] if narrow else values, kind(weight), out=own)
                out[rows] += own
        i, j = np.searchsorted(self.sorted, (query, query + 1))
        return out, self.order[i:j]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Postings]:
    held: list[pa.RecordBatch] = []
    size = 0

    def made() -> Postings:
        part = pa.Table.from_batches(held).combine_chunks()
        column = part.column("w").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        sizes = np.diff(column.offsets.to_numpy())
        rows = np.repeat(np.arange(len(sizes)), sizes)
        return Postings(part.column("vec_id").to_numpy(), rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes), column.flatten().to_numpy())

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= CANDIDATE_BLOCK:
            yield made()
            held, size = [], 0
    if size:
        yield made()


def search(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best candidates of each query, ties to smaller vec_id.

    Both tables are ``(vec_id, w)``. A query with an id that occurs several times is searched once,
    by its smallest vector; all candidates with the query's id are its own and left out. Other
    repeated candidates take a rank each. Vectors of different lengths meet in the components that
    both have. Every query is scored against every candidate, in blocks of queries.
    """
    spark = candidates.sparkSession
    queries = queries.groupBy("vec_id").agg(F.min("w").alias("w"))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    # Written once, sorted into its blocks: each block is then read without the table of vectors.
    queries = materialize(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "queries")
    path = scratch_path(spark, "topk")
    schema = "query_id long, vec_id long, score long"
    for b in range(blocks):
        own = queries.where(F.col("block") == b).select("vec_id", "w").toArrow()
        own = [(own.column("vec_id").to_numpy(), x.flatten().to_numpy(), np.append(0, np.cumsum(x.value_lengths().to_numpy()))) for x in [own.column("w").combine_chunks()]]
        sent = spark.sparkContext.broadcast(own[0])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked, flat, ends = sent.value
            ids = [np.zeros(0, np.int64) for _ in asked]
            scores = [np.zeros(0, np.int64) for _ in asked]
            for block in _blocks(batches):
                for q, query in enumerate(asked.tolist()):
                    own, same = block.scores(query, flat[ends[q] : ends[q + 1]].tolist())
                    some = _best(block.ids, own, k, same)
                    all_ids, all_scores = np.append(ids[q], block.ids[some]), np.append(scores[q], own[some].astype(np.int64))
                    best = _best(all_ids, all_scores, k)
                    ids[q], scores[q] = all_ids[best], all_scores[best]
            if len(asked):
                of = np.repeat(asked, [len(x) for x in ids])
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))], names=["query_id", "vec_id", "score"])

        candidates.mapInArrow(run, schema).write.mode("append").parquet(path)
        sent.destroy()
    found = spark.read.schema(schema).parquet(path)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, k: int = K, every: int = 20) -> DataFrame:
    """The vectors whose id ``every`` divides, searched among all."""
    rows = weights(vectors)
    return search(rows.where(F.col("vec_id") % every == 0), rows, k)


NEIGHBOURS_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT vec_id, min(w) AS w FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
  FROM q JOIN v c ON c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
