"""SimHash near-duplicates by similarity: long fingerprints in BK-trees, then exact Jaccard.

Two documents are near copies if their sets of five-word shingles have a Jaccard similarity of 0.8
or more. Sets of similarity s, of about one size, share c = 2s / (1 + s) of their shingles, and each
bit of their fingerprints differs with a probability of arccos(c) / pi: at 0.8 about 15 %. That is
too many of 64 bits for the exact shards of ``simhash.links``, and of any number of bits for shards by
bits alone: either a shard holds much that is unrelated, or a fingerprint goes to very many. So the
fingerprints have ``BITS`` bits, and a shard is the documents that agree on a band of MinHashes. The bands,
16 of six, are as many for any number of documents; a pair of the least similarity meets in one with a
probability of ``RECALL``, and documents that share a fifth of their shingles with one of a thousand.

In every shard a BK-tree, as for ``simhash``, links what lies within ``radius``. The exact similarity
decides within the components of these links. Equal word sequences are looked at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, mixed, packed, row_keys, slices, text_bytes
from .paragraphs import BUCKET_PARAGRAPHS, RECALL, SHINGLE_WORDS, SIMILARITY, SLICE_BYTES, Words, _links, _minhashes, _shingles, _shingles_of_rows, bands, contents
from .simhash import SHINGLES_AT_ONCE, TREE_NODES, first_rows, search

BITS = 128
#: MinHashes that the bands of a text may take.
HASHES = 128


def differing(similarity: float) -> float:
    """The share of bits at which fingerprints of this similarity are expected to differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius(similarity: float = SIMILARITY, bits: int = BITS) -> int:
    """Two and a half deviations above the bits expected to differ."""
    p = differing(similarity)
    return math.ceil(bits * p + 2.5 * math.sqrt(bits * p * (1 - p)))


def _shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """``(start, contents, sets)`` of some texts at a time, a text's content being 128 bits of its words in order; a text of fewer words than a shingle has itself as its only one."""
    raw, offsets = text_bytes(texts)
    for i, j in slices(offsets, SLICE_BYTES):
        words = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        content, first = contents(words.hashes, words.first[:-1], words.first[1:]), words.first.tolist()
        yield i, content, [np.unique(own) if len(own := _shingles(words.hashes[a:b], SHINGLE_WORDS)) else content[t : t + 1, 0] for t, (a, b) in enumerate(zip(first, first[1:], strict=False))]


def _fingerprint(shingles: np.ndarray) -> np.ndarray:
    """``BITS`` bits as two numbers; a bit is set if it is set in over half the shingles' hashes."""
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), SHINGLES_AT_ONCE):
        part = shingles[at : at + SHINGLES_AT_ONCE]
        both = np.column_stack([mixed(part + np.uint64(k)) for k in (0x5851F42D4C957F2D, 0x14057B7EF767814F)])
        count += np.unpackbits(both.view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(2 * count > len(shingles), bitorder="little").view(np.uint64)


def _sketches(rows: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """``(k1, k2, doc_id, c1, c2, low, high, bands)`` of all texts; c1 and c2 are equal for equal words, low and high are the fingerprint."""
    count, height = shape
    names = ["k1", "k2", "doc_id", "c1", "c2", "low", "high", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, content, sets in _shingle_sets(batch.column("text")):
                found = np.array([_fingerprint(own) for own in sets], np.uint64).reshape(-1, 2).view(np.int64)
                ends = np.cumsum([0, *map(len, sets)])
                small = _minhashes(np.concatenate(sets), ends[:-1], ends[1:], count * height)
                keys = np.column_stack([_shingles_of_rows(small[:, b * height : (b + 1) * height], b) for b in range(count)])
                columns = [batch.column(c).slice(i, len(sets)) for c in ("k1", "k2", "doc_id")]
                columns += [pa.array(x) for x in (*content.view(np.int64).T, *found.T)]
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * count, pa.int32()), pa.array(keys.reshape(-1).view(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.select("k1", "k2", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{n} long" for n in names[:-1]) + ", bands array<long>")


def _sets(rows: DataFrame) -> DataFrame:
    """``(content, shingles)`` from ``content`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, sets in _shingle_sets(batch.column("text")):
                ends = np.cumsum([0, *map(len, sets)])
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("content").slice(i, len(sets)), listed], names=["content", "shingles"])

    return rows.select("content", "text").mapInArrow(run, "content long, shingles array<long>")


def groups(unique: DataFrame, similarity: float = SIMILARITY, tree_nodes: int = TREE_NODES) -> DataFrame:
    """``(fp, group)`` of the texts ``(fp, low, high, bands)`` whose fingerprints have links to others, or equal ones."""
    node = F.xxhash64("low", "high")
    placed = unique.select("low", "high", F.explode("bands").alias("shard")).distinct()
    found = search(placed, ("low", "high"), radius(similarity), tree_nodes)
    edges = found.select(F.xxhash64("a_low", "a_high").alias("a"), F.xxhash64("b_low", "b_high").alias("b"))
    labels = components(edges).withColumnRenamed("label", "root")
    grouped = unique.select("fp", node.alias("node")).join(labels, "node", "left").select("fp", F.coalesce("root", "node").alias("group"))
    several = materialize(grouped.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group"), "groups")
    return grouped.join(several, "group")


def representatives(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, bucket: int = BUCKET_PARAGRAPHS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """The rows of ``docs``, one of each component of near copies: that with the smallest doc_id.

    A pair of the least similarity meets with a probability of about ``recall``; texts of a few words
    meet less surely. Texts without words are equal. Ties are settled as in ``simhash.representatives``.
    """
    rows = packed(docs, "doc_id", "text").select("*", *row_keys())
    found = materialize(_sketches(rows, bands(similarity, recall, HASHES)), "sketches")
    unique = found.groupBy("c1", "c2").agg(F.min(F.struct("k1", "k2", "low", "high", "bands")).alias("own")).select("c1", "c2", "own.*")
    # Each different text has a number of its own from here on: no hash of it has to be unique.
    unique = materialize(unique.withColumn("fp", F.monotonically_increasing_id()), "unique-documents")
    grouped = materialize(groups(unique, similarity, tree_nodes), "grouped-documents")
    wanted = unique.join(grouped.select("fp"), "fp", "left_semi").select("k1", "k2", F.col("fp").alias("content"))
    sets = materialize(_sets(rows.select("k1", "k2", "text").join(wanted, ["k1", "k2"])).dropDuplicates(["content"]), "shingle-sets")
    met = grouped.select(F.col("fp").alias("content"), F.col("group").alias("band"))
    labels = components(_links(met.join(sets, "content"), similarity, bucket)).select(F.col("node").alias("fp"), F.col("label").alias("root"))
    roots = unique.select("fp").join(labels, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return first_rows(rows, found.join(unique.select("c1", "c2", "fp"), ["c1", "c2"]), roots)
