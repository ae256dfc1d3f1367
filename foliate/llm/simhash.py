"""SimHash near-duplicates, searched with BK-trees over shards of the fingerprints.

A fingerprint has 64 bits, cut into blocks; two within ``RADIUS`` differing bits agree on all blocks
but ``RADIUS`` at least. So each distinct fingerprint goes to one shard for each choice of so many
blocks and their values, and every shard builds a BK-tree: the more fingerprints, the more blocks and
the longer the shards' keys, so that a shard keeps to one tree. In it
children are keyed by their Hamming distance to the parent, and a search
follows only the edges within the radius. A shard of more than ``TREE_NODES`` fingerprints becomes
several trees, and the fingerprints of the earlier ones are looked up in each later one. The trees
are built where the shard's rows are dealt to: sending them from the driver would bring the
fingerprints of all documents there.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, packed, row_keys

SHINGLE_WORDS = 4
RADIUS = 4
TREE_NODES = 20_000
#: Shingles hashed at a time, so that a very long text needs no more memory than a short one.
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64 bits; bit i is set if it is set in over half the shingles' hashes. No words: 0."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(parts) > words:
        starts, ends = starts[: 1 - words], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, count = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        part = slice(at, at + SHINGLES_AT_ONCE)
        hashes = np.array([digest(joined[i:j], 42) for i, j in zip(starts[part].tolist(), ends[part].tolist(), strict=True)], "<u8")
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, fp long)`` and the long columns ``keep``, a row for each input row; fp holds the 64 bits as a signed number.

    A null or empty text, or one of blanks only, has fingerprint 0.
    """
    names = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(found.view(np.int64))], names=[*names, "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text")
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in [*names, "fp"]))


class BKTree:
    """Fingerprints; ``add`` links each to the components that it touches."""

    def __init__(self, radius: int):
        self.radius, self.value, self.edges, self.up = radius, [], [], []

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def touched(self, x: int) -> list[int]:
        """A node within the radius of x from every component that has one.

        Where a node matches, all that hang from it by edges within the radius are linked to it
        already, so those edges add nothing.
        """
        found, stack, radius = {}, [0] if self.value else [], self.radius
        while stack:
            i = stack.pop()
            d = (self.value[i] ^ x).bit_count()
            low, high = d - radius, d + radius
            if low <= 0:
                found.setdefault(self.top(i), i)
                low = radius + 1
            stack.extend(j for e, j in self.edges[i].items() if low <= e <= high)
        return list(found.values())

    def add(self, x: int) -> list[int]:
        """The values that x now links to, one for each component joined."""
        links = self.touched(x)
        if any(self.value[i] == x for i in links):
            return []
        new = len(self.value)
        if new:
            i = 0
            while True:
                d = (self.value[i] ^ x).bit_count()
                if d == 0:
                    return []
                j = self.edges[i].get(d)
                if j is None:
                    self.edges[i][d] = new
                    break
                i = j
        self.value.append(x)
        self.edges.append({})
        self.up.append(new)
        for i in links:
            self.up[self.top(i)] = new
        return [self.value[i] for i in links]


def shard_blocks(n: int, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> int:
    """Into how many blocks to cut the bits, so that a shard of ``n`` random fingerprints fits a tree."""
    blocks = radius + 1
    while n >> 64 * (blocks - radius) // blocks > tree_nodes // 2 and blocks < 16:
        blocks += 1
    return blocks


def shard_keys(blocks: int, radius: int = RADIUS) -> list[Column]:
    """A key for each choice of ``blocks`` - ``radius`` blocks: two fingerprints within the radius share one at least."""
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    out = []
    for number, some in enumerate(itertools.combinations(range(blocks), blocks - radius)):
        mask = sum((1 << bounds[i + 1]) - (1 << bounds[i]) for i in some)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        out.append(F.xxhash64(F.col("fp").bitwiseAND(F.lit(signed)), F.lit(number)))
    return out


def links(nodes: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES, blocks: int | None = None) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints, enough to connect all that link.

    ``nodes`` has one column ``fp`` of distinct non-null values. ``blocks`` is ``shard_blocks`` of their
    number unless given; it decides how the work is spread, not what is found.
    """
    keys = shard_keys(blocks or shard_blocks(nodes.count(), radius, tree_nodes), radius)
    placed = nodes.select("fp", F.explode(F.array(*keys)).alias("shard"))
    return search(placed, ("fp",), radius, tree_nodes).select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b")).distinct()


def search(placed: DataFrame, words: tuple[str, ...], radius: int, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Edges ``(a_<word>, b_<word>)`` between fingerprints of a shard, enough to connect all within the radius.

    ``placed`` has a row for each shard of each distinct fingerprint: ``shard`` and the long columns
    ``words`` that make up the fingerprint.
    """
    sizes = placed.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1").select("shard", F.ceil(F.col("n") / tree_nodes).cast("int").alias("trees"))
    dealt = placed.join(sizes, "shard").withColumn("own", F.pmod(F.xxhash64(*words), F.col("trees")).cast("int"))
    # Its own tree comes first in `tree`; each later tree only looks it up.
    dealt = dealt.withColumn("tree", F.explode(F.sequence("own", F.col("trees") - 1)))
    dealt = dealt.select("shard", "tree", (F.col("own") != F.col("tree")).cast("int").alias("guest"), *words)
    dealt = dealt.repartition("shard", "tree").sortWithinPartitions("shard", "tree", "guest", *words)
    names = [f"{end}_{word}" for end in "ab" for word in words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at, low = BKTree(radius), None, (1 << 64) - 1
        for batch in batches:
            out: list[tuple[int, int]] = []
            parts = [batch.column(w).to_numpy(zero_copy_only=False).view(np.uint64).tolist() for w in words]
            values = [sum(v << 64 * k for k, v in enumerate(own)) for own in zip(*parts, strict=True)] if len(words) > 1 else parts[0]
            for shard, part, guest, x in zip(batch.column("shard").to_pylist(), batch.column("tree").to_pylist(), batch.column("guest").to_pylist(), values, strict=True):
                if (shard, part) != at:
                    tree, at = BKTree(radius), (shard, part)
                if guest:
                    out += [(x, tree.value[i]) for i in tree.touched(x)]
                else:
                    out += [(x, y) for y in tree.add(x)]
            columns = [[pair[end] >> 64 * k & low for pair in out] for end in (0, 1) for k in range(len(words))]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) for c in columns], names=names)

    return dealt.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _roots(prints: DataFrame, radius: int) -> DataFrame:
    """``(fp, root, low, n)``: each fingerprint's component, its smallest doc_id and its number of rows."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "nodes")
    labels = components(links(nodes.select("fp"), radius)).select(F.col("node").alias("fp"), "label")
    return nodes.join(labels, "fp", "left").withColumn("root", F.coalesce("label", "fp")).drop("label")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fingerprint, component_id, n_component)`` for each input row.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the smallest doc_id
    that links reach. ``n_component`` counts the component's rows. Null and empty texts share
    fingerprint 0 and are linked like any others; rows with a null doc_id keep their component, but
    name none (null, if the component has no other rows). Ties and repeated rows change nothing.
    """
    prints = materialize(fingerprints(docs, words), "fingerprints")
    roots = _roots(prints, radius)
    groups = roots.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("n_component"))
    named = roots.select("fp", "root").join(groups, "root").select("fp", "component_id", "n_component")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_component")


def representatives(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs``, one of each component: that with the smallest doc_id.

    Among texts that share this doc_id, a hash decides; of repeated rows one stays. A component of
    null doc_ids keeps one row too.
    """
    rows = packed(docs, "doc_id", "text").select("*", *row_keys())
    prints = materialize(fingerprints(rows, words, ("k1", "k2")), "fingerprints")
    return first_rows(rows, prints, _roots(prints, radius).select("fp", "root"))


def first_rows(rows: DataFrame, prints: DataFrame, roots: DataFrame) -> DataFrame:
    """The first row of each root, from ``rows (row, k1, k2)``, ``prints (doc_id, k1, k2, fp)`` and ``roots (fp, root)``."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k1", "k2")).alias("first")
    own = prints.groupBy("fp").agg(first).join(roots, "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = own.select("first.k1", "first.k2")
    kept = materialize(prints.join(kept, ["k1", "k2"]).groupBy("k1", "k2").agg(F.count("*").alias("copies")), "representatives")
    held = rows.select("row", "k1", "k2").join(kept, ["k1", "k2"])
    single = held.where("copies = 1").select("row.*")
    return single.unionByName(held.where("copies > 1").dropDuplicates(["k1", "k2"]).select("row.*"))
