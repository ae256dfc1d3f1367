"""Substring deduplication by paragraphs: MinHash banding, exact Jaccard, components.

A paragraph is a line of ``least`` words or more: by default ``LEAST_WORDS``, in the query every line
that has a word. A line of fewer words than a shingle is its own only shingle. Equal paragraphs are counted and sent on
once. The others meet in the buckets of their MinHash bands; bands and rows are tuned so that a pair
of the least similarity meets with a probability of ``RECALL`` or more. Within a bucket the exact
Jaccard similarity of their five-word shingles decides, and components of what it links are classes.

A passage may also stand inside longer lines. So every window of ``PASSAGE_WORDS`` words is filed
under the least hash of its ``GRAM_WORDS``-word shingles, a band of one row: two documents that
share a passage of that length share such a shingle, which is the verified repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, mixed, packed, powers, row_keys, slices, text_bytes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RECALL = 0.99
LEAST_WORDS = 20
PASSAGE_WORDS = 50
GRAM_WORDS = 20
SLICE_BYTES = 512 << 10
#: Paragraphs of a bucket compared in one task; a larger bucket becomes several, each looked up in the later ones.
BUCKET_PARAGRAPHS = 2000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LOWER[[0x20, *range(0x09, 0x0E)]] = 0


def bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = 32) -> tuple[int, int]:
    """``(bands, rows)``: the most rows to a band, and so the fewest chance meetings, that ``most`` hashes allow for the recall."""
    for rows in range(most, 0, -1):
        for count in range(1, most // rows + 1):
            if 1 - (1 - similarity**rows) ** count >= recall:
                return count, rows
    return most, 1


def _shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, in order."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    return mixed(out)


def contents(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits, as two columns, of each range of words in order."""
    up, down = powers(len(hashes) + 1)
    out = []
    for own in (hashes, mixed(hashes + np.uint64(0x5851F42D4C957F2D))):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * up[: len(own)], dtype=np.uint64)])
        out.append(mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)))
    return np.column_stack(out)


class Words:
    """The words of some texts: their hashes, and the texts and lines that they are in."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        low = _LOWER[raw]
        word = low != 0
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1] | edge[1:-1]
        end[:-1] &= ~word[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        up, down = powers(len(raw) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(low * up[: len(raw)], dtype=np.uint64)])
        self.hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        self.first = np.searchsorted(starts, offsets)  # each text's first word
        # Lines are numbered through: a text begins one, and so does every line feed.
        feed = np.flatnonzero(raw == 0x0A)
        self.line_starts = np.concatenate([offsets[:-1], feed + 1])
        self.line_texts = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, feed, "right") - 1])
        order = np.lexsort((self.line_starts, self.line_texts))
        self.line_starts, self.line_texts = self.line_starts[order], self.line_texts[order]
        self.line_first = np.append(np.searchsorted(starts, self.line_starts), len(starts))
        new = np.flatnonzero(np.diff(self.line_texts, prepend=-1))
        self.line_numbers = np.arange(len(self.line_texts)) - np.repeat(new, np.diff(np.append(new, len(self.line_texts))))

    def paragraphs(self, least: int) -> np.ndarray:
        """Indices of the lines of ``least`` words or more."""
        return np.flatnonzero(np.diff(self.line_first) >= least)


def _minhashes(shingles: np.ndarray, begins: np.ndarray, ends: np.ndarray, count: int) -> np.ndarray:
    """``count`` MinHashes (columns) of the shingle ranges; the ranges are not empty."""
    rng = np.random.default_rng(7)
    factors = rng.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, count, dtype=np.uint64)
    bounds = np.column_stack([begins, ends]).reshape(-1)
    padded = np.append(shingles, np.uint64(0))
    return np.column_stack([np.minimum.reduceat((padded * f + s) >> np.uint64(1), bounds)[::2] for f, s in zip(factors, shifts, strict=True)])


def _paragraphs(rows: DataFrame, least: int, shape: tuple[int, int]) -> DataFrame:
    """``(k1, k2, doc_id, number, words, c1, c2, bands)`` of all paragraphs; c1 and c2 are equal for equal words."""
    count, height = shape
    names = ["k1", "k2", "doc_id", "number", "words", "c1", "c2", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            ids = [batch.column(c) for c in ("k1", "k2", "doc_id")]
            for i, j in slices(offsets, SLICE_BYTES):
                words = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                own = words.paragraphs(least)
                if not len(own):
                    continue
                begin, end = words.line_first[own], words.line_first[own + 1]
                content = contents(words.hashes, begin, end)
                shingles = _shingles(words.hashes, SHINGLE_WORDS)
                short = end - begin < SHINGLE_WORDS
                low = np.where(short, len(shingles) + np.cumsum(short) - 1, begin)
                high = np.where(short, low + 1, end - SHINGLE_WORDS + 1)
                small = _minhashes(np.concatenate([shingles, content[short, 0]]), low, high, count * height)
                keys = [_shingles_of_rows(small[:, b * height : (b + 1) * height], b) for b in range(count)]
                flat = pa.array(np.column_stack(keys).reshape(-1).view(np.int64))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * count, pa.int32()), flat)
                at = pa.array(words.line_texts[own] + i)
                columns = [*(c.take(at) for c in ids), pa.array(words.line_numbers[own].astype(np.int32)), pa.array((end - begin).astype(np.int32)), *(pa.array(c) for c in content.view(np.int64).T), listed]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, "k1 long, k2 long, doc_id long, number int, words int, c1 long, c2 long, bands array<long>")


def _shingles_of_rows(small: np.ndarray, band: int) -> np.ndarray:
    out = np.full(len(small), band + 1, np.uint64)
    for column in small.T:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def _windows(rows: DataFrame, passage: int, gram: int) -> DataFrame:
    """``(gram, k1, k2, doc_id, at)``: the least shingles of all windows, each once for a row; ``at`` lists its places, in words."""
    width = passage - gram + 1
    names = ["gram", "k1", "k2", "doc_id", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            ids = [batch.column(c) for c in ("k1", "k2", "doc_id")]
            for i, j in slices(offsets, SLICE_BYTES):
                words = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = len(words.hashes)
                if n < passage:
                    continue
                grams = _shingles(words.hashes, gram)
                low = np.uint64((1 << max(24, int(n).bit_length())) - 1)  # the same for all but the longest texts
                least, size = (grams & ~low) | np.arange(len(grams), dtype=np.uint64), 1
                while 2 * size <= width:
                    least = np.minimum(least[:-size], least[size:])
                    size *= 2
                if size < width:
                    least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
                text = np.repeat(np.arange(j - i), np.diff(words.first))
                inside = text[: len(least)] == text[passage - 1 :]
                at = np.unique((least[inside] & low).astype(np.int64))
                at = at[np.lexsort((at, grams[at], text[at]))]
                if not len(at):
                    continue
                new = np.flatnonzero(np.concatenate([[True], (grams[at[1:]] != grams[at[:-1]]) | (text[at[1:]] != text[at[:-1]])]))
                own = pa.array(text[at[new]] + i)
                places = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)), pa.int32()), pa.array((at - words.first[text[at]]).astype(np.int32)))
                columns = [pa.array(grams[at[new]].view(np.int64)), *(c.take(own) for c in ids), places]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, "gram long, k1 long, k2 long, doc_id long, at array<int>")


def _shingled(rows: DataFrame) -> DataFrame:
    """``(content, shingles)``: the shingle sets of the paragraphs listed in ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, sets = [], []
            for text, wanted in zip(batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
                raw = np.frombuffer(text.as_py().encode(), np.uint8)
                words = Words(raw, np.array([0, len(raw)]))
                for w in wanted:
                    begin, end = words.line_first[w["number"]], words.line_first[w["number"] + 1]
                    content.append(w["content"])
                    own = _shingles(words.hashes[begin:end], SHINGLE_WORDS).view(np.int64)
                    sets.append(np.unique(own) if len(own) else contents(words.hashes, np.array([begin]), np.array([end]))[:, 0].view(np.int64))
            flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, sets)])
            yield pa.RecordBatch.from_arrays([pa.array(content, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["content", "shingles"])

    return rows.mapInArrow(run, "content long, shingles array<long>")


class Bucket:
    """Paragraphs that met in a band, linked where their exact similarity is high enough."""

    def __init__(self, similarity: float):
        self.similarity, self.members, self.up = similarity, [], []
        self.groups = 0  # components among the members

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        if min(len(a), len(b)) < self.similarity * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both >= self.similarity * (len(a) + len(b) - both)

    def touched(self, shingles: np.ndarray) -> list[int]:
        """A similar member of every component that has one."""
        found: dict[int, int] = {}
        for i, (_, own) in enumerate(self.members):
            if len(found) == self.groups:
                break
            if (t := self.top(i)) not in found and self.similar(own, shingles):
                found[t] = i
        return list(found.values())

    def add(self, content: int, shingles: np.ndarray) -> list[int]:
        links, new = self.touched(shingles), len(self.members)
        self.members.append((content, shingles))
        self.up.append(new)
        self.groups += 1 - len(links)
        for i in links:
            self.up[self.top(i)] = new
        return [self.members[i][0] for i in links]


def _links(met: DataFrame, similarity: float, most: int) -> DataFrame:
    """Edges ``(a, b)`` from ``(band, content, shingles)``, enough to connect all that are similar."""
    sizes = met.groupBy("band").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    dealt = met.join(sizes, "band").withColumn("own", F.pmod(F.xxhash64("content"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("part", F.explode(F.sequence("own", F.col("parts") - 1)))
    dealt = dealt.select("band", "part", (F.col("own") != F.col("part")).cast("int").alias("guest"), "content", "shingles")
    dealt = dealt.repartition("band", "part").sortWithinPartitions("band", "part", "guest", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, at = Bucket(similarity), None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for band, part, guest, content, shingles in zip(*(batch.column(c) for c in ("band", "part", "guest", "content", "shingles")), strict=True):
                key, content, shingles = (band.as_py(), part.as_py()), content.as_py(), shingles.values.to_numpy()
                if key != at:
                    bucket, at = Bucket(similarity), key
                if guest.as_py():
                    out += [(content, bucket.members[i][0]) for i in bucket.touched(shingles)]
                else:
                    out += [(content, other) for other in bucket.add(content, shingles)]
            pairs = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *row_keys())


def classes(rows: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, least: int = LEAST_WORDS, bucket: int = BUCKET_PARAGRAPHS) -> DataFrame:
    """Every paragraph ``(k1, k2, doc_id, number, words, class, first)`` whose class has more than one.

    ``first`` is the class's place ``(doc_id, k1, k2, number)`` that stays: that of the smallest doc_id.
    """
    found = materialize(_paragraphs(rows, least, bands(similarity, recall)), "paragraphs")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k1", "k2", "number")
    unique = found.groupBy("c1", "c2").agg(F.min(F.struct(place.alias("place"), "bands")).alias("own"), F.count("*").alias("n"))
    # Each different paragraph has a number of its own from here on, as its content: no hash of it has to be unique.
    unique = materialize(unique.withColumn("content", F.monotonically_increasing_id()), "unique-paragraphs")
    banded = unique.select("content", F.explode("own.bands").alias("band")).distinct()
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    shared = materialize(shared, "shared-band-keys")
    banded = materialize(banded.join(shared, "band"), "shared-bands")
    wanted = unique.join(banded.select("content").distinct(), "content", "left_semi")
    wanted = wanted.select("own.place.k1", "own.place.k2", F.struct("content", "own.place.number").alias("w")).groupBy("k1", "k2").agg(F.collect_list("w").alias("wanted"))
    shingled = _shingled(rows.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).select("text", "wanted")).dropDuplicates(["content"])
    edges = _links(banded.join(shingled, "content"), similarity, bucket)
    labels = components(edges).select(F.col("node").alias("content"), "label")
    rooted = unique.join(labels, "content", "left").select("c1", "c2", F.coalesce("label", "content").alias("class"), "own.place", "n")
    groups = rooted.groupBy("class").agg(F.min("place").alias("first"), F.sum("n").alias("n")).where("n > 1")
    named = rooted.select("c1", "c2", "class").join(groups, "class").select("c1", "c2", "class", "first")
    return found.drop("bands").join(named, ["c1", "c2"]).drop("c1", "c2")


def passages(rows: DataFrame, passage: int = PASSAGE_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """``(k1, k2, at, first)``: places of shingles of repeated passages, ``first`` the smallest doc_id that has it.

    Only what occurs in more than one row counts.
    """
    filed = materialize(_windows(rows, passage, gram), "windows")
    shared = filed.groupBy("gram").agg(F.min("k1").alias("low"), F.max("k1").alias("high"), F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")
    # Written first, so that the join deals out both sides itself and can split a hot shingle.
    shared = materialize(shared.where("low <> high").select("gram", "first"), "shared-grams")
    return filed.join(shared, "gram").select("k1", "k2", "at", "first")


def repeated(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``(doc_id, n_repeated, n_removed, removed, n_passage_words, first_doc_ids)`` for each input row.

    ``n_repeated`` counts the row's paragraphs whose class has others, ``n_removed`` those of them
    that go because another place is its class's first; ``removed`` are their line numbers from 0.
    ``n_passage_words`` counts the words of the shingles by which repeated passages were found (parts of these), ``first_doc_ids`` names the other documents
    where the repeats stand first. Null and empty texts have no paragraphs. Repeated rows share one
    place, so they repeat each other only in what is left to ``near_duplicates``.
    """
    rows = _keyed(docs)
    own = classes(rows, least=least).select("k1", "k2", "doc_id", "number", "first").distinct()
    stays = (F.col("first.k1") == F.col("k1")) & (F.col("first.k2") == F.col("k2")) & (F.col("first.number") == F.col("number"))
    lines = own.groupBy("k1", "k2").agg(
        F.count("*").alias("n_repeated"), F.array_sort(F.collect_list(F.when(~stays, F.col("number")))).alias("removed"), F.collect_set("first.doc_id").alias("line_firsts"),
    )
    inner = passages(rows).groupBy("k1", "k2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"), F.collect_set("first").alias("passage_firsts"))
    covered = F.aggregate(
        "at", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + x + GRAM_WORDS - F.greatest(a["end"], x)).alias("n"), (x + GRAM_WORDS).alias("end")),
    )["n"]
    inner = inner.select("k1", "k2", covered.cast("long").alias("n_passage_words"), "passage_firsts")
    out = rows.select("doc_id", "k1", "k2").join(lines, ["k1", "k2"], "left").join(inner, ["k1", "k2"], "left")
    none = F.array().cast("array<long>")
    firsts = F.array_sort(F.array_union(F.coalesce("line_firsts", none), F.coalesce("passage_firsts", none)))
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", F.coalesce("n_repeated", zero).alias("n_repeated"), F.coalesce(F.size("removed").cast("long"), zero).alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), F.coalesce("n_passage_words", zero).alias("n_passage_words"),
        F.filter(firsts, lambda x: ~x.eqNullSafe(F.col("doc_id"))).alias("first_doc_ids"),
    )


def deduplicate(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs``, their texts without the paragraphs that stand first elsewhere; passages inside other lines stay."""
    own = classes(_keyed(docs), least=least).select("k1", "k2", "number", "first").distinct()
    stays = (F.col("first.k1") == F.col("k1")) & (F.col("first.k2") == F.col("k2")) & (F.col("first.number") == F.col("number"))
    gone = own.where(~stays).groupBy("k1", "k2").agg(F.collect_list("number").alias("gone"))
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("gone", i)), "\n")
    rows = packed(docs, "doc_id", "text").select("*", *row_keys())
    out = rows.join(gone, ["k1", "k2"], "left").withColumn("row", F.col("row").withField("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)))
    return out.select("row.*")
