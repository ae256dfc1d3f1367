"""Benchmark decontamination over a distributed positional inverted index.

The index is a table of segments. A segment holds some two megabytes of training text: its sorted
terms with their spellings, and for each term the ascending token positions at which it occurs. A
document's tokens are numbered on, with a gap after each document that no phrase can span. The
benchmark's windows are broadcast to all segments in blocks of bounded size. In a segment, a window's
lists are taken from the rarest term on: the candidate starts are that term's positions less its
offset, and every further list keeps those it confirms. The windows of a block go through this
together, list by list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mixed, powers, slices, text_bytes

WINDOW_WORDS = 13
SEGMENT_BYTES = 2 << 20
#: Benchmark text sent to every task at a time; more is worked off in several blocks.
BLOCK_BYTES = 16 << 20
#: Proximity: at most so many terms may be missing, the others so many words out of place.
NEAR_MISSING = 2
NEAR_SLOP = 3
#: Empty positions between two documents; more than a window and its slop.
GAP = 64

SEGMENT = "segment long, terms binary, spellings binary, spelling_ends binary, list_ends binary, steps binary, doc_ids array<long>, doc_starts binary, doc_words binary"

_WORD = np.zeros(256, np.uint8)
for _c in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _WORD[_c] = _c
_WORD[0x41:0x5B] = np.arange(0x61, 0x7B)

def tokenize(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes (0 outside words), word starts, word ends and 64-bit word hashes."""
    low = _WORD[raw]
    word = low != 0
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | edge[1:-1]
    end[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = powers(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(low * up[: len(raw)], dtype=np.uint64)])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    hashes ^= (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return low, starts, ends, mixed(hashes)


def _segment(raw: np.ndarray, offsets: np.ndarray) -> dict:
    low, starts, ends, hashes = tokenize(raw, offsets)
    first = np.searchsorted(starts, offsets)  # each document's first token
    words = np.diff(first)
    begins = first[:-1] + GAP * np.arange(len(words))
    positions = np.arange(len(starts)) + np.repeat(begins - first[:-1], words)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    some = order[new]
    sizes = ends[some] - starts[some]
    at = np.repeat(starts[some] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(some) else np.zeros(0, np.int64)
    return {
        "terms": ordered[new].tobytes(),
        "spellings": low[at].tobytes(),
        "spelling_ends": np.cumsum(sizes).astype(np.int32).tobytes(),
        "list_ends": np.append(new[1:], len(ordered)).astype(np.int32).tobytes() if len(new) else b"",
        "steps": np.diff(positions[order], prepend=0).astype(np.int32).tobytes(),
        "doc_starts": begins.astype(np.int32).tobytes(),
        "doc_words": words.astype(np.int32).tobytes(),
    }


def build_index(docs: DataFrame) -> DataFrame:
    """Index segments of ``(doc_id, text)``; every token of every text is in them.

    Null and empty texts are documents of no words. A text longer than a segment gets one alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            ids = batch.column("doc_id")
            for i, j in slices(offsets, SEGMENT_BYTES):
                made = _segment(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                row = {"segment": number, **made, "doc_ids": ids[i:j].to_pylist()}
                number += 1
                yield pa.RecordBatch.from_pylist([row], schema=_SEGMENT_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SEGMENT)


_SEGMENT_ARROW = pa.schema([("segment", pa.int64()), ("terms", pa.binary()), ("spellings", pa.binary()), ("spelling_ends", pa.binary()), ("list_ends", pa.binary()), ("steps", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.binary()), ("doc_words", pa.binary())])


@dataclass
class Phrases:
    """Windows of test items, each once, with the items that it comes from."""

    words: list[bytes] = field(default_factory=list)
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    windows: list[tuple[int, ...]] = field(default_factory=list)
    items: list[list[str]] = field(default_factory=list)

    def by_length(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(length, window numbers, their words as rows)``."""
        sizes = np.array([len(w) for w in self.windows], np.int64)
        for length in np.unique(sizes).tolist():
            numbers = np.flatnonzero(sizes == length)
            yield length, numbers, np.array([self.windows[n] for n in numbers.tolist()], np.int64)


def phrases(items: list[tuple[str, str | None]], size: int = WINDOW_WORDS) -> Phrases:
    number: dict[bytes, int] = {}
    hashes: list[int] = []
    found: dict[tuple[int, ...], set[str]] = {}
    for name, text in items:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        if not len(raw):
            continue
        low, starts, ends, keys = tokenize(raw, np.array([0, len(raw)]))
        low = low.tobytes()
        ids = []
        for i, j, key in zip(starts.tolist(), ends.tolist(), keys.tolist(), strict=True):
            if (word := low[i:j]) not in number:
                number[word] = len(number)
                hashes.append(key)
            ids.append(number[word])
        for i in range(max(1, len(ids) - size + 1) if ids else 0):
            found.setdefault(tuple(ids[i : i + size]), set()).add(name)
    return Phrases(list(number), np.array(hashes, np.uint64), list(found), [sorted(x) for x in found.values()])


class Segment:
    """A row of the index, opened for a search: the position lists of the wanted words.

    The lists stand one after another in one ascending array of keys, a word's number in the upper
    half and a position in the lower, so that one binary search serves many lists at once.
    """

    def __init__(self, row: dict, wanted: Phrases):
        terms = np.frombuffer(row["terms"], np.uint64)
        spelling_ends, list_ends = np.frombuffer(row["spelling_ends"], np.int32), np.frombuffer(row["list_ends"], np.int32)
        positions = np.cumsum(np.frombuffer(row["steps"], np.int32), dtype=np.int64)
        self.doc_starts, self.doc_words = (np.frombuffer(row[k], np.int32).astype(np.int64) for k in ("doc_starts", "doc_words"))
        lists: list[np.ndarray] = [_NONE] * len(wanted.words)
        if len(terms):
            at = np.minimum(np.searchsorted(terms, wanted.hashes), len(terms) - 1)
            for w in np.flatnonzero(terms[at] == wanted.hashes).tolist():
                k = int(at[w])
                if row["spellings"][spelling_ends[k - 1] if k else 0 : spelling_ends[k]] == wanted.words[w]:
                    lists[w] = positions[list_ends[k - 1] if k else 0 : list_ends[k]]
        self.keys, self.begins = _keyed(lists)

    def documents(self, starts: np.ndarray) -> np.ndarray:
        """The numbers of the documents in which the positions are; a gap belongs to the document before it."""
        return np.searchsorted(self.doc_starts, starts, "right") - 1

    @staticmethod
    def near_starts(lists: list[np.ndarray], offsets: list[int], missing: int, slop: int) -> np.ndarray:
        """Starts at which all lists but ``missing`` have a position within ``slop`` of the offset's."""
        keys, begins = _keyed(lists)
        asked = Asked(np.arange(len(lists))[None], np.array(offsets)[None], np.diff(begins), missing)
        return np.concatenate([start for _, start in asked.near(keys, begins, slop)] or [_NONE])


_NONE = np.zeros(0, np.int64)
#: Candidate starts confirmed together.
CANDIDATES = 1 << 19


def _keyed(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    numbers = np.repeat(np.arange(len(lists)), sizes)
    return (numbers << 32) + (np.concatenate(lists) if lists else _NONE), np.concatenate([[0], np.cumsum(sizes)])


class Asked:
    """Windows of one length as rows of words, each row's words from the rarest on; absent ones come last."""

    def __init__(self, windows: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, missing: int):
        counts = sizes[windows]
        self.present = (counts > 0).sum(1)
        absent = windows.shape[1] - self.present
        self.rows = np.flatnonzero((absent <= missing) & (self.present > 0))
        order = np.argsort(np.where(counts > 0, counts, np.iinfo(np.int64).max)[self.rows], axis=1, kind="stable")
        self.words = np.take_along_axis(windows[self.rows], order, 1)
        self.offsets = np.take_along_axis(offsets[self.rows] if len(offsets) == len(windows) else np.repeat(offsets, len(self.rows), 0), order, 1)
        self.counts = np.take_along_axis(counts[self.rows], order, 1)
        self.present, self.budget = self.present[self.rows], missing - absent[self.rows]

    def confirmed(self, keys: np.ndarray, row: np.ndarray, start: np.ndarray, budget: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """The candidates ``(row, start)`` that all present lists but ``budget`` of them confirm, list by list from the rarest."""
        lost = np.zeros(len(row), np.int64)
        for t in range(self.words.shape[1]):
            if not len(row):
                break
            word = self.words[row, t] << 32
            target = start + self.offsets[row, t]
            at = np.searchsorted(keys, word + np.maximum(target - slop, 0))
            here = keys[np.minimum(at, len(keys) - 1)] - word
            found = (at < len(keys)) & (here >= 0) & (here <= target + slop)
            lost += ~found & (self.present[row] > t)
            keep = lost <= budget
            row, start, budget, lost = row[keep], start[keep], budget[keep], lost[keep]
        return row, start

    def candidates(self, keys: np.ndarray, begins: np.ndarray, rows: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, start)`` from the positions of the rarest word of each of ``rows``, and of its ``extra`` next ones."""
        most = min(int(extra.max(initial=0)) + 1, self.words.shape[1])
        row = np.repeat(rows, most)
        rank = np.tile(np.arange(most), len(rows))
        wanted = (rank <= np.repeat(extra, most)) & (rank < self.present[row])
        row, rank = row[wanted], rank[wanted]
        n, word = self.counts[row, rank], self.words[row, rank]
        at = np.repeat(begins[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(row, n), (keys[at] & 0xFFFFFFFF) - np.repeat(self.offsets[row, rank], n)

    def near(self, keys: np.ndarray, begins: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(row, start)``, each once, at which all words but the missing ones are within ``slop`` of their places.

        One of the budget + 1 rarest words is among them, so their positions are the candidates: the
        others of a start are within twice the slop of them, and the start itself within the slop.
        """
        ranks = np.arange(self.counts.shape[1])
        work = np.cumsum((self.counts * (ranks <= self.budget[:, None])).sum(1))
        i = 0
        while i < len(self.rows):
            j = max(i + 1, int(np.searchsorted(work, (work[i - 1] if i else 0) + CANDIDATES, "right")))
            own = np.arange(i, j)
            row, start = self.candidates(keys, begins, own, self.budget[own])
            row, start = self.confirmed(keys, row, start, self.budget[row], 2 * slop)
            if len(row):
                pair = np.unique((row[:, None] << 32) + (start[:, None] + np.arange(-slop, slop + 1)) + _SHIFT)
                row, start = pair >> 32, (pair & 0xFFFFFFFF) - _SHIFT
                yield self.confirmed(keys, row, start, self.budget[row], slop)
            i = j

    def exact(self, keys: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, start)`` at which all words stand at their places."""
        whole = np.flatnonzero(self.present == self.words.shape[1])
        row, start = self.candidates(keys, begins, whole, np.zeros(len(whole), np.int64))
        return self.confirmed(keys, row, start, np.zeros(len(row), np.int64), 0)


#: A start may lie before the first position, by less than a window and its slop.
_SHIFT = 1 << 16


def _search(segment: Segment, wanted: Phrases, missing: int, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each document of a segment the windows found nearly; exact hits as ``(start, length)``; ``(document, window)`` pairs of these, packed."""
    n_docs = len(segment.doc_starts)
    near, hits, pairs = np.zeros(n_docs, np.int64), [], []
    sizes = np.diff(segment.begins)
    for length, numbers, windows in wanted.by_length():
        places = np.arange(length)[None]
        nearly = length > 2 * missing  # shorter ones count as near where they are exact
        asked = Asked(windows, places, sizes, missing if nearly else 0)
        if not len(asked.rows):
            continue
        if nearly:
            row, start = map(np.concatenate, zip((_NONE, _NONE), *asked.near(segment.keys, segment.begins, slop), strict=True))
            # The first term found is there or before it, less than a gap away.
            doc = segment.documents(start + (missing + slop))
            seen = np.unique((row << 32) + doc) & 0xFFFFFFFF
            near += np.bincount(seen, minlength=n_docs)
            some = asked.present[row] == length
            row, start = asked.confirmed(segment.keys, row[some], start[some], np.zeros(int(some.sum()), np.int64), 0)
        else:
            row, start = asked.exact(segment.keys, segment.begins)
        doc, window = segment.documents(start), numbers[asked.rows[row]]
        pair = np.unique((doc << 32) + window)
        if not nearly:
            near += np.bincount(pair >> 32, minlength=n_docs)
        hits.append(np.column_stack([start, np.full(len(start), length)]))
        pairs.append(pair)
    return near, np.concatenate(hits or [np.zeros((0, 2), np.int64)]), np.unique(np.concatenate(pairs or [_NONE]))


RESULT = "segment long, number int, doc_id long, n_words long, n_near long, items array<string>, spans array<struct<begin: int, end: int>>"
_RESULT_ARROW = pa.schema([("segment", pa.int64()), ("number", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_near", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))])


def _result(number: int, doc_ids: pa.Array, segment: Segment, wanted: Phrases, missing: int, slop: int, every: bool) -> pa.RecordBatch:
    """What a segment's documents share with ``wanted``: all of them, or those that share something."""
    near, hits, pairs = _search(segment, wanted, missing, slop)
    n = len(segment.doc_starts)
    ends = segment.doc_starts + segment.doc_words
    cover = np.zeros((int(ends[-1]) if n else 0) + GAP, np.int32)
    np.add.at(cover, hits[:, 0], 1)
    np.add.at(cover, hits.sum(1), -1)
    hit = np.cumsum(cover) > 0
    items: list[list[str]] = [[] for _ in range(n)]
    spans: list[list[dict]] = [[] for _ in range(n)]
    docs, first = np.unique(pairs >> 32, return_index=True)
    for doc, own in zip(docs.tolist(), np.split(pairs & 0xFFFFFFFF, first[1:]), strict=False):
        items[doc] = sorted({name for w in own.tolist() for name in wanted.items[w]})
        edge = np.diff(hit[segment.doc_starts[doc] : ends[doc]].astype(np.int8), prepend=0, append=0)
        spans[doc] = [{"begin": int(i), "end": int(j)} for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
    columns = [pa.array(np.full(n, number, np.int64)), pa.array(np.arange(n, dtype=np.int32)), doc_ids, pa.array(segment.doc_words), pa.array(near), pa.array(items, _RESULT_ARROW.field("items").type), pa.array(spans, _RESULT_ARROW.field("spans").type)]
    found = pa.RecordBatch.from_arrays(columns, schema=_RESULT_ARROW)
    return found if every else found.filter(pa.array(near.astype(bool) | np.isin(np.arange(n), docs)))


def search(index: DataFrame, wanted: Phrases, missing: int = NEAR_MISSING, slop: int = NEAR_SLOP, every: bool = True) -> DataFrame:
    """For every document of the index, or each that shares anything, what it shares with ``wanted``.

    ``items``: names of the items with an exact window; ``spans``: the word ranges that exact windows
    cover; ``n_near``: windows found at least nearly (exact ones too; windows of so few words that
    half of them could be missing only as exact ones).
    """
    sent = index.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [n for n in _SEGMENT_ARROW.names if n != "doc_ids"]
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(n)[at].as_py() for n in names}
                yield _result(row["segment"], batch.column("doc_ids")[at].values, Segment(row, sent.value), sent.value, missing, slop, every)

    return index.mapInArrow(run, RESULT)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near)`` for each input row.

    A window is ``size`` consecutive words of an item; a shorter item, unless it has no words, is
    one window. ``n_hit`` counts the document's words inside an occurring window; it is contaminated
    if they are a twentieth of its words or more. Items without an id or without words take no part;
    an item_id that occurs several times names one item with all its texts. A null text has no words,
    nor has an empty one; equal rows and rows of one doc_id are counted one by one.

    The benchmark comes to the driver a block at a time. A block's hits are written before the next
    one is read, so neither the driver nor a task holds more than one.
    """
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    whole = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(whole) // BLOCK_BYTES))
    index = materialize(build_index(docs), "index", "zstd")
    found = None
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        part = search(index, phrases([(r["item_id"], r["text"]) for r in own], size), every=b == 0)
        part = part if blocks == 1 else materialize(part, "hits")
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        found = found.groupBy("segment", "number").agg(
            F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("n_near").alias("n_near"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        )
    joined = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("at")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["at"], s["begin"]))).alias("n"), F.greatest(a["at"], s["end"]).alias("at")),
    )["n"]
    out = found.withColumn("n_hit", joined)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "n_near",
    )
