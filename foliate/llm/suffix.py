"""Exact removal of long repeated strings by suffix arrays built bucket by bucket.

A string of ``STRING`` bytes that occurs twice has the same smallest gram in both places (the gram
of ``GRAM`` bytes with the least hash). So every start of such a string is filed under that gram, its
anchor; consecutive starts with one anchor make a piece. Only pieces whose anchor occurs more than
once can hold a repeat. Equal pieces are counted and sent on once. The pieces of an anchor meet in
one task, which sorts their suffixes one first byte at a time: by their first ``PERIOD`` bytes, and
beyond that by the ranks of a difference cover's positions, computed beforehand. Neighbours in that
order that share ``STRING`` bytes are repeats.

The same sort can tell repeats of a second, shorter length: starts are then filed by that one, and a
piece reaches on over the bytes of the longer strings that begin in it.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mixed, powers, row_keys, slices, text_bytes

STRING = 400
GRAM = 100
SLICE_BYTES = 512 << 10
#: Bytes of a passage of 50 words, of five letters and a blank each: fewer than ``STRING``.
PASSAGE = 300
#: Bytes looked at together, a power of two; only a text alone in its slice can be longer.
LONGEST = 1 << 24
#: Pieces sorted together; more only where one anchor has more.
BLOCK_BYTES = 1 << 20
#: Anchors with more different pieces than this are resolved start by start.
ANCHOR_PIECES = 8192
#: Any two residues modulo PERIOD have a shift that takes both into the cover.
PERIOD = 32
COVER = (0, 1, 2, 3, 7, 11, 19)


def _sums(raw: np.ndarray) -> np.ndarray:
    up, _ = powers(len(raw) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw * up[: len(raw)], dtype=np.uint64)])


def pieces(raw: np.ndarray, offsets: np.ndarray, string: int = STRING, gram: int = GRAM, reach: int = 0, most: int | None = None) -> tuple[np.ndarray, ...]:
    """``(document, anchor hash, piece hash, first start, last start, anchor)`` of all pieces; places count within the document.

    A piece is known by its bytes up to ``reach`` after its last start, or the text's end. Only starts before ``most`` count.
    """
    n, width, reach = len(raw), string - gram + 1, max(string, reach)
    if n > LONGEST and most is None:  # one long text: by ranges of starts, each with the bytes that its strings reach into
        parts, step = [], LONGEST - reach + 1
        for begin in range(0, n - string + 1, step):
            own = raw[begin : begin + LONGEST]
            _, anchor, piece, lo, hi, at = pieces(own, np.array([0, len(own)]), string, gram, reach, step)
            parts.append((np.zeros(len(lo), np.int64), anchor, piece, lo + begin, hi + begin, at + begin))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    if n < string:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    sums, down = _sums(raw), powers(n + 1)[1]
    count = n - gram + 1
    grams = mixed((sums[gram:] - sums[:count]) * down[:count])
    low = np.uint64(LONGEST - 1)  # the same for all slices: which gram is the least must depend on the string alone
    least, size = (grams & ~low) | np.arange(count, dtype=np.uint64), 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    anchors = (least & low).astype(np.int64)
    long = np.flatnonzero(np.diff(offsets) >= string)
    change = np.zeros(len(anchors) + 1, np.int8)
    change[offsets[long]] += 1
    np.add.at(change, offsets[long + 1] - string + 1, -1)
    starts = np.flatnonzero(np.cumsum(change[:-1]))
    starts = starts if most is None else starts[starts < most]
    if not len(starts):
        return pieces(raw[:0], offsets[:1])
    own = anchors[starts]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    lo, hi, at = starts[first], starts[np.append(first[1:], len(starts)) - 1], own[first]
    doc = np.searchsorted(offsets, lo, "right") - 1
    base, end = offsets[doc], np.minimum(hi + reach, offsets[doc + 1])
    whole = mixed((sums[end] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))
    whole = mixed(whole + (end - hi).astype(np.uint64))
    return doc, mixed(grams[at] + np.uint64(1)), whole, lo - base, hi - base, at - base


def _shifts() -> np.ndarray:
    """For each two residues, the least shift that takes both into the cover."""
    cover = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    return np.array([[next(d for d in range(PERIOD) if cover[i + d] and cover[j + d]) for j in range(PERIOD)] for i in range(PERIOD)])


SHIFT = _shifts()


def _change(*keys: np.ndarray) -> np.ndarray:
    """Where a row of sorted keys differs from the one before."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def cover_ranks(words: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Ranks of the cover's positions by ``depth`` bytes or more, -1 elsewhere; equal prefixes share a rank."""
    places = np.arange(n)
    places = places[np.isin(places % PERIOD, COVER)]
    ranks = np.full(n + 2 * depth + PERIOD, -1, np.int64)
    keys = [words[places + d] for d in range(0, PERIOD, 8)]
    order = np.lexsort(keys[::-1])
    ranks[places[order]] = np.cumsum(_change(*[k[order] for k in keys])) - 1
    done = PERIOD
    while done < depth:
        # Steps of PERIOD and its multiples stay in the cover.
        keys = ranks[places] * (len(places) + 2) + ranks[places + done] + 1
        order = np.argsort(keys, kind="stable")
        ranks[places[order]] = np.cumsum(_change(keys[order])) - 1
        done *= 2
    return ranks


def sorted_buckets(data: np.ndarray, starts: np.ndarray, depth: int) -> Iterator[np.ndarray]:
    """``starts`` by the order of their suffixes to ``depth`` bytes, a bucket for each first byte in turn.

    ``data`` is followed by 2 * depth zeros at least.
    """
    n = len(data) - 2 * depth
    words = data.astype(np.uint64)
    for size in (1, 2, 4):
        words = (words[:-size] << np.uint64(8 * size)) | words[size:]
    ranks = cover_ranks(words, n, depth)
    heads = data[starts]
    for head in np.unique(heads):
        own = starts[heads == head]
        keys = [words[own + d] for d in range(0, PERIOD, 8)]
        order = np.lexsort(keys[::-1])
        own = own[order]
        new = _change(*[k[order] for k in keys])
        group = np.cumsum(new) - 1
        # Where all of a tie have one residue, one shift serves the whole of it.
        residue = own % PERIOD
        begin = np.flatnonzero(new)
        mixed_residues = np.maximum.reduceat(residue, begin) != np.minimum.reduceat(residue, begin)
        tie = ranks[own + SHIFT[residue, residue]]
        own = own[np.lexsort((np.where(mixed_residues[group], 0, tie), group))]
        ends = np.append(begin[1:], len(own))
        for g in np.flatnonzero(mixed_residues).tolist():
            part = own[begin[g] : ends[g]].tolist()

            def compare(i: int, j: int) -> int:
                d = SHIFT[i % PERIOD, j % PERIOD]
                return int(ranks[i + d] - ranks[j + d])

            own[begin[g] : ends[g]] = sorted(part, key=functools.cmp_to_key(compare))
        yield own


def _runs(found: np.ndarray) -> list[tuple[int, int]]:
    own = np.diff(found.astype(np.int8), prepend=0, append=0)
    return [(int(i), int(j) - 1) for i, j in zip(np.flatnonzero(own == 1), np.flatnonzero(own == -1), strict=True)]


def repeats(texts: list[bytes], anchors: list[int], counts: list[int], starts_of: list[int], lengths: tuple[int, ...]) -> list[list[list[tuple[int, int]]]]:
    """For each string length and each piece, the ranges (first, last) of its starts whose string of that length starts elsewhere too.

    The first length is the longest. A piece has ``starts_of`` starts; a string that its bytes don't hold whole is beyond its text's end.
    Pieces are laid out with their anchors on multiples of PERIOD, so strings that meet at an anchor
    have one residue. A piece counted more than once is a repeat throughout.
    """
    at, place, longest = [], 0, lengths[0]
    for text, anchor in zip(texts, anchors, strict=True):
        place += -(place + anchor) % PERIOD
        at.append(place)
        place += len(text)
    data = np.zeros(place + 2 * (longest + PERIOD), np.uint8)
    for text, place in zip(texts, at, strict=True):
        data[place : place + len(text)] = np.frombuffer(text, np.uint8)
    many, begins, sizes = np.array(starts_of), np.array(at), np.array([len(t) for t in texts])
    starts = np.repeat(begins - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    ends = np.zeros(len(data), np.int64)
    ends[starts] = np.repeat(begins + sizes, many)
    sums, down = _sums(data), powers(len(data) + 1)[1]
    found = [np.zeros(len(data), bool) for _ in lengths]
    for bucket in sorted_buckets(data, starts, longest):
        for string, marks in zip(lengths, found, strict=True):
            own = bucket[bucket + string <= ends[bucket]]
            hashes = (sums[own + string] - sums[own]) * down[own]
            equal = np.flatnonzero(hashes[1:] == hashes[:-1])
            marks[own[equal]] = marks[own[equal + 1]] = True
    out = []
    for string, marks in zip(lengths, found, strict=True):
        whole = np.minimum(many, sizes - string + 1).tolist()
        out.append([([(0, n - 1)] if n > 0 else []) if count > 1 else _runs(marks[begin : begin + length]) for begin, length, count, n in zip(at, starts_of, counts, whole, strict=True)])
    return out


_RANGES = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _file(docs: DataFrame, string: int, gram: int, reach: int) -> DataFrame:
    """``(anchor, piece, k1, k2, lo, hi, at)``: every piece of every text, without its bytes."""
    names = ["anchor", "piece", "k1", "k2", "lo", "hi", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            k1, k2 = (batch.column(k).to_numpy() for k in ("k1", "k2"))
            for i, j in slices(offsets, SLICE_BYTES):
                doc, anchor, piece, lo, hi, at = pieces(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], string, gram, reach)
                columns = [anchor.view(np.int64), piece.view(np.int64), k1[i:j][doc], k2[i:j][doc], *(x.astype(np.int32) for x in (lo, hi, at))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    return docs.select("k1", "k2", "text").mapInArrow(run, "anchor long, piece long, k1 long, k2 long, lo int, hi int, at int")


def _cut(rows: DataFrame, string: int) -> DataFrame:
    """``(anchor, piece, n, starts, at, bytes)`` for the pieces listed in ``wanted``, from their documents' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            for k1, k2, text, wanted in zip(*(batch.column(c) for c in ("k1", "k2", "text", "wanted")), strict=True):
                if (key := (k1.as_py(), k2.as_py())) == last:  # a repeated row
                    continue
                last, raw = key, text.as_py().encode()
                out += [{"anchor": w["anchor"], "piece": w["piece"], "n": w["n"], "starts": w["hi"] - w["lo"] + 1, "at": w["at"] - w["lo"], "bytes": raw[w["lo"] : w["hi"] + string]} for w in wanted.as_py()]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("anchor", pa.int64()), ("piece", pa.int64()), ("n", pa.int64()), ("starts", pa.int32()), ("at", pa.int32()), ("bytes", pa.binary())]))

    return rows.mapInArrow(run, "anchor long, piece long, n long, starts int, at int, bytes binary")


def _resolve(rows: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """``(anchor, piece, ranges0, ...)``, ranges for each length, for pieces ``(anchor, piece, n, starts, at, bytes)``."""
    names = [f"ranges{k}" for k in range(len(lengths))]

    def settled(rows: list[tuple]) -> pa.RecordBatch:
        found = repeats([r[5] for r in rows], [r[4] for r in rows], [r[2] for r in rows], [r[3] for r in rows], lengths) if rows else [[] for _ in lengths]
        ranges = [pa.array([[{"lo": i, "hi": j} for i, j in own] for own in each], _RANGES) for each in found]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), *ranges], names=["anchor", "piece", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "piece", "n", "starts", "at", "bytes")), strict=True):
                if size > BLOCK_BYTES and row[0] != held[-1][0]:
                    yield settled(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        yield settled(held)

    dealt = rows.repartition("anchor").sortWithinPartitions("anchor", "piece")
    schema = ", ".join(["anchor long", "piece long", *(f"{n} array<struct<lo: int, hi: int>>" for n in names)])
    return dealt.mapInArrow(run, schema).where(" or ".join(f"size({n}) > 0" for n in names))


def _start_by_start(rows: DataFrame, string: int) -> DataFrame:
    """``(k1, k2, lo, hi)`` of repeated starts, for the runs listed in ``crowded``: each start's string by its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, text, wanted in zip(*(batch.column(c) for c in ("k1", "k2", "text", "crowded")), strict=True):
                raw, own = text.as_py().encode(), [i for w in wanted.as_py() for i in range(w["lo"], w["hi"] + 1)]
                own = [i for i in own if i + string <= len(raw)]
                digests = [hashlib.blake2b(raw[i : i + string], digest_size=16).digest() for i in own]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([k1.as_py()] * len(own), pa.int64()), pa.array([k2.as_py()] * len(own), pa.int64()), pa.array(own, pa.int32())], names=["digest", "k1", "k2", "lo"])

    starts = materialize(rows.mapInArrow(run, "digest binary, k1 long, k2 long, lo int"), "crowded")
    often = starts.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    often = materialize(often, "often-digests")
    return starts.join(often, "digest").select("k1", "k2", "lo", F.col("lo").alias("hi"))


def _spans(ranges: list[dict] | None, string: int) -> list[list[int]]:
    """The bytes that strings cover whose starts lie in the ranges, as maximal runs."""
    spans: list[list[int]] = []
    for i, j in sorted((r["lo"], r["hi"] + string) for r in ranges or ()):
        if spans and i <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], j)
        else:
            spans.append([i, j])
    return spans


def _remove(rows: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Texts without the bytes of their repeated strings: what is left of each, as figures; ``n_shorter`` counts the bytes of shorter repeats."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shorter"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, *found in zip(batch.column("text"), *(batch.column(f"ranges{k}").to_pylist() for k in range(len(lengths))), strict=True):
                raw = text.as_py().encode()
                spans, *shorter = (_spans(ranges, string) for ranges, string in zip(found, lengths, strict=True))
                kept, at = hashlib.sha256(), 0
                for i, j in [*spans, [len(raw), len(raw)]]:
                    kept.update(raw[at:i])
                    at = j
                out.append((len(raw), sum(j - i for i, j in spans), len(spans), kept.hexdigest(), sum(j - i for own in shorter for i, j in own)))
            columns = [batch.column("doc_id"), *(pa.array([o[k] for o in out], pa.string() if k == 3 else pa.int64()) for k in range(5))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shorter long")


def remove_repeats(docs: DataFrame, string: int = STRING, gram: int = GRAM, anchor_pieces: int = ANCHOR_PIECES, shorter: int | None = None) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for each input row; with ``shorter`` (from ``gram`` to ``string``) also
    ``n_shorter``, the bytes that a string of that length covers which starts anywhere else too: these stay.

    A byte goes if any ``string`` bytes that hold it start anywhere else too, in its own text or in
    another row's; all copies go. A null or empty text has no bytes. Repeated rows are copies of each
    other.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *row_keys())
    lengths = (string,) if shorter is None else (string, shorter)
    filed = materialize(_file(rows, lengths[-1], gram, string), "pieces")
    often = filed.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    # Written first, so that the join deals out both sides itself and can split a hot anchor.
    often = materialize(often, "often")
    filed = materialize(filed.join(often, "anchor"), "repeated-anchors")
    # Equal pieces once, with how many there are and one place to find them.
    place = F.struct("k1", "k2", "lo", "hi", "at")
    unique = filed.groupBy("anchor", "piece").agg(F.count("*").alias("n"), F.min(place).alias("place"))
    unique = materialize(unique, "unique-pieces")
    crowded = unique.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > anchor_pieces).select("anchor", F.lit(True).alias("crowded"))
    crowded = materialize(crowded, "crowded-anchors")
    wanted = unique.join(crowded, "anchor", "left").where("crowded is null").select("place.k1", "place.k2", F.struct("anchor", "piece", "n", "place.lo", "place.hi", "place.at").alias("own"))
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list("own").alias("wanted"))
    members = filed.join(crowded, "anchor", "left")
    busy = members.groupBy("k1", "k2").agg(F.collect_set(F.when(F.col("crowded"), F.struct("lo", "hi"))).alias("crowded"))
    busy = busy.join(wanted, ["k1", "k2"], "left")
    texts = rows.join(busy, ["k1", "k2"], "left")
    free = F.col("crowded").isNull()
    texts = materialize(
        texts.select(
            "k1", "k2", "doc_id", F.when(~free, F.col("text")).alias("text"), "wanted", "crowded", F.octet_length("text").cast("long").alias("n_bytes"),
            F.when(free, F.sha2(F.col("text").cast("binary"), 256)).alias("kept_sha256"),
        ), "texts",
    )
    held = texts.where("text is not null")
    ranges = _resolve(_cut(held.where("wanted is not null").select("k1", "k2", "text", "wanted"), string), lengths)
    met = members.where("crowded is null").select("anchor", "piece", "k1", "k2", "lo").join(ranges, ["anchor", "piece"])
    moved = lambda k: F.transform(f"ranges{k}", lambda r: F.struct((r["lo"] + F.col("lo")).alias("lo"), (r["hi"] + F.col("lo")).alias("hi"), F.lit(k).alias("k")))
    found = met.select("k1", "k2", F.explode(F.concat(*map(moved, range(len(lengths))))).alias("r")).select("k1", "k2", F.struct("r.lo", "r.hi").alias("r"), F.col("r.k").alias("k"))
    crowd = held.where(F.size("crowded") > 0).select("k1", "k2", "text", "crowded")
    for k, length in enumerate(lengths):
        found = found.unionByName(_start_by_start(crowd, length).select("k1", "k2", F.struct("lo", "hi").alias("r"), F.lit(k).alias("k")))
    spans = found.groupBy("k1", "k2").agg(*[F.collect_set(F.when(F.col("k") == k, F.col("r"))).alias(f"ranges{k}") for k in range(len(lengths))])
    done = _remove(held.select("k1", "k2", "doc_id", "text").join(spans, ["k1", "k2"], "left").drop("k1", "k2"), lengths)
    zero = F.lit(0).cast("long")
    untouched = texts.where("text is null").select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), "kept_sha256", zero.alias("n_shorter"))
    out = done.unionByName(untouched)
    return out.drop("n_shorter") if shorter is None else out
