import hashlib
import random

import numpy as np
import pytest

from foliate.llm import suffix


def brute(rows, string):
    seen = {}
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, raw in raws:
        for i in range(len(raw) - string + 1):
            seen[raw[i : i + string]] = seen.get(raw[i : i + string], 0) + 1
    out = []
    for i, raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - string + 1):
            if seen[raw[k : k + string]] > 1:
                gone[k : k + string] = True
        gone[-1] = False
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows(words):
    r = random.Random(3)
    base = [words(r.randrange(30, 200), k) for k in range(12)]
    passage = words(90, 77)
    made = [(k, t) for k, t in enumerate(base)]
    made += [(20 + k, f"{words(20, 100 + k)} {passage} {words(30, 200 + k)}") for k in range(8)]
    made += [(40, base[0]), (41, base[1] + " x"), (42, base[2][5:]), (43, None), (44, ""), (45, "Und " * 300), (46, "é" * 500)]
    made += [(47, passage + passage), (48, base[3][:200] + "!" + base[3][201:]), (0, base[0]), (None, base[4]), (None, words(60, 9))]
    return made


@pytest.mark.parametrize("string,gram,limit", [(400, 100, 8192), (120, 40, 8192), (120, 40, 1), (64, 32, 3)])
def test_matches_brute_force(docs, words, string, gram, limit):
    data = rows(words)
    got = [tuple(r) for r in suffix.remove_repeats(docs(data).repartition(3), string, gram, limit).collect()]
    assert sorted(got, key=str) == brute(data, string)


@pytest.mark.parametrize("string,shorter,gram,limit", [(400, 256, 100, 8192), (120, 64, 40, 8192), (120, 64, 40, 1), (64, 64, 32, 3), (200, 33, 32, 8192)])
def test_a_shorter_length_beside(docs, words, string, shorter, gram, limit):
    """The shorter length changes nothing of the longer one's figures, and has its own."""
    data = rows(words) + [(60 + k, words(9, 300 + k) + " " + words(25, 88)) for k in range(3)] + [(70, words(25, 88))]
    got = [tuple(r) for r in suffix.remove_repeats(docs(data).repartition(3), string, gram, limit, shorter).collect()]
    assert sorted((r[:5] for r in got), key=str) == brute(data, string)
    assert sorted(((r[0], r[1], r[5]) for r in got), key=str) == sorted(((r[0], r[1], r[2]) for r in brute(data, shorter)), key=str)


def test_a_long_text_in_ranges(docs, words, monkeypatch):
    data = rows(words)
    # A range of starts is one more place where a run of starts is cut; what repeats stays the same.
    raw = np.frombuffer((data[0][1] * 3).encode(), np.uint8)
    whole = suffix.pieces(raw, np.array([0, len(raw)]), 64, 32)
    monkeypatch.setattr(suffix, "LONGEST", 1 << 8)
    cut = suffix.pieces(raw, np.array([0, len(raw)]), 64, 32)
    starts = lambda p: [i for lo, hi in zip(p[3], p[4]) for i in range(lo, hi + 1)]
    assert starts(cut) == starts(whole) == list(range(len(raw) - 63))
    anchors = lambda p: {i: int(a) for a, lo, hi in zip(p[5], p[3], p[4]) for i in range(lo, hi + 1)}
    assert sum(anchors(cut)[i] != anchors(whole)[i] for i in starts(cut)) == 0


def test_empty_table(docs):
    assert suffix.remove_repeats(docs([])).count() == 0


def test_cover_shifts():
    cover = set(suffix.COVER)
    for i in range(suffix.PERIOD):
        for j in range(suffix.PERIOD):
            d = suffix.SHIFT[i, j]
            assert (i + d) % suffix.PERIOD in cover and (j + d) % suffix.PERIOD in cover


def test_suffix_order():
    r = random.Random(1)
    for text in (bytes(r.choice(b"ab") for _ in range(900)), b"abc" * 300, bytes(r.randrange(256) for _ in range(500)) * 2):
        data = np.frombuffer(text + bytes(2 * 64 + suffix.PERIOD), np.uint8)
        starts = np.arange(len(text) - 64)
        own = np.concatenate(list(suffix.sorted_buckets(data, starts, 64)))
        heads = [text[i : i + 64] for i in own.tolist()]
        assert heads == sorted(heads) and sorted(own.tolist()) == starts.tolist()
