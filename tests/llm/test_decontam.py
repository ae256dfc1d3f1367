import hashlib
import re

import numpy as np
import pytest

from foliate.llm import decontam


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def brute(rows, items, size=13):
    windows = {}
    for name, text in items:
        w = split(text)
        if name is not None:
            for i in range(max(1, len(w) - size + 1) if w else 0):
                windows.setdefault(tuple(w[i : i + size]), set()).add(str(name))
    out = []
    for i, text in rows:
        w = split(text)
        hit, names = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    names |= found
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [16 << 20, 300])
def test_matches_brute_force(spark, docs, words, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    items = [(k, words(20 + k, 50 + k)) for k in range(12)] + [(20, "Über größe, ÀB"), (21, "one"), (22, "!!"), (None, words(20, 1)), (23, None), (3, words(15, 99))]
    rows = [(k, words(80, k)) for k in range(10)]
    rows += [(20 + k, words(100, 30 + k) + ". " + items[k][1].upper().replace(" ", ",  ") + "! " + words(9, k)) for k in range(10)]
    rows += [(40, "über GRÖßE Àb"), (41, "x über größe Àb"), (42, "ONE"), (43, None), (44, ""), (45, "..."), (46, items[1][1][:60]), (21, rows[11][1]), (None, items[2][1])]
    rows += [(50, items[4][1] + " " + items[4][1]), (51, " ".join(items[5][1].split()[:13])), (52, " ".join(items[5][1].split()[:12])), (53, items[6][1] + " " + words(400, 5))]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r)[:6] for r in decontam.contamination(docs(rows).repartition(3), table).collect()]
    assert sorted(got, key=str) == brute(rows, items)


def test_phrase_does_not_span_documents(spark, docs):
    items = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(13)))], "item_id long, text string")
    rows = [(1, " ".join(f"w{k}" for k in range(6))), (2, " ".join(f"w{k}" for k in range(6, 13)))]
    assert [r["n_hit"] for r in decontam.contamination(docs(rows).coalesce(1), items).collect()] == [0, 0]


def test_proximity(spark, docs):
    text = [f"w{k}" for k in range(13)]
    items = spark.createDataFrame([(1, " ".join(text))], "item_id long, text string")
    rows = [(1, " ".join([*text[:5], "extra", *text[5:]])), (2, " ".join([*text[:3], "other", *text[4:]])), (3, " ".join(text[::-1]))]
    found = {r["doc_id"]: r for r in decontam.contamination(docs(rows), items).collect()}
    assert [(found[k]["n_near"], found[k]["n_hit"]) for k in (1, 2, 3)] == [(1, 0), (1, 0), (0, 0)]


def test_proximity_does_not_depend_on_the_segment(spark, docs):
    text = [f"w{k}" for k in range(13)]
    items = spark.createDataFrame([(1, " ".join(text)), (2, "only four words here")], "item_id long, text string")
    rows = [(1, " ".join([*text[:5], "extra", *text[5:]])), (2, " ".join([*text[:3], "other", *text[4:]])), (3, " ".join(text[::-1])), (4, " ".join(text[2:])), (5, "but only four words here")]
    rows += [(6, " ".join([*text[:5], "x", *text[5:9], "y", "z", *text[9:]])), (7, " ".join(w for k, w in enumerate(text) if k not in (0, 6, 12)))]
    for parts in (1, len(rows)):
        found = {r["doc_id"]: r["n_near"] for r in decontam.contamination(docs(rows).repartition(parts), items).collect()}
        assert found == {1: 1, 2: 1, 3: 0, 4: 1, 5: 1, 6: 1, 7: 0}


def test_near_starts_match_brute_force():
    r = np.random.default_rng(1)
    for _ in range(200):
        n, missing, slop = int(r.integers(5, 9)), int(r.integers(0, 3)), int(r.integers(0, 4))
        lists = sorted((np.unique(r.integers(20, 60, r.integers(1, 12))) for _ in range(n)), key=len)
        offsets = r.permutation(n).tolist()
        want = [s for s in range(90) if sum(not any(abs(int(p) - s - o) <= slop for p in own) for own, o in zip(lists, offsets, strict=True)) <= missing]
        assert [s for s in decontam.Segment.near_starts(lists, offsets, missing, slop).tolist() if s >= 0] == want


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs([]), none).count() == 0
    row = decontam.contamination(docs([(1, "a b")]), none).first()
    assert (row["n_words"], row["n_items"], row["contaminated"]) == (2, 0, False)
