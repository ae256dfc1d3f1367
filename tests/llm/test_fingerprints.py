"""Fingerprints against fresh ones of whole texts, edits, order and likeness."""

import hashlib
import random

import numpy as np
import pytest

from foliate.llm import fingerprints as fp


def expected(rows):
    """By doc_id; ids are distinct and not null."""
    rows, out = sorted(((i, t or "") for i, t in rows), reverse=True), {}
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        own, after, other = (fp.text_sums([t]) for t in (text, new, following))
        out[i] = (len(text), hashlib.sha256(new.encode()).hexdigest(), own.strings()[0], after.strings()[0], float(fp.likeness(own, after)[0]), float(fp.likeness(own, other)[0]))
    return out


def test_against_whole_texts(spark, docs, words):
    r = random.Random(5)
    rows = [(i * 3 - 50, "\n".join(words(r.randrange(0, 12), i * 100 + k) for k in range(r.randrange(1, 8)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "\n"), (1003, "x"), (1004, "é日𝒳" * 5), (1005, "a\n" * 9), (1006, words(90_000, 3)), (1007, rows[3][1]), (1008, rows[3][1])]
    got = fp.audit(docs(rows))
    assert {row[0]: tuple(row)[1:] for row in got.collect()} == expected(rows) and got.count() == len(rows)


@pytest.mark.parametrize("n", [1, 2])
def test_few_documents(docs, n):
    rows = [(i, f"one {i}\ntwo words more {i}") for i in range(n)]
    assert {r[0]: tuple(r)[1:] for r in fp.audit(docs(rows)).collect()} == expected(rows)


def test_ids_that_repeat_or_are_null(docs, words):
    rows = [(None, words(20, i)) for i in range(60)] + [(7, words(20, 100 + i)) for i in range(60)] + [(i, words(20, 200 + i)) for i in range(60)] + [(7, "same text here"), (7, "same text here"), (None, None), (None, "")]
    got = fp.audit(docs(rows).selectExpr("*", "1 AS bucket", "2 AS guard", "3 AS h", "4 AS `a b.c`")).collect()
    assert len(got) == len(rows)
    # Each document is the next one of exactly one other: the edited texts take up every document's start.
    texts = sorted(t or "" for _, t in rows)
    assert sorted(r["fingerprint"] for r in got) == sorted(fp.text_sums(texts).strings())
    by_print = {f: t for f, t in zip(fp.text_sums(texts).strings(), texts, strict=True)}
    for r in got:
        own, half = by_print[r["fingerprint"]], len(by_print[r["fingerprint"]]) // 2
        assert r["edited_sha256"] in {hashlib.sha256((own[: len(own) - half] + t[:half]).encode()).hexdigest() for t in texts}
    assert fp.audit(docs(rows).limit(0)).count() == 0


def test_order_does_not_matter_but_times_do(words):
    lines = [words(10, k) for k in range(20)]
    a, b, c, d = fp.text_sums(["\n".join(lines), "\n".join(reversed(lines)), "\n".join([*lines, lines[0]]), "\n".join(lines[1:])]).strings()
    assert a == b and len({a, c, d}) == 3
    assert fp.text_sums([""]).strings() == fp.Sums.zero(1).strings() != fp.text_sums(["\n"]).strings()
    assert fp.Sums.of_strings([a, c]).strings() == [a, c]


def test_likeness_tells_how_much_is_shared(words):
    lines = [words(40, k) for k in range(40)]
    for shared in (0, 10, 20, 30, 40):
        a, b = fp.text_sums(["\n".join(lines)]), fp.text_sums(["\n".join(lines[:shared] + [words(40, 1000 + k) for k in range(40 - shared)])])
        assert abs(float(fp.likeness(a, b)[0]) - shared / 40) < 0.2
    blank = fp.text_sums([" ", "\t"])
    assert list(fp.likeness(blank[:1], blank[1:])) == [0.0] and list(fp.likeness(blank, blank)) == [1.0, 1.0]


def test_lanes_are_those_of_a_plain_sum(words):
    texts = [words(9, 1) + "\n" + words(2, 2), "", words(1, 3), "a b c a b c a b c"]
    whole = fp.text_sums(texts)
    for i, t in enumerate(texts):
        parts = [fp.lines_sums([p]) for p in t.split("\n")] if t else [fp.Sums.zero(1)]
        assert (sum((p.lanes for p in parts[1:]), parts[0].lanes) == whole.lanes[i]).all() and (sum((p.wide for p in parts[1:]), parts[0].wide) == whole.wide[i]).all()
    assert int(np.abs(whole.lanes.view(np.int16)[3]).sum()) == 7


def test_fingerprints_follow_changes(spark, words):
    before = {i: [words(6, 10 * i + k) for k in range(5)] for i in range(30)}
    fingerprints = spark.createDataFrame([(i, fp.text_sums(["\n".join(t)]).strings()[0]) for i, t in before.items()], "doc_id long, fingerprint string")
    changes, after = [], {}
    for i, lines in before.items():
        new = lines[1:] + [words(7, 5000 + i)] * 2
        after[i] = fp.text_sums(["\n".join(new)]).strings()[0]
        changes += [(i, lines[0], -1), (i, new[-1], 2)]
    changes += [(99, "only line", 1), (3, None, 1), (3, "x", None)]
    after[99] = fp.text_sums(["only line"]).strings()[0]
    got = fp.changed(fingerprints, spark.createDataFrame(changes, "doc_id long, paragraph string, times int"))
    assert {r["doc_id"]: r["fingerprint"] for r in got.collect()} == after
