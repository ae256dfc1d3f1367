"""Conversation repair against a forward search over all edits, whole and in stretches."""

import hashlib
import random
import zlib

import pytest

from foliate.llm import repair

COLUMNS = "conv_id long, turn long, role string, text string"
STEPS = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
BLANK = " \t\n\x0b\x0c\r"


def damage(rows):
    for conv_id, turn, role, text in rows:
        blank = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{blank(conv_id)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        yield from [(turn, role, text)] * (2 if kind == 3 else 1)


def cheapest(rows):
    """Edits, cost, faults and repaired lines by a search forward, which keeps the best edits for each place and state."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(BLANK)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {(0, ""): (0, "", ())}
    for i in range(len(rows) + 1):
        for _ in range(3):
            for state in STEPS:
                if (i, state) in best:
                    cost, edits, lines = best[i, state]
                    for role in ("user", "assistant"):
                        if role[0] in STEPS[state]:
                            key, way = (i, role[0]), (cost + 5, edits + "I", (*lines, f"{role}:"))
                            best[key] = min(best.get(key, way), way)
        if i == len(rows):
            break
        _, role, text = rows[i]
        for state in STEPS:
            if (i, state) not in best:
                continue
            cost, edits, lines = best[i, state]
            more = 5 * (faults[i] == "truncated")
            ways = [(state, (cost + 2, edits + "D", lines))]
            if faults[i] not in ("blank", "duplicate"):
                if role[:1] in STEPS[state]:
                    ways.append((role[:1], (cost + more, edits + "K", (*lines, f"{role}:{text}"))))
                ways += [(r[0], (cost + 1 + more, edits + "R", (*lines, f"{r}:{text}"))) for r in ("user", "assistant") if r[0] in STEPS[state]]
            for to, way in ways:
                best[i + 1, to] = min(best.get((i + 1, to), way), way)
    cost, edits, lines = min(best[len(rows), state] for state in ("", "a") if (len(rows), state) in best)
    return faults, cost, edits, "\n".join(lines)


def expected(rows):
    out = {}
    for conv_id in {r[0] for r in rows}:
        mine = sorted(damage([r for r in rows if r[0] == conv_id]), key=lambda r: (r[0] is not None, r[0] or 0))
        faults, cost, edits, lines = cheapest(mine)
        turns = [r[0] for r in mine if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[1][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv_id] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, edits, hashlib.sha256(lines.encode()).hexdigest())
    return out


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def made(seed, conversations, most):
    """Conversations with odd roles, missing turns, repeats and every kind of end; no two rows of a conversation share a turn."""
    r, rows = random.Random(seed), []
    for c in range(conversations):
        texts = [r.choice(["yes.", "no", "why?", "", " \n", "good!", "so on \t", "a. b", "ünü."]) + r.choice(["", "", f" {r.randrange(9)}."]) for _ in range(r.randrange(1, most))]
        turns = r.sample(range(-2, 3 * len(texts) + 3), len(texts))
        rows += [(c, t, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), x if r.random() > 0.05 else None) for t, x in zip(turns, texts, strict=True)]
        if r.random() < 0.1:
            rows.append((c, None, "user", "what?"))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return lambda rows: spark.createDataFrame(rows, COLUMNS)


def test_against_a_forward_search(table):
    rows = made(1, 300, 14)
    assert found(repair.repair(table(rows))) == expected(rows)


def test_conversations_cut_into_stretches(table):
    rows = made(2, 25, 60)
    assert found(repair.repair(table(rows), held=2, stretch=7)) == expected(rows)


def test_one_conversation_over_all_tasks(table):
    r = random.Random(3)
    rows = [(7, t, r.choice(["user", "assistant", "system"]), f"{r.randrange(900)}" + r.choice([".", ".", ""])) for t in range(3000)] + [(8, 0, "user", "hi!"), (None, 1, "user", "x."), (None, 2, "assistant", "y.")]
    assert found(repair.repair(table(rows), stretch=100)) == expected(rows)


def test_a_conversation_that_loses_all_rows(table):
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    for held in (2, 1000):
        result = found(repair.repair(table([(5, gone, "user", "x."), (4, 1, "user", "x."), (6, 1, "user", "x.")]), held=held))
        assert result[5] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_ties_clashing_names_long_texts_and_nothing(spark, table):
    rows = [(1, 3, "user", "b."), (1, 3, "user", "a."), (1, 3, "user", "b."), (1, None, "assistant", "c."), (2, 1, "user", "x " * 60_000 + "?"), (2, 2, "assistant", None), (None, None, None, None)]
    names = {c: "1" for c in ("part", "pos", "whole", "gone", "sym", "stretch", "kind", "copy", "a b.c")}
    odd = table(rows).selectExpr("*", *[f"{v} AS `{k}`" for k, v in names.items()])
    once = found(repair.repair(odd))
    assert once == found(repair.repair(odd.repartition(3, "text"), held=2, stretch=2)) and set(once) == {1, 2, None}
    assert repair.repair(odd.limit(0)).count() == 0


def test_turns_at_the_ends_of_their_range(table):
    rows = [(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")]
    for held in (1, 1000):
        assert found(repair.repair(table(rows), held=held))[1][0] in (0, 2**63 - 1)
