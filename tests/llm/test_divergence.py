"""Source divergence against sums over all shares of all groups."""

import random
import re
from collections import Counter, defaultdict

import pytest

from foliate.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def expected(rows, least, top=10):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        occurs = Counter(t for d in mine for t in set(d[2]))
        kept = sorted((t for t, n in occurs.items() if n >= least), key=lambda t: t.encode())
        counts, whole = defaultdict(Counter), Counter()
        for _, source, terms in mine:
            counts[source].update(t for t in terms if occurs[t] >= least)
            whole.update(t for t in terms if occurs[t] >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        shares, q = {s: share(counts[s]) for s in counts}, share(whole)
        for source, p in shares.items():
            pairs = [(other, sum(f(p[t], r[t]) for t in kept)) for other, r in shares.items() if other != source]
            terms = [(t, f(p[t], q[t])) for t in kept if counts[source][t] and p[t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, source, part, item, value, i) for i, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


def rows_of(seed, n):
    r = random.Random(seed)
    stock = ["the", "The", "über", "ÜBER", "naïve", "x1y", "don't", "日本語", "𝒳b", "a\u0001b", "[z]", "12", ""] + [f"w{chr(97 + k)}" for k in range(12)]
    return [(" ".join(r.choice(stock) for _ in range(r.randrange(0, 40))) if r.random() > 0.05 else None, r.choice(["en", "de", None, ""]), r.choice(["s0", "s0", "s0", "s1", "s2", "é", None])) for _ in range(n)]


@pytest.mark.parametrize(("seed", "n", "least"), [(1, 150, 10), (2, 150, 2), (3, 40, 10), (4, 20, 1)])
def test_against_all_shares(docs, seed, n, least):
    rows = rows_of(seed, n)
    got = divergence.audit(docs([(i, t, g, s, 0) for i, (t, g, s) in enumerate(rows)]), least)
    assert sorted(map(tuple, got.collect())) == expected(rows, least)


def test_sources_without_terms_and_languages_without_kept_ones(docs):
    rows = [("a b", "en", "s0")] * 12 + [("1 2", "en", "s1"), (None, "en", "s2"), ("c", "fr", "s0"), ("d", "fr", "s1"), ("e", "es", None)]
    got = sorted(map(tuple, divergence.audit(docs([(None, t, g, s, 0) for t, g, s in rows])).collect()))
    assert got == expected(rows, 10)
    assert {r[4] for r in got if r[0] == "fr"} == {0} and not [r for r in got if r[0] == "es"]


def test_clashing_names_long_texts_and_nothing(docs):
    rows = [("ab " * 60_000 + "cd", "en", "s0")] * 10 + [("cd", "en", "s1")] * 3
    table = docs([(1, t, g, s, 0) for t, g, s in rows]).selectExpr("*", "'x' AS term", "1 AS n", "2 AS p", "3 AS v", "4 AS item", "5 AS terms", "6 AS docs", "7 AS `a b.c`")
    assert sorted(map(tuple, divergence.audit(table).collect())) == expected(rows, 10)
    assert divergence.audit(table.limit(0)).count() == 0


def test_shares_beyond_a_long(spark):
    n, total, v = 9 * 10**17, 9 * 10**18, 10**6
    one = spark.createDataFrame([(n, total, v)], "n long, total long, v long").select(divergence.share("n", "total").alias("p")).first()
    assert one["p"] == 1 + 10**9 * (n + 2) // (total + 2 * v)
