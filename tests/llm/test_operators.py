import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foliate.llm import common, langid, mixing, quality, secrets, sharding, simhash, topk


# ---- components


@pytest.mark.parametrize("seed", range(3))
def test_components_match_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(5, 5), (None, 3), (100, 101), (101, 102), (102, 103), (103, 104)]
    up = list(range(200))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None:
            a, b = sorted((top(a), top(b)))
            up[b] = a
    want = {i: top(i) for i in range(200) if sum(top(j) == top(i) for j in range(200)) > 1}
    got = {x["node"]: x["label"] for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1 SimHash


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def near_rows(words):
    rows = [(k, words(60, k)) for k in range(20)]
    for k in range(8):
        w = words(60, k).split()
        w[k] = "changed"
        rows.append((30 + k, " ".join(w)))
    return rows + [(50, None), (51, ""), (52, " \t"), (53, "one two"), (54, "ONE  two"), (3, words(60, 3)), (3, words(60, 9)), (None, words(60, 4)), (None, "alone here"), (60, words(60, 5) + " x")]


@pytest.mark.parametrize("tree", [20_000, 3])
def test_near_duplicates_match_brute_force(docs, words, monkeypatch, tree):
    rows = near_rows(words)
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda nodes, radius: links(nodes, radius, tree))
    prints = [plain_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            a, b = sorted((top(i), top(j)))
            up[b] = a
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(d, low.get(top(i), d))
    want = sorted(((d, f"{prints[i]:016x}", low.get(top(i))) for i, (d, _) in enumerate(rows)), key=str)
    got = sorted((tuple(r)[:3] for r in simhash.near_duplicates(docs(rows).repartition(3)).collect()), key=str)
    assert got == want
    kept = simhash.representatives(docs(rows)).select("doc_id", "text").collect()
    assert len(kept) == len({top(i) for i in range(len(rows))})
    by = {(d, t): top(i) for i, (d, t) in enumerate(rows)}
    assert len({by[tuple(r)] for r in kept}) == len(kept)


def test_long_text_in_pieces(words, monkeypatch):
    text = words(3000, 1)
    want = plain_fingerprint(text)
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 100)
    assert simhash.fingerprint(text) == want


def test_links_are_complete():
    r = random.Random(2)
    tree, values, up = simhash.BKTree(4), [], {}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    centres = [r.getrandbits(64) for _ in range(5)]
    for _ in range(400):
        x = r.choice(centres)
        for _ in range(r.randrange(9)):
            x ^= 1 << r.randrange(64)
        if x not in up:
            up[x] = x
            for y in tree.add(x):
                up[top(y)] = x
            values.append(x)
    for x, y in itertools.combinations(values, 2):
        if (x ^ y).bit_count() <= 4:
            assert top(x) == top(y)


# ---- 2 top-k


def test_topk_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 50)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=6).round(1)]) for i in range(240)]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, []), (20, rows[40][1]), (500, rows[20][1]), (501, rows[20][1]), (None, rows[1][1]), (305, [9e7] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    usable = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int).tolist()) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    queries = {}
    for i, w in usable:
        if i % 20 == 0:
            queries[i] = min(w, queries.get(i, w))
    want = []
    for q, w in queries.items():
        scored = sorted(((-sum(a * b for a, b in zip(w, v)), i) for i, v in usable if i != q))[:20]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    assert sorted(tuple(x) for x in topk.neighbours(table).collect()) == sorted(want)
    assert topk.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ---- 3 mixing


def mixed_docs(spark, words):
    r = random.Random(4)
    rows = [(i, words(r.randrange(1, 40), i) + (" All rights reserved" if i % 7 == 0 else ""), r.choice(["en", "de", None]), r.choice("abc") if i % 3 else "a", 0) for i in range(400)]
    return spark.createDataFrame([*rows, (900, None, "en", "a", 0), (901, "", None, None, 0), (5, *rows[5][1:])], "doc_id long, text string, lang string, source string, n_chars long")


def test_margins_meet_their_targets(spark, words):
    rows = mixing.features(mixed_docs(spark, words)).cache()
    targets = {"source": {"a": 0.2, "b": 0.3, "c": 0.5, "z": 0.5}, "lang": {"en": 0.6, "de": 0.3, mixing.NONE: 0.1}}
    for together in (True, False):
        cells = mixing.rake(mixing.cells_of(rows), targets, rounds=40, together=together)
        for margin, goal in targets.items():
            got = {r[margin]: r["s"] for r in cells.groupBy(margin).agg(F.sum("weight").alias("s")).collect()}
            whole = sum(goal[k] for k in got)
            assert all(abs(got[k] - goal[k] / whole) < 1e-6 for k in got)


def test_expected_tokens_are_the_budget(spark, words):
    found = mixing.mix(mixed_docs(spark, words), budget=0.5).collect()
    tokens = sum(r["tokens"] for r in found)
    assert abs(sum(r["tokens"] * r["p"] for r in found) / tokens - 0.5) < 1e-3
    assert all(r["kept"] for r in found if r["tokens"] == 0) and len(found) == 403
    kept = sorted((r["doc_id"] for r in found if r["kept"]))
    assert sorted(r["doc_id"] for r in mixing.sample(mixed_docs(spark, words), budget=0.5).collect()) == kept
    assert mixing.mix(mixed_docs(spark, words).limit(0)).count() == 0


def test_kept_tokens_meet_the_margins_under_the_cap(spark, words):
    rows = mixing.features(mixed_docs(spark, words)).cache()
    mass = lambda m: {r[m]: r["s"] for r in rows.groupBy(m).agg(F.sum("tokens").alias("s")).collect() if r["s"]}
    whole = sum(mass("lang").values())
    # "All rights reserved" marks a seventh of the texts: less than the half that is asked for, so it is kept whole.
    targets = {"source": {"a": 0.45, "b": 0.28, "c": 0.27}, "lang": {"en": 0.3, "de": 0.3, mixing.NONE: 0.4}, "topic": {"legal": 0.5, "prose": 0.5}}
    legal = mass("topic")["legal"] / (0.6 * whole)
    goals = targets | {"topic": {"legal": legal, "prose": 1 - legal}}
    assert legal < 0.5
    for cells in (mixing.chances(rows, targets, 0.6), mixing.rake_bounded(mixing.cells_of(rows), targets, 0.6)):
        found = mixing._decided(rows, cells.select(*mixing.MARGINS, "p")).where("tokens > 0")
        assert found.agg(F.max("p")).first()[0] <= 1
        for m, goal in goals.items():
            got = {r[m]: r["s"] for r in found.groupBy(m).agg(F.sum(F.col("tokens") * F.col("p")).alias("s")).collect()}
            assert all(abs(got[k] / (0.6 * whole) - goal[k]) < 2e-3 for k in goal), (m, got)


# ---- 4 language


def test_backpropagation_matches_differences():
    rng = np.random.default_rng(0)
    p = [x.astype(np.float64) for x in langid._start(3, rng)]
    x = rng.integers(97, 103, (6, 4)).astype(np.uint8)
    weight = rng.normal(size=(6, 4, langid.HIDDEN))

    def loss():
        h, _ = langid._forward(x, p[0], p[1])
        return float((h[1:] * weight).sum())

    h, g = langid._forward(x, p[0], p[1])
    dtable, dweights = langid._backward(x, h, g, weight, p[0], p[1])
    for array, grad, at in ((p[0], dtable, (98, 3)), (p[0], dtable, (99, 12)), (p[1], dweights, (2, 5)), (p[1], dweights, (0, 13))):
        array[at] += 1e-2
        up = loss()
        array[at] -= 2e-2
        down = loss()
        array[at] += 1e-2
        assert abs((up - down) / 2e-2 - grad[at]) < 2e-2 * max(1, abs(grad[at]))


def test_prediction_is_that_of_the_trained_cells():
    rng = np.random.default_rng(0)
    texts = [b"the cat sat on the mat " * 12, b"der hund und die katze " * 12]
    model = langid.train(texts * 8, [0, 1] * 8, ["en", "de"], steps=20)
    raw = np.frombuffer(b"".join(texts) + b"x", np.uint8)
    offsets = np.array([0, len(texts[0]), len(texts[0]) + len(texts[1]), len(raw)])
    sums, counts = langid.predict(raw, offsets, model)
    assert counts.sum(1).tolist() == np.diff(offsets).tolist() and np.allclose(sums.sum(1), np.diff(offsets), atol=1e-2)
    own = np.frombuffer(texts[1][: langid.STEPS], np.uint8)[:, None]
    hf, _ = langid._forward(own, *model.cells[0])
    hb, _ = langid._forward(own[::-1], *model.cells[1])
    logits = hf[1:, 0] @ model.out[0] + hb[1:, 0][::-1] @ model.out[1] + model.out[2]
    e = np.exp(logits - logits.max(1, keepdims=True))
    one, _ = langid.predict(own[:, 0], np.array([0, len(own)]), model)
    assert np.allclose(one[0], (e / e.sum(1, keepdims=True)).sum(0), atol=1e-3)


def test_languages_are_told_apart(docs):
    r = random.Random(1)
    stock = {"en": "the of and thing with for was that".split(), "de": "der die und nicht ein über größe für".split(), "fr": "le la et être dans où très déjà".split()}
    rows = [(i, " ".join(r.choice(stock[k]) for _ in range(r.randrange(20, 300))), k) for i, k in enumerate(["en", "de", "fr"] * 60)]
    rows += [(1000, None, "en"), (1001, "123 !?", "en"), (1002, "", None), (1003, "the thing was for that and with", None)]
    found = {x["doc_id"]: x for x in langid.identify(docs([(*row, "s", 0) for row in rows])).collect()}
    for i in (1000, 1001, 1002):
        assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0)
    held = [(found[i]["lang_pred"], k) for i, _, k in rows[:180] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)
    assert sum(a == b for a, b in held) >= 0.95 * len(held) and all(0 <= x["score"] <= 1 for x in found.values())
    none = langid.identify(docs([(1, "abc", None, "s", 0)])).first()
    assert (none["lang_pred"], none["score"]) == ("und", 0.0)
    assert langid.identify(docs([])).count() == 0


# ---- 6 secrets


def plain_scan(text):
    text = text or ""
    found = [(*m.span(), 0) for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(*m.span(), 1) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(*m.span(), 2) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    found.sort(key=lambda s: (s[0], s[2]))
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{i}:{j}" for i, j, k in found), [sum(s[2] == k for s in found) for k in range(3)]


def secret_rows():
    key, blob = "AKIA" + "AB12" * 4, "aB3" * 12
    rows = ["", None, "nothing", f"é {key} x", f"{key}{key} AKIA123", "PassWord = 'abcdef' token:\"x\"", "token: token: abcdef", "api_key=abcde apikey:abcdef0123", "0" * 23 + "g" + "f" * 24, "secret=" + "a" * 30]
    rows += [f"id {key} then {blob}", f"{blob} alone", f"user: bob {'.' * 50} {blob} https://h.example/x", f"https://h.example/x user=bob", f"user=bob {'z ' * 150} {blob}", f"{blob} https://h.example/{'p' * 900} user: eve", "ſecret=abcdefgh toKen=abcdefgh"]
    return list(enumerate(rows)) + [(4, rows[4]), (None, rows[10])]


def test_secrets_match_plain_regexes(docs):
    rows = secret_rows()
    got = sorted(((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secrets.scan(docs(rows).repartition(3)).collect()), key=str)
    want = []
    for i, text in rows:
        listed, counts = plain_scan(text)
        want.append((i, *counts, hashlib.sha256(listed.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert secrets.scan(docs([])).count() == 0


def test_weak_parts_need_complements(docs):
    rows = secret_rows()
    found = {r["doc_id"]: r for r in secrets.scan(docs(rows)).collect() if r["doc_id"] is not None}
    kinds = lambda i: [x.split(":")[0] for x in found[i]["spans"].split(",") if x]
    assert kinds(10) == ["access", "blob"] and kinds(11) == [] and sorted(kinds(12)) == ["blob", "endpoint", "user"]
    assert kinds(13) == [] and kinds(14) == [] and sorted(kinds(15)) == ["blob", "endpoint"]

    def brute(text):
        parts = [(*s, secrets.ROLES[s[2]]) for s in secrets.base_spans(text) + secrets.weak_spans(text)]
        near = lambda a, b: b[0] <= a[1] + secrets.SCOPE and b[1] >= a[0] - secrets.SCOPE
        return sum(all(any(b[3] in roles and near(a, b) for b in parts) for roles in secrets.NEEDS[a[2]]) for a in parts if a[2] in secrets.NEEDS)

    for i, text in rows:
        if i is not None:
            assert found[i]["n_linked"] == brute(text or "")


# ---- 8 quality


def test_quality_on_held_out_documents(spark, docs, words):
    r = random.Random(0)
    rows, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        text = words(r.randrange(20, 200), i)
        if not good:
            text = " | ".join(w.upper() + "!!" for w in text.split()) if i % 2 else (text.split()[0] + " ") * 60
        rows.append((i, text))
        labels.append((i, int(good), 0))
    rows += [(1000, None), (1001, ""), (1002, words(50, 5000)), (None, "x")]
    table = spark.createDataFrame([*labels, (5, None, 0), (None, 1, 0), (7, 3, 0)], "doc_id long, quality int, toxic int")
    found = {x["doc_id"]: x for x in quality.classify(docs(rows), table).collect()}
    assert len(found) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.3) for x in found.values())
    assert found[1000]["score"] == found[1001]["score"]
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i]["held_out"] == (i in held) for i in range(600))
    assert sum(found[i]["predicted"] == (i % 3 > 0) for i in held) >= 0.95 * len(held)


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(docs([(1, "a"), (2, None)]), none).first()["score"] == pytest.approx(0.5)
    assert quality.classify(docs([]), none).count() == 0


# ---- 10 sharding


def test_shards(spark, docs, words):
    rows = [(i, words(i % 30, i)) for i in range(500)] + [(600, None), (601, ""), (5, "other"), (5, "other"), (None, "x"), (602, "é")]
    found = sharding.shard(docs(rows).repartition(3)).collect()
    assert len(found) == len(rows) and {r["law"] for r in found} == {"key"}
    by = {}
    for r in found:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40) and 0 <= r["shard"] < 40
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    texts = {i: t for i, t in rows[:500]} | {600: None, 601: "", 602: "é"}
    for r in found:
        if r["doc_id"] in texts and r["doc_id"] != 5:
            raw = (texts[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
    part = {r["doc_id"]: r["shard"] for r in sharding.shard(docs(rows[::3])).collect()}
    assert all(part[r["doc_id"]] == r["shard"] for r in found if r["doc_id"] in part)
    assert sharding.shard(docs([])).count() == 0


def test_slot_maps():
    for n in (1, 2, 7, 40):
        now = sharding.slot_map(n)
        counts = np.bincount(now, minlength=n)
        assert counts.max() - counts.min() <= max(2, 0.03 * counts.mean())
        more = sharding.grown(now, n)
        assert all(a == b or b == n for a, b in zip(now, more)) and more == sharding.slot_map(n + 1)
    r = random.Random(1)
    sizes = [r.randrange(1000) ** 2 for _ in range(512)]
    now = sharding.slot_map(8, 512)
    moved = sharding.rebalanced(now, sizes, 8)
    load = lambda m: [sum(s for s, x in zip(sizes, m) if x == k) for k in range(8)]
    assert max(load(moved)) < max(load(now)) and max(load(moved)) <= 1.011 * sum(sizes) / 8
