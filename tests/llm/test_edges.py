"""Odd tables through every operator: clashing columns, nulls, very long texts, ties, repeated rows, nothing at all."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliate.llm import decontam, langid, mixing, near, paragraphs, quality, secrets, sharding, simhash, suffix

#: Names that operators use for columns of their own.
CLASHING = ("row", "k1", "k2", "fp", "key", "score", "n_bytes", "shard", "slot", "gone", "tokens", "topic", "p", "kept", "vslot", "a b.c")


@pytest.fixture(scope="module")
def odd(docs, words):
    long = "\n".join(words(200, k) for k in range(150))
    rows = [(i, words(30 + i, i), "en" if i % 2 else "de", f"s{i % 3}", 1) for i in range(12)]
    rows += [(20, None, None, None, None), (None, None, None, None, None), (None, words(9, 1), "en", None, 1), (21, "", "en", "s0", 0), (22, " \t\n ", "de", "s1", 3)]
    rows += [(23, long, "en", "s1", len(long)), (24, "x" * 120_000, "de", "s1", 120_000), (3, rows[3][1], "en", "s0", 1), rows[5], rows[5]]
    table = docs(rows)
    return table.select("*", *[(F.lit("mine") if i % 2 else F.lit(i)).alias(c) for i, c in enumerate(CLASHING)])


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def benchmark(spark, words):
    return spark.createDataFrame([(1, words(30, 0)), (None, "x"), (2, None)], "item_id long, text string")


OPERATORS = {
    "op1": lambda s, d, w: simhash.near_duplicates(d),
    "op3": lambda s, d, w: mixing.mix(d),
    "op4": lambda s, d, w: langid.identify(d),
    "op5": lambda s, d, w: decontam.contamination(d, benchmark(s, w)),
    "op6": lambda s, d, w: secrets.scan(d),
    "op7": lambda s, d, w: paragraphs.repeated(d, least=1),
    "op8": lambda s, d, w: quality.classify(d, labels(s)),
    "op9": lambda s, d, w: suffix.remove_repeats(d),
    "op10": lambda s, d, w: sharding.shard(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, odd, words, name):
    found = OPERATORS[name](spark, odd, words)
    ids = lambda df: sorted((r[0] for r in df.select("doc_id").collect()), key=str)
    assert ids(found) == ids(odd)
    assert OPERATORS[name](spark, odd.limit(0), words).count() == 0


def test_filters_carry_all_columns(spark, odd, words):
    model = quality.fit(odd, labels(spark))
    whole = {(r["doc_id"], r["text"]): tuple(r) for r in odd.collect()}
    kept = {"simhash": simhash.representatives(odd), "near": near.representatives(odd), "mixing": mixing.sample(odd), "quality": quality.accepted(odd, model, 0.0), "paragraphs": paragraphs.deduplicate(odd)}
    for name, found in kept.items():
        assert found.columns == odd.columns, name
        rows = found.collect()
        assert rows and all(tuple(r)[2:] == next(v[2:] for (d, _), v in whole.items() if d == r["doc_id"] and v[2:] == tuple(r)[2:]) for r in rows), name
        if name != "paragraphs":
            assert all(tuple(r) == whole[r["doc_id"], r["text"]] for r in rows), name
    assert quality.accepted(odd, model, 0.0).count() == odd.count() and paragraphs.deduplicate(odd).count() == odd.count()
    with pytest.raises(ValueError, match="score"):
        quality.score(odd, model, keep=("doc_id", "score"))


def test_stages_on_odd_and_empty_tables(spark, odd, words, tmp_path):
    for name, table in (("labels", labels(spark)), ("benchmark", benchmark(spark, words))):
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, odd.limit(0), str(tmp_path))
        assert none.count() == 0, name
        found = stage(spark, odd, str(tmp_path))
        assert found.count() <= odd.count(), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert found.columns == list(corpus_pipeline.COLUMNS) == none.columns, name


@pytest.mark.parametrize("blocks", [5, 6, 8])
def test_links_by_longer_shard_keys(spark, blocks):
    r = random.Random(blocks)
    values = {r.getrandbits(64) for _ in range(60)}
    for x in list(values):
        for _ in range(3):
            y = x
            for bit in r.sample(range(64), r.randrange(1, 8)):
                y ^= 1 << bit
            values.add(y)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(x),) for x in values], "fp long")
    up = {x: x for x in values}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    edges = [(int(e["a"]) % (1 << 64), int(e["b"]) % (1 << 64)) for e in simhash.links(nodes, blocks=blocks).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    for a, b in edges:
        up[top(a)] = top(b)
    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= 4:
            assert top(a) == top(b)


def test_blocks_grow_with_the_fingerprints():
    sizes = [10**k for k in range(3, 13)]
    found = [simhash.shard_blocks(n) for n in sizes]
    assert found == sorted(found) and found[0] == 5
    assert all(n >> 64 * (b - 4) // b <= simhash.TREE_NODES // 2 for n, b in zip(sizes, found, strict=True))


def test_more_languages_than_texts_for_each(spark, docs, monkeypatch):
    monkeypatch.setattr(langid, "TEXTS", 40)
    rows = [(i, f"text number {i} of language {i % 30}", f"l{i % 30:02d}", "s", 0) for i in range(300)]
    assert len({lang for lang, _ in langid.training_sample(docs(rows))}) == 30


def test_versions_of_the_slot_map(spark, docs, words, tmp_path):
    rows = [(i, words(1 + (i * i) % 300, i)) for i in range(400)]
    path = str(tmp_path / "map")
    found = sharding.shard(docs(rows), 8, 256, path).collect()
    maps = sharding.load_maps(spark, path)
    one, grown, even = (sharding.version_of(maps, v) for v in (1, 2, 3))
    assert one == sharding.slot_map(8, 256) and grown == sharding.grown(one, 8)
    for r in found:
        assert (r["shard"], r["grown_shard"], r["rebalanced_shard"]) == (one[r["vslot"]], grown[r["vslot"]], even[r["vslot"]])
    load = lambda name: [sum(r["size"] for r in found if r[name] == k) for k in range(8)]
    assert max(load("rebalanced_shard")) - min(load("rebalanced_shard")) < max(load("shard")) - min(load("shard"))
    assert sharding.append_versions(spark, path, [(8, even)]) == [4] and sharding.version_of(sharding.load_maps(spark, path), 1) == one
    # Numbered as a plain count within each shard: by virtual slot, then doc_id.
    for k in range(8):
        own = sorted((r["vslot"], r["doc_id"]) for r in found if r["shard"] == k)
        assert [r["slot"] for r in sorted((r for r in found if r["shard"] == k), key=lambda r: (r["vslot"], r["doc_id"]))] == list(range(len(own)))


def test_passages_below_and_above_the_string_length(docs, words):
    """op9 takes whole strings of 400 bytes: a shared passage of over 50 words is cut only if it is that long."""
    short, long = words(60, 901)[:390], words(140, 902)[:410]
    rows = [(i, f"{words(40, 10 + i)} #{i}# {short} #{i}# {words(40, 50 + i)}") for i in range(2)] + [(10 + i, f"{words(40, 90 + i)} #{i}# {long} #{i}# {words(40, 130 + i)}") for i in range(2)]
    found = {r["doc_id"]: r["n_removed"] for r in suffix.remove_repeats(docs(rows)).collect()}
    assert len(short.split()) > 50 and found[0] == found[1] == 0
    assert found[10] == found[11] >= 410
