import random

import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from foliate.llm import decontam, mixing, near, quality, simhash
from foliate.llm.paragraphs import bands


def tables(tmp_path, words):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(240):
        text = words(r.randrange(30, 120), i)
        good = i % 4 > 0
        if not good:
            text = " | ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text, "en" if i % 2 else "de", f"src{i % 3}", len(text)))
        labels.append((i, int(good), 0))
    rows += [(300 + k, rows[k * 4 + 1][1], "en", "src0", 1) for k in range(20)]
    item = words(30, 900)
    rows += [(400 + k, words(40, 600 + k) + " " + item, "en", "src1", 1) for k in range(10)] + [(500, None, None, None, None)]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    pq.write_table(pa.table({n: [x[i] for x in rows] for i, n in enumerate(names)}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [x[0] for x in labels], "quality": [x[1] for x in labels], "toxic": [0] * len(labels)}), tmp_path / "labels.parquet")
    pq.write_table(pa.table({"item_id": [1], "text": [item]}), tmp_path / "benchmark.parquet")
    return {x[0]: x for x in rows}


def test_stages_take_effect_and_lose_nothing_else(spark, tmp_path, words):
    rows = tables(tmp_path, words)
    d = str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == list(corpus_pipeline.COLUMNS)
        path = str(tmp_path / name)
        out.write.parquet(path)
        kept = spark.read.parquet(path)
        found = [r["doc_id"] for r in kept.collect()]
        assert len(found) == len(set(found)) and set(found) <= before
        if name == "quality":
            scored = {r["doc_id"]: r["predicted"] for r in quality.classify(docs, spark.read.parquet(f"{d}/labels.parquet")).collect()}
            assert set(found) == {i for i in before if scored[i]}
            assert sum(i % 4 > 0 for i in found if i < 240) >= 170 and not [i for i in found if i < 240 and i % 4 == 0]
        elif name == "near_duplicates":
            assert set(found) == {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
        elif name == "decontamination":
            bad = {r["doc_id"] for r in decontam.contamination(docs, spark.read.parquet(f"{d}/benchmark.parquet")).collect() if r["contaminated"]}
            assert set(found) == before - bad and bad == {i for i in before if i is not None and 400 <= i < 410}
        else:
            assert set(found) == {r["doc_id"] for r in mixing.mix(docs).collect() if r["kept"]}
        for r in kept.collect():
            assert tuple(r) == rows[r["doc_id"]]
        docs, before = kept, set(found)
    name, stage = corpus_pipeline.STAGES[-1]
    assert {r["doc_id"] for r in stage(spark, docs, d).collect()} == before


def test_run_gives_the_last_stage(spark, tmp_path, words):
    tables(tmp_path, words)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 50 and "shard" in out.columns


def test_hot_group_of_copies(spark, docs, words):
    rows = [(k, words(50, 1)) for k in range(300)] + [(1000 + k, words(50, k + 2)) for k in range(20)]
    kept = sorted(r["doc_id"] for r in simhash.representatives(docs(rows)).collect())
    assert kept[0] == 0 and len(kept) == 21


def test_near_copies_at_a_similarity_of_eight_tenths_go(spark, docs, words):
    def jaccard(a, b):
        a, b = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
        return len(a & b) / len(a | b)

    rows, want = [(900, "a b c"), (901, "A  b c"), (902, "a b d"), (903, None), (904, "")], {900, 902, 903}
    for k in range(40):
        base = words(200, 1000 + k).split()
        copy = list(base)
        for n in range(k % 4 + 1):  # each changed word changes five shingles
            copy[20 + 40 * n] = f"changed{k}x{n}"
        rows += [(k, " ".join(base)), (100 + k, " ".join(copy))]
        assert jaccard(" ".join(base), " ".join(copy)) >= 0.8
        want.add(k)
        far = [w if i % 20 else f"other{k}x{i}" for i, w in enumerate(base)]
        assert jaccard(" ".join(base), " ".join(far)) < 0.8
        rows.append((200 + k, " ".join(far)))
        want.add(200 + k)
    found = corpus_pipeline.near_duplicate_stage(spark, docs(rows).repartition(3), "")
    assert {r["doc_id"] for r in found.collect()} == want


def test_bands_meet_as_often_as_they_promise():
    count, rows = bands(0.8, near.RECALL, near.HASHES)
    assert 1 - (1 - 0.8**rows) ** count >= near.RECALL and 1 - (1 - 0.2**rows) ** count < 0.002
    assert near.differing(1.0) == 0 and near.differing(0.8) * near.BITS < near.radius() < near.BITS // 2


def test_recall_at_the_threshold_whatever_the_trees(spark, docs, words):
    r = random.Random(8)
    rows = []
    for k in range(300):
        base = words(240, 5000 + k).split()
        copy = list(base)
        for at in r.sample(range(10, 230, 10), 5):  # five changed words: 25 of 236 shingles, Jaccard 0.81
            copy[at] = f"other{k}x{at}"
        rows += [(k, " ".join(base)), (1000 + k, " ".join(copy))]
    kept = {}
    for nodes in (20_000, 3):
        kept[nodes] = {x["doc_id"] for x in near.representatives(docs(rows), tree_nodes=nodes).collect()}
        assert set(range(300)) <= kept[nodes]  # none falls without its copy
        assert len(kept[nodes]) <= 300 + 300 * 0.03
    assert kept[3] == kept[20_000]
