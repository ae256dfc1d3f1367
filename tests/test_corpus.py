"""Merging pages into a corpus."""

import random

import pytest
from pyspark.sql import functions as F

from foliate.jobs import polish as job
from foliate.operators import blocks
from foliate.sources import corpus

PAGES = "vendor string, slug string, text string"


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "corpus")


@pytest.fixture(scope="module")
def table(spark):
    return lambda rows: spark.createDataFrame(rows, PAGES)


def stored(spark, root, version=None):
    rows = [tuple(r) for r in corpus.read_corpus(spark, root, version).collect()]
    assert len({r[:2] for r in rows}) == len(rows)
    return {r[:2]: r[2] for r in rows}


def files(tmp_path):
    return {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}


def test_unchanged_pages_stay(spark, table, root):
    first = [("alpha", f"p{i}", f"text {i}") for i in range(50)]
    assert corpus.merge_pages(table(first), root, buckets=8) == 1
    assert corpus.merge_pages(table([("alpha", "p7", "new"), ("beta", "p7", "more"), ("alpha", "p8", "text 8")]), root) == 2
    want = {(v, s): t for v, s, t in first} | {("alpha", "p7"): "new", ("beta", "p7"): "more"}
    assert stored(spark, root) == want and stored(spark, root, 1) == {(v, s): t for v, s, t in first}
    with pytest.raises(ValueError, match="no version 5"):
        corpus.read_corpus(spark, root, 5)


def test_a_merge_without_changes_writes_nothing(spark, table, root, tmp_path):
    rows = [("alpha", f"p{i}", f"text {i}") for i in range(20)]
    corpus.merge_pages(table(rows), root, buckets=4)
    before = files(tmp_path)
    assert corpus.merge_pages(table(rows[5:12]), root) == 1 and corpus.merge_pages(table([]), root) == 1
    assert files(tmp_path) == before


def test_only_touched_buckets_are_written(spark, table, root, tmp_path):
    rows = [("alpha", f"p{i}", f"text {i}") for i in range(200)]
    corpus.merge_pages(table(rows), root, buckets=16)
    before = set(files(tmp_path))
    corpus.merge_pages(table([("alpha", "p3", "other")]), root)
    assert len({f.rpartition("/")[0] for f in set(files(tmp_path)) - before}) == 1


def test_a_failed_merge_changes_nothing(spark, table, root):
    rows = [("alpha", f"p{i}", f"text {i}") for i in range(20)]
    corpus.merge_pages(table(rows), root, buckets=4)
    bad = table([("alpha", "p1", "x"), ("alpha", "p2", "y")]).withColumn("text", F.when(F.col("slug") == "p2", F.raise_error(F.lit("broken page"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken page"):
        corpus.merge_pages(bad, root)
    assert stored(spark, root) == {(v, s): t for v, s, t in rows} and corpus.versions(spark, root) == [1]


def test_a_merge_that_fails_before_its_snapshot(spark, table, root, monkeypatch):
    corpus.merge_pages(table([("alpha", "p", "a"), ("alpha", "q", "b")]), root, buckets=2)
    publish = corpus._publish

    def late(*given):
        publish(*given)  # another merge was faster
        publish(*given)

    monkeypatch.setattr(corpus, "_publish", lambda *given: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        corpus.merge_pages(table([("alpha", "p", "c")]), root)
    assert stored(spark, root) == {("alpha", "p"): "a", ("alpha", "q"): "b"}
    monkeypatch.setattr(corpus, "_publish", late)
    with pytest.raises(corpus.Conflict):
        corpus.merge_pages(table([("alpha", "p", "d")]), root)
    assert stored(spark, root) == {("alpha", "p"): "d", ("alpha", "q"): "b"}


def test_buckets_follow_the_size_and_stay(spark, table, root, monkeypatch):
    monkeypatch.setattr(corpus, "BUCKET_BYTES", 50)
    rows = [("alpha", f"p{i}", f"text {i:04d}") for i in range(200)]  # 1,800 bytes
    corpus.merge_pages(table(rows), root)
    made = corpus._snapshot(spark, root, 1)["buckets"]
    corpus.merge_pages(table([("beta", "q", "x" * 5000)]), root)
    assert made == 36 == corpus._snapshot(spark, root, 2)["buckets"] and len(stored(spark, root)) == 201


def test_vacuum(spark, table, root, tmp_path):
    r, want = random.Random(1), {}
    for n in range(4):
        rows = [("alpha", f"p{r.randrange(30)}", f"{n} {i}") for i in range(12)]
        rows = list({row[1]: row for row in rows}.values())
        want |= {row[:2]: row[2] for row in rows}
        corpus.merge_pages(table(rows), root, buckets=4)
    assert corpus.vacuum(spark, root) > 0 and corpus.versions(spark, root) == [4]
    assert stored(spark, root) == want and len({f.rpartition("/")[0] for f in files(tmp_path)}) <= 4
    assert corpus.vacuum(spark, root) == 0


def test_nulls_repeats_long_texts_and_nothing(spark, table, root):
    assert corpus.merge_pages(table([]), root) is None and stored(spark, root) == {}
    rows = [(None, None, None), ("alpha", None, ""), ("alpha", "a", "1"), ("alpha", "a", "2"), ("alpha", "b", None), ("alpha", "b", "x" * 200_000)]
    odd = table(rows).selectExpr("*", "1 AS bucket", "2 AS digest", "3 AS fresh", "4 AS merge", "5 AS `a b.c`")
    corpus.merge_pages(odd, root, buckets=3)
    assert stored(spark, root) == {(None, None): None, ("alpha", None): "", ("alpha", "a"): "2", ("alpha", "b"): "x" * 200_000}
    assert corpus.merge_pages(table([(None, None, None), ("alpha", None, "")]), root) == 1
    corpus.merge_pages(table([(None, None, "now")]), root)
    assert stored(spark, root)[None, None] == "now"


def pages(table, n):
    return table([("alpha", f"p{i:02d}", f'---\nsource: "M pp.{i}-{i}"\n---\n\n# P{i}\n\n設定し\n\nます。\n') for i in range(n)])


def test_the_cleaning_job_merges_and_counts_once(spark, table, root, monkeypatch):
    corpus.merge_pages(pages(table, 12).unionByName(table([("beta", "kept", "as it is")])), root, buckets=4)
    cleaned, clean = spark.sparkContext.accumulator(0), blocks.polish_bodies

    def seen(frames):
        for frame in frames:
            cleaned.add(len(frame))
            yield frame

    monkeypatch.setattr(blocks, "polish_bodies", lambda rows: (done := clean(rows)).mapInPandas(seen, done.schema))
    totals = job.run(corpus.read_corpus(spark, root).where("vendor = 'alpha'"), root).first()
    assert totals["suffix_joins"] == 12 and totals["changed_pages"] == 12 and totals["overlaps"] == 0
    assert cleaned.value == 12  # one pass writes and counts
    after = stored(spark, root)
    assert after["beta", "kept"] == "as it is" and all("設定します。" in t for (v, _), t in after.items() if v == "alpha")
    version = corpus.versions(spark, root)
    assert job.run(corpus.read_corpus(spark, root).where("vendor = 'alpha'"), root).first()["suffix_joins"] == 0
    assert corpus.versions(spark, root) == version


def test_a_dry_run_and_no_pages(spark, table, root):
    assert job.run(pages(table, 3), root, dry_run=True).first()["changed_pages"] == 3 and corpus.versions(spark, root) == []
    assert tuple(job.run(pages(table, 0), root).first()) == (0,) * 7


def test_totals_are_those_of_an_aggregation(spark, table):
    done = job.polish(pages(table, 9))
    kept, totals = job.counted(done)
    assert totals.collect() == blocks.counter_totals(kept).collect() == blocks.counter_totals(done).collect() and totals.dtypes == blocks.counter_totals(kept).dtypes


def test_a_merge_leaves_no_scratch_and_copies_no_table(spark, tmp_path, monkeypatch):
    """Buckets are merged in blocks, with the same rows for pages that are new, as they were, changed, given twice or without a key."""
    from foliate.sources import scratch

    wrote, before = [], len(scratch._made)
    monkeypatch.setattr(corpus, "materialize", lambda df, name, *a: (wrote.append(name), scratch.materialize(df, name, *a))[1])
    schema = "vendor string, slug string, text string"
    first = [("a", f"p{i}", f"text {i}") for i in range(60)] + [(None, "x", "old"), ("a", None, None)]
    root = str(tmp_path / "corpus")
    corpus.merge_pages(spark.createDataFrame(first, schema), root)
    assert wrote == ["given-pages"] and len(scratch._made) == before
    then = [("a", "p1", "text 1"), ("a", "p2", "new"), ("a", "p3", "b"), ("a", "p3", "c"), ("a", "p3", None), (None, "x", "now"), ("a", None, None), ("b", "p1", "text 1"), ("a", "p4", None)]
    table = scratch.materialize(spark.createDataFrame(then, schema), "table")
    assert corpus.merge_pages(table, root, written=True) == 2 and wrote == ["given-pages"] and len(scratch._made) == before + 1
    want = {(v, s): t for v, s, t in first} | {("a", "p2"): "new", ("a", "p3"): "c", (None, "x"): "now", ("b", "p1"): "text 1", ("a", "p4"): None}
    got = corpus.read_corpus(spark, root).collect()
    assert {(r["vendor"], r["slug"]): r["text"] for r in got} == want and len(got) == len(want)
    assert corpus.merge_pages(table.where("slug = 'p1'"), root, written=True) == 2
