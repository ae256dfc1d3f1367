"""The posting index against the search without one."""

import random

import pytest
from pyspark.sql import functions as F

from foliate.operators import postings, search

DOCS = "vendor string, slug string, num string, title string, cat string, heads array<string>, excerpt string"
WORDS = ["red", "reddish", "blue", "a", "é", "ÉTÉ", "x1", "1.2", "日本語", "語", "\U0001d4b3b", "the", "other", "-", "%", "_", "\\d", "o'k"]


@pytest.fixture(scope="module")
def made():
    r = random.Random(4)
    some = lambda n: " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing", str(r.randrange(30))]) for _ in range(r.randrange(n)))
    rows = [(r.choice(["alpha", "beta", "common"]), f"p{i:03d}", r.choice(["", "1.2", "2-10", "A-3", None]), some(5), "setup", [some(3) for _ in range(r.randrange(4))], some(12)) for i in range(260)]
    return [*rows, ("alpha", "none", None, None, None, None, None), ("alpha", "rare", "9.9", "Quixotic word", "x", [], "only here"), ("beta", "long", "1", "t", "x", ["h"], "the " * 30_000), rows[0]]


@pytest.fixture(scope="module")
def docs(spark, made):
    return search.prepared(spark.createDataFrame(made, DOCS).repartition(3))


@pytest.fixture(scope="module")
def path(docs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("index") / "postings")
    postings.write_index(docs, at)
    return at


def results(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vendor", "slug", "score", "route").collect()), key=str)


QUERIES = ["red", "Red blue", "a", "é", "red red the", "quixotic", "quixotic the", "zzz", "zz the", "q", "9.9 only here", "語", "\U0001d4b3", "1", "1.2 red", "%", "_", "\\d", "o'k", "ing 12", "", "   ", None, "the", "-", "s the other", "été"]


@pytest.mark.parametrize(("k", "first", "longer", "block"), [(7, 2, 16, 1000), (3, 1, 1, 5), (1000, 2, 10**6, 1000)])
def test_what_the_plain_search_finds(spark, docs, path, monkeypatch, k, first, longer, block):
    monkeypatch.setattr(postings, "FIRST", first)
    monkeypatch.setattr(postings, "LONGER", longer)
    monkeypatch.setattr(postings, "QUERY_BLOCK", block)
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")
    assert results(postings.top_each(spark, path, queries, k)) == results(search.top_each(docs, queries, k))


def test_many_grams_are_selected_by_a_join(spark, docs, path, monkeypatch):
    monkeypatch.setattr(postings, "NAMED", 2)
    queries = spark.createDataFrame([(1, "reddish the"), (2, "a")], "query_id int, query string")
    assert results(postings.top_each(spark, path, queries, 9)) == results(search.top_each(docs, queries, 9))


def test_matches_of_one_query(spark, docs, path):
    for query, vendor in (("red the", None), ("the", "beta"), ("", None), ("zzz", "alpha"), ("quixotic", "alpha"), ("quixotic", "beta")):
        got, want = (sorted((r["vendor"], r["slug"]) for r in df.collect()) for df in (postings.match(spark, path, query, vendor), search.match(docs, query, vendor)))
        assert got == want


def test_a_bound_is_never_below_the_score(spark, docs, path):
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")
    wanted = postings.asked(queries)
    found = postings.candidates(spark, path, wanted)
    rows = postings.verified(spark, path, wanted, found.select("query_id", "n")).join(found, ["query_id", "n"])
    assert rows.where("score > bound").count() == 0 and rows.where("score = bound").count() > 100


def test_rare_terms_read_less(spark, path):
    context = spark.sparkContext._jsc.sc()

    def read_so_far():
        context.listenerBus().waitUntilEmpty(30_000)
        executors = context.statusStore().executorList(True)
        return sum(executors.apply(i).totalInputBytes() for i in range(executors.size()))

    def read(query):
        chosen = postings.chosen_grams(spark, path, postings.asked(spark.createDataFrame([(1, query)], "query_id int, query string")))
        rows = postings.lists_of(spark, path, chosen)
        before = read_so_far()
        return rows.count(), read_so_far() - before

    before = read_so_far()
    spark.read.parquet(f"{path}/postings").write.format("noop").mode("overwrite").save()
    whole = read_so_far() - before
    (of_rare, rare), (of_both, both), (of_common, common) = read("quixotic"), read("quixotic the"), read("the")
    assert of_both == of_rare < 40 and of_common > 100
    assert 0 < rare < whole / 4 and both < whole / 4 and common < whole / 4


def test_lists_are_rows_of_bounded_length(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "ROW_BITS", 3)
    postings.write_index(docs, str(tmp_path / "i"))
    rows = spark.read.parquet(str(tmp_path / "i" / "postings"))
    assert rows.agg(F.max(F.size("docs"))).first()[0] <= 8
    queries = spark.createDataFrame([(1, "the red")], "query_id int, query string")
    assert results(postings.top_each(spark, str(tmp_path / "i"), queries)) == results(search.top_each(docs, queries))


def test_nothing(spark, docs, tmp_path):
    postings.write_index(docs.limit(0), str(tmp_path / "i"))
    assert postings.top_each(spark, str(tmp_path / "i"), spark.createDataFrame([(1, "the a")], "query_id int, query string")).count() == 0
    assert postings.match(spark, str(tmp_path / "i"), "red").count() == 0
