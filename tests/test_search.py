import pytest

from foliate.operators import search


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("alpha", f"p{i:02d}", f"1.{i}", f"Title {'red' if i % 3 else 'blue'} {i}", "setup", ["Red things", f"part {i}"] if i % 2 else [], f"text of number {i} green") for i in range(40)]
    return search.prepared(spark.createDataFrame(rows, "vendor string, slug string, num string, title string, cat string, heads array<string>, excerpt string"))


@pytest.mark.parametrize("block", [1000, 2])
def test_many_queries_find_what_each_alone_finds(spark, docs, monkeypatch, block):
    monkeypatch.setattr(search, "QUERY_BLOCK", block)
    asked = {1: "Red", 2: "blue  1.3", 3: "red red", 4: "nothing like it", 5: "", 6: None, 7: "GREEN", 8: "quo\"te \\ it's"}
    found = {}
    for r in search.top_each(docs, spark.createDataFrame(list(asked.items()), "query_id long, query string"), 7).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["slug"], r["score"]))
    for i, query in asked.items():
        alone = [(r["slug"], r["score"]) for r in search.top(docs, query or "", None, 7).collect()]
        assert found.get(i, []) == alone
    assert len(found) == 4 and found[3][0][1] == 2 * found[1][0][1]


def test_the_plan_does_not_grow_with_the_queries(spark, docs):
    size = lambda n: len(search.top_each(docs, spark.createDataFrame([(i, f"red {i}") for i in range(n)], "query_id int, query string"))._jdf.queryExecution().optimizedPlan().numberedTreeString().splitlines())
    assert size(300) == size(3)


def test_no_queries(spark, docs):
    assert search.top_each(docs, spark.createDataFrame([], "query_id int, query string")).count() == 0
