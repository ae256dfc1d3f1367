"""Keyword search over the search documents."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import COMMON
from ..sources.scratch import materialize
from .parse import sort_key

RESULTS = 30
#: Queries looked at in one pass over the documents.
QUERY_BLOCK = 1000
SNIPPET = 70
# Points for a term in the title, in any heading, in the number.
POINTS = {"title": 10, "heads": 4, "num": 6}


def prepared(docs: DataFrame) -> DataFrame:
    """``docs`` with the lower-cased columns that every query reads."""
    heads = F.array_join("heads", " ")
    return docs.withColumns({"l_title": F.lower("title"), "l_num": F.lower("num"), "l_heads": F.transform("heads", F.lower), "hay": F.lower(F.concat_ws(" ", "num", "title", heads, "excerpt"))})


def _terms(query: str) -> list[str]:
    return query.lower().split()


def _points(term: Column) -> Column:
    title = F.when(F.contains("l_title", term), POINTS["title"]).otherwise(0)
    heads = F.when(F.exists("l_heads", lambda h: F.contains(h, term)), POINTS["heads"]).otherwise(0)
    return title + heads + F.when(F.contains("l_num", term), POINTS["num"]).otherwise(0)


def match(docs: DataFrame, query: str, vendor: str | None = None) -> DataFrame:
    """Rows of ``prepared`` that hold every term of the query; a blank query matches none."""
    terms = _terms(query)
    if not terms:
        return docs.limit(0)
    rows = docs if vendor is None else docs.where(F.col("vendor") == vendor)
    return rows.where(reduce(and_, [F.contains("hay", F.lit(t)) for t in terms]))


def _shown(rows: DataFrame) -> DataFrame:
    route = F.concat(F.lit("/"), F.when(F.col("vendor") == COMMON, F.lit(COMMON)).otherwise(F.col("vendor")), F.lit("/"), F.col("slug"))
    return rows.withColumns({"route": route, "snippet": F.substring("excerpt", 1, SNIPPET)})


def _index_order() -> list[Column]:
    return [F.col("vendor"), sort_key(F.col("num")), F.col("slug")]


def top(docs: DataFrame, query: str, vendor: str | None = None, k: int = RESULTS) -> DataFrame:
    """``(vendor, slug, num, title, score, route, snippet)``: the k best, ties in index order.

    A repeated term counts again; a match in the excerpt alone scores nothing, but stays.
    """
    found = match(docs, query, vendor)
    score = reduce(add, [_points(F.lit(t)) for t in _terms(query)], F.lit(0))
    rows = _shown(found.withColumn("score", score)).orderBy(F.desc("score"), *_index_order()).limit(k)
    return rows.select("vendor", "slug", "num", "title", "score", "route", "snippet")


def top_each(docs: DataFrame, queries: DataFrame, k: int = RESULTS) -> DataFrame:
    """The same for a table ``(query_id, query)``: ``(query_id, rank, vendor, slug, score, route)``.

    The queries go to the tasks as one constant array, so many at a time, and a document brings a row
    for each query that it matches: the plan is as large for many queries as for one.
    """
    terms = F.filter(F.split(F.lower("query"), r"\s+"), lambda t: t != "")
    kind = dict(queries.dtypes)["query_id"]
    asked = queries.select("query_id", terms.alias("terms")).where("size(terms) > 0")
    count = asked.count()
    blocks = max(1, -(-count // QUERY_BLOCK))
    out = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select(F.to_json(F.struct("query_id", "terms"))).collect()
        found = _matches(docs, F.from_json(F.lit("[" + ",".join(r[0] for r in own) + "]"), f"array<struct<query_id: {kind}, terms: array<string>>>"), k)
        found = found if blocks == 1 else materialize(found, "search-results")
        out = found if out is None else out.unionByName(found)
    return out


def _matches(docs: DataFrame, asked: Column, k: int) -> DataFrame:
    score = lambda q: F.aggregate(q["terms"], F.lit(0), lambda n, t: n + _points(t))
    fits = F.filter(asked, lambda q: F.forall(q["terms"], lambda t: F.contains("hay", t)))
    rows = docs.withColumn("hit", F.explode(F.transform(fits, lambda q: F.struct(q["query_id"].alias("query_id"), score(q).alias("score"))))).select("*", "hit.query_id", "hit.score")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *_index_order()))).where(F.col("rank") <= k)
    return _shown(ranked).select("query_id", "rank", "vendor", "slug", "score", "route")
