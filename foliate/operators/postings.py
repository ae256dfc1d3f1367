"""A posting index for the keyword search: which search documents hold which runs of three characters.

Every term of a query is a substring of a document, so each of its three-character grams is too. A
query reads the posting lists of its rarest grams, intersects them, and verifies what is left by the
substring itself. Postings also say in which fields a gram stands; the points that a document can get
at most follow from them, and of the documents of a query only those that may be among its best are read.

The index is a folder: ``docs`` (by stretches of the index order), ``postings`` (by hash parts of the gram,
ordered by gram) and ``grams`` (how many documents have each).
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .parse import sort_key
from .search import POINTS, RESULTS, _points, _shown

GRAM = 3
#: Parts of the postings, and documents of a posting list's row (as a power of two).
PARTS, ROW_BITS = 64, 16
#: Of a query's grams those are looked up whose list is at most so many times as long as the rarest one's.
LONGER = 16
#: Queries answered in one pass; grams that are named in a filter on the postings, beyond which a join alone selects them.
QUERY_BLOCK, NAMED = 1000, 10_000
#: Documents of a query that are read first, as a multiple of those wanted.
FIRST = 2
_FIELDS = {"title": 1, "heads": 2, "num": 4}
#: Not in any text: grams reach over both ends of a field, so that terms of one or two characters lie in one.
_EDGE = "\ufdd0\ufdd0"


#: What an index is made of; tables that may be empty are read by these.
_TABLES = {
    "docs": "vendor string, slug string, num string, title string, heads array<string>, excerpt string, l_title string, l_num string, l_heads array<string>, hay string, n long, stretch int",
    "postings": "gram string, row long, docs array<struct<n: long, mask: tinyint>>, part int",
    "grams": "gram string, docs long",
}


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(_TABLES[name]).parquet(f"{path}/{name}")


def _grams(text: Column) -> Column:
    """The distinct grams of a text and its edges."""
    padded = F.split(F.concat(F.lit(_EDGE), text, F.lit(_EDGE)), "")
    chars = lambda c, i: F.concat(*[c[i + k] for k in range(GRAM)])
    return F.array_distinct(F.transform(F.array(padded), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - GRAM), lambda i: chars(c, i)))[0])


def _marked() -> Column:
    """``(gram, mask)`` for each gram of a prepared search document, mask being the sum of the fields that have it."""
    heads = F.array_distinct(F.flatten(F.transform("l_heads", _grams)))
    fields = [(_grams(F.col("hay")), 0), (_grams(F.col("l_title")), _FIELDS["title"]), (heads, _FIELDS["heads"]), (_grams(F.col("l_num")), _FIELDS["num"])]
    bit = lambda grams, b: F.transform(grams, lambda g: F.struct(g.alias("gram"), F.lit(b).alias("bit")))
    # A gram's entries, one for each field at most, stand side by side once sorted.
    ordered = F.array_sort(F.concat(*[bit(g, b) for g, b in fields]))
    back = lambda s, i, k: F.when((i >= k) & (F.get(s, i - k)["gram"] == s[i]["gram"]), F.get(s, i - k)["bit"]).otherwise(0)
    whole = lambda s, i: F.struct(s[i]["gram"].alias("gram"), reduce(add, [back(s, i, k) for k in range(len(fields))]).cast("tinyint").alias("mask"), (F.coalesce(F.get(s, i + 1)["gram"] != s[i]["gram"], F.lit(True))).alias("last"))
    merged = F.transform(F.array(ordered), lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda i: whole(s, i)))[0]
    return F.filter(merged, lambda x: x["last"])


def write_index(docs: DataFrame, path: str) -> None:
    """Writes the index of ``search.prepared`` documents; the order of their numbers ``n`` is the index order. Other columns are left out; nulls are as empty texts in a search."""
    spark = docs.sparkSession
    texts = {c: F.coalesce(c, F.lit("")).alias(c) for c in ("l_title", "l_num", "hay")}
    heads = F.coalesce(F.filter("l_heads", lambda h: h.isNotNull()), F.array().cast("array<string>"))
    rows = docs.select(*[c.split()[0] for c in _TABLES["docs"].split(", ")[:-2]]).withColumns(texts | {"l_heads": heads, "_key": sort_key(F.col("num"))})
    order = [F.col("vendor"), F.col("_key"), F.col("slug")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_key").withColumns({"n": F.monotonically_increasing_id(), "stretch": F.spark_partition_id()})
    placed.write.partitionBy("stretch").parquet(f"{path}/docs")
    entries = _table(spark, path, "docs").select("n", F.explode(_marked()).alias("x")).select("x.gram", "n", "x.mask")
    lists = entries.groupBy("gram", F.shiftright("n", ROW_BITS).alias("row")).agg(F.array_sort(F.collect_list(F.struct("n", "mask"))).alias("docs"))
    lists = lists.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(PARTS)).cast("int"))
    lists.repartitionByRange("part", "gram").sortWithinPartitions("part", "gram", "row").write.partitionBy("part").parquet(f"{path}/postings")
    sizes = _table(spark, path, "postings").groupBy("gram").agg(F.sum(F.size("docs")).alias("docs"))
    sizes.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/grams")


def asked(queries: DataFrame) -> DataFrame:
    """``(query_id, terms)``: the queries that have a term."""
    terms = F.filter(F.split(F.lower("query"), r"\s+"), lambda t: t != "")
    return queries.select("query_id", terms.alias("terms")).where("size(terms) > 0")


def chosen_grams(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``(query_id, term, gram, grams, times, terms)``: the lists that a query reads.

    ``grams``: how many lists a document must be in for the term (null: any of them, for terms shorter than a gram);
    ``times`` the term occurs in the query; ``terms`` are looked up of it. Grams that no document has stay: their lists are empty.
    """
    sizes = _table(spark, path, "grams")
    each = wanted.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").cast("int").alias("times"))
    terms = each.select("term").distinct()
    long = terms.where(F.length("term") >= GRAM)
    inner = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("term") - GRAM + 1), lambda i: F.substring("term", i, GRAM)))
    of_long = long.select("term", F.explode(inner).alias("gram")).join(sizes, "gram", "left").select("term", "gram", F.coalesce("docs", F.lit(0)).alias("docs"), F.lit(False).alias("any"))
    piece = F.array_distinct(F.array(*[F.substring("gram", at, k) for k in range(1, GRAM) for at in range(1, GRAM + 2 - k)]))
    of_short = terms.where(F.length("term") < GRAM).join(sizes.select("gram", "docs", F.explode(piece).alias("term")), "term").select("term", "gram", "docs", F.lit(True).alias("any"))
    # A short term counts as one list, as long as all of its grams' together.
    lists = of_long.unionByName(of_short).withColumn("length", F.when(F.col("any"), F.sum(F.when(F.col("any"), F.col("docs"))).over(Window.partitionBy("term"))).otherwise(F.col("docs")))
    rarest = Window.partitionBy("query_id")
    some = each.join(lists, "term").withColumn("least", F.min("length").over(rarest)).where(F.col("length") <= F.col("least") * LONGER)
    some = some.withColumn("grams", F.when(~F.col("any"), F.count("*").over(Window.partitionBy("query_id", "term")))).withColumn("terms", F.size(F.collect_set("term").over(rarest)))
    return some.select("query_id", "term", "gram", "grams", "times", "terms")


def lists_of(spark: SparkSession, path: str, grams: DataFrame) -> DataFrame:
    """``(gram, n, mask)`` of these grams; the parts, and the files' pieces, that hold none of them are not read."""
    names = [r["gram"] for r in grams.select("gram").distinct().limit(NAMED + 1).collect()]
    rows = _table(spark, path, "postings")
    if len(names) <= NAMED:
        parts = spark.createDataFrame([(g,) for g in names], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(PARTS)).cast("int").alias("part")).distinct()
        rows = rows.where(F.col("part").isin([r["part"] for r in parts.collect()]) & F.col("gram").isin(names))
    return rows.select("gram", F.explode("docs").alias("x")).select("gram", "x.n", "x.mask")


def candidates(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``(query_id, n, bound)``: documents in all lists of a query, and the points that they get at most."""
    chosen = materialize(chosen_grams(spark, path, wanted), "chosen-grams")
    # A query none of whose short terms is in any gram has no list at all, and no document.
    found = lists_of(spark, path, chosen).join(chosen, "gram").repartition("query_id", "n")
    by_term = found.groupBy("query_id", "n", "term", "grams", "times", "terms").agg(F.count("*").alias("have"), F.bit_and("mask").alias("all"), F.bit_or("mask").alias("some"))
    by_term = by_term.where(F.col("grams").isNull() | (F.col("have") == F.col("grams"))).withColumn("mask", F.when(F.col("grams").isNull(), F.col("some")).otherwise(F.col("all")).cast("int"))
    most = sum(POINTS.values())
    points = reduce(add, [F.when(F.col("mask").bitwiseAND(bit) > 0, POINTS[field]).otherwise(0) for field, bit in _FIELDS.items()])
    looked = by_term.groupBy("query_id", "n", "terms").agg(F.count("*").alias("met"), F.sum(F.col("times") * (points - most)).alias("less")).where("met = terms")
    return looked.join(wanted.select("query_id", F.size("terms").alias("_size")), "query_id").select("query_id", "n", (F.col("_size") * most + F.col("less")).alias("bound"))


def verified(spark: SparkSession, path: str, wanted: DataFrame, found: DataFrame) -> DataFrame:
    """The documents of ``found`` (query_id, n) that hold every term, with ``score``; stretches without a candidate are not read."""
    stretches = [r[0] for r in found.select(F.shiftright("n", 33).cast("int").alias("stretch")).distinct().collect()]  # at most one for each file of docs
    docs = _table(spark, path, "docs").where(F.col("stretch").isin(stretches))
    rows = found.join(docs, "n").join(wanted, "query_id").where(F.forall("terms", lambda t: F.contains("hay", t)))
    return rows.withColumn("score", F.aggregate("terms", F.lit(0), lambda n, t: n + _points(t)))


def _best(rows: DataFrame, by: str, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(by), "n")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_SHOWN = ("query_id", "n", "score", "vendor", "slug", "num", "title", "excerpt")


def top_each(spark: SparkSession, path: str, queries: DataFrame, k: int = RESULTS) -> DataFrame:
    """``(query_id, rank, vendor, slug, score, route)``: the k best documents of each query ``(query_id, query)``, as ``search.top_each`` finds them without an index.

    The documents with the greatest bounds are read first. The k-th best score among them is what another document's
    bound must reach for it to be read too. Queries of blanks, and null ones, have no results.
    """
    wanted = materialize(asked(queries), "queries")
    blocks = max(1, -(-wanted.count() // QUERY_BLOCK))
    parts = []
    for b in range(blocks):
        own = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        found = materialize(candidates(spark, path, own), "candidates")
        first = materialize(_best(found, "bound", FIRST * k).drop("rank"), "first-candidates")
        seen = materialize(verified(spark, path, own, first.drop("bound")).select(*_SHOWN), "first-results")
        enough = _best(seen, "score", k).where(F.col("rank") == k).select("query_id", F.col("score").alias("_least"))
        left = found.join(first.select("query_id", "n"), ["query_id", "n"], "left_anti").join(enough, "query_id", "left").where("_least is null or bound >= _least").select("query_id", "n")
        rest = verified(spark, path, own, materialize(left, "more-candidates")).select(*_SHOWN)
        parts.append(_shown(_best(seen.unionByName(rest), "score", k)).select("query_id", "rank", "vendor", "slug", "score", "route"))
        if blocks > 1:
            parts[-1] = materialize(parts[-1], "search-results")
    return reduce(DataFrame.unionByName, parts)


def match(spark: SparkSession, path: str, query: str, vendor: str | None = None) -> DataFrame:
    """The documents that hold every term of the query, with ``score``; a blank query matches none."""
    wanted = asked(spark.createDataFrame([(0, query)], "query_id int, query string"))
    rows = verified(spark, path, wanted, materialize(candidates(spark, path, wanted).select("query_id", "n"), "candidates"))
    fits = [] if vendor is None else [F.col("vendor") == vendor]
    return rows.where(reduce(and_, fits, F.lit(True))).drop("query_id", "terms", "n", "stretch")
