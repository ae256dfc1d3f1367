import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliate.functions.ordering import in_order, running_last, with_stretches
from foliate.operators import index


@pytest.mark.parametrize("backwards", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_running_values_are_those_of_one_window(spark, backwards, inclusive):
    r = random.Random(2)
    rows = [(v, i, r.choice([None, None, r.randrange(100)])) for v in "ab" for i in r.sample(range(500), 120)]
    table = spark.createDataFrame(rows, "vendor string, pos int, x int")
    order = F.desc("pos") if backwards else F.asc("pos")
    plain = table.withColumn("last", F.last("x", ignorenulls=True).over(Window.partitionBy("vendor").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)))
    for size in (7, 100, 1000):
        got = running_last(table, ["vendor"], F.floor(F.col("pos") / size), [order], {"last": F.col("x")}, backwards, inclusive)
        assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_a_hot_value_is_split(spark, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one stretch
    request.addfinalizer(lambda: spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true"))
    rows = spark.createDataFrame([("a", 98 if i % 10 else i, f"s{i:05d}") for i in range(4000)], "vendor string, key int, slug string")
    ranged = with_stretches(rows.repartition(3), ["vendor"], ["key", "slug"])
    assert max(r["n"] for r in ranged.groupBy("stretch").agg(F.count("*").alias("n")).collect()) < 4000
    found = in_order(ranged, ["vendor"], ["stretch"], ["key", "slug"], {"slug": F.col("slug")}).orderBy("position").collect()
    want = sorted(((98 if i % 10 else i), f"s{i:05d}") for i in range(4000))
    assert [(r["key"], r["slug"]) for r in found] == want and [r["position"] for r in found] == list(range(1, 4001))
    assert [r["next_slug"] for r in found] == [s for _, s in want[1:]] + [None]


def test_navigation_as_rows_and_nested(spark):
    page = lambda n: f'---\nvendor: a\nid: "{n}"\nnum: "{"" if n % 3 else "1." + str(n)}"\ntitle: "T"\ncategory: {"x" if n % 2 else "y"}\nsource: "M pp.1-2"\n---\n\nbody\n'
    rows = index.entries(spark.createDataFrame([("a", f"p{n:03d}", page(n)) for n in range(40)], "vendor string, slug string, text string"))
    nested = {(r["vendor"], r["cat"]): [p["slug"] for p in r["pages"]] for r in index.nested_nav(rows).collect()}
    flat = {}
    for r in index.nav_rows(rows).orderBy("position").collect():
        flat.setdefault((r["vendor"], r["cat"]), []).append(r["slug"])
    assert flat == nested
