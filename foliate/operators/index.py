"""Search documents, navigation order and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import COMMON
from ..functions.ordering import in_order, with_stretches
from .parse import excerpt, headings, page_entries, search_heads, sort_key, split_front_matter

COMMON_SUFFIX = "(3社対応表)"  # Fixed value: marks a common guide's title.


def entries(pages: DataFrame) -> DataFrame:
    """``(vendor, slug, num, title, cat, source, body, key)`` of vendor pages."""
    rows = page_entries(split_front_matter(pages))
    return rows.select("vendor", "slug", "num", "title", "cat", "source", "body", sort_key(F.col("num")).alias("key"))


def drop_common_index(pages: DataFrame) -> DataFrame:
    return pages.where(~((F.col("vendor") == COMMON) & (F.col("slug") == "index")))


def search_docs(pages: DataFrame, common: DataFrame | None = None) -> DataFrame:
    """``(vendor, slug, num, title, cat, heads, excerpt)`` of vendor pages and common guides."""
    rows = entries(pages).select("vendor", "slug", "num", "title", "cat", search_heads(headings(F.col("body"))).alias("heads"), excerpt(F.col("body")).alias("excerpt"))
    if common is None:
        return rows
    guides = page_entries(split_front_matter(drop_common_index(common)).withColumn("fm", F.col("fm")))
    titled = F.when(F.col("title") == "", F.col("slug")).otherwise(F.col("title"))
    guides = guides.select(
        F.lit(COMMON).alias("vendor"), "slug", F.lit("").alias("num"), F.concat(titled, F.lit(COMMON_SUFFIX)).alias("title"), F.col("slug").alias("cat"),
        search_heads(headings(F.col("body"))).alias("heads"), excerpt(F.col("body")).alias("excerpt"),
    )
    return rows.unionByName(guides)


def _ordered(rows: DataFrame, outer: list[str], values: list[str]) -> DataFrame:
    """Pages in navigation order within each outer part: by sort key, then slug.

    Ordered by stretches of about equal size, so that no task sorts a vendor, nor all of its pages
    without a number.
    """
    light = rows.select(*dict.fromkeys([*outer, "vendor", "slug", "num", "title", "cat"]), F.col("key.a").alias("key_a"), F.col("key.b").alias("key_b"))
    order = ["key_a", "key_b", "slug"]
    return in_order(with_stretches(light, outer, order), outer, ["stretch"], order, {v: F.col(v) for v in values}).drop("key_a", "key_b", "stretch")


def nav_order(rows: DataFrame) -> DataFrame:
    """``(vendor, slug, num, title, cat)`` with ``position`` and the pages before and after within the vendor."""
    return _ordered(rows, ["vendor"], ["slug", "num", "title"])


def first_pages(rows: DataFrame, vendors: DataFrame) -> DataFrame:
    """``(vendor, slug)``: each vendor's first page in the order, ``index`` where it has none."""
    first = rows.groupBy("vendor").agg(F.min_by("slug", F.struct("key", "slug")).alias("first"))
    found = vendors.select(F.col("id").alias("vendor")).join(first, "vendor", "left")
    return found.select("vendor", F.coalesce("first", F.lit("index")).alias("slug"))


def count_by_category(rows: DataFrame) -> DataFrame:
    return rows.groupBy("vendor", "cat").agg(F.count("*").alias("n_pages"))


def count_by_vendor(rows: DataFrame) -> DataFrame:
    return rows.groupBy("vendor").agg(F.count("*").alias("n_pages"))


def listing_grid(rows: DataFrame, vendors: DataFrame, categories: DataFrame) -> DataFrame:
    """``(vendor_ord, cat_ord, vendor, cat, n_pages)`` of the pairs that have pages."""
    # Both dimensions are configuration of fixed size; so is the counted table's size at most.
    counted = count_by_category(rows)
    v = F.broadcast(vendors.select("vendor_ord", F.col("id").alias("vendor")))
    c = F.broadcast(categories.select("cat_ord", F.col("id").alias("cat")))
    return counted.join(v, "vendor").join(c, "cat").select("vendor_ord", "cat_ord", "vendor", "cat", "n_pages")


def nav_rows(rows: DataFrame) -> DataFrame:
    """``(vendor, cat, position, slug, num, title)``: each pair's pages as rows in navigation order, however many they are."""
    return category_listing(rows).select("vendor", "cat", F.col("ord").alias("position"), "slug", "num", "title")


def nested_nav(rows: DataFrame) -> DataFrame:
    """``(vendor, cat, pages)``: the pages of each pair as an array of (key, slug, num, title) in order.

    For what a reader's menu can hold, since a pair is one row; ``nav_rows`` has no such limit.
    """
    return rows.groupBy("vendor", "cat").agg(F.array_sort(F.collect_list(F.struct("key", "slug", "num", "title"))).alias("pages"))


def category_listing(rows: DataFrame) -> DataFrame:
    """``(cat, vendor, ord, slug, num, title)``: each category's pages in navigation order within each vendor."""
    return _ordered(rows, ["cat", "vendor"], ["slug"]).select("cat", "vendor", F.col("position").alias("ord"), "slug", "num", "title")


def agent_index(rows: DataFrame, vendors: DataFrame, categories: DataFrame, heading: str = "Manuals") -> DataFrame:
    """``(part, ord, line)``: the lines of the agent index, ordered by part, then ord.

    Vendors and their categories follow in the order of their dimensions, pages in navigation order;
    a category without pages is left out.
    """
    spark = rows.sparkSession
    head = [f"# {heading}", ""]
    size = categories.count()
    top = spark.createDataFrame([(0, i, x) for i, x in enumerate(head)], "part long, ord long, line string")
    titles = vendors.select(((F.col("vendor_ord") + 1) * (size + 1)).cast("long").alias("part"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("ord"), F.concat(F.lit("## "), F.col("label"), F.lit(" ("), F.col("company"), F.lit(")")).alias("line")), F.struct(F.lit(1).cast("long").alias("ord"), F.lit("").alias("line")))).alias("x")).select("part", "x.*")
    grid = listing_grid(rows, vendors, categories).join(F.broadcast(categories.select("cat_ord", "label")), "cat_ord")
    part = ((F.col("vendor_ord") + 1) * (size + 1) + F.col("cat_ord") + 1).cast("long")
    ends = grid.select(part.alias("part"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("ord"), F.concat(F.lit("### "), F.col("label")).alias("line")), F.struct((F.col("n_pages") + 1).cast("long").alias("ord"), F.lit("").alias("line")))).alias("x")).select("part", "x.*")
    listed = category_listing(rows).join(F.broadcast(grid.select("vendor", "cat", "vendor_ord", "cat_ord")), ["vendor", "cat"])
    line = F.concat(F.lit("- ["), F.col("num"), F.lit(" "), F.col("title"), F.lit("](content/"), F.col("vendor"), F.lit("/"), F.col("slug"), F.lit(".md)"))
    return top.unionByName(titles).unionByName(ends).unionByName(listed.select(part.alias("part"), F.col("ord").cast("long").alias("ord"), line.alias("line")))
