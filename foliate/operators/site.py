"""Site metadata: titles, URLs, structured data, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import CATEGORIES, COMMON, VENDORS, Site, labelled, vendor_label
from .index import nav_order

DESCRIPTION = 155
SCHEMA = "https://schema.org"


def with_search_doc(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` with the excerpt and headings of the search document of the same vendor and slug."""
    return rows.join(docs.select("vendor", "slug", "heads", "excerpt"), ["vendor", "slug"], "left")


def with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    return rows.join(sources.select("vendor", "slug", "source"), ["vendor", "slug"], "left")


def escape(c: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def safe_json(c: Column) -> Column:
    return F.replace(F.to_json(c), F.lit("<"), F.lit("\\u003c"))


def url(site: Site, path: Column) -> Column:
    return F.concat(F.lit(site.url.rstrip("/") + "/"), F.regexp_replace(path, r"\A/", ""))


def meta_description(excerpt: Column, vendor: Column, title: Column) -> Column:
    """The excerpt, or a sentence made of vendor and title where there is none; the first characters of it."""
    made = F.concat(vendor, F.lit("の"), title, F.lit("に関する解説。"))
    return F.substring(F.coalesce(F.nullif(excerpt, F.lit("")), made), 1, DESCRIPTION)


def page_metadata(rows: DataFrame, site: Site = Site(), vendors=VENDORS, categories=CATEGORIES) -> DataFrame:
    """``(vendor, slug, route, url, markdown_url, title, description, json_ld)`` of vendor pages.

    ``rows``: vendor, slug, num, title, cat, source, excerpt. A page without a source has none in its
    structured data.
    """
    label, category = vendor_label(F.col("vendor"), vendors), labelled(F.col("cat"), categories)
    known = F.create_map(*[F.lit(x) for r in categories for x in r])[F.col("cat")]
    headline = F.concat("num", F.lit(" "), "title")
    step = lambda i, name, item: F.struct(F.lit("ListItem").alias("@type"), F.lit(i).alias("position"), name.alias("name"), item.cast("string").alias("item"))
    json_ld = F.struct(
        F.lit(SCHEMA).alias("@context"), F.lit("TechArticle").alias("@type"), headline.alias("headline"), F.lit(site.language).alias("inLanguage"),
        F.concat(label, F.lit(" "), F.coalesce(known, F.lit(""))).alias("about"), F.nullif(F.col("source"), F.lit("")).alias("isBasedOn"),
        F.struct(F.lit("WebSite").alias("@type"), F.lit(site.name).alias("name"), F.lit(site.url).alias("url")).alias("isPartOf"),
        F.struct(
            F.lit("BreadcrumbList").alias("@type"),
            F.array(step(1, F.lit(site.name), F.lit(site.url)), step(2, category, url(site, F.concat(F.lit("common/"), "cat", F.lit("/")))), step(3, headline, F.lit(None))).alias("itemListElement"),
        ).alias("breadcrumb"),
    )
    path = F.concat("vendor", F.lit("/"), "slug")
    return rows.select(
        "vendor", "slug", F.concat(F.lit("/"), path).alias("route"), url(site, F.concat(path, F.lit("/"))).alias("url"), url(site, F.concat(F.lit("content/"), path, F.lit(".md"))).alias("markdown_url"),
        F.concat(headline, F.lit(" | "), label, F.lit(" | "), F.lit(site.name)).alias("title"), meta_description(F.col("excerpt"), label, F.col("title")).alias("description"), safe_json(json_ld).alias("json_ld"),
    )


def category_metadata(categories: DataFrame, site: Site = Site()) -> DataFrame:
    """The same columns for the common page of each category."""
    article = F.struct(
        F.lit(SCHEMA).alias("@context"), F.lit("TechArticle").alias("@type"), F.concat("label", F.lit(" — 3社対応表")).alias("headline"), F.lit(site.language).alias("inLanguage"),
        F.struct(F.lit("WebSite").alias("@type"), F.lit(site.name).alias("name"), F.lit(site.url).alias("url")).alias("isPartOf"),
    )
    path = F.concat(F.lit("common/"), "id")
    return categories.select(
        F.lit(COMMON).alias("vendor"), F.col("id").alias("slug"), F.concat(F.lit("/"), path).alias("route"), url(site, F.concat(path, F.lit("/"))).alias("url"),
        url(site, F.concat(F.lit("content/"), path, F.lit(".md"))).alias("markdown_url"), F.concat("label", F.lit(" — 3社対応表 | "), F.lit(site.name)).alias("title"),
        F.concat("label", F.lit("に関する用語対応表と、マニュアルの該当節一覧。")).alias("description"), safe_json(article).alias("json_ld"),
    )


def top_metadata(spark, site: Site = Site()) -> DataFrame:
    """The same columns for the top page."""
    one = spark.createDataFrame([(COMMON, "index", "/", site.url.rstrip("/") + "/", site.top_title, site.description)], "vendor string, slug string, route string, url string, title string, description string")
    web = F.struct(F.lit(SCHEMA).alias("@context"), F.lit("WebSite").alias("@type"), F.lit(site.name).alias("name"), F.lit(site.url).alias("url"), F.lit(site.description).alias("description"), F.lit(site.language).alias("inLanguage"))
    return one.withColumns({"markdown_url": url(site, F.lit("content/common/index.md")), "json_ld": safe_json(web)}).select("vendor", "slug", "route", "url", "markdown_url", "title", "description", "json_ld")


def head_tags(rows: DataFrame, site: Site = Site()) -> DataFrame:
    """``(vendor, slug, head)``: the head of each page as HTML lines."""
    title, description = escape(F.col("title")), escape(F.col("description"))
    tags = [
        F.concat(F.lit("<title>"), title, F.lit("</title>")), F.concat(F.lit('<meta name="description" content="'), description, F.lit('" />')),
        F.concat(F.lit('<link rel="canonical" href="'), "url", F.lit('" />')), F.concat(F.lit('<meta property="og:title" content="'), title, F.lit('" />')),
        F.concat(F.lit('<meta property="og:description" content="'), description, F.lit('" />')), F.lit('<meta property="og:type" content="article" />'),
        F.concat(F.lit('<meta property="og:url" content="'), "url", F.lit('" />')), F.concat(F.lit('<meta property="og:site_name" content="'), escape(F.lit(site.name)), F.lit('" />')),
        F.concat(F.lit('<link rel="alternate" type="text/markdown" href="'), "markdown_url", F.lit('" title="Markdown原文" />')),
        F.concat(F.lit('<script type="application/ld+json">'), "json_ld", F.lit("</script>")),
    ]
    return rows.select("vendor", "slug", F.concat(F.concat_ws("\n", *tags), F.lit("\n")).alias("head"))


def routes(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """``(route)``: the top page, the category pages and the vendor pages."""
    top = rows.sparkSession.createDataFrame([("/",)], "route string")
    common = categories.select(F.concat(F.lit("/common/"), "id").alias("route"))
    return top.unionByName(common).unionByName(rows.select(F.concat(F.lit("/"), "vendor", F.lit("/"), "slug").alias("route")))


def sitemap(found: DataFrame, site: Site = Site()) -> DataFrame:
    """``(loc, lastmod)`` for each route."""
    loc = F.when(F.col("route") == "/", F.lit(site.url.rstrip("/") + "/")).otherwise(url(site, F.concat("route", F.lit("/"))))
    return found.select(loc.alias("loc"), F.lit(site.built).alias("lastmod"))


def neighbours(entries: DataFrame) -> DataFrame:
    """``(vendor, slug, previous_slug, next_slug)`` in navigation order."""
    return nav_order(entries).select("vendor", "slug", "previous_slug", "next_slug")


def strip_h1(text: Column) -> Column:
    return F.regexp_replace(text, r"(?d)\A# .+\n", "")


def resolve_image_url(src: Column, base: str) -> Column:
    """``base`` before a relative image path; absolute URLs and paths stay, and so does null or nothing."""
    return F.when(src.isNull() | (src == "") | src.rlike(r"\A(?:https?:|/)"), src).otherwise(F.concat(F.lit(base), src))
