"""Queries over the bridge view, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dims import CATEGORIES, VENDORS, Site, categories, labelled, vendors
from .jobs import polish as polish_job
from .operators import audit, blocks, clean, index, parse, postings, search, site, toc
from .sources.pages import BRIDGE_SQL, bridge, bridge_images
from .sources.scratch import materialize, scratch_path
from .sources.tables import read_table

SITE = Site()
SEARCH = "the 1 section"
SEARCHES = ((1, "the 1 section"), (2, "Section 7"), (3, "setup"), (4, "of of 2-1"), (5, "and"))
#: Terms of one and two characters, rare ones, accents, terms of no document.
MORE_SEARCHES = ((6, "1"), (7, "é th"), (8, "section 12 overview"), (9, "zzz the"), (10, "-1 ion"), (11, "Ändern é"), (12, "ti on 3"), (13, "q"))
RARE = "section 12 ing"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return bridge(_docs(spark, d))


def _split(spark: SparkSession, d: str) -> DataFrame:
    return parse.split_front_matter(_pages(spark, d))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return index.entries(_pages(spark, d))


def _search_docs(spark: SparkSession, d: str) -> DataFrame:
    return index.search_docs(_pages(spark, d))


def _search_index(spark: SparkSession, d: str) -> DataFrame:
    """The prepared search documents as a table: every query reads it, none parses pages."""
    return materialize(search.prepared(_search_docs(spark, d)), "search-index")


def _postings(spark: SparkSession, d: str) -> str:
    """The posting index of the search documents."""
    path = scratch_path(spark, "search-postings")
    postings.write_index(search.prepared(_search_docs(spark, d)), path)
    return path


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows, names: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_q(x) if isinstance(x, str) else str(x) for x in (i, *r)) + ")" for i, r in enumerate(rows)) + f") t({names}))"


# ---- SQL shared by the oracles: pages, their parts, their entries in navigation order.
PARTS_SQL = f"""
WITH pages AS ({BRIDGE_SQL}),
parts AS (
  SELECT *, regexp_matches(text, '(?s)^---\\n.*?\\n---\\n') AS has_fm, regexp_extract(text, '(?s)^---\\n(.*?)\\n---\\n', 1) AS fm,
    substr(text, length(regexp_extract(text, '(?s)^---\\n.*?\\n---\\n')) + 1) AS body FROM pages
),
kv AS (
  SELECT *, regexp_extract(fm, '(?m)^num: "?([^"\\n]*)', 1) AS num, regexp_extract(fm, '(?m)^title: "?([^"\\n]*)', 1) AS title,
    coalesce(nullif(regexp_extract(fm, '(?m)^category: (.*)$', 1), ''), 'reference') AS cat, nullif(regexp_extract(fm, '(?m)^source: "?([^"\\n]*)', 1), '') AS source FROM parts
),
entries AS (
  SELECT *, CASE WHEN num LIKE 'A-%' THEN 99 WHEN num = '' THEN 98 ELSE CAST(regexp_extract(num, '^\\d+') AS BIGINT) END AS ka,
    CASE WHEN num LIKE 'A-%' THEN CAST(substr(num, 3) AS BIGINT) WHEN num = '' THEN 0 ELSE CAST(regexp_extract(num, '^\\d+[.-](\\d+)', 1) AS BIGINT) END AS kb FROM kv
),
docs AS (
  SELECT vendor, slug, num, title, cat, source, ka, kb, list_slice(regexp_extract_all(body, '(?m)^#{{1,4}}\\s+(.+)$', 1), 2, 25) AS heads,
    substr(regexp_replace(regexp_replace(regexp_replace(body, '!\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'), '[|#*\\-`>]', ' ', 'g'), '\\s+', ' ', 'g'), 1, 180) AS excerpt FROM entries
),
vendors AS {_values(VENDORS, 'vendor_ord, id, label, company')},
categories AS {_values(CATEGORIES, 'cat_ord, id, label')},
images AS (SELECT 'images/' || vendor || '/ok-' || doc_id || '.webp' AS path FROM pages WHERE doc_id % 23 = 13),
lines AS (SELECT vendor, slug, has_fm, body, CASE WHEN body LIKE '%' || chr(10) THEN string_split(body, chr(10))[:-2] ELSE string_split(body, chr(10)) END AS l FROM parts),
line AS (SELECT vendor, slug, has_fm, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS n FROM lines)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None, shared: bool = True):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = (PARTS_SQL if shared else "") + sql
        return f

    return put


@_query("s0_bridge", BRIDGE_SQL, shared=False)
def _(s, d):
    return _pages(s, d)


@_query("p1_front_matter", "SELECT doc_id, has_fm, fm, body FROM parts")
def _(s, d):
    return _split(s, d).select("doc_id", "has_fm", "fm", "body")


@_query("p2_front_matter_map", """SELECT doc_id, list_aggregate(list_sort(list_transform(list_filter(string_split(fm, chr(10)), lambda x: x <> ''),
  lambda x: trim(split_part(x, ':', 1)) || '=' || trim(trim(substr(x, strpos(x, ':') + 1)), '"'))), 'string_agg', '|') AS pairs FROM parts""")
def _(s, d):
    pairs = F.array_sort(F.transform(F.map_entries(parse.front_matter_map(F.col("fm"))), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return _split(s, d).select("doc_id", F.nullif(F.array_join(pairs, "|"), F.lit("")).alias("pairs"))


@_query("p3_fields", "SELECT doc_id, " + ", ".join(f"nullif(trim(regexp_extract(fm, '(?m)^{n}:\\s*\"?([^\"\\n]+)\"?\\s*$', 1)), '') AS f_{n}" for n in (*audit.REQUIRED, "num")) + " FROM parts")
def _(s, d):
    return _split(s, d).select("doc_id", *[parse.field(F.col("fm"), n).alias(f"f_{n}") for n in (*audit.REQUIRED, "num")])


@_query("p4_source_range", "SELECT doc_id, coalesce(CAST(nullif(regexp_extract(fm, 'pp\\.(\\d+)-(\\d+)', 1), '') AS BIGINT), 0) AS first_page, coalesce(CAST(nullif(regexp_extract(fm, 'pp\\.(\\d+)-(\\d+)', 2), '') AS BIGINT), 0) AS last_page, coalesce(CAST(nullif(regexp_extract(fm, 'pp\\.(\\d+)-(\\d+)', 1), '') AS BIGINT), 1000000000) AS source_start FROM parts")
def _(s, d):
    first, last = parse.source_range(F.col("fm"))
    zero = F.lit(0).cast("long")
    return _split(s, d).select("doc_id", F.coalesce(first, zero).alias("first_page"), F.coalesce(last, zero).alias("last_page"), parse.source_start(F.col("fm")).alias("source_start"))


@_query("p5_page_entry", "SELECT vendor, slug, num, title, cat, source FROM kv")
def _(s, d):
    return _entries(s, d).select("vendor", "slug", "num", "title", "cat", "source")


@_query("p6_headings", "SELECT doc_id, list_aggregate(regexp_extract_all(body, '(?m)^#{1,4}\\s+(.+)$', 1), 'string_agg', '|') AS heads FROM parts")
def _(s, d):
    return _split(s, d).select("doc_id", F.array_join(parse.headings(F.col("body")), "|").alias("heads"))


@_query("p7_search_heads", "SELECT vendor, slug, CAST(len(heads) AS INTEGER) AS n, coalesce(list_aggregate(heads, 'string_agg', '|'), '') AS heads FROM docs")
def _(s, d):
    return _search_docs(s, d).select("vendor", "slug", F.size("heads").alias("n"), F.array_join("heads", "|").alias("heads"))


@_query("p8_excerpt", "SELECT vendor, slug, excerpt FROM docs")
def _(s, d):
    return _search_docs(s, d).select("vendor", "slug", "excerpt")


@_query("p9_sort_key", "SELECT vendor, slug, num, CAST(ka AS BIGINT) AS a, CAST(kb AS BIGINT) AS b FROM entries")
def _(s, d):
    return _entries(s, d).select("vendor", "slug", "num", "key.a", "key.b")


@_query("p10_section_slug", """SELECT vendor, slug, num, CASE WHEN num LIKE 'A-%' THEN 'ap-' || CASE WHEN length(substr(num, 3)) < 2 THEN '0' ELSE '' END || substr(num, 3)
  ELSE coalesce(list_aggregate(list_transform(regexp_extract_all(num, '\\d+'), lambda x: CASE WHEN length(x) < 2 THEN '0' || x ELSE x END), 'string_agg', '-'), '') END AS section_slug FROM kv""")
def _(s, d):
    return _entries(s, d).select("vendor", "slug", "num", parse.section_slug(F.col("num")).alias("section_slug"))


@_query("p12_meta_description", f"""SELECT d.vendor, slug, substr(coalesce(nullif(excerpt, ''), v.label || '(' || v.company || ')の' || title || 'に関する解説。'), 1, {site.DESCRIPTION}) AS description FROM docs d JOIN vendors v ON v.id = d.vendor""")
def _(s, d):
    return _metadata(s, d).select("vendor", "slug", "description")


def _metadata(s, d):
    rows = site.with_source(_search_docs(s, d), _entries(s, d))
    return site.page_metadata(rows, SITE)


@_query("p13_page_title", f"SELECT d.vendor, slug, num || ' ' || title || ' | ' || v.label || '(' || v.company || ') | {SITE.name}' AS title FROM docs d JOIN vendors v ON v.id = d.vendor")
def _(s, d):
    return _metadata(s, d).select("vendor", "slug", "title")


@_query("p14_page_urls", f"SELECT vendor, slug, '/' || vendor || '/' || slug AS route, '{SITE.url}' || vendor || '/' || slug || '/' AS url, '{SITE.url}content/' || vendor || '/' || slug || '.md' AS markdown_url FROM docs")
def _(s, d):
    return _metadata(s, d).select("vendor", "slug", "route", "url", "markdown_url")


_LD_SQL = f"""replace('{{"@context":"https://schema.org","@type":"TechArticle","headline":"' || num || ' ' || title || '","inLanguage":"{SITE.language}","about":"' || v.label || '(' || v.company || ') ' || coalesce(c.label, '') || '",'
  || CASE WHEN source IS NULL THEN '' ELSE '"isBasedOn":"' || source || '",' END || '"isPartOf":{{"@type":"WebSite","name":"{SITE.name}","url":"{SITE.url}"}},"breadcrumb":{{"@type":"BreadcrumbList","itemListElement":[{{"@type":"ListItem","position":1,"name":"{SITE.name}","item":"{SITE.url}"}},{{"@type":"ListItem","position":2,"name":"'
  || coalesce(c.label, cat) || '","item":"{SITE.url}common/' || cat || '/"}},{{"@type":"ListItem","position":3,"name":"' || num || ' ' || title || '"}}]}}}}', '<', '\\u003c')"""


@_query("p15_json_ld", f"SELECT d.vendor, slug, {_LD_SQL} AS json_ld FROM docs d JOIN vendors v ON v.id = d.vendor LEFT JOIN categories c ON c.id = d.cat")
def _(s, d):
    return _metadata(s, d).select("vendor", "slug", "json_ld")


_ESC = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '\"', '&quot;')"


@_query("p16_head_tags", f"""SELECT vendor, slug, '<title>' || {_ESC('title')} || '</title>' || chr(10) || '<meta name="description" content="' || {_ESC('description')} || '" />' || chr(10) || '<link rel="canonical" href="' || url || '" />' || chr(10)
  || '<meta property="og:title" content="' || {_ESC('title')} || '" />' || chr(10) || '<meta property="og:description" content="' || {_ESC('description')} || '" />' || chr(10) || '<meta property="og:type" content="article" />' || chr(10)
  || '<meta property="og:url" content="' || url || '" />' || chr(10) || '<meta property="og:site_name" content="{SITE.name}" />' || chr(10) || '<link rel="alternate" type="text/markdown" href="' || markdown_url || '" title="Markdown原文" />' || chr(10)
  || '<script type="application/ld+json">' || json_ld || '</script>' || chr(10) AS head FROM (
  SELECT d.vendor, slug, num || ' ' || title || ' | ' || v.label || '(' || v.company || ') | {SITE.name}' AS title, substr(coalesce(nullif(excerpt, ''), v.label || '(' || v.company || ')の' || title || 'に関する解説。'), 1, {site.DESCRIPTION}) AS description,
    '{SITE.url}' || d.vendor || '/' || slug || '/' AS url, '{SITE.url}content/' || d.vendor || '/' || slug || '.md' AS markdown_url, {_LD_SQL} AS json_ld
  FROM docs d JOIN vendors v ON v.id = d.vendor LEFT JOIN categories c ON c.id = d.cat)""")
def _(s, d):
    return site.head_tags(_metadata(s, d), SITE)


@_query("p17_strip_h1", "SELECT vendor, slug, regexp_replace(ltrim(body, chr(10)), '^# .+\\n', '') AS md FROM parts")
def _(s, d):
    return _split(s, d).select("vendor", "slug", site.strip_h1(F.regexp_replace("body", r"\A\n+", "")).alias("md"))


@_query("p18_image_urls", "SELECT vendor, slug, image, CASE WHEN regexp_matches(image, '^(https?:|/)') THEN image ELSE '/base/' || image END AS url FROM (SELECT vendor, slug, unnest(regexp_extract_all(body, '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1)) AS image FROM parts)")
def _(s, d):
    return _split(s, d).select("vendor", "slug", F.explode(audit.images(F.col("body"))).alias("image")).withColumn("url", site.resolve_image_url(F.col("image"), "/base/"))


@_query("p19_labels", "SELECT d.vendor, slug, coalesce(v.label, d.vendor) AS vendor_label, coalesce(c.label, cat) AS cat_label FROM docs d LEFT JOIN vendors v ON v.id = d.vendor LEFT JOIN categories c ON c.id = d.cat")
def _(s, d):
    return _entries(s, d).select("vendor", "slug", labelled(F.col("vendor"), VENDORS).alias("vendor_label"), labelled(F.col("cat"), CATEGORIES).alias("cat_label"))


_HAY = "lower(num || ' ' || title || ' ' || coalesce(list_aggregate(heads, 'string_agg', ' '), '') || ' ' || excerpt)"


def _search_sql(query: str) -> tuple[str, str]:
    terms = query.lower().split()
    fits = " AND ".join(f"contains({_HAY}, {_q(t)})" for t in terms)
    points = " + ".join(f"CASE WHEN contains(lower(title), {_q(t)}) THEN 10 ELSE 0 END + CASE WHEN len(list_filter(heads, lambda h: contains(lower(h), {_q(t)}))) > 0 THEN 4 ELSE 0 END + CASE WHEN contains(lower(num), {_q(t)}) THEN 6 ELSE 0 END" for t in terms)
    return fits, points


@_query("f1_search_match", f"SELECT vendor, slug FROM docs WHERE vendor = 'alpha' AND {_search_sql(SEARCH)[0]}")
def _(s, d):
    return search.match(_search_index(s, d), SEARCH, "alpha").select("vendor", "slug")


@_query("f2_drop_common_index", "SELECT vendor, slug FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN 'common' ELSE vendor END AS vendor, CASE WHEN doc_id % 10 = 0 THEN 'index' ELSE slug END AS slug FROM pages) WHERE NOT (vendor = 'common' AND slug = 'index')")
def _(s, d):
    rows = _pages(s, d).select(F.when(F.col("doc_id") % 5 == 0, "common").otherwise(F.col("vendor")).alias("vendor"), F.when(F.col("doc_id") % 10 == 0, "index").otherwise(F.col("slug")).alias("slug"))
    return index.drop_common_index(rows)


@_query("k1_search_topk", f"SELECT vendor, slug, num, title, CAST({_search_sql(SEARCH)[1]} AS INTEGER) AS score, '/' || vendor || '/' || slug AS route, substr(excerpt, 1, 70) AS snippet FROM docs WHERE {_search_sql(SEARCH)[0]} ORDER BY score DESC, vendor, ka, kb, slug LIMIT 30")
def _(s, d):
    return search.top(_search_index(s, d), SEARCH)


@_query("k1_search_many", " UNION ALL ".join(f"SELECT * FROM (SELECT {i} AS query_id, CAST(row_number() OVER (ORDER BY {_search_sql(q)[1]} DESC, vendor, ka, kb, slug) AS INTEGER) AS rank, vendor, slug, CAST({_search_sql(q)[1]} AS INTEGER) AS score, '/' || vendor || '/' || slug AS route FROM docs WHERE {_search_sql(q)[0]}) WHERE rank <= 30" for i, q in SEARCHES))
def _(s, d):
    return search.top_each(_search_index(s, d), s.createDataFrame(list(SEARCHES), "query_id int, query string"))


@_query("f1_search_indexed", f"SELECT vendor, slug, CAST({_search_sql(RARE)[1]} AS INTEGER) AS score FROM docs WHERE vendor = 'beta' AND {_search_sql(RARE)[0]}")
def _(s, d):
    return postings.match(s, _postings(s, d), RARE, "beta").select("vendor", "slug", "score")


@_query("k1_search_indexed", " UNION ALL ".join(f"SELECT * FROM (SELECT {i} AS query_id, CAST(row_number() OVER (ORDER BY {_search_sql(q)[1]} DESC, vendor, ka, kb, slug) AS INTEGER) AS rank, vendor, slug, CAST({_search_sql(q)[1]} AS INTEGER) AS score, '/' || vendor || '/' || slug AS route FROM docs WHERE {_search_sql(q)[0]}) WHERE rank <= 30" for i, q in (*SEARCHES, *MORE_SEARCHES)))
def _(s, d):
    return postings.top_each(s, _postings(s, d), s.createDataFrame([*SEARCHES, *MORE_SEARCHES, (99, "  ")], "query_id int, query string"))


@_query("j1_with_search_doc", "SELECT e.vendor, e.slug, e.num, d.excerpt FROM entries e LEFT JOIN docs d USING (vendor, slug)")
def _(s, d):
    return site.with_search_doc(_entries(s, d), _search_docs(s, d)).select("vendor", "slug", "num", "excerpt")


@_query("j2_with_source", "SELECT vendor, slug, num, source FROM entries")
def _(s, d):
    return site.with_source(_entries(s, d).select("vendor", "slug", "num"), _entries(s, d)).select("vendor", "slug", "num", "source")


@_query("j3_listing_grid", "SELECT CAST(vendor_ord AS INTEGER) AS vendor_ord, CAST(cat_ord AS INTEGER) AS cat_ord, e.vendor, e.cat, count(*) AS n_pages FROM entries e JOIN vendors v ON v.id = e.vendor JOIN categories c ON c.id = e.cat GROUP BY ALL")
def _(s, d):
    return index.listing_grid(_entries(s, d), vendors(s), categories(s))


@_query("j4_category_listing", "SELECT cat, vendor, CAST(row_number() OVER (PARTITION BY cat, vendor ORDER BY ka, kb, slug) AS INTEGER) AS ord, slug, num, title FROM entries")
def _(s, d):
    return index.category_listing(_entries(s, d)).withColumn("ord", F.col("ord").cast("int"))


_IMAGES = "SELECT vendor, slug, image FROM (SELECT vendor, slug, unnest(regexp_extract_all(body, '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1)) AS image FROM parts WHERE has_fm) WHERE NOT regexp_matches(image, '^(https?:)?//') AND ltrim(image, '/') NOT IN (SELECT path FROM images)"


@_query("j5_missing_images", _IMAGES)
def _(s, d):
    return audit.missing_images(audit.read(_pages(s, d)).where("has_fm"), bridge_images(_docs(s, d)))


@_query("a1_pages_by_category", "SELECT vendor, cat, count(*) AS n_pages FROM kv GROUP BY ALL")
def _(s, d):
    return index.count_by_category(_entries(s, d))


@_query("a2_pages_by_vendor", "SELECT vendor, count(*) AS n_pages FROM kv GROUP BY ALL")
def _(s, d):
    return index.count_by_vendor(_entries(s, d))


_TABLES = "SELECT vendor, slug, min(n) AS start, count(*) AS size, count(DISTINCT w) AS widths, max(CASE WHEN k = 2 THEN CASE WHEN regexp_full_match(x, '\\|(?:\\s*:?-+:?\\s*\\|)+') THEN 1 ELSE 0 END END) AS sep FROM (SELECT *, row_number() OVER (PARTITION BY vendor, slug, run ORDER BY n) AS k FROM (SELECT *, n - row_number() OVER (PARTITION BY vendor, slug ORDER BY n) AS run, len(x) - len(replace(x, '|', '')) - 1 AS w FROM line WHERE has_fm AND x LIKE '|%')) GROUP BY vendor, slug, run"


@_query("a3_corpus_totals", f", t AS ({_TABLES}) SELECT (SELECT count(*) FROM pages) AS files, (SELECT count(*) FROM t) AS tables, (SELECT CAST(sum(len(regexp_extract_all(body, '!\\[[^\\]]*\\]\\(([^)]+)\\)'))) AS BIGINT) FROM parts WHERE has_fm) AS images")
def _(s, d):
    return audit.totals(_pages(s, d))


_DUPLICATES = "SELECT vendor, slug, n FROM (SELECT *, lag(trim(x, ' \t')) OVER (PARTITION BY vendor, slug ORDER BY n) AS p FROM line WHERE has_fm) WHERE trim(x, ' \t') <> '' AND trim(x, ' \t') = p AND x NOT LIKE '|%' AND x NOT LIKE '---%'"
_LINKS = "SELECT vendor, slug, unnest(list_zip(regexp_extract_all(body, '(?:^|[^!])\\[([^\\]\\n]+)\\]\\(([^)\\n]*)\\)', 1), regexp_extract_all(body, '(?:^|[^!])\\[([^\\]\\n]+)\\]\\(([^)\\n]*)\\)', 2))) AS l FROM parts WHERE has_fm"
_F = {n: f"nullif(trim(regexp_extract(fm, '(?m)^{n}:\\s*\"?([^\"\\n]+)\"?\\s*$', 1)), '')" for n in (*audit.REQUIRED, "num")}
_H1 = "regexp_extract_all(body, '(?m)^# (.+)$', 1)"


def _finding(rule: str, severity: str, source: str, line: str = "0", detail: str = "''", n: str = "1") -> str:
    return f"SELECT vendor, slug, '{rule}' AS rule, '{severity}' AS severity, CAST({line} AS INTEGER) AS line_no, CAST({n} AS BIGINT) AS n, {detail} AS detail FROM {source}"


_RULES = {
    "q2_front_matter": _finding("Q2 front matter", "error", "parts WHERE NOT has_fm"),
    "q3_fields": " UNION ALL ".join(_finding("Q3 field missing", "error", f"parts WHERE has_fm AND {f} IS NULL", detail=f"'{n}'") for n, f in _F.items()),
    "q4_h1_count": _finding("Q4 H1 count", "error", f"parts WHERE has_fm AND len({_H1}) <> 1", detail=f"CAST(len({_H1}) AS VARCHAR)"),
    "q5_h1_differs": _finding("Q5 H1 differs", "error", f"parts WHERE has_fm AND len({_H1}) = 1 AND {_F['title']} IS NOT NULL AND {_H1}[1] <> coalesce({_F['num']} || ' ', '') || {_F['title']}", detail=f"{_H1}[1]"),
    "q6_replacement_character": _finding("Q6 replacement character", "error", "parts WHERE has_fm AND contains(text, '�')"),
    "q7_private_use": _finding("Q7 private-use glyph", "error", "parts WHERE has_fm AND regexp_matches(text, '[\\x{E000}-\\x{F8FF}]')"),
    "q8_empty_link": _finding("Q8 empty link", "error", "parts WHERE has_fm AND regexp_matches(text, '\\]\\(\\s*\\)')"),
    "q9_suspicious_link": _finding(
        "Q9 suspicious link", "error",
        f"(SELECT vendor, slug, l[1] AS label, trim(l[2]) AS target FROM ({_LINKS})) WHERE NOT regexp_matches(target, '^(https?://|mailto:|#)') AND NOT regexp_full_match(target, '/(alpha|beta|gamma|common)/[a-z0-9-]+/?(#[^\\s]+)?') AND NOT regexp_full_match(target, '(\\.\\./)*[a-z0-9_./-]+\\.md(#[^\\s]+)?')",
        detail="'[' || label || '](' || target || ')'",
    ),
    "q11_heading_bullet": _finding("Q11 heading bullet", "error", "parts WHERE has_fm AND regexp_matches(body, '(?m)^#{2,6}\\s+[・•●■]')"),
    "q13_malformed_table": _finding("Q13 malformed table", "error", f"({_TABLES}) WHERE size < 2 OR widths <> 1 OR coalesce(sep, 0) = 0", line="start"),
    "q14_missing_image": _finding("Q14 missing image", "error", f"({_IMAGES})", detail="image"),
    "q15_fence": _finding("Q15 unclosed fence", "error", "parts WHERE has_fm AND len(regexp_extract_all(body, '```')) % 2 = 1"),
    "q16_duplicate_line": _finding("Q16 duplicate line", "warning", f"({_DUPLICATES})", line="n"),
}


def _audit(s, d):
    return audit.audit(_pages(s, d), bridge_images(_docs(s, d)))


for _name, _sql in _RULES.items():
    _tag = _name.split("_")[0].upper() + " "

    @_query(_name, f" SELECT * FROM ({_sql})")
    def _(s, d, tag=_tag):
        return _audit(s, d).where(F.col("rule").startswith(tag))


_ALL = " UNION ALL ".join(f"({x})" for x in _RULES.values())


@_query("q20_audit", f" SELECT * FROM ({_ALL})")
def _(s, d):
    return _audit(s, d)


@_query("a4_warning_totals", f" SELECT rule, CAST(sum(n) AS BIGINT) AS total FROM ({_ALL}) WHERE severity = 'warning' GROUP BY rule")
def _(s, d):
    return audit.warning_totals(_audit(s, d))


@_query("a5_verdict", f" SELECT CAST(sum(CASE WHEN severity = 'error' THEN n ELSE 0 END) AS BIGINT) AS errors, sum(CASE WHEN severity = 'error' THEN n ELSE 0 END) = 0 AS passes FROM ({_ALL})")
def _(s, d):
    return audit.verdict(_audit(s, d))


@_query("w4_duplicate_lines", _DUPLICATES.replace("SELECT vendor, slug, n FROM", "SELECT vendor, slug, CAST(n AS INTEGER) AS line_no FROM", 1))
def _(s, d):
    return audit.read(_pages(s, d)).where("has_fm").select("vendor", "slug", F.explode(audit.duplicate_lines(F.col("lines"))).alias("line_no"))


@_query("w5_tables", f"SELECT vendor, slug, CAST(start AS INTEGER) AS start, CAST(start + size - 1 AS INTEGER) AS last FROM ({_TABLES})")
def _(s, d):
    return audit.read(_pages(s, d)).where("has_fm").select("vendor", "slug", F.explode(audit.tables(F.col("lines"))).alias("t")).select("vendor", "slug", "t.start", "t.last")


@_query("a7_nested_nav", "SELECT vendor, cat, string_agg(slug || ' ' || num, '|' ORDER BY ka, kb, slug) AS pages FROM entries GROUP BY vendor, cat")
def _(s, d):
    return index.nested_nav(_entries(s, d)).select("vendor", "cat", F.array_join(F.transform("pages", lambda p: F.concat_ws(" ", p["slug"], p["num"])), "|").alias("pages"))


@_query("w1_neighbours", "SELECT vendor, slug, lag(slug) OVER w AS previous_slug, lead(slug) OVER w AS next_slug FROM entries WINDOW w AS (PARTITION BY vendor ORDER BY ka, kb, slug)")
def _(s, d):
    return site.neighbours(_entries(s, d))


@_query("w2_nav_position", "SELECT vendor, slug, CAST(row_number() OVER (PARTITION BY vendor ORDER BY ka, kb, slug) AS INTEGER) AS position FROM entries")
def _(s, d):
    return index.nav_order(_entries(s, d)).select("vendor", "slug", F.col("position").cast("int").alias("position"))


@_query("w3_first_pages", "SELECT v.id AS vendor, coalesce(arg_min(slug, lpad(CAST(ka AS VARCHAR), 8, '0') || lpad(CAST(kb AS VARCHAR), 12, '0') || slug), 'index') AS slug FROM vendors v LEFT JOIN entries e ON e.vendor = v.id GROUP BY v.id")
def _(s, d):
    return index.first_pages(_entries(s, d), vendors(s))


@_query("u1_search_docs", "SELECT vendor, slug, num, title, cat, coalesce(list_aggregate(heads, 'string_agg', '|'), '') AS heads, excerpt FROM docs UNION ALL SELECT 'common', slug, '', CASE WHEN title = '' THEN slug ELSE title END || '(3社対応表)', slug, coalesce(list_aggregate(heads, 'string_agg', '|'), ''), excerpt FROM docs WHERE num LIKE '1%'")
def _(s, d):
    pages = _pages(s, d)
    common = pages.join(_entries(s, d).where("num like '1%'").select("vendor", "slug"), ["vendor", "slug"], "left_semi").withColumn("vendor", F.lit("common"))
    return index.search_docs(pages, common).withColumn("heads", F.array_join("heads", "|"))


@_query("u2_sitemap", f"SELECT '{SITE.url}' AS loc, '{SITE.built}' AS lastmod UNION ALL SELECT '{SITE.url}common/' || id || '/', '{SITE.built}' FROM categories UNION ALL SELECT '{SITE.url}' || vendor || '/' || slug || '/', '{SITE.built}' FROM docs")
def _(s, d):
    return site.sitemap(site.routes(_entries(s, d), categories(s)), SITE)


@_query("s6_agent_index", """, g AS (SELECT vendor_ord, cat_ord, v.id AS vendor, c.id AS cat, c.label, count(*) AS n FROM entries e JOIN vendors v ON v.id = e.vendor JOIN categories c ON c.id = e.cat GROUP BY ALL)
SELECT 0::BIGINT AS part, 0::BIGINT AS ord, '# Manuals' AS line UNION ALL SELECT 0, 1, '' UNION ALL SELECT (vendor_ord + 1) * 10, 0, '## ' || label || ' (' || company || ')' FROM vendors UNION ALL SELECT (vendor_ord + 1) * 10, 1, '' FROM vendors
UNION ALL SELECT (vendor_ord + 1) * 10 + cat_ord + 1, 0, '### ' || label FROM g UNION ALL SELECT (vendor_ord + 1) * 10 + cat_ord + 1, n + 1, '' FROM g
UNION ALL SELECT (vendor_ord + 1) * 10 + cat_ord + 1, row_number() OVER (PARTITION BY e.vendor, e.cat ORDER BY ka, kb, slug), '- [' || num || ' ' || title || '](content/' || e.vendor || '/' || slug || '.md)' FROM entries e JOIN g ON g.vendor = e.vendor AND g.cat = e.cat""")
def _(s, d):
    return index.agent_index(_entries(s, d), vendors(s), categories(s))


# C1: the anchor is the next page's first line of text; the cut is the last equal line late enough.
_OVERLAP = """, b AS (SELECT p.vendor, p.slug, text, has_fm, body, coalesce(CAST(nullif(regexp_extract(fm, 'pp\\.(\\d+)-', 1), '') AS BIGINT), 1000000000) AS start, l,
  list_filter(list_transform(l, lambda x: trim(x, ' \t')), lambda x: x <> '' AND NOT regexp_matches(x, '^(#|\\||!\\[|---)') AND length(regexp_replace(x, '[*_`]', '', 'g')) >= 12)[1] AS anchor FROM parts p JOIN lines USING (vendor, slug, has_fm, body)),
n AS (SELECT *, lead(anchor) OVER (PARTITION BY vendor ORDER BY start, slug) AS next_anchor FROM b),
c AS (SELECT *, list_max(list_filter(range(1, len(l) + 1), lambda i: trim(l[i], ' \t') = next_anchor AND i - 1 >= greatest(8, CAST(floor(len(l) * 0.52) AS BIGINT)))) AS cut FROM n),
u AS (SELECT vendor, slug, text AS old, CASE WHEN cut IS NULL THEN text ELSE substr(text, 1, length(text) - length(body)) || rtrim(list_aggregate(l[1:cut - 1], 'string_agg', chr(10)), ' \t' || chr(10)) || chr(10) END AS text FROM c)
"""


@_query("c1_trim_overlap", _OVERLAP + "SELECT vendor, slug, text, text <> old AS overlap FROM u")
def _(s, d):
    return clean.trim_overlap(_pages(s, d))


@_query("w9_next_anchor", _OVERLAP + "SELECT vendor, slug, start, anchor FROM b")
def _(s, d):
    return _split(s, d).select("vendor", "slug", parse.source_start(F.col("fm")).alias("start"), clean.first_anchor(F.col("body")).alias("anchor"))


@_query("c12_canonical_h1", f"SELECT vendor, slug, CASE WHEN {_F['num']} IS NOT NULL AND {_F['title']} IS NOT NULL THEN regexp_replace(body, '(?m)^# .+$', '# ' || {_F['num']} || ' ' || {_F['title']}) ELSE body END AS body FROM parts")
def _(s, d):
    return _split(s, d).select("vendor", "slug", clean.canonical_h1(F.col("fm"), F.col("body")).alias("body"))


@_query("c4_normalize_lines")
def _(s, d):
    return clean.normalize_lines(_split(s, d)).select("vendor", "slug", "body")


@_query("c11_polish_blocks")
def _(s, d):
    return blocks.polish_bodies(_split(s, d).select("vendor", "slug", "body"))


@_query("c13_polish")
def _(s, d):
    return polish_job.polish(_pages(s, d))


@_query("a6_polish_totals")
def _(s, d):
    return blocks.counter_totals(polish_job.polish(_pages(s, d)))
