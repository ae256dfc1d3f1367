"""Queries over tables of contents and page layout made from ``documents``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jobs.extract import boxes_of_pages, items_of_pages, pages_of_sections
from .layout_config import LAYOUTS, glyph_map
from .operators import assemble, changes, layout, tables, toc
from .sources import layout_view as view
from .sources import manual_view as manual
from .sources.scratch import materialize, scratch_removed
from .sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Places on a page in numbers that go through a manual, and pages kept free behind the last.
PAGE_PLACES, SPARE_PAGES = 10_000, 100
_TOC = f"WITH {view.BASE_SQL}, toc AS ({view.TOC_SQL}) "


def _query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def _docs(s, d):
    return read_table(s, d, "documents")


def _toc(s, d):
    return view.toc(_docs(s, d))


def _sections(s, d):
    return toc.build_sections(_toc(s, d), view.page_counts(_docs(s, d))).withColumn("ord", F.col("ord").cast("int"))


def _lines(s, d):
    return layout.text_lines(view.spans(_docs(s, d)))


def _boxes(s, d):
    return view.boxes(_docs(s, d))


def _tables(s, d):
    return tables.tables_of_pages(view.cells(_docs(s, d)), _lines(s, d), _boxes(s, d))


def _boxed(s, d, lines=None):
    return boxes_of_pages(_lines(s, d) if lines is None else lines, _boxes(s, d), view.cells(_docs(s, d)))


def _items(s, d):
    with scratch_removed(s, keep=("items",)):
        lines = materialize(_lines(s, d), "lines", "zstd")
        return items_of_pages(lines, *_boxed(s, d, lines))


def _made(s, d):
    """The sections and their Markdown."""
    with scratch_removed(s, keep=("sections", "sections-made")):
        # Sections are read by several joins; they and their sub-headings are made once.
        entries = materialize(_toc(s, d), "toc")
        found = materialize(toc.build_sections(entries, view.page_counts(_docs(s, d))), "sections")
        subs = materialize(toc.sub_headings(found, entries), "sub-headings")
        with scratch_removed(s, keep=("items", "tables", "figures")):
            lines = materialize(_lines(s, d), "lines", "zstd")
            boxed = _boxed(s, d, lines)
            items = items_of_pages(lines, *boxed)
        return found, pages_of_sections(found, items, subs, *boxed)


@_query("l0_toc", _TOC + "SELECT * FROM toc")
def _(s, d):
    return _toc(s, d)


@_query("w6_toc_chapters", _TOC + """SELECT * REPLACE (coalesce(chapter, 0) AS chapter) FROM (SELECT *, last_value(CASE WHEN level = 2 AND regexp_matches(title, '^\\d+\\s+.+$') THEN CAST(regexp_extract(title, '^(\\d+)', 1) AS INTEGER) END IGNORE NULLS) OVER w AS chapter,
  coalesce(max(CASE WHEN level = 1 AND title LIKE '付%' THEN 1 END) OVER w, 0) = 1 AS in_appendix FROM toc WINDOW w AS (PARTITION BY vendor ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
def _(s, d):
    return toc.toc_chapters(_toc(s, d)).withColumn("chapter", F.coalesce("chapter", F.lit(0)))


_HISTORY = "level = 2 AND ((vendor = 'alpha' AND regexp_matches(title, '^付1\\s')) OR (vendor = 'beta' AND contains(title, '改訂履歴')) OR (vendor = 'gamma' AND regexp_matches(title, '^A-1[34]\\s')))"


@_query("u3_breaks", _TOC + f"SELECT DISTINCT vendor, page FROM toc WHERE level = 1 OR (vendor = 'alpha' AND level = 2 AND regexp_matches(title, '^\\d+\\s')) OR ({_HISTORY})")
def _(s, d):
    rows, out = toc.toc_chapters(_toc(s, d)), None
    for vendor, scheme in toc.SCHEMES.items():
        part = toc.breaks_of(rows.where(F.col("vendor") == vendor), scheme)
        out = part if out is None else out.unionByName(part)
    return out


@_query("f6_history", _TOC + f"SELECT vendor, pos, title FROM toc WHERE {_HISTORY}")
def _(s, d):
    rows, out = _toc(s, d), None
    for vendor, scheme in toc.SCHEMES.items():
        part = rows.where(F.col("vendor") == vendor).where(toc._history(rows, scheme)).select("vendor", "pos", "title")
        out = part if out is None else out.unionByName(part)
    return out


_CATEGORY = lambda scheme, chapter, num: "CASE " + "".join(f"WHEN {num} = '{k}' THEN '{v}' " for k, v in scheme.overrides.items()) + "".join(f"WHEN {chapter} = {k} THEN '{v}' " for k, v in scheme.categories.items()) + "ELSE 'reference' END"
_SECTIONS = _TOC + f""", ch AS (SELECT *, last_value(CASE WHEN level = 2 AND regexp_matches(title, '^\\d+\\s+.+$') THEN CAST(regexp_extract(title, '^(\\d+)', 1) AS INTEGER) END IGNORE NULLS) OVER w AS chapter,
  coalesce(max(CASE WHEN level = 1 AND title LIKE '付%' THEN 1 END) OVER w, 0) = 1 AS ap FROM toc WINDOW w AS (PARTITION BY vendor ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
n AS (SELECT *, regexp_extract(title, '^(\\S+)\\s', 1) AS num, regexp_extract(title, '^\\S+\\s+(.+)$', 1) AS rest, CAST(nullif(regexp_extract(title, '^(\\d+)', 1), '') AS INTEGER) AS own FROM ch),
plain AS (
  SELECT vendor, pos, level, num, rest AS title, page, {_CATEGORY(toc.DOTTED, 'chapter', 'num')} AS cat, 4 AS sub FROM n WHERE vendor = 'alpha' AND level = 3 AND regexp_full_match(num, '\\d+\\.\\d+') AND chapter IS NOT NULL AND chapter <> 0
  UNION ALL SELECT vendor, pos, level, num, rest, page, 'reference', 3 FROM n WHERE vendor = 'alpha' AND level = 2 AND regexp_full_match(num, '付\\d+') AND num <> '付1'
  UNION ALL SELECT vendor, pos, level, num, rest, page, {_CATEGORY(toc.PART, 'own', 'num')}, 3 FROM n WHERE vendor = 'beta' AND level = 2 AND NOT ap AND regexp_full_match(num, '\\d+-\\d+')
  UNION ALL SELECT vendor, pos, level, '付' || num, rest, page, 'reference', 3 FROM n WHERE vendor = 'beta' AND level = 2 AND ap AND regexp_full_match(num, '\\d+') AND NOT contains(title, '改訂履歴')
  UNION ALL SELECT vendor, pos, level, num, rest, page, {_CATEGORY(toc.LETTER, 'own', 'num')}, 3 FROM n WHERE vendor = 'gamma' AND level = 2 AND regexp_full_match(num, '\\d+-\\d+') AND own <= 11
  UNION ALL SELECT vendor, pos, level, num, rest, page, 'reference', 3 FROM n WHERE vendor = 'gamma' AND level = 2 AND regexp_full_match(num, 'A-\\d+') AND num NOT IN ('A-13', 'A-14')
),
over AS (
  SELECT c.vendor, c.pos, c.level, c.own || '.0' AS num, c.rest || '(機能概要)' AS title, c.page, {_CATEGORY(toc.DOTTED, 'c.own', "''")} AS cat, 4 AS sub
  FROM n c JOIN (SELECT CAST(split_part(num, '.', 1) AS INTEGER) AS chap, arg_min(page, pos) AS first FROM plain WHERE vendor = 'alpha' AND contains(num, '.') GROUP BY 1) f ON f.chap = c.own
  WHERE c.vendor = 'alpha' AND c.level = 2 AND regexp_matches(c.title, '^\\d+\\s+.+$') AND first > c.page
),
s AS (SELECT *, CASE vendor WHEN 'alpha' THEN page ELSE pos END AS k1, CASE vendor WHEN 'alpha' THEN num ELSE '' END AS k2 FROM (SELECT * FROM plain UNION ALL SELECT * FROM over)),
o AS (SELECT *, row_number() OVER w AS ord, lead(page) OVER w AS next_page FROM s WINDOW w AS (PARTITION BY vendor ORDER BY k1, k2, pos)),
b AS (SELECT DISTINCT vendor, page FROM toc WHERE level = 1 OR (vendor = 'alpha' AND level = 2 AND regexp_matches(title, '^\\d+\\s')) OR ({_HISTORY})),
pc AS (SELECT vendor, max(page) + 4 AS pages FROM layout_base GROUP BY vendor),
e AS (SELECT o.*, coalesce(next_page, pages) AS stop, (SELECT min(b.page) FROM b WHERE b.vendor = o.vendor AND b.page > o.page) AS brk FROM o JOIN pc USING (vendor)),
sections AS (SELECT vendor, CAST(ord AS INTEGER) AS ord, num, title, cat, page, CAST(greatest(page, CASE WHEN brk < stop THEN brk - 1 ELSE stop END) AS INTEGER) AS page_end, pos, level, sub AS sub_level FROM e)
"""


_PADDED = lambda x: f"(CASE WHEN length({x}) < 2 THEN '0' ELSE '' END || {x})"
_SLUG = f"""CASE WHEN regexp_full_match(num, '(?:付|A-?)\\d+') THEN 'ap-' || {_PADDED("regexp_extract(num, '([0-9]+)$', 1)")} ELSE list_aggregate(list_transform(regexp_split_to_array(num, '[.-]'), lambda x: {_PADDED("x")}), 'string_agg', '-') END"""


@_query("x1_sections", _SECTIONS + "SELECT * FROM sections")
def _(s, d):
    return _sections(s, d).drop("slug")


@_query("j6_skip_done", _SECTIONS + "SELECT vendor, num FROM sections WHERE ord % 4 <> 0")
def _(s, d):
    found = _sections(s, d)
    return toc.skip_done(found, found.where("ord % 4 = 0")).select("vendor", "num")


@_query("j6_changed_sections", _SECTIONS + "SELECT DISTINCT s.vendor, s.num FROM sections s JOIN layout_base b ON b.vendor = s.vendor AND b.page BETWEEN s.page AND s.page_end WHERE b.page % 16 = 1")
def _(s, d):
    """What is left to do when the titles of every fourth manual section have changed on their pages."""
    entries = materialize(_toc(s, d), "toc")
    found = materialize(toc.build_sections(entries, view.page_counts(_docs(s, d))), "sections")
    subs, spans = materialize(toc.sub_headings(found, entries), "sub-headings"), view.spans(_docs(s, d))
    others = (_boxes(s, d), view.cells(_docs(s, d)))
    manifest = materialize(changes.section_digests(found, subs, changes.page_digests(spans, *others)), "manifest")
    altered = spans.withColumn("text", F.when((F.col("block") == 0) & (F.col("page") % 16 == 1), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    now = changes.section_digests(found, subs, changes.page_digests(altered, *others))
    return changes.skip_unchanged(now, manifest).select("vendor", "num")


@_query("j7_categories", _SECTIONS + "SELECT vendor, cat, count(*) AS n FROM sections GROUP BY ALL")
def _(s, d):
    return _sections(s, d).groupBy("vendor", "cat").agg(F.count("*").alias("n"))


@_query("j9_page_end", _SECTIONS + "SELECT vendor, ord, page, page_end FROM sections")
def _(s, d):
    return _sections(s, d).select("vendor", "ord", "page", "page_end")


@_query("j10_sub_headings", _SECTIONS + """, m AS (SELECT s.vendor, s.num, s.pos AS at, t.pos, t.level, t.title, t.page, s.level AS own, (SELECT min(x.pos) FROM toc x WHERE x.vendor = s.vendor AND x.pos > s.pos AND x.level <= s.level) AS bound,
  (SELECT min(x.pos) FROM toc x WHERE x.vendor = s.vendor AND x.pos > s.pos AND x.page >= s.page_end AND x.page > s.page) AS past FROM sections s JOIN toc t ON t.vendor = s.vendor AND t.pos > s.pos)
SELECT vendor, num, pos, CAST(least(4, level - own + 1) AS INTEGER) AS level, title, page FROM m WHERE pos < coalesce(bound, 1000000000) AND pos < coalesce(past, 1000000000) AND level > own""")
def _(s, d):
    found = _sections(s, d)
    subs = toc.sub_headings(found, _toc(s, d))
    return subs.join(found.select("vendor", "slug", "num"), ["vendor", "slug"]).select("vendor", "num", "pos", "level", "title", "page")


@_query("j11_overviews", _SECTIONS + "SELECT vendor, num, title, page FROM sections WHERE num LIKE '%.0'")
def _(s, d):
    return _sections(s, d).where("num like '%.0'").select("vendor", "num", "title", "page")


@_query("k4_section_order", _SECTIONS + "SELECT vendor, ord, num FROM sections")
def _(s, d):
    return _sections(s, d).select("vendor", "ord", "num")


# ---- Layout. A page has one table at most (two halves of one are merged) and two figures, so SQL needs no running state.
_BLANK = "[ \\t\\r\\f\\x0B]"
_AREA = lambda x0, y0, x1, y1: f"(greatest(0.0, {x1} - {x0}) * greatest(0.0, {y1} - {y0}))"
_BOTH = lambda a, b: _AREA(f"greatest({a}.x0, {b}.x0)", f"greatest({a}.y0, {b}.y0)", f"least({a}.x1, {b}.x1)", f"least({a}.y1, {b}.y1)")
_OWN = lambda a: _AREA(f"{a}.x0", f"{a}.y0", f"{a}.x1", f"{a}.y1")
_CONFIG = ", ".join(f"('{v}', {', '.join(f'{float(x)}::DOUBLE' for x in c.body_box)}, '{'|'.join(c.running)}')" for v, c in LAYOUTS.items())
_LAY = f"""WITH {view.BASE_SQL}, {view.LINES_SQL},
config AS (SELECT * FROM (VALUES {_CONFIG}) t(vendor, x0, y0, x1, y1, running)),
pieces AS (
  SELECT b.* FROM layout_boxes b JOIN config c USING (vendor) WHERE kind <> 'table' AND {_BOTH("b", "c")} > 0.5 * {_OWN("b")} AND {_OWN("b")} < 0.92 * 595 * 842
    AND CASE kind WHEN 'raster' THEN b.x1 - b.x0 >= 100 AND b.y1 - b.y0 >= 40 ELSE b.x1 - b.x0 >= 150 AND b.y1 - b.y0 >= 60 AND (n_items >= 6 OR EXISTS (
      SELECT 1 FROM layout_boxes r WHERE r.vendor = b.vendor AND r.page = b.page AND r.kind = 'raster' AND r.x1 - r.x0 >= 100 AND r.y1 - r.y0 >= 40 AND {_BOTH("r", "b")} > 0)) END
),
figures AS (
  SELECT p.vendor, p.page, CAST(row_number() OVER (PARTITION BY p.vendor, p.page ORDER BY p.y0, p.x0) AS INTEGER) AS fig, least(p.x0, coalesce(q.x0, p.x0)) AS x0, least(p.y0, coalesce(q.y0, p.y0)) AS y0,
    greatest(p.x1, coalesce(q.x1, p.x1)) AS x1, greatest(p.y1, coalesce(q.y1, p.y1)) AS y1
  FROM pieces p LEFT JOIN pieces q ON q.vendor = p.vendor AND q.page = p.page AND p.kind = 'raster' AND q.kind = 'vector' AND {_BOTH("p", "q")} > 0.25 * least({_OWN("p")}, {_OWN("q")})
  WHERE NOT EXISTS (SELECT 1 FROM pieces r WHERE r.vendor = p.vendor AND r.page = p.page AND r.kind = 'raster' AND p.kind = 'vector' AND {_BOTH("p", "r")} > 0.25 * least({_OWN("p")}, {_OWN("r")}))
),
taken AS (SELECT vendor, page, x0 - 1 AS x0, y0 - 1 AS y0, x1 + 1 AS x1, y1 + 1 AS y1 FROM figures UNION ALL SELECT vendor, page, x0 - 2, y0 - 2, x1 + 2, y1 + 2 FROM layout_boxes WHERE kind = 'table'),
free AS (SELECT * FROM layout_lines l WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.vendor = l.vendor AND t.page = l.page AND (l.x0 + l.x1) / 2 BETWEEN t.x0 AND t.x1 AND (l.y0 + l.y1) / 2 BETWEEN t.y0 AND t.y1)),
body AS (SELECT l.* FROM layout_lines l JOIN config c USING (vendor) WHERE abs(dir_x) >= 0.5 AND (l.x0 + l.x1) / 2 BETWEEN c.x0 AND c.x1 AND (l.y0 + l.y1) / 2 BETWEEN c.y0 AND c.y1),
items AS (
  SELECT vendor, page, l.y0 AS y, l.x0 AS x, 'text' AS kind, regexp_replace(text, '{_BLANK}+$', '') AS text, size, bold FROM body l JOIN (SELECT vendor, page, block FROM free) USING (vendor, page, block) JOIN config c USING (vendor)
  WHERE regexp_matches(text, '[^ \\t\\r\\f\\x0B]') AND NOT regexp_matches(regexp_replace(text, '^{_BLANK}+|{_BLANK}+$', '', 'g'), '^(?:' || running || ')')
),
ordered AS (SELECT *, CAST(row_number() OVER (PARTITION BY vendor, page ORDER BY round(y, 1), x, kind, text) AS INTEGER) AS seq FROM items)
"""
_LINE = "vendor, page, block, line, x0, y0, x1, y1, dir_x, text, size, bold"


@_query("x6_block_stats", _LAY + "SELECT vendor, page, block, size, bold FROM layout_lines")
def _(s, d):
    return layout.block_stats(_lines(s, d))


@_query("f4_in_body_box", _LAY + f"SELECT {_LINE} FROM body")
def _(s, d):
    return layout.in_body_box(_lines(s, d), layout.config_table(s))


@_query("f5_drop_blank", _LAY + f"SELECT {_LINE} FROM layout_lines WHERE regexp_matches(text, '[^ \\t\\r\\f\\x0B]')")
def _(s, d):
    return layout.drop_blank(_lines(s, d))


@_query("j12_text_outside_boxes", _LAY + f"SELECT {_LINE} FROM free")
def _(s, d):
    lines = materialize(_lines(s, d), "lines")
    return layout.text_outside_boxes(lines, layout.taken(*_boxed(s, d, lines)))


@_query("f3_page_items", _LAY + "SELECT * FROM items")
def _(s, d):
    return _items(s, d)


@_query("w8_reading_order", _LAY + "SELECT * FROM ordered")
def _(s, d):
    return layout.reading_order(_items(s, d))


@_query("x2_figure_boxes", _LAY + "SELECT * FROM figures")
def _(s, d):
    return layout.figure_boxes(_boxes(s, d))


@_query("x3_tables")
def _(s, d):
    return _tables(s, d)


# A table holds the cells by rows of three; a merged cell takes the value above it, and the second half follows the first.
_GRID = """, grid AS (SELECT vendor, page, doc_id, n_cells, split_table, cells AS w, CAST(ceil(n_cells / 3) AS BIGINT) AS h FROM layout_words WHERE n_cells > 1),
sized AS (SELECT *, CASE WHEN split_table THEN CAST(ceil(h / 2) AS BIGINT) ELSE h END AS first, CASE WHEN n_cells = 2 THEN 2 ELSE 3 END AS width FROM grid),
filled AS (SELECT *, list_transform(range(h * 3), lambda i: CASE WHEN i = 6 AND doc_id % 15 = 0 AND first > 2 THEN w[4] ELSE coalesce(w[i + 1], '') END) AS c FROM sized)
"""


@_query("x3_damaged_tables", f"WITH {view.BASE_SQL}, {view.LINES_SQL}, {view.DAMAGED_SQL} SELECT vendor, page, number, CAST(row_number() OVER (PARTITION BY vendor, page, number ORDER BY r) - 1 AS INTEGER) AS r, list_aggregate(list(text ORDER BY c), 'string_agg', '|') AS cells FROM rebuilt GROUP BY vendor, page, number, r")
def _(s, d):
    """Tables rebuilt from their edges, the texts of missing cells from loose lines."""
    docs = _docs(s, d)
    found = tables.tables_of_pages(view.damaged_cells(docs), view.damaged_lines(docs), view.boxes(docs).limit(0))
    return found.where("kind = 'table'").select("vendor", "page", "number", F.posexplode("rows").alias("r", "own")).select("vendor", "page", "number", "r", F.array_join("own", "|").alias("cells"))


@_query("x9_kinds_of_tables", f"WITH {view.BASE_SQL}, {view.LINES_SQL} {view.KINDS_SQL}")
def _(s, d):
    """Grids, callout boxes, single columns, tables that are figures; a table of one column is none."""
    docs = _docs(s, d)
    found = tables.tables_of_pages(view.kinds_cells(docs), view.kinds_lines(docs), view.kinds_images(docs))
    text = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n")
    return found.select("vendor", "page", "kind", F.size("rows").alias("n_rows"), F.size(F.get("rows", F.lit(0))).alias("n_columns"), text.alias("grid"))


@_query("w13_table_texts", _LAY + _GRID + """SELECT vendor, page, 1 AS number, CAST(h AS INTEGER) AS n_rows, CAST(width AS INTEGER) AS n_columns,
  list_aggregate(list_transform(range(h), lambda r: list_aggregate(c[r * 3 + 1 : r * 3 + width], 'string_agg', '|')), 'string_agg', chr(10)) AS grid FROM filled""")
def _(s, d):
    found = _tables(s, d).where("kind = 'table'")
    text = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n")
    return found.select("vendor", "page", "number", F.size("rows").alias("n_rows"), F.array_max(F.transform("rows", F.size)).alias("n_columns"), text.alias("grid"))


_CELL = "replace(x, '|', chr(92) || '|')"
_ROW = f"'| ' || list_aggregate(list_transform(c[r * 3 + 1 : r * 3 + 3], lambda x: {_CELL}), 'string_agg', ' | ') || ' |' || chr(10)"


@_query("x8_markdown", _LAY + _GRID + f"""SELECT vendor, page, CASE WHEN list_sum(list_transform(c, lambda x: length(x))) < 14 OR h < 2 OR len(list_filter(c, lambda x: x <> '')) <= 4 AND len(list_filter(c, lambda x: length(x) > 150)) > 0 THEN NULL
  ELSE list_transform([0], lambda r: {_ROW})[1] || '|---|---|---|' || chr(10) || coalesce(list_aggregate(list_transform(range(1, h), lambda r: {_ROW}), 'string_agg', ''), '') END AS markdown FROM filled""")
def _(s, d):
    return tables.markdown(_tables(s, d).where("kind = 'table'")).select("vendor", "page", "markdown")


@_query("w7_figure_names", _SECTIONS.replace("WITH ", _LAY + ", ", 1).replace(view.BASE_SQL + ", toc", "toc", 1) + f""", f AS (SELECT s.vendor, {_SLUG} AS slug, f.page, fig FROM sections s JOIN figures f ON f.vendor = s.vendor AND f.page BETWEEN s.page AND s.page_end)
SELECT *, CAST(row_number() OVER w AS INTEGER) AS seq, slug || '-' || CASE WHEN row_number() OVER w < 10 THEN '0' ELSE '' END || CAST(row_number() OVER w AS VARCHAR) || '.webp' AS name FROM f WINDOW w AS (PARTITION BY vendor, slug ORDER BY page, fig)""")
def _(s, d):
    _, figures = _boxed(s, d)
    own = _sections(s, d).select("vendor", "slug", F.explode(F.sequence("page", "page_end")).alias("page"))
    return layout.figure_names(own.join(figures.select("vendor", "page", "fig"), ["vendor", "page"]))


@_query("p11_match_key", _TOC + "SELECT vendor, pos, regexp_replace(title, '\\s+', '', 'g') AS key FROM toc")
def _(s, d):
    return _toc(s, d).select("vendor", "pos", assemble.match_keys("title").alias("key"))


@_query("p11_full_width_key", _TOC + "SELECT vendor, pos, regexp_replace(title, '\\s+', '', 'g') AS key FROM toc")
def _(s, d):
    # The titles in full-width forms have the keys of the plain ones.
    wide = F.translate("title", "0123456789 ADST.-", "０１２３４５６７８９　ＡＤＳＴ．－")
    return _toc(s, d).select("vendor", "pos", assemble.match_keys(wide).alias("key"))


@_query("j13_toc_headings", _SECTIONS.replace("WITH ", _LAY + ", ", 1).replace(view.BASE_SQL + ", toc", "toc", 1) + f""", m AS (SELECT s.vendor, {_SLUG.replace("num", "s.num")} AS slug, s.pos AS at, t.pos, t.level, t.title, t.page, s.level AS own, (SELECT min(x.pos) FROM toc x WHERE x.vendor = s.vendor AND x.pos > s.pos AND x.level <= s.level) AS bound,
  (SELECT min(x.pos) FROM toc x WHERE x.vendor = s.vendor AND x.pos > s.pos AND x.page >= s.page_end AND x.page > s.page) AS past FROM sections s JOIN toc t ON t.vendor = s.vendor AND t.pos > s.pos),
subs AS (SELECT vendor, slug, pos, CAST(least(4, level - own + 1) AS INTEGER) AS level, regexp_replace(title, '\\s+', '', 'g') AS key FROM m WHERE pos < coalesce(bound, 1000000000) AND pos < coalesce(past, 1000000000) AND level > own),
placed AS (SELECT s.vendor, {_SLUG.replace("num", "s.num")} AS slug, CAST(o.page * 10000 + o.seq AS INTEGER) AS seq, o.text, regexp_replace(o.text, '\\s+', '', 'g') AS norm FROM sections s JOIN ordered o ON o.vendor = s.vendor AND o.page BETWEEN s.page AND s.page_end),
hit AS (SELECT p.vendor, p.slug, p.seq, arg_min(level, pos) AS toc_level FROM placed p JOIN subs USING (vendor, slug) WHERE norm = key OR length(key) > 6 AND starts_with(norm, key) GROUP BY ALL)
SELECT p.vendor, p.slug, p.seq, text, toc_level FROM placed p LEFT JOIN hit USING (vendor, slug, seq)""")
def _(s, d):
    # An integer as in the SQL where all pages fit, which ends at page 214,747, and else a long.
    most = view.page_counts(_docs(s, d)).agg(F.max("pages")).first()[0] or 0
    kind = "int" if (most + SPARE_PAGES) * PAGE_PLACES < 2**31 else "long"
    with scratch_removed(s, keep=("placed", "sub-headings")):
        found = materialize(_sections(s, d), "sections")
        own = found.select("vendor", "slug", F.explode(F.sequence("page", "page_end")).alias("page"))
        items = layout.reading_order(_items(s, d)).join(own, ["vendor", "page"]).withColumn("seq", (F.col("page").cast("long") * PAGE_PLACES + F.col("seq")).cast(kind))
        # Written, so that the shuffles of the pages are gone when those of the sections are made.
        placed = materialize(items.select("vendor", "slug", "seq", "text"), "placed", "zstd")
        subs = materialize(toc.sub_headings(found, _toc(s, d)), "sub-headings")
    return assemble.toc_headings(placed, subs)


# ---- Rules on lines, rows and tables, on what each document's text makes of them.
_PAIRS = """, pairs AS (SELECT vendor, page, block // 2 AS pair, block, text, size, x0 + block % 7 * 60 AS x0, x1 + block % 7 * 60 AS x1, CASE WHEN block % 4 = 1 THEN first_value(y0) OVER w ELSE y0 END AS y0,
  CASE WHEN block % 4 = 1 THEN first_value(y1) OVER w ELSE y1 END AS y1, row_number() OVER w AS k FROM layout_lines WINDOW w AS (PARTITION BY vendor, page, block // 2 ORDER BY block)),
met AS (SELECT a.vendor, a.page, a.pair, a.text AS t, b.text AS u, b.text IS NOT NULL AND b.size < 11.5 AND least(b.y1, a.y1) - greatest(b.y0, a.y0) > (b.y1 - b.y0) * 0.5 AND b.x0 > a.x1 + 3 AND NOT regexp_matches(trim(a.text), '^[0-9.\\-]{1,8}$') AS beside,
  CASE WHEN length(trim(b.text)) <= 1 OR b.x0 <= a.x1 + 10 THEN '' WHEN length(a.text) <= 24 AND NOT contains(a.text, '。') AND NOT regexp_matches(a.text, '[：:、，]$') THEN '：' ELSE ' ' END AS mark
  FROM pairs a LEFT JOIN pairs b ON b.vendor = a.vendor AND b.page = a.page AND b.pair = a.pair AND b.k = 2 WHERE a.k = 1)
"""


@_query("x4_same_row_lines", _LAY + _PAIRS + "SELECT vendor, page, pair, CASE WHEN beside THEN t || mark || u ELSE t || coalesce(chr(10) || u, '') END AS text FROM met")
def _(s, d):
    # Lines two by two; of every second pair the second line stands in the row of the first.
    n = F.col("block")
    rows = _lines(s, d).withColumns({"x0": F.col("x0") + n % 7 * 60, "x1": F.col("x1") + n % 7 * 60, "pair": F.floor(n / 2)})
    own = rows.groupBy("vendor", "page", "pair").agg(F.array_sort(F.collect_list(F.struct("block", "y0", "x0", "y1", "x1", "size", "text"))).alias("own"))
    first = F.get("own", F.lit(0))
    level = lambda n, c: F.when(n["block"] % 4 == 1, first[c]).otherwise(n[c]).alias(c)
    own = own.withColumn("own", F.transform("own", lambda n: F.struct(level(n, "y0"), n["x0"].alias("x0"), level(n, "y1"), n["x1"].alias("x1"), n["size"].alias("size"), n["text"].alias("text"))))
    return own.select("vendor", "page", "pair", F.array_join(layout.merge_same_row_lines(F.col("own")), "\n").alias("text"))


_ENDS, _BEGINS = "[0-9A-Za-z)\\]%.,:;]", "[0-9A-Za-z(\\[]"
_ONCE = lambda x: f"regexp_replace({x}, '({_ENDS})\\x01+({_BEGINS})', '\\1 \\2', 'g')"


@_query("x5_join_lines", _LAY + f"SELECT vendor, page, replace({_ONCE(_ONCE('j'))}, chr(1), '') AS text FROM (SELECT vendor, page, string_agg(regexp_replace(text, '{_BLANK}+$', ''), chr(1) ORDER BY block) AS j FROM layout_lines GROUP BY ALL)")
def _(s, d):
    own = F.array_sort(F.collect_list(F.struct("block", "text")))
    rows = _lines(s, d).groupBy("vendor", "page").agg(F.transform(own, lambda x: x["text"]).alias("own"))
    return rows.select("vendor", "page", layout.join_lines(F.col("own")).alias("text"))


# Rows of four words; some columns are blank, or blank below their header.
_ROWS4 = """, w4 AS (SELECT doc_id, w, CAST(ceil(len(w) / 4) AS BIGINT) AS h FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+') AS w FROM layout_base) WHERE len(w) > 0),
r4 AS (SELECT doc_id, h, list_transform(range(h * 4), lambda i: CASE WHEN i % 4 = 1 AND doc_id % 4 = 0 OR i % 4 = 2 AND i > 3 AND doc_id % 3 = 0 THEN '' ELSE coalesce(w[i + 1], '') END) AS c FROM w4)
"""
_FILLED = lambda least: f"len(list_filter(range({least}, h), lambda r: c[r * 4 + k + 1] <> '')) > 0"


def _rows4(s, d):
    words = F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0))
    rows = view._based(_docs(s, d)).select("doc_id", words.alias("w")).where("size(w) > 0")
    blank = lambda i: (i % 4 == 1) & (F.col("doc_id") % 4 == 0) | (i % 4 == 2) & (i > 3) & (F.col("doc_id") % 3 == 0)
    # The words are bound once, so that no row looks them up in the text, and stay with their document.
    fours = lambda w: F.transform(F.sequence(F.lit(0), F.ceil(F.size(w) / 4).cast("int") - 1), lambda r: F.slice(w, r * 4 + 1, F.lit(4)))
    shown = F.transform("w", lambda x, i: F.when(blank(i), "").otherwise(x))
    return rows.select("doc_id", F.explode(F.transform(F.array(shown), fours)).alias("rows"))


@_query("x7_clean_columns", f"WITH {view.BASE_SQL}{_ROWS4}, k4 AS (SELECT *, list_filter(range(LEAST(4, CASE WHEN h > 1 THEN 4 ELSE (SELECT len(w) FROM w4 WHERE w4.doc_id = r4.doc_id) END)), lambda k: {_FILLED(0)} AND NOT (h >= 4 AND c[k + 1] <> '' AND NOT {_FILLED(1)})) AS keep FROM r4) SELECT doc_id, list_aggregate(list_transform(range(h), lambda r: coalesce(list_aggregate(list_transform(keep, lambda k: c[r * 4 + k + 1]), 'string_agg', '|'), '')), 'string_agg', chr(10)) AS grid FROM k4")
def _(s, d):
    return _rows4(s, d).select("doc_id", F.array_join(F.transform(tables.clean_columns_column(F.col("rows")), lambda r: F.array_join(r, "|")), "\n").alias("grid"))


@_query("x10_header_like", f"WITH {view.BASE_SQL}{_ROWS4} SELECT doc_id, CAST(r AS INTEGER) AS r, len(list_filter(x, lambda v: v <> '')) >= 2 AND len(list_filter(x, lambda v: length(v) > 22 OR contains(v, '「') OR contains(v, '。'))) = 0 AS header_like FROM (SELECT doc_id, r, c[r * 4 + 1 : r * 4 + 4] AS x FROM (SELECT doc_id, c, unnest(range(h)) AS r FROM r4))")
def _(s, d):
    return _rows4(s, d).select("doc_id", F.posexplode("rows").alias("r", "row")).select("doc_id", "r", tables.header_like_column(F.col("row")).alias("header_like"))


# Three tables below one another; how far apart, how wide and where they begin depends on the document.
_THREE = (("0", "40", "0", "doc_id % 2"), ("40 + doc_id % 20", "100", "doc_id % 25", "0"), ("100 + doc_id * 7 % 20", "160", "doc_id * 3 % 25", "doc_id % 5 % 2"))
_NEAR = lambda gap, x, wide: f"({gap}) < 16 AND abs({x}) < 20 AND {wide}"


@_query("w10_merged_neighbours", f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_NEAR("doc_id % 20", "doc_id % 25", "doc_id % 2 = 0")} AS one, CASE WHEN {_NEAR("doc_id % 20", "doc_id % 25", "doc_id % 2 = 0")} THEN 0 ELSE doc_id % 25 END AS left_edge FROM documents WHERE doc_id IS NOT NULL),
u AS (SELECT doc_id, text, length(text) // 3 AS third, one, {_NEAR("doc_id * 7 % 20", "left_edge - doc_id * 3 % 25", "doc_id % 5 % 2 = 0")} AS two FROM t)
SELECT doc_id, CAST(3 - one::INT - two::INT AS INTEGER) AS n, CASE WHEN one AND two THEN '0-160' WHEN one THEN '0-100 ' || (100 + doc_id * 7 % 20) || '-160' WHEN two THEN '0-40 ' || (40 + doc_id % 20) || '-160' ELSE '0-40 ' || (40 + doc_id % 20) || '-100 ' || (100 + doc_id * 7 % 20) || '-160' END AS ends,
  'y' || CASE WHEN doc_id % 2 = 1 THEN '|y' ELSE '' END || '|' || substr(text, 1, third) || CASE WHEN one THEN chr(1) ELSE chr(2) END || 'y|' || substr(text, third + 1, third) || CASE WHEN two THEN chr(1) ELSE chr(2) END
    || 'y' || CASE WHEN doc_id % 5 % 2 = 1 THEN '|y' ELSE '' END || '|' || substr(text, 2 * third + 1) AS texts FROM u""")
def _(s, d):
    """A third of each text in each table: which are merged, and in which order their rows stand."""
    third = lambda n: F.expr(f"substring(text, {n} * floor(length(text) / 3) + 1, " + ("length(text))" if n == 2 else "floor(length(text) / 3))"))
    row = lambda n, wide: F.concat(F.array_repeat(F.lit("y"), F.expr(f"cast(1 + {wide} as int)")), F.array(third(n)))
    table = lambda n, top, low, x, wide: F.struct(*[F.expr(f"cast({v} as double)").alias(c) for c, v in (("y0", top), ("x0", x), ("y1", low))], F.lit(300.0).alias("x1"), F.array(row(n, wide)).alias("rows"))
    merged = tables.merge_neighbours(F.array(*[table(n, *t) for n, t in reversed(list(enumerate(_THREE)))]))
    rows = _docs(s, d).where("doc_id is not null").withColumn("text", F.coalesce("text", F.lit(""))).select("doc_id", merged.alias("m"))
    texts = F.array_join(F.transform("m", lambda t: F.array_join(F.transform(t["rows"], lambda r: F.array_join(r, "|")), "\1")), "\2")
    return rows.select("doc_id", F.size("m").alias("n"), texts.alias("texts"), F.array_join(F.transform("m", lambda t: F.concat(t["y0"].cast("long").cast("string"), F.lit("-"), t["y1"].cast("long").cast("string"))), " ").alias("ends"))


_LEVELS = " ".join(
    f"WHEN vendor = '{v}' THEN CASE WHEN size >= {c.title_size} AND NOT contains(text, '。') AND length(text) < 60 THEN 2 WHEN bold AND length(text) < 55 AND NOT contains(text, '。') AND NOT regexp_matches(text, '(しま|できま|されま|につい|を行|とな)$') "
    f"AND NOT regexp_matches(text, '^[1-9][0-9]?[^0-9.\\-]') THEN CASE {' '.join(f'WHEN size >= {least} THEN {level}' for least, level in c.tiers)} END END" for v, c in LAYOUTS.items()
)


@_query("x11_heading_level", _LAY + f"SELECT vendor, page, block, CAST(coalesce(CASE {_LEVELS} END, 0) AS INTEGER) AS level FROM layout_lines")
def _(s, d):
    level = assemble.heading_level(F.col("text"), F.col("size"), F.col("bold"), F.col("vendor"))
    return _lines(s, d).select("vendor", "page", "block", F.coalesce(level, F.lit(0)).alias("level"))


#: Parts before and after, as kind and text in turn; "#" stands for the document's number.
_POSTPROCESSED = (
    (("p", "1"), ("p", "開く #"), ("p", "2"), ("img", "![x](y)"), ("p", "●項目 #")),
    (("p", "1. 開く #"), ("p", "2."), ("img", "![x](y)"), ("p", "- 項目 #")),
    (("p", "■題 #"), ("p", "→ → 参照"), ("p", "a • b # • c d e")),
    (("p", "**題 #**"), ("p", "→ 参照"), ("p", "- a"), ("p", "- b #"), ("p", "- c d e")),
    (("p", "文章が途中で切れている場"), ("p", "合の例 #"), ("h", "## x  y")),
    (("p", "文章が途中で切れている場合の例 #"), ("h", "## x y")),
)
_REPAIRED = (
    (("h", "## 保存 #"), ("p", "x"), ("h", "## 保存 #"), ("p", "を押します")),
    (("h", "## 保存 #"), ("p", "x"), ("p", "保存 #を押します")),
    (("p", "開く #(→ 参照"), ("h", "## 先) 2. 次の手順")),
    (("p", "開く #(→ 参照先)"), ("p", "2. 次の手順")),
    (("h", "## 3 開く("), ("p", ")を押す #"), ("h", "## 終わります")),
    (("p", "3. 開く"), ("p", "を押す #"), ("p", "終わります")),
    (("p", "開きます。2ファイル # を選びます。3つあります。"), ("h", "## a"), ("h", "## a")),
    (("p", "開きます。"), ("p", "2. ファイル # を選びます。3つあります。"), ("h", "## a")),
)
_AS_TEXT = lambda parts: "~".join(f"{k}={t}" for k, t in parts)


def _cases_sql(cases) -> str:
    # Heading marks are no places for the number.
    after = ", ".join("'" + _AS_TEXT(c).replace("##", "@@") + "'" for c in cases[1::2])
    own = "list_aggregate(list_transform(list_filter(string_split(text, chr(10)), lambda x: x <> ''), lambda x: 'p=§ ' || x || '~'), 'string_agg', '')"
    return f"WITH {view.BASE_SQL} SELECT doc_id, coalesce({own}, '') || replace(replace([{after}][doc_id % {len(cases) // 2} + 1], '#', CAST(doc_id AS VARCHAR)), '@@', '##') AS parts FROM layout_base"


def _case_rows(s, d, cases, run) -> DataFrame:
    """The lines of every document as paragraphs, then one of the cases with its number, and what becomes of them."""
    number = F.col("doc_id").cast("string")
    part = lambda k, t: F.struct(F.lit(k).alias("kind"), F.replace(F.lit(t.replace("##", "@@")), F.lit("#"), number).alias("text"))
    plain = lambda p: F.struct(p["kind"].alias("kind"), F.replace(p["text"], F.lit("@@"), F.lit("##")).alias("text"))
    choices = F.array(*[F.transform(F.array(*[part(*p) for p in c]), plain) for c in cases[::2]])
    own = F.transform(F.filter(F.split("text", "\n"), lambda x: x != ""), lambda x: F.struct(F.lit("p").alias("kind"), F.concat(F.lit("§ "), x).alias("text")))
    rows = view._based(_docs(s, d)).select("doc_id", "vendor", F.concat(own, choices[F.pmod("doc_id", F.lit(len(cases) // 2)).cast("int")]).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["kind"], F.lit("="), p["text"])), "~")
    return assemble.rewritten_parts(rows, run).select("doc_id", text.alias("parts"))


@_query("x13_postprocess", _cases_sql(_POSTPROCESSED))
def _(s, d):
    return _case_rows(s, d, _POSTPROCESSED, assemble.postprocess)


@_query("x14_repair_structure", _cases_sql(_REPAIRED))
def _(s, d):
    return _case_rows(s, d, _REPAIRED, lambda _, parts: assemble.repair_structure(parts))


# A section of two pages for each document: a table at the foot of one, another at the head of the next, or further down.
_W11 = "FROM documents WHERE doc_id IS NOT NULL"
_FLAT = "trim('value ' || doc_id || ' ' || replace(regexp_replace(coalesce(text, ''), '[ \\n]+', ' ', 'g'), '|', chr(92) || '|'), ' ')"


@_query("w11_continued_tables", f"SELECT 's' || doc_id AS slug, CAST(CASE WHEN doc_id % 3 = 0 THEN 2 WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS INTEGER) AS n_tables, CAST(CASE WHEN doc_id % 3 = 0 THEN 2 WHEN doc_id % 5 = 0 THEN 1 ELSE 1 END AS INTEGER) AS n_headers, 2 AS n_rows, 'a|' || {_FLAT} || ' that is long enough~b|' || {_FLAT} || ' that is long enough' AS texts {_W11}")
def _(s, d):
    """On the next page doc_id % 3 = 0: too far down, so a table of its own that borrows the header; % 5 = 0: of a header of its own."""
    docs = _docs(s, d).where("doc_id is not null").select("doc_id", "text", F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("slug"), (F.col("doc_id") * 2 + 1).cast("int").alias("page"))
    found = docs.select(F.lit("beta").alias("vendor"), F.col("doc_id").cast("int").alias("ord"), "slug", F.lit("1-1").alias("num"), F.lit("T").alias("title"), F.lit("setup").alias("cat"), "page", (F.col("page") + 1).alias("page_end"))
    value = F.concat(F.lit("value "), F.col("doc_id").cast("string"), F.lit(" "), F.coalesce("text", F.lit("")), F.lit(" that is long enough"))
    rows = lambda *r: F.array(*[F.array(*[x if not isinstance(x, str) else F.lit(x) for x in own]) for own in r])
    again = (F.col("doc_id") % 2 == 0) & (F.col("doc_id") % 3 != 0)
    second = F.when((F.col("doc_id") % 5 == 0) & (F.col("doc_id") % 3 != 0), rows(("other", "kind", "note"), ("b", value, "x"))).when(again, rows(("name", "meaning", "note"), ("b", value, "x"))).otherwise(rows(("b", value, "x")))
    top = F.when(F.col("doc_id") % 3 == 0, 300.0).otherwise(60.0)
    one = lambda page, y0, y1, own: F.struct(page.cast("int").alias("page"), F.lit(1).alias("number"), F.lit("table").alias("kind"), F.lit(50.0).alias("x0"), y0.alias("y0"), F.lit(400.0).alias("x1"), y1.alias("y1"), own.alias("rows"))
    both = F.array(one(F.col("page"), F.lit(600.0), F.lit(690.0), rows(("name", "meaning", "note"), ("a", value, "x"))), one(F.col("page") + 1, top, top + 50, second))
    boxes = docs.select(F.lit("beta").alias("vendor"), F.explode(both).alias("t")).select("vendor", "t.*")
    none = s.createDataFrame([], "vendor string, page int, y double, x double, kind string, text string, size double, bold boolean")
    figures, subs = s.createDataFrame([], "vendor string, page int, fig int, x0 double, y0 double, x1 double, y1 double"), s.createDataFrame([], "vendor string, slug string, pos int, level int, title string")
    made = assemble.assemble(found, none, subs, boxes, figures)
    count = lambda x: F.regexp_count("text", F.lit(x)).cast("int")
    return made.select("slug", count(r"\|---\|---\|---\|").alias("n_tables"), count(r"\| name \| meaning \| note \|").alias("n_headers"), count("that is long enough").alias("n_rows"), F.array_join(F.transform(F.regexp_extract_all("text", F.lit(r"\| ([ab] \| value .*? that is long enough) \| x \|"), F.lit(1)), lambda x: F.replace(x, F.lit(" | "), F.lit("|"))), "~").alias("texts"))


def _mapped(vendor: str) -> str:
    sql = "text || chr(CAST(61440 + doc_id % 256 AS INTEGER))"
    for glyph, name in glyph_map(vendor).items():
        sql = f"replace({sql}, chr({ord(glyph)}), '{name}')"
    return sql


@_query("j14_map_glyphs", f"WITH {view.BASE_SQL} SELECT doc_id, CASE vendor WHEN 'alpha' THEN {_mapped('alpha')} WHEN 'beta' THEN {_mapped('beta')} ELSE {_mapped('gamma')} END AS text FROM layout_base")
def _(s, d):
    glyph = F.expr("concat(text, decode(unhex(hex(61440 + doc_id % 256)), 'utf-16be'))")
    rows = view._based(_docs(s, d)).select("doc_id", "vendor", glyph.alias("text"))
    return rows.select("doc_id", layout.map_glyphs(F.col("text"), F.col("vendor")).alias("text"))


def _manual(s, d):
    docs = _docs(s, d)
    return manual.sections(docs), manual.items(docs), manual.sub_headings(docs), manual.tables(docs), manual.figures(docs)


@_query("x12_section_parts", f"WITH {manual.PARTS_SQL} SELECT vendor, slug, true AS started, CAST(n AS INTEGER) AS n, parts[n + 1].kind AS kind, parts[n + 1].text AS text FROM (SELECT *, unnest(range(len(parts))) AS n FROM made)")
def _(s, d):
    found = assemble.parts_of_sections(*_manual(s, d))
    return found.select("vendor", "slug", "started", F.posexplode("parts").alias("n", "part")).select("vendor", "slug", "started", "n", "part.kind", "part.text")


@_query("x15_manual_pages", f"WITH {manual.PARTS_SQL} {manual.MARKDOWN_SQL}")
def _(s, d):
    return assemble.assemble(*_manual(s, d)).select("vendor", "slug", "text")


@_query("x15_markdown")
def _(s, d):
    return _made(s, d)[1]


@_query("x16_catalog")
def _(s, d):
    return toc.catalog(*_made(s, d))


@_query("a8_outliers")
def _(s, d):
    # Both reasons are looked for in the catalog; without a table each would make all pages.
    return toc.outliers(materialize(toc.catalog(*_made(s, d)), "catalog"))
