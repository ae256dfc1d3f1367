"""A manual with a section for each document, made so that its Markdown is known: sections that share pages, figures, tables, headings.

Section k of a vendor begins in the middle of page k + 1, below the end of section k - 1, and ends on
page k + 2, above the title of section k + 1. Its lines are the document's, the last one stands on its last page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..layout_config import LAYOUTS

FIGURE, TABLE = "doc_id % 4 = 0", "doc_id % 5 = 0"


def _base(documents: DataFrame) -> DataFrame:
    rows = documents.where("doc_id is not null and text is not null").selectExpr("doc_id", "cast(floor(doc_id / 3) as int) as k", "case doc_id % 3 when 0 then 'alpha' when 1 then 'beta' else 'gamma' end as vendor", "split(text, '\\n') as lines")
    return rows.withColumns({"lines": F.filter("lines", lambda x: x != ""), "slug": F.concat(F.lit("s"), F.col("doc_id").cast("string")), "num": F.concat(F.lit("1-"), (F.col("k") + 1).cast("string")), "title": F.concat(F.lit("Section "), F.col("doc_id").cast("string")), "page": F.col("k") + 1})


def sections(documents: DataFrame) -> DataFrame:
    return _base(documents).select("vendor", F.col("k").alias("ord"), "slug", "num", "title", F.lit("setup").alias("cat"), "page", (F.col("page") + 1).alias("page_end"))


def sub_headings(documents: DataFrame) -> DataFrame:
    return _base(documents).select("vendor", "slug", F.lit(1).alias("pos"), F.lit(3).alias("level"), F.concat(F.lit("Topic "), F.col("doc_id").cast("string")).alias("title"))


def items(documents: DataFrame) -> DataFrame:
    """``(vendor, page, y, x, kind, text, size, bold)``."""
    last = F.size("lines") - 1
    item = lambda page, y, text, size: F.struct(page.alias("page"), y.cast("double").alias("y"), F.lit(50.0).alias("x"), text.alias("text"), F.lit(size).alias("size"))
    own = F.transform("lines", lambda x, i: item(F.when(i < last, F.col("page")).otherwise(F.col("page") + 1), F.when(i < last, F.lit(310) + i * 12).otherwise(100), x, 10.0))
    heads = F.array(item(F.col("page"), F.lit(300), F.concat_ws(" ", "num", "title"), 18.0), item(F.col("page"), F.lit(308), F.concat(F.lit("Topic "), F.col("doc_id").cast("string")), 10.0))
    return _base(documents).select("vendor", F.explode(F.concat(heads, own)).alias("i")).select("vendor", "i.page", "i.y", "i.x", F.lit("text").alias("kind"), "i.text", "i.size", F.lit(False).alias("bold"))


def figures(documents: DataFrame) -> DataFrame:
    return _base(documents).where(FIGURE).select("vendor", "page", F.lit(1).alias("fig"), F.lit(60.0).alias("x0"), F.lit(305.0).alias("y0"), F.lit(200.0).alias("x1"), F.lit(307.0).alias("y1"))


def tables(documents: DataFrame) -> DataFrame:
    value = F.concat(F.lit("value of "), F.col("doc_id").cast("string"), F.lit(" in words"))
    rows = F.array(F.array(F.lit("name"), F.lit("meaning")), F.array(F.lit("a"), value))
    return _base(documents).where(TABLE).select("vendor", (F.col("page") + 1).alias("page"), F.lit(1).alias("number"), F.lit("table").alias("kind"), F.lit(50.0).alias("x0"), F.lit(50.0).alias("y0"), F.lit(400.0).alias("x1"), F.lit(90.0).alias("y1"), rows.alias("rows"))


_GRID = "'| name | meaning |' || chr(10) || '|---|---|' || chr(10) || '| a | value of ' || {0} || ' in words |'"
#: ``manual`` with ``parts`` as kind and text. A vendor whose sections begin at the top of their first page has the end of the section before, too.
PARTS_SQL = f"""manual AS (
  SELECT *, 's' || doc_id AS slug, '1-' || (k + 1) AS num, 'Section ' || doc_id AS title, k + 1 AS page, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l
  FROM (SELECT doc_id, text, doc_id // 3 AS k, CASE doc_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS vendor FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
ends AS (
  SELECT *, list_concat(CASE WHEN {TABLE} THEN [{{'kind': 'table', 'text': {_GRID.format("doc_id")} || chr(10)}}] ELSE [] END, list_transform(l[len(l):], lambda x: {{'kind': 'p', 'text': x}})) AS tail FROM manual),
made AS (
  SELECT a.*, list_concat(list_concat(CASE WHEN a.vendor IN ({", ".join(f"'{v}'" for v, c in LAYOUTS.items() if c.starts_at_once) or "''"}) THEN coalesce(b.tail, []) ELSE [] END,
    CASE WHEN a.{FIGURE} THEN [{{'kind': 'img', 'text': '![図(元マニュアル p.' || a.page || ')](images/' || a.vendor || '/' || a.slug || '-01.webp)'}}] ELSE [] END),
    list_concat(list_concat([{{'kind': 'h', 'text': '### Topic ' || a.doc_id}}], list_transform(a.l[:len(a.l) - 1], lambda x: {{'kind': 'p', 'text': x}})), a.tail)) AS parts
  FROM ends a LEFT JOIN ends b ON b.vendor = a.vendor AND b.k = a.k - 1)"""
MARKDOWN_SQL = f"""SELECT vendor, slug, '---' || chr(10) || 'vendor: ' || vendor || chr(10) || 'vendor_label: "' || CASE {" ".join(f"WHEN vendor = '{v}' THEN '{c.label} ({c.company})'" for v, c in LAYOUTS.items())} END || '"' || chr(10) || 'id: "' || slug || '"' || chr(10) || 'num: "' || num || '"' || chr(10)
  || 'title: "' || title || '"' || chr(10) || 'category: setup' || chr(10) || 'source: "' || CASE {" ".join(f"WHEN vendor = '{v}' THEN '{c.manual}'" for v, c in LAYOUTS.items())} END || ' pp.' || page || '-' || (page + 1) || '"' || chr(10) || '---' || chr(10) || chr(10) || '# ' || num || ' ' || title || chr(10) || chr(10)
  || list_aggregate(list_transform(parts, lambda p: rtrim(p.text, chr(10))), 'string_agg', chr(10) || chr(10)) || chr(10) AS text FROM made"""
