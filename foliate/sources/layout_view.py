"""Tables of contents, spans, boxes and cells made from ``documents``: what a PDF parser would hand over.

Each document is a section of its vendor's manual, four pages long; its lines are text blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS_ON_A_PAGE = 45
PAGES = 4
BODY_HEIGHT = 585.0
COLUMNS = 3
CELL_WORDS = 8

_BASE = """
  doc_id, text, CAST(FLOOR(doc_id / 3) AS BIGINT) AS k, CASE doc_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS vendor
"""


def _based(documents: DataFrame) -> DataFrame:
    rows = documents.where("doc_id is not null and text is not null").selectExpr("doc_id", "text", "cast(floor(doc_id / 3) as bigint) as k", "case doc_id % 3 when 0 then 'alpha' when 1 then 'beta' else 'gamma' end as vendor")
    return rows.selectExpr("*", "cast(floor(k / 20) as int) + 1 as ch", "cast(k % 20 as int) as se", "cast(k * 4 + 1 as int) as page")


#: The entries that a section brings, as rows (when, position, level, title, page) of SQL that both engines read.
_ENTRIES = (
    ("se = 0 AND ch % 5 = 1", 0, "1", "'Part ' || CAST(ch AS VARCHAR(12))", "page"),
    ("se = 0 AND vendor = 'alpha'", 1, "2", "CAST(ch AS VARCHAR(12)) || ' Chapter ' || CAST(ch AS VARCHAR(12))", "page"),
    ("vendor = 'beta' AND k = 240", 1, "1", "'付録'", "page"),
    ("vendor = 'alpha' AND k % 90 = 89", 1, "2", "'付' || CAST(k % 90 - 88 AS VARCHAR(12)) || ' History'", "page"),
    ("vendor = 'alpha'", 2, "3", "CAST(ch AS VARCHAR(12)) || '.' || CAST(se + 1 AS VARCHAR(12)) || ' Section ' || CAST(doc_id AS VARCHAR(12))", "page + CASE WHEN se = 0 AND ch % 2 = 0 THEN 1 ELSE 0 END"),
    ("vendor = 'beta' AND k < 240", 2, "2", "CAST(ch AS VARCHAR(12)) || '-' || CAST(se + 1 AS VARCHAR(12)) || ' Section ' || CAST(doc_id AS VARCHAR(12))", "page"),
    ("vendor = 'beta' AND k >= 240", 2, "2", "CAST(k - 239 AS VARCHAR(12)) || CASE WHEN k % 40 = 7 THEN ' 改訂履歴' ELSE ' Appendix ' || CAST(doc_id AS VARCHAR(12)) END", "page"),
    ("vendor = 'gamma' AND k % 17 <> 16", 2, "2", "CAST(ch AS VARCHAR(12)) || '-' || CAST(se + 1 AS VARCHAR(12)) || ' Section ' || CAST(doc_id AS VARCHAR(12))", "page"),
    ("vendor = 'gamma' AND k % 17 = 16", 2, "2", "'A-' || CAST(CAST(FLOOR(k / 17) AS BIGINT) + 1 AS VARCHAR(12)) || ' Appendix ' || CAST(doc_id AS VARCHAR(12))", "page"),
    ("true", 3, "4", "'Topic ' || CAST(doc_id AS VARCHAR(12))", "page + 1"),
    ("k % 3 = 0", 4, "5", "'Detail of topic ' || CAST(doc_id AS VARCHAR(12))", "page + 2"),
    ("true", 5, "4", "'More on ' || CAST(doc_id AS VARCHAR(12))", "page + 4"),
)

TOC_SQL = "\nUNION ALL\n".join(
    f"SELECT vendor, CAST(k * 10 + {i} AS INTEGER) AS pos, CAST({level} AS INTEGER) AS level, {title} AS title, CAST({page} AS INTEGER) AS page FROM layout_base WHERE {when}" for when, i, level, title, page in _ENTRIES
)
BASE_SQL = f"layout_base AS (SELECT *, CAST(FLOOR(k / 20) AS INTEGER) + 1 AS ch, CAST(k % 20 AS INTEGER) AS se, CAST(k * 4 + 1 AS INTEGER) AS page FROM (SELECT {_BASE} FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL))"


def toc(documents: DataFrame) -> DataFrame:
    """``(vendor, pos, level, title, page)``."""
    entry = lambda when, i, level, title, page: F.when(F.expr(when), F.struct(F.expr(f"cast(k * 10 + {i} as int)").alias("pos"), F.expr(f"cast({level} as int)").alias("level"), F.expr(title).alias("title"), F.expr(f"cast({page} as int)").alias("page")))
    found = F.filter(F.array(*[entry(*e) for e in _ENTRIES]), lambda e: e.isNotNull())
    return _based(documents).select("vendor", F.explode(found).alias("e")).select("vendor", "e.*")


def page_counts(documents: DataFrame) -> DataFrame:
    return _based(documents).groupBy("vendor").agg((F.max("page") + 4).alias("pages"))


def spans(documents: DataFrame) -> DataFrame:
    """A block for each line of text, a span for each of its halves; some lines in the margin or upright.

    A section's first blocks are its title, as the table of contents has it (but for appendices), and a heading, its last one begins with another heading.
    Its lines fill four pages; the more there are, the closer they stand.
    """
    numbered = lambda before, after="": F.array(F.concat(F.lit(before), F.col("doc_id").cast("string"), F.lit(after)))
    title = F.concat(F.col("ch").cast("string"), F.when(F.col("vendor") == "alpha", ".").otherwise("-"), (F.col("se") + 1).cast("string"), F.lit(" Section "), F.col("doc_id").cast("string"))
    lines = F.concat(F.array(title), numbered("Topic "), F.split("text", "\n"), numbered("More on ", " in short"))
    rows = _based(documents).withColumn("lines", lines).withColumn("per", F.greatest(F.lit(BLOCKS_ON_A_PAGE), F.ceil(F.size("lines") / PAGES)).cast("long"))
    rows = rows.select("vendor", "doc_id", "page", "per", F.posexplode("lines").alias("n", "line"))
    half = F.floor(F.length("line") / 2).cast("int")
    parts = F.array(F.struct(F.lit(0).alias("span"), F.substring(F.col("line"), F.lit(1), half).alias("text")), F.struct(F.lit(1).alias("span"), F.substring(F.col("line"), half + 1, F.length("line")).alias("text")))
    rows = rows.select("*", F.explode(parts).alias("p"), (F.lit(BODY_HEIGHT) / F.col("per")).alias("step"))
    y = F.lit(90.0) + F.pmod(F.col("n"), F.col("per")) * F.col("step")
    x = F.when(F.pmod("doc_id", F.lit(11)) == 3, 5.0).otherwise(60.0) + F.col("p.span") * 150
    return rows.select(
        "vendor", (F.col("page") + F.floor(F.col("n") / F.col("per"))).cast("int").alias("page"), F.col("n").cast("long").alias("block"),
        F.lit(0).alias("line"), F.col("p.span").alias("span"), x.alias("x0"), y.alias("y0"), (x + 140).alias("x1"), (y + F.least(F.lit(10.0), F.col("step"))).alias("y1"),
        F.when(F.pmod("n", F.lit(37)) == 36, 0.0).otherwise(1.0).alias("dir_x"), F.col("p.text").alias("text"),
        F.when(F.col("n") == 0, 18.0).when(F.pmod("n", F.lit(9)) == 8, 13.5).otherwise(10.0).alias("size"), (F.pmod("n", F.lit(9)) == 8).alias("bold"),
    )


#: The boxes of a section's first page, as rows (when, kind, x0, y0, x1, y1, items) of SQL that both engines read.
_BOXES = (
    ("doc_id % 4 = 0", "raster", "100", "200", "180 + doc_id % 7 * 20", "230 + doc_id % 5 * 20", "0"),
    ("doc_id % 8 = 0", "vector", "120", "220", "250 + doc_id % 6 * 20", "270 + doc_id % 9 * 10", "2"),
    ("doc_id % 4 = 1", "vector", "100", "200", "300", "300", "doc_id % 12"),
    ("doc_id % 6 = 2", "vector", "60", "190", "80", "210", "9"),
    ("n_cells > 1", "table", "60", "400", "360", "CASE WHEN split_table THEN 510 ELSE 460 END", "0"),
)
_OTHER_BLANKS = r"\t\n\r\f\x0B"
_WORD = rf"[^ {_OTHER_BLANKS}]+"

BOXES_SQL = "\nUNION ALL\n".join(
    f"SELECT vendor, doc_id, page, '{kind}' AS kind, CAST({x0} AS DOUBLE) AS x0, CAST({y0} AS DOUBLE) AS y0, CAST({x1} AS DOUBLE) AS x1, CAST({y1} AS DOUBLE) AS y1, CAST({n} AS INTEGER) AS n_items FROM layout_words WHERE {when}" for when, kind, x0, y0, x1, y1, n in _BOXES
)
#: Common table expressions: the words of each text, the lines of its pages put together, its boxes.
LINES_SQL = f"""layout_words AS (SELECT *, doc_id % 10 = 0 AND n_cells >= 12 AS split_table FROM (SELECT *, len(cells) AS n_cells FROM (
  SELECT *, list_transform(range(CAST(ceil(len(words) / {CELL_WORDS}) AS BIGINT)), lambda i: list_aggregate(words[i * {CELL_WORDS} + 1 : i * {CELL_WORDS} + {CELL_WORDS}], 'string_agg', ' ')) AS cells
  FROM (SELECT *, regexp_extract_all(text, '{_WORD}') AS words FROM layout_base)))),
layout_lines AS (
  SELECT vendor, doc_id, CAST(page + n // per AS INTEGER) AS page, n AS block, CAST(0 AS INTEGER) AS line, CASE WHEN doc_id % 11 = 3 THEN 5.0 ELSE 60.0 END::DOUBLE AS x0, 90.0::DOUBLE + (n % per) * step AS y0,
    CASE WHEN doc_id % 11 = 3 THEN 295.0 ELSE 350.0 END::DOUBLE AS x1, 90.0::DOUBLE + (n % per) * step + least(10.0::DOUBLE, step) AS y1, CASE WHEN n % 37 = 36 THEN 0.0 ELSE 1.0 END::DOUBLE AS dir_x, x AS text,
    CASE WHEN NOT regexp_matches(x, '[^ \\t\\r\\f\\x0B]') THEN 0.0 WHEN n = 0 THEN 18.0 WHEN n % 9 = 8 THEN 13.5 ELSE 10.0 END::DOUBLE AS size, n % 9 = 8 AND regexp_matches(x, '[^ \\t\\r\\f\\x0B]') AS bold
  FROM (SELECT *, {BODY_HEIGHT}::DOUBLE / per AS step FROM (
    SELECT vendor, doc_id, page, unnest(l) AS x, unnest(range(len(l))) AS n, greatest({BLOCKS_ON_A_PAGE}, CAST(ceil(len(l) / {PAGES}) AS BIGINT)) AS per
    FROM (SELECT *, list_concat(list_concat([CAST(ch AS VARCHAR) || CASE vendor WHEN 'alpha' THEN '.' ELSE '-' END || CAST(se + 1 AS VARCHAR) || ' Section ' || CAST(doc_id AS VARCHAR), 'Topic ' || CAST(doc_id AS VARCHAR)], string_split(text, chr(10))), ['More on ' || CAST(doc_id AS VARCHAR) || ' in short']) AS l FROM layout_base)))
),
layout_boxes AS ({BOXES_SQL})"""


def _fitted(documents: DataFrame) -> DataFrame:
    """The base rows with ``cells``, runs of words, ``n_cells`` and ``split_table``: whether they fill two tables."""
    # Two passes over the text, however often the column is read: no expression looks up single words of it.
    plain = F.regexp_replace("text", rf"[ {_OTHER_BLANKS}]{{2,}}|[{_OTHER_BLANKS}]", " ")
    found = F.regexp_extract_all(plain, F.lit(f"[^ ]+(?: [^ ]+){{0,{CELL_WORDS - 1}}}"), F.lit(0))
    rows = _based(documents).withColumn("cells", found).withColumn("n_cells", F.size("cells"))
    return rows.withColumn("split_table", (F.col("doc_id") % 10 == 0) & (F.col("n_cells") >= 12))


def _worded(documents: DataFrame) -> DataFrame:
    """``_fitted`` of the texts that have a word. A filter by ``n_cells`` would stand before the cells' projection and make them once more."""
    return _fitted(documents.where(F.rlike("text", F.lit(_WORD))))


def boxes(documents: DataFrame) -> DataFrame:
    """Rasters, drawings and tables of each section's first page, some too small to be figures."""
    box = lambda when, kind, *v: F.when(F.expr(when), F.struct(F.lit(kind).alias("kind"), *[F.expr(f"cast({x} as double)").alias(c) for c, x in zip(("x0", "y0", "x1", "y1"), v, strict=False)], F.expr(f"cast({v[4]} as int)").alias("n_items")))
    found = F.filter(F.array(*[box(*b) for b in _BOXES]), lambda b: b.isNotNull())
    return _fitted(documents).select("vendor", "page", F.posexplode(found).alias("box", "b")).select("vendor", "page", "box", "b.*")


def cells(documents: DataFrame) -> DataFrame:
    """Tables of three columns that hold all words of the document, some to a cell; merged cells have no rectangle.

    Some texts fill two tables, one right below the other, half of the rows each.
    """
    rows = _worded(documents).withColumn("height", F.ceil(F.col("n_cells") / COLUMNS).cast("int"))
    rows = rows.withColumn("first", F.when(F.col("split_table"), F.ceil(F.col("height") / 2).cast("int")).otherwise(F.col("height")))
    padded = F.concat("cells", F.array_repeat(F.lit(""), F.col("height") * COLUMNS - F.col("n_cells")))
    grid = rows.select("vendor", "page", "doc_id", "height", "first", F.posexplode(padded).alias("i", "word")).withColumns({"row": F.floor(F.col("i") / COLUMNS).cast("int"), "c": (F.col("i") % COLUMNS).cast("int")})
    second = F.col("row") >= F.col("first")
    r = F.when(second, F.col("row") - F.col("first")).otherwise(F.col("row"))
    step = F.when(second, F.lit(40.0) / (F.col("height") - F.col("first"))).otherwise(F.lit(60.0) / F.col("first"))
    spans_two = F.col("doc_id") % 15 == 0
    merged = spans_two & ~second & (F.col("row") == 2) & (F.col("c") == 0)
    tall = F.when(spans_two & ~second & (F.col("row") == 1) & (F.col("c") == 0) & (F.col("first") > 2), 2).otherwise(1)
    top = F.when(second, 470.0).otherwise(400.0) + r * step
    left = 60.0 + F.col("c") * 100.0
    rect = lambda v: F.when(~merged, v)
    text = F.when(merged, "").otherwise(F.col("word"))
    return grid.select("vendor", "page", F.when(second, 2).otherwise(1).alias("table"), r.cast("int").alias("r"), "c", text.alias("text"), rect(left).alias("x0"), rect(top).alias("y0"), rect(left + 100).alias("x1"), rect(top + step * tall).alias("y1"))


# ---- tables that a parser has read with gaps
DAMAGED_STEP, DAMAGED_ROWS, DAMAGED_APART = 12.0, 150, 100.0
#: A cell that is missing, by its row in the table and its column; and whether its text goes on in the row below.
_MISSING, _GOES_ON = "c = doc_id % 3 AND r % 5 IN (1, 2)", "doc_id % 4 = 1 AND c = doc_id % 3 AND r % 5 = 1"


def _damaged(documents: DataFrame) -> DataFrame:
    """All words of each document in tables of three columns and at most 150 rows, one below the other on the section's first page; without the missing cells' rectangles."""
    padded = F.concat("cells", F.array_repeat(F.lit("-"), F.pmod(-F.col("n_cells"), F.lit(COLUMNS)).cast("int")))
    rows = _worded(documents).select("vendor", "page", "doc_id", F.posexplode(padded).alias("i", "word")).withColumns({"row": F.floor(F.col("i") / COLUMNS).cast("int"), "c": (F.col("i") % COLUMNS).cast("int")})
    rows = rows.withColumns({"table": F.floor(F.col("row") / DAMAGED_ROWS).cast("int") + 1, "r": F.pmod("row", F.lit(DAMAGED_ROWS))})
    top = F.lit(DAMAGED_APART) + (F.col("table") - 1) * (DAMAGED_ROWS * DAMAGED_STEP + DAMAGED_APART) + F.col("r") * DAMAGED_STEP
    return rows.select("vendor", "page", "doc_id", "table", "r", "c", F.concat("word", F.when(F.expr(_GOES_ON), "、").otherwise("")).alias("text"), (60.0 + F.col("c") * 100.0).alias("x"), top.alias("y"), F.expr(_MISSING).alias("missing"))


def damaged_cells(documents: DataFrame) -> DataFrame:
    """The cells that a parser found: vendor, page, table, r, c, text, x0 to y1."""
    found = _damaged(documents).where("not missing")
    return found.select("vendor", "page", "table", "r", "c", "text", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 100).alias("x1"), (F.col("y") + DAMAGED_STEP).alias("y1"))


def damaged_lines(documents: DataFrame) -> DataFrame:
    """The texts of the missing cells, as loose lines where these would be."""
    found = _damaged(documents).where("missing")
    return found.select("vendor", "page", F.col("x").alias("x0"), (F.col("y") + 1).alias("y0"), (F.col("x") + 100).alias("x1"), (F.col("y") + DAMAGED_STEP - 1).alias("y1"), F.lit(1.0).alias("dir_x"), "text")


#: ``(vendor, page, number, r, cells)``: the rows of those tables, rebuilt. In a run of two missing cells whose text goes on, both have all of it.
DAMAGED_SQL = f"""damaged AS (
  SELECT *, CAST(row // {DAMAGED_ROWS} AS INTEGER) + 1 AS number, CAST(row % {DAMAGED_ROWS} AS INTEGER) AS r FROM (
    SELECT vendor, page, doc_id, i // {COLUMNS} AS row, i % {COLUMNS} AS c, word FROM (
      SELECT vendor, page, doc_id, unnest(l) AS word, unnest(range(len(l))) AS i FROM (
        SELECT *, list_concat(cells, list_transform(range(({COLUMNS} - n_cells % {COLUMNS}) % {COLUMNS}), lambda x: '-')) AS l FROM layout_words WHERE n_cells > 0)))),
rebuilt AS (
  SELECT a.*, CASE WHEN doc_id % 4 = 1 AND c = doc_id % 3 AND r % 5 = 1 THEN a.word || '、' || coalesce(below, '') WHEN doc_id % 4 = 1 AND c = doc_id % 3 AND r % 5 = 2 THEN above || '、' || a.word ELSE a.word END AS text
  FROM (SELECT *, lead(word) OVER w AS below, lag(word) OVER w AS above FROM damaged WINDOW w AS (PARTITION BY doc_id, number, c ORDER BY r)) a)"""


# ---- tables of every kind
#: By doc_id % 5: a grid, a callout box, one column, a grid half empty with images in it, a wide grid mostly empty.
_KIND_STEP = 12.0


def kinds_cells(documents: DataFrame) -> DataFrame:
    """A table for each document, of a kind that depends on its number, with all of its words but for callout boxes, whose text is in ``kinds_lines``."""
    rows = _worded(documents).withColumn("kind", F.pmod("doc_id", F.lit(5)))
    own = F.col("cells")
    tail = lambda n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.lit("-"))
    padded = F.concat(own, F.array_repeat(F.lit("-"), F.pmod(-F.col("n_cells"), F.lit(COLUMNS)).cast("int")))
    # Bound once for all rows: an expression within a lambda is evaluated for each of them.
    triples = F.get(F.transform(F.array(padded), lambda own: F.transform(F.sequence(F.lit(0), F.ceil(F.col("n_cells") / COLUMNS).cast("int") - 1), lambda r: F.slice(own, r * COLUMNS + 1, F.lit(COLUMNS)))), F.lit(0))
    at_ends = lambda i: F.when((i == 0) | (i == F.col("n_cells") - 1), "-").otherwise("")
    halves = F.transform(own, lambda x, i: F.array(x, at_ends(i)))
    blank = F.array_repeat(F.lit(""), 11)
    wide = F.concat(F.array(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.concat(F.lit("h"), i.cast("string")))), F.transform(own, lambda x: F.concat(F.array(x), blank)), F.array(tail(12)))
    grid = F.when(F.col("kind") == 0, triples).when(F.col("kind") == 1, F.array(F.array(F.lit("注 意"), F.lit("")))).when(F.col("kind") == 2, F.transform(own, lambda x: F.array(x))).when(F.col("kind") == 3, halves).otherwise(wide)
    cells_ = rows.select("vendor", "page", "kind", "n_cells", F.posexplode(grid).alias("r", "row")).select("*", F.posexplode("row").alias("c", "text"))
    height = F.when(F.col("kind") == 1, F.col("n_cells") * _KIND_STEP).otherwise(_KIND_STEP)
    x, y = 60.0 + F.col("c") * 40.0, 100.0 + F.col("r") * _KIND_STEP
    return cells_.select("vendor", "page", F.lit(1).alias("table"), "r", "c", "text", x.alias("x0"), y.alias("y0"), (x + 40).alias("x1"), (y + height).alias("y1"))


def kinds_lines(documents: DataFrame) -> DataFrame:
    """The texts in callout boxes, the label among them."""
    rows = _worded(documents.where("doc_id % 5 = 1")).select("vendor", "page", F.posexplode("cells").alias("i", "text"))
    y = 100.0 + F.col("i") * _KIND_STEP
    box = [F.lit(62.0).alias("x0"), (y + 1).alias("y0"), F.lit(110.0).alias("x1"), (y + 11).alias("y1"), F.lit(1.0).alias("dir_x")]
    label = rows.where("i = 0").select("vendor", "page", *[c for c in box if c is not box[0]], F.lit(61.0).alias("x0"), F.lit("注 意").alias("text"))
    return rows.select("vendor", "page", *box, "text").unionByName(label)


def kinds_images(documents: DataFrame) -> DataFrame:
    """Two images in every table that is half empty, one in each wide one."""
    rows = _based(documents.where("doc_id % 5 >= 3").where(F.rlike("text", F.lit(_WORD)))).select("vendor", "page", F.explode(F.when(F.expr("doc_id % 5 = 3"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("n"))
    return rows.select("vendor", "page", F.lit("raster").alias("kind"), F.lit(62.0).alias("x0"), F.lit(101.0).alias("y0"), F.lit(80.0).alias("x1"), (110.0 + F.col("n")).alias("y1"))


#: ``(vendor, page, kind, n_rows, n_columns, grid)``.
KINDS_SQL = """SELECT vendor, page, kind, CAST(len(own) AS INTEGER) AS n_rows, CAST(len(own[1]) AS INTEGER) AS n_columns, list_aggregate(list_transform(own, lambda r: list_aggregate(r, 'string_agg', '|')), 'string_agg', chr(10)) AS grid FROM (
  SELECT vendor, page, CASE WHEN doc_id % 5 = 3 AND n_cells > 1 AND n_cells * 100 < 55 * 2 * (n_cells - 1) OR doc_id % 5 = 4 AND (n_cells + 12) * 10 < 3 * 12 * (n_cells + 1) THEN 'figure' ELSE 'table' END AS kind,
    CASE doc_id % 5 WHEN 0 THEN list_transform(range((n_cells + 2) // 3), lambda r: list_concat(cells, ['-', '-'])[r * 3 + 1 : r * 3 + 3])
      WHEN 1 THEN [['__CALLOUT__注意', list_reduce(cells, lambda a, b: a || CASE WHEN regexp_matches(a, '[0-9A-Za-z)\\]%.,:;]$') AND regexp_matches(b, '^[0-9A-Za-z(\\[]') THEN ' ' ELSE '' END || b)]]
      WHEN 3 THEN list_transform(range(n_cells), lambda i: [cells[i + 1], CASE WHEN i = 0 OR i = n_cells - 1 THEN '-' ELSE '' END])
      WHEN 4 THEN list_concat(list_concat([list_transform(range(12), lambda i: 'h' || i)], list_transform(cells, lambda x: list_concat([x], list_transform(range(11), lambda i: '')))), [list_transform(range(12), lambda i: '-')]) END AS own
  FROM layout_words WHERE n_cells > 0 AND doc_id % 5 <> 2)"""
