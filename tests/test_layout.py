import pytest
from pyspark.sql import functions as F

from foliate.layout_config import LAYOUTS, glyph_map
from foliate.operators import assemble, layout, tables, toc
from foliate.operators.layout import Rect
from foliate.operators.tables import Cell

SPANS = "vendor string, page int, block long, line int, span int, x0 double, y0 double, x1 double, y1 double, dir_x double, text string, size double, bold boolean"

TABLES = "vendor string, page int, number int, kind string, x0 double, y0 double, x1 double, y1 double, rows array<array<string>>"
FIGURES = "vendor string, page int, fig int, x0 double, y0 double, x1 double, y1 double"


def span(text, block=1, line=0, n=0, x=60.0, y=100.0, w=100.0, dir_x=1.0, size=10.0, bold=False, page=1, vendor="alpha"):
    return (vendor, page, block, line, n, x, y, x + w, y + 10, dir_x, text, size, bold)


def test_items_of_a_page(spark):
    rows = [
        span("first ", n=0), span("half", n=1, x=160.0), span("second", line=1, y=112.0), span("margin", block=2, y=10.0), span("upright", block=3, dir_x=0.0),
        span("   ", block=4), span("in a table", block=5, y=300.0), span("12", block=6, y=500.0), span("Big", block=7, y=520.0, size=14.0, bold=True), span("label", block=8, y=540.0), span("value", block=8, line=1, x=300.0, y=541.0),
    ]
    tables_, none = spark.createDataFrame([("alpha", 1, 1, "table", 50.0, 298.0, 300.0, 320.0, [["x"]]), ("alpha", 1, 1, "figure", 50.0, 95.0, 300.0, 120.0, None)], TABLES), spark.createDataFrame([], FIGURES)
    found = layout.reading_order(layout.page_items(spark.createDataFrame(rows, SPANS), tables_, none, layout.config_table(spark))).orderBy("seq").collect()
    assert [(r["text"], r["size"], r["bold"], r["y"]) for r in found] == [("first half second", 10.0, False, 100.0), ("Big", 14.0, True, 520.0), ("label：value", 10.0, False, 540.0)]


@pytest.mark.parametrize("parts,want", [(["a", "b"], "a b"), (["日本", "語"], "日本語"), (["a,", "(b"], "a, (b"), (["a", "語"], "a語"), ([], ""), (["", "x "], "x")])
def test_join_lines(spark, parts, want):
    assert spark.createDataFrame([(parts,)], "p array<string>").select(layout.join_lines(F.col("p"))).first()[0] == want
    assert tables.joined(parts) == want


def test_figures():
    body, page = Rect(0, 0, 500, 700), Rect(0, 0, 600, 800)
    of = lambda rasters=(), vectors=(), boxes=(): layout.figures_of(list(rasters), list(vectors), list(boxes), body, page)
    assert of([Rect(0, 0, 99, 100), Rect(0, 0, 100, 39)]) == []
    assert of([Rect(0, 0, 100, 40)]) == [Rect(0, 0, 100, 40)]
    assert of([Rect(0, 0, 100, 100)], boxes=[Rect(0, 0, 100, 61)]) == []
    assert of(vectors=[(Rect(0, 0, 200, 100), 5)]) == [] and len(of(vectors=[(Rect(0, 0, 200, 100), 6)])) == 1
    assert of([Rect(10, 10, 120, 60)], [(Rect(0, 0, 200, 100), 0)]) == [Rect(0, 0, 200, 100)]
    assert of([Rect(450, 0, 600, 100)]) == [] and of([Rect(0, 0, 599, 799)]) == []
    # The third touches the second, not what the first has become: greedy, not transitive.
    a, b, c = Rect(0, 0, 100, 100), Rect(0, 150, 100, 250), Rect(0, 60, 100, 190)
    assert of([a, b, c]) == [Rect(0, 0, 100, 190), Rect(0, 150, 100, 250)] or len(of([a, b, c])) == 1


def grid(rows, merged=(), step=20.0):
    return [Cell(r, c, t, None if (r, c) in merged else Rect(100 * c, step * r, 100 * c + 100, step * r + step)) for r, row in enumerate(rows) for c, t in enumerate(row)]


def test_merged_cells_take_the_value_above():
    cells = grid([["h", "k"], ["a", "1"], ["", "2"]], merged={(2, 0)})
    cells[2].rect = Rect(0, 20, 100, 60)
    assert tables.table_rows(cells, [], {}) == [["h", "k"], ["a", "1"], ["a", "2"]]


def test_uncovered_parts_take_the_loose_lines():
    cells = [Cell(0, 0, "h", Rect(0, 0, 100, 20)), Cell(0, 1, "k", Rect(100, 0, 200, 20)), Cell(1, 0, "a", Rect(0, 20, 100, 40)), Cell(2, 0, "b", Rect(0, 40, 100, 60))]
    lines = [(Rect(110, 24, 150, 34), "one"), (Rect(110, 44, 150, 54), "two")]
    assert tables.table_rows(cells, lines, {}) == [["h", "k"], ["a", "one"], ["b", "two"]]
    lines[1] = (Rect(110, 44, 150, 54), "を含む")
    assert tables.table_rows(cells, lines, {}) == [["h", "k"], ["a", "oneを含む"], ["b", "oneを含む"]]


@pytest.mark.parametrize(
    "rows,want",
    [
        ([["name", "value of it"], ["a|b", "1"]], "| name | value of it |\n|---|---|\n| a\\|b | 1 |\n"),
        ([["x", "y"]], None),
        ([["w" * 151, "a"]], None),
        ([["注意", "気をつけてください。必ず。"]], "**注意**: 気をつけてください。必ず。"),
        ([["long header here", "", ""], ["", "x", ""], ["", "", "y"]], "long header here\n\nx\n\ny"),
        ([["heading text", "second one"], ["", ""], ["日 本", "「 」 _"]], "| heading text | second one |\n|---|---|\n| 日本 | 「_」 |\n"),
    ],
)
def test_markdown_of_rows(rows, want):
    assert tables.rows_to_markdown(rows) == want


def test_clean_columns():
    assert tables.clean_columns([["a", "", "c"], ["1", "", ""], ["2"], ["3", "", ""]]) == [["a"], ["1"], ["2"], ["3"]]
    assert tables.clean_columns([["a", "", "c"], ["1"]]) == [["a", "c"], ["1", ""]]


def test_header_like(spark):
    for row in (["a", "b"], ["a", ""], ["a" * 23, "b"], ["「a", "b"], ["a。", "b"]):
        assert spark.createDataFrame([(row,)], "r array<string>").select(tables.header_like_column(F.col("r"))).first()[0] == tables.header_like(row)


def test_neighbouring_tables_merge(spark):
    t = lambda y0, y1, x0=0.0, n=2: (float(y0), float(x0), float(y1), 200.0, [["c"] * n])
    cases = [([t(0, 10), t(25, 30)], 1), ([t(0, 10), t(26, 30)], 2), ([t(0, 10), t(15, 30, x0=20)], 2), ([t(0, 10), t(15, 30, n=3)], 2), ([t(15, 30), t(0, 10), t(40, 50)], 1), ([], 0)]
    rows = spark.createDataFrame([(i, own, n) for i, (own, n) in enumerate(cases)], "i int, own array<struct<y0: double, x0: double, y1: double, x1: double, rows: array<array<string>>>>, n int")
    for r in rows.withColumn("merged", tables.merge_neighbours(F.col("own"))).collect():
        assert len(r["merged"]) == r["n"]
        assert sum(len(m["rows"]) for m in r["merged"]) == len(cases[r["i"]][0])
    assert {(m["y0"], m["y1"]) for r in rows.where("i = 4").select(tables.merge_neighbours(F.col("own")).alias("m")).collect() for m in r["m"]} == {(0.0, 50.0)}


def test_clean_columns_as_a_column(spark):
    for rows in ([["a", "", "c"], ["1", "", ""], ["2"], ["3", "", ""]], [["a", "", "c"], ["1"]], [["", "x"], ["", "y"]], [["a"]]):
        got = spark.createDataFrame([(rows,)], "r array<array<string>>").select(tables.clean_columns_column(F.col("r"))).first()[0]
        assert got == tables.clean_columns(rows)


def test_kinds_of_tables():
    box, images = Rect(0, 0, 100, 100), [Rect(10, 10, 20, 20), Rect(30, 30, 40, 40)]
    kind = lambda rows, images=(), lines=(): tables.classified(box, rows, list(lines), list(images), {})[0]
    full, sparse = [["a", "b"], ["c", "d"]], [["a", "b"], ["c", ""], ["", ""]]
    assert kind(full) == "table" and kind(full, images) == "table" and kind(sparse, images[:1]) == "table"
    assert kind(sparse, images) == "figure" and kind([[str(i) for i in range(12)], ["x", *[""] * 11]]) == "figure"
    assert kind([["a"], ["b"]]) == "nothing" and kind([]) == "nothing" and kind([["注意", ""]]) == "nothing"
    assert tables.classified(box, [["注 意", ""]], [(Rect(5, 5, 50, 15), " 気を "), (Rect(5, 20, 50, 30), "つける")], [], {}) == ("table", [[tables.CALLOUT + "注意", "気をつける"]])


def test_tables_that_are_figures_join_the_figures(spark):
    figures = spark.createDataFrame([("a", 1, 1, 0.0, 0.0, 100.0, 100.0)], FIGURES)
    t = lambda page, number, kind, *box: ("a", page, number, kind, *map(float, box), None)
    found = spark.createDataFrame([t(1, 1, "figure", 10, 10, 50, 50), t(1, 2, "figure", 0, 60, 100, 141), t(1, 1, "table", 0, 200, 50, 250), t(2, 1, "figure", 0, 0, 9, 9), t(2, 2, "figure", 0, 0, 8, 8)], TABLES)
    got = sorted((r["page"], r["fig"], r["y1"]) for r in layout.all_figures(figures, found).collect())
    # Half of the second lies in the figure and a little more does not; the last lies in the one before it.
    assert got == [(1, 1, 100.0), (1, 2, 141.0), (2, 1, 9.0)]


def test_small_boxes_hide_no_text(spark):
    icon = spark.createDataFrame([("alpha", 1, "vector", 50.0, 95.0, 120.0, 120.0, 9), ("alpha", 1, "raster", 50.0, 195.0, 200.0, 300.0, 0)], "vendor string, page int, kind string, x0 double, y0 double, x1 double, y1 double, n_items int")
    figures = layout.all_figures(layout.figure_boxes(icon), spark.createDataFrame([], TABLES))
    rows = spark.createDataFrame([span("beside an icon"), span("in a figure", block=2, y=200.0)], SPANS)
    found = layout.page_items(rows, spark.createDataFrame([], TABLES), figures, layout.config_table(spark)).collect()
    assert [r["text"] for r in found] == ["beside an icon"]


def test_figure_boxes_and_tables_run_in_spark(spark):
    boxes = spark.createDataFrame([("alpha", 1, "raster", 100.0, 200.0, 300.0, 300.0, 0), ("alpha", 1, "vector", 110.0, 210.0, 320.0, 320.0, 0), ("beta", 2, "vector", 100.0, 200.0, 300.0, 300.0, 9)], "vendor string, page int, kind string, x0 double, y0 double, x1 double, y1 double, n_items int")
    found = sorted(tuple(r) for r in layout.figure_boxes(boxes).collect())
    assert found == [("alpha", 1, 1, 100.0, 200.0, 320.0, 320.0), ("beta", 2, 1, 100.0, 200.0, 300.0, 300.0)]
    cells = [("alpha", 1, 1, c.r, c.c, c.text, *(map(float, c.rect) if c.rect else (None,) * 4)) for c in grid([["name", "other"], ["a", "b"]])]
    cells = spark.createDataFrame(cells, "vendor string, page int, table int, r int, c int, text string, x0 double, y0 double, x1 double, y1 double")
    lines = layout.text_lines(spark.createDataFrame([span("x", y=700.0)], SPANS))
    got = tables.tables_of_pages(cells, lines, boxes).collect()
    assert [(r["kind"], r["rows"]) for r in got] == [("table", [["name", "other"], ["a", "b"]])]
    named = layout.figure_names(spark.createDataFrame([("a", "s", 2, 1), ("a", "s", 1, 2), ("a", "s", 1, 1)], "vendor string, slug string, page int, fig int"))
    assert {(r["page"], r["fig"]): r["name"] for r in named.collect()} == {(1, 1): "s-01.webp", (1, 2): "s-02.webp", (2, 1): "s-03.webp"}


def section(items, **kw):
    base = dict(layout=LAYOUTS["alpha"], num="1.1", title="開始の方法", following=("1.2", "次"), first_page=1, last_page=2, headings=((2, "設定画面の操作"), (3, "短")))
    return assemble.section_parts(items, assemble.Unit(**(base | kw)))


def item(text, page=1, y=0.0, x=50.0, kind="text", size=10.0, level=None, rows=(), low=0.0, number=0):
    return assemble.Item(page, y, x, kind, text, size, level, rows, low, number)


def test_section_starts_at_its_title_and_stops_at_the_next():
    items = [
        item("前の節の終わり"), item("1.1 開始の方法 この節では多くのことを説明", y=5.0, size=16.0), item("本文です。", y=20.0), item("短", y=40.0), item("設定画面の操作から始まる文章で長いもの", y=60.0),
        item("大きな見出し", y=80.0, size=15.5, level=2), item("太い見出し", y=90.0, size=12.0, level=3), item("続きの文です 1.2 次", page=2, size=15.0), item("次の節", page=2, y=50.0),
    ]
    assert section(items) == ([
        ("p", "この節では多くのことを説明"), ("p", "本文です。"), ("h", "### 短"), ("h", "## 設定画面の操作"), ("p", "から始まる文章で長いもの"), ("h", "## 大きな見出し"), ("h", "### 太い見出し"), ("p", "続きの文です"),
    ], True)


def test_section_without_its_title():
    assert section([item("前の節")]) == ([], False) and section([]) == ([], False) and section([], starts=True) == ([], True)
    assert section([item("前の節"), item("本文", page=2)], following=None) == ([("p", "本文")], True)
    assert section([item("前の節"), item("1.1 開始の方法", y=9.0)], following=None) == ([], True)


def test_heading_levels(spark):
    rows = [("alpha", "題", 15.0, False), ("alpha", "題。", 15.0, False), ("alpha", "太い", 12.0, True), ("alpha", "太い", 12.0, False), ("alpha", "太いしま", 12.0, True), ("alpha", "2設定", 12.0, True), ("alpha", "2.設定", 12.6, True), ("alpha", "x" * 60, 20.0, True), ("gamma", "太い", 12.0, True), ("other", "題", 20.0, True)]
    table = spark.createDataFrame(rows, "vendor string, text string, size double, bold boolean")
    assert [r[0] for r in table.select(assemble.heading_level(F.col("text"), F.col("size"), F.col("bold"), F.col("vendor"))).collect()] == [2, None, 3, None, None, None, 2, None, 3, None]


def test_steps_and_same_line_values():
    items = [item("操作手順1.開く。2.閉じる。"), item("3ファイルを選んでから開くを押します。", y=20.0, size=11.0), item("ラベル", y=50.0), item("値", y=52.0, x=100.0), item("次の行", y=60.0, x=100.0)]
    assert section(items, starts=True, following=None)[0] == [("p", "**操作手順**"), ("p", "1.開く。"), ("p", "2.閉じる。"), ("p", "3. ファイルを選んでから開くを押します。"), ("p", "ラベル：値"), ("p", "次の行")]


def test_table_goes_on_over_the_page_and_headers_are_borrowed():
    head, long = ["名前", "説明の列"], "1" * 30
    first = item("", kind="table", rows=[head, ["a", long]], y=700.0, low=780.0, number=1)
    run = lambda *more: section([first, *more], starts=True, following=None, last_page=3)[0]
    after = lambda rows, page=2, y=50.0, low=90.0, number=1: item("", page=page, kind="table", rows=rows, y=y, low=low, number=number)
    assert len(run(after([["b", long]], page=3))) == 2 and len(run(after([["b", long]], y=300.0))) == 2
    assert len(run(after([["別の", "見出し"], ["b", long]]))) == 2
    whole = run(after([head, ["b", long]]))
    assert len(whole) == 1 and whole[0][1].count("\n") == 4 and whole[0][1].count("名前") == 1
    # Over two pages; what follows on the page stays a table, and borrows the header.
    three = run(after([["b", long]], low=780.0), after([["c", long]], page=3), after([["d", long]], page=3, y=300.0, number=2))
    assert [t.count(long) for _, t in three] == [3, 1] and three[1][1].startswith("| 名前 | 説明の列 |")
    assert len(run(after([["c", long, "x"]]))) == 1  # one row of another width is no table


def test_postprocess():
    parts = [("p", "1"), ("p", "開く"), ("p", "2"), ("img", "![x](y)"), ("p", "●項目"), ("p", "■題"), ("p", "→ → 参照"), ("p", "a • b • c d e"), ("p", "12ページ 参照")]
    assert assemble.postprocess("alpha", parts) == [("p", "1. 開く"), ("p", "2."), ("img", "![x](y)"), ("p", "- 項目"), ("p", "**題**"), ("p", "→ 参照"), ("p", "- a"), ("p", "- b"), ("p", "- c d e"), ("p", "→ 参照")]
    assert assemble.postprocess("beta", [("p", "文章が途中で切れている場"), ("p", "合の例（3ページ）")]) == [("p", "文章が途中で切れている場合の例")]


def test_repair_structure():
    repair = assemble.repair_structure
    assert repair([("h", "## 保存"), ("p", "x"), ("h", "## 保存"), ("p", "を押します")]) == [("h", "## 保存"), ("p", "x"), ("p", "保存を押します")]
    assert repair([("p", "開く(→ 参照"), ("h", "## 先) 2. 次の手順")]) == [("p", "開く(→ 参照先)"), ("p", "2. 次の手順")]
    assert repair([("h", "## 3 開く("), ("p", ")を押す")]) == [("p", "3. 開く"), ("p", "を押す")]
    assert repair([("h", "## 終わります")]) == [("p", "終わります")]
    assert repair([("p", "開きます。2ファイルを選びます。3つあります。")]) == [("p", "開きます。"), ("p", "2. ファイルを選びます。3つあります。")]
    assert repair([("p", "[x](：)")]) == [("p", "[x]")]


def test_markdown_of_a_unit():
    unit = {"slug": "01-01", "num": "1.1", "title": "T", "cat": "setup", "page": 3, "page_end": 5}
    text = assemble.to_markdown(LAYOUTS["alpha"], "alpha", unit, [("p", "a"), ("p", "b"), ("h", "## h"), ("p", "x y"), ("table", "| x | y |\n|---|---|\n"), ("p", "end")])
    assert text.endswith("# 1.1 T\n\na\n\nb\n\n## h\n\n| x | y |\n|---|---|\n\nend\n")
    assert 'source: "Manual alpha pp.3-5"' in text


def test_glyphs_and_keys(spark):
    rows = spark.createDataFrame([("alpha", "\uf0a1\uf0a3\uf041"), ("beta", "\uf06c"), ("other", "\uf06c")], "vendor string, text string")
    got = {r["vendor"]: r["t"] for r in rows.select("vendor", layout.map_glyphs(F.col("text"), F.col("vendor")).alias("t")).collect()}
    assert got == {"alpha": "[F1]≤[A]", "beta": "●", "other": "\uf06c"}
    assert len(glyph_map("alpha")) > 80 and assemble.match_key("Ａ　ｂ①") == "Ab1"


def test_toc_headings_first_in_order_wins(spark):
    items = spark.createDataFrame([("a", "s", 1, "長い見出しの名前 と続き"), ("a", "s", 2, "短い"), ("a", "s", 3, "短い続き"), ("a", "t", 4, "短い")], "vendor string, slug string, seq int, text string")
    subs = spark.createDataFrame([("a", "s", 5, 3, "長い見出しの名前"), ("a", "s", 4, 2, "長い見出しの名"), ("a", "s", 6, 4, "短 い")], "vendor string, slug string, pos int, level int, title string")
    assert {r["seq"]: r["toc_level"] for r in assemble.toc_headings(items, subs).collect()} == {1: 2, 2: 4, 3: None, 4: None}


def test_catalog_outliers(spark):
    found = spark.createDataFrame([("a", f"s{i:02d}", "1", "t", "c", i * 30, i % 2 == 0, "1-2") for i in range(60)], "vendor string, slug string, num string, title string, cat string, chars int, started boolean, pages string")
    rows = toc.outliers(found).collect()
    assert sum(r["reason"] == "short" for r in rows) == 14 and sum(r["reason"] == "title not found" for r in rows) == 20


def test_glyphs_are_mapped_in_whole_texts(spark, tmp_path):
    from foliate import layout_entries

    long = "x" * 5000 + "\uf06c" + "y" * 10
    spark.createDataFrame([(0, long), (1, "short"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["text"] for r in layout_entries.QUERIES["j14_map_glyphs"](spark, str(tmp_path)).collect()}
    want = spark.createDataFrame([(0, "alpha", long + "\uf000"), (1, "beta", "short\uf001")], "doc_id long, vendor string, text string")
    assert got == {r["doc_id"]: r["text"] for r in want.select("doc_id", layout.map_glyphs(F.col("text"), F.col("vendor")).alias("text")).collect()}
    assert len(got[0]) > 5000
