"""What grows with a page, a table or a corpus no faster than it: the findings of round 3 on larger inputs."""

import os
import random
import re
import time

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from foliate import layout_entries
from foliate.functions.text import lines
from foliate.jobs import extract
from foliate.layout_config import LAYOUTS, glyph_map
from foliate.operators import assemble, tables
from foliate.sources import layout_view as view
from foliate.sources import scratch


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_joining_lines_looks_at_the_last_character_only():
    begun = time.monotonic()
    assert len(tables.joined(["ab cd, "] * 60_000)) == 60_000 * 7 - 1
    assert time.monotonic() - begun < 3


def test_filling_down_goes_through_the_rows_once():
    n = 12_000
    grid, rects = [["", str(i)] for i in range(n)], [[None, tables.Rect(0, i, 1, i + 1)] for i in range(n)]
    begun = time.monotonic()
    tables.fill_down(grid, rects)
    assert time.monotonic() - begun < 2 and grid[-1] == ["", str(n - 1)]


def test_joined_as_the_rule_says():
    r = random.Random(3)
    for _ in range(300):
        parts = ["".join(r.choices(" aZ0)](［[%.,:;語、　", k=r.randint(0, 3))) for _ in range(r.randint(0, 6))]
        want = ""
        for part in map(str.rstrip, parts):
            blank = want and want[-1] in "0123456789aZ)]%.,:;" and part[:1] and part[0] in "0aZ(["
            want = f"{want} {part}" if blank else want + part
        assert tables.joined(parts) == want


@pytest.mark.parametrize("vendor", LAYOUTS)
def test_glyphs_as_translate_puts_them(vendor):
    names = glyph_map(vendor)
    text = "a |[]^-\\ 語" + "".join(names) + "z"
    assert tables.glyphs_of(vendor)(text) == text.translate(str.maketrans(names))


def test_cells_and_keys_as_their_patterns_say():
    assert tables._in_cell("  a　 b|c ") == r"a b\|c" and tables._in_cell("語 語") == "語語" and tables._in_cell("Press「 」key _ ") == "Press「_」key"
    assert tables._in_cell("長い文字列です 語 語") == "長い文字列です 語 語" and tables._in_cell("a_ ") == "a_"
    assert assemble.match_key(" a\tＢ\x1c　c ") == "aBc" and assemble.match_key(None) == ""


def test_tidied_as_all_its_patterns_say():
    r, tidy = random.Random(7), assemble._tidy("beta", LAYOUTS["beta"])
    marks = ((r"→ *→ *", "→ "), (r"(?<![0-9A-Za-z])_\s+(?=[0-9A-Za-z□])", "_"), (r"(?<![0-9A-Za-z_()])_ ?_(?![0-9A-Za-z_()])", " "), (r"[・.]{3,}", " "))
    for _ in range(400):
        text = "x" + "".join(r.choices("a□_ \t→・.語(", k=r.randint(0, 25)))
        want = re.sub(r"[ \t]+", " ", text).strip()
        for pattern, put in marks:
            want = re.sub(pattern, put, want)
        assert tidy(("p", text)) == [("p", want.strip())]


def test_the_cells_of_a_text_are_made_once(spark):
    docs = spark.createDataFrame([(0, "a b"), (1, " \n\t"), (2, None)], "doc_id long, text string")
    for made in (view.cells(docs), view.kinds_cells(docs), view.damaged_cells(docs)):
        assert plan(made).count("regexp_extract_all(") == 1


def test_cells_are_the_runs_of_words(spark):
    r = random.Random(5)
    texts = ["".join(r.choices(["a", "語", " ", "\t", "\n", "\r", "\f", "\x0b", "  ", "　"], k=r.randint(0, 90))) for _ in range(120)]
    for row in view._fitted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        words = [w for w in "".join(" " if c in "\t\n\r\f\x0b" else c for c in row["text"]).split(" ") if w]
        assert row["cells"] == [" ".join(words[i : i + 8]) for i in range(0, len(words), 8)]


def test_lines_split_a_text_once(spark):
    rows = spark.createDataFrame([("a\r\nb\x85c\n",), ("",), ("\n\n",), ("x",)], "t string")
    assert [r["l"] for r in rows.select(lines(F.col("t")).alias("l")).collect()] == [["a", "b", "c"], [], ["", ""], ["x"]]
    assert plan(rows.select(F.transform(lines(F.col("t")), F.upper).alias("l"))).count("split(") == 1


def test_outliers_make_each_page_once(spark, monkeypatch, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string", useArrow=False)
    def text(slug):
        made.add(1)
        return "short"

    found = spark.createDataFrame([("alpha", f"s{i}", "1", "T", "setup", 1, 2) for i in range(7)], "vendor string, slug string, num string, title string, cat string, page int, page_end int")
    monkeypatch.setattr(layout_entries, "_made", lambda s, d: (found, found.select("vendor", "slug", text("slug").alias("text"), F.lit(False).alias("started"))))
    assert len(layout_entries.QUERIES["a8_outliers"](spark, "").collect()) == 14 and made.value == 7


@pytest.mark.parametrize("held", [1, 3, 10**6])
def test_pages_handed_on_together_are_the_same(spark, monkeypatch, held):
    docs = spark.createDataFrame([(i, " ".join(map(str, range(i)))) for i in range(40)], "doc_id long, text string")
    found = tables.tables_of_pages(view.cells(docs), view.damaged_lines(docs), view.boxes(docs).limit(0))
    monkeypatch.setattr(tables, "CELLS_HELD", held)
    again = tables.tables_of_pages(view.cells(docs), view.damaged_lines(docs), view.boxes(docs).limit(0))
    assert sorted(map(repr, found.collect())) == sorted(map(repr, again.collect())) and found.count() > 20


def test_shuffle_files_go_with_the_write(spark, monkeypatch):
    kept = []
    real = spark.conf.get(scratch._CLEANED)
    monkeypatch.setattr("pyspark.sql.DataFrameWriter.parquet", lambda self, path, *a, parquet=DataFrameWriter.parquet, **b: (kept.append(spark.conf.get(scratch._CLEANED)), parquet(self, path, *a, **b))[1])
    made = scratch.materialize(spark.range(100).repartition(3), "dealt")
    blocks = scratch.materialize_in_blocks(scratch.blocks_of(["id"], lambda of: of(spark.range(100)).repartition(3)), "dealt-in-blocks")
    assert kept == ["true"] * (1 + scratch.BLOCKS) and spark.conf.get(scratch._CLEANED) == real
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, blocks.collect())) == [(i,) for i in range(100)]


def test_tables_that_are_kept_outlive_the_block(spark):
    with scratch.scratch_removed(spark):
        with scratch.scratch_removed(spark, keep=("kept-one",)):
            kept, gone = scratch.materialize(spark.range(5), "kept-one"), scratch.materialize(spark.range(3), "gone-one")
            at, gone_at = (df.inputFiles()[0].removeprefix("file://") for df in (kept, gone))
        assert kept.count() == 5 and not os.path.exists(gone_at)
    assert not os.path.exists(at)


def test_sections_made_in_blocks_are_the_same(spark, monkeypatch, tmp_path):
    """Sections that share pages or a slug, one without pages; from the pages of a block only."""
    docs = spark.createDataFrame([(i, f"First line of {i}.\nSecond line {i}.\n" * 3) for i in range(60)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(extract, "LEAST_SECTIONS", 10**6)
    found, whole = layout_entries._made(spark, str(tmp_path))
    seen = []
    monkeypatch.setattr(extract, "LEAST_SECTIONS", 3)
    monkeypatch.setattr(assemble, "assemble", lambda *a, build=assemble.assemble, **b: (seen.append({r[0] for r in a[1].select("page").distinct().collect()}), build(*a, **b))[1])
    _, again = layout_entries._made(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, again.collect())) and again.count() == found.count()
    assert len(seen) == 4 and all(pages < set.union(*seen) for pages in seen)
    twice = found.unionByName(found.where("ord = 1").withColumns({"ord": F.lit(10**6).cast("long"), "page": F.col("page") + 40, "page_end": F.col("page_end") + 40}))
    blocks = list(extract._section_blocks(twice.unionByName(found.limit(1).withColumns({"slug": F.lit("none"), "page": F.lit(None).cast("int"), "page_end": F.lit(None).cast("int")})), None))
    named = [tuple(r) for own, _ in blocks for r in own.collect()]
    assert len(named) == len(set(named)) and ("none" in {slug for _, slug in named})


def test_items_are_dealt_out_as_far_as_headings_go(spark):
    items = spark.createDataFrame([("alpha", "s", 1, "Topic 12"), ("alpha", "s", 2, "Topic 12 and " + "more " * 500), ("alpha", "s", 3, "Topic"), ("alpha", "t", 1, "x" * 9)], "vendor string, slug string, seq int, text string")
    subs = spark.createDataFrame([("alpha", "s", 1, 3, "Topic 12", 1), ("alpha", "s", 2, 4, "Topic", 1), ("alpha", "t", 3, 4, "y", 1)], "vendor string, slug string, pos int, level int, title string, page int")
    made = assemble.toc_headings(items, subs)
    assert sorted((r["slug"], r["seq"], r["toc_level"]) for r in made.collect()) == [("s", 1, 3), ("s", 2, 3), ("s", 3, 4), ("t", 1, None)]
    assert re.search(r"substring\(\S+, 1, 7\)", plan(made))
    assert assemble.toc_headings(items, subs.limit(0)).where("toc_level is null").count() == 4
