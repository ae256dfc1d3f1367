"""Queries on what only larger tables hold."""

import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from foliate.functions.text import BLANK, lstrip, rstrip, strip
from foliate.operators import assemble, audit, blocks, tables


@pytest.fixture
def documents(spark, tmp_path):
    def write(*rows):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return write


def _run(spark, name, folder):
    return __spark_entry__.queries()[name](spark, folder)


def test_items_of_late_pages_are_numbered(spark, documents):
    assert dict(_run(spark, "j13_toc_headings", documents((0, "one\ntwo"))).dtypes)["seq"] == "int"
    rows = _run(spark, "j13_toc_headings", documents((900_000, "three\nfour"))).collect()
    assert sorted(r["seq"] for r in rows if r["text"] == "Topic 900000") == [12_000_010_002]


@pytest.mark.parametrize(("text", "made"), [("leontion | a", "leontion | a"), ("l’eau", "l’eau"), ("l項目", "- 項目"), ("lGX を開く", "- GX を開く"), ("l 項目", "- 項目")])
def test_a_letter_is_a_bullet_where_no_word_goes_on(text, made):
    assert assemble.postprocess("gamma", [("p", text)]) == [("p", made)]


def test_columns_of_long_tables_are_cleaned_in_one_pass(spark):
    rows = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.array(i.cast("string"), F.lit(""), F.when(i == 1, "h").otherwise("")))
    long = spark.createDataFrame([(30_000,)], "n int").select(rows.alias("rows")).localCheckpoint()
    begun = time.monotonic()
    assert long.select(F.explode(tables.clean_columns_column(F.col("rows"))).alias("r")).where("size(r) = 1").count() == 30_000
    assert time.monotonic() - begun < 40


def test_pages_are_polished_one_at_a_time(spark):
    # Batches of Arrow are of thousands of pages, however long these are.
    pages = spark.createDataFrame([("alpha", "p1", "a\n\nます。"), ("alpha", "p2", None)], "vendor string, slug string, body string")
    for made in (blocks.polish_bodies(pages), blocks.blocks_of(pages)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "Arrow" not in plan and "MapInPandas" not in plan
    assert [tuple(r) for r in blocks.polish_bodies(pages).orderBy("slug").collect()] == [("alpha", "p1", "aます。\n", 1, 0, 0, 0, 0), ("alpha", "p2", "\n", 0, 0, 0, 0, 0)]


def test_blanks_are_those_of_the_pattern(spark):
    made = spark.range(0x1, 0xD800).select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'utf-16be')").alias("x"))
    pattern = rf"(?U)\A[{BLANK}]+|[{BLANK}]+\z"
    around = F.concat("x", F.lit("a"), "x", F.lit("b"), "x")
    assert made.where((strip(around) != F.regexp_replace(around, pattern, "")) | (strip(F.col("x")) != F.regexp_replace("x", pattern, ""))).count() == 0
    assert made.where((rstrip(around) != F.concat("x", F.lit("a"), "x", F.lit("b"), rstrip(F.col("x")))) | (lstrip(around) != F.concat(lstrip(F.col("x")), F.lit("a"), "x", F.lit("b"), "x"))).count() == 0


def test_repeated_lines_of_long_pages_are_found_in_one_pass(spark):
    lines = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit(" line "), F.floor(i / 2).cast("string")))
    long = spark.createDataFrame([(20_001,)], "n int").select(lines.alias("lines")).localCheckpoint()
    begun = time.monotonic()
    assert long.select(F.explode(audit.duplicate_lines(F.col("lines")))).count() == 10_000
    assert time.monotonic() - begun < 40


def test_every_document_is_read_back(spark, documents):
    """Empty texts, names that several documents share once cut to eight digits, a document without a number."""
    folder = documents((1, ""), (2, "b"), (7, "c"), (100_000_000, "d"), (100_000_003, "e"), (100_000_003, "e"), (None, "f"), (None, ""), (3, None))
    got = sorted(map(repr, map(tuple, _run(spark, "s1_read_pages", folder).collect())))
    want = [("beta", "p00000001", ""), ("gamma", "p00000002", "b"), ("beta", "p00000007", "c��"), ("beta", "p10000000", "d"), ("beta", "p10000000", "e"), ("beta", "p10000000", "e"), ("gamma", None, "f"), ("gamma", None, "")]
    assert got == sorted(map(repr, want))
