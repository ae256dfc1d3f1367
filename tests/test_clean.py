import pytest
from pyspark.sql import functions as F

from foliate.jobs.polish import polish, run
from foliate.operators import blocks, clean


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "line,want",
    [
        ("《製品》 名", "製品名"), ("日本 語 ABC と", "日本語ABCと"), ("ABC 日本", "ABC日本"), ("（ 日本 ）", "（日本）"), ("a b", "a b"),
        ("値：：1", "値：1"), ("x 。", "x。"), ("end 　", "end"), ("３ 個", "３ 個"),
    ],
)
def test_spacing(spark, line, want):
    assert one(spark, line, clean.normalize_spacing) == want


@pytest.mark.parametrize(
    "line,want",
    [
        ("必ずお読みください。", ""), ("本章では、設定について説明します。", "設定をまとめます。"), ("設定について簡単に説明しています。", "設定をまとめます。"),
        ("項目を以下に一覧で示します。", "項目の一覧です。"), ("項目を下記に示します。", "項目は次のとおりです。"), ("詳細は、以下を参照してください。", "**関連項目**"),
        ("操作方法は下記を参照してください。", "**操作方法の関連項目**"), ("設定の詳細は、以下を参照してください。", "**設定の関連項目**"),
        ("接続は、以下を参照してください。", "**接続の関連項目**"), ("- 設定について説明します。", "- 設定について説明します。"), ("よくご確認ください", "よく確認してください"),
    ],
)
def test_tone_in_columns_and_in_the_helper(spark, line, want):
    assert one(spark, line, clean.rewrite_tone) == want
    assert blocks._tone(line) == want


@pytest.mark.parametrize(
    "line,want",
    [
        ("## ■ 設定", "## 設定"), ("# a ● b", "# a — b"), ("## 1.2設定", "## 1. 2 設定"), ("## 10-2設定", "## 10-2 設定"), ("# 1.2設定", "# 1.2 設定"), ("## 3.次", "## 3. 次"), ("## 2設定", "## 2 設定"), ("## 2 台", "## 2台"),
        ("## 3 : n", "## 3:n"), ("| a • b |", "| a / b |"), ("画面表示", "**画面の開き方**"), ("例", "**例**"), ("図(元マニュアルp.3)", "図(元マニュアル p.3)"),
    ],
)
def test_lines(spark, line, want):
    assert one(spark, line, lambda c: clean.normalize_line(c, F.lit("alpha"))) == want


def test_common_guides_keep_their_heading_numbers(spark):
    assert one(spark, "## 2設定", lambda c: clean.normalize_line(c, F.lit("common"))) == "## 2設定"


@pytest.mark.parametrize(
    "body,want,counts",
    [
        ("設定し\n\nます。\n", "設定します。\n", [1, 0, 0, 0, 0]),
        ("設定し\n\n![a](b)\n\nます。\n", "設定します。\n\n![a](b)\n", [1, 0, 0, 0, 0]),
        ("終わり。\n\nます。\n", "終わり。\n\nます。\n", [0, 0, 0, 0, 0]),
        ("| a | 設定し |\n\nます。\n", "| a | 設定します。 |\n", [1, 0, 0, 0, 0]),
        ("メニューの\n\n## [開く]\n\nを選びます\n", "メニューの[開く]を選びます\n", [0, 1, 0, 0, 0]),
        ("## 1.2 機能\n\nについて\n", "## 1.2 機能\n\n機能について\n", [0, 0, 1, 0, 0]),
        ("主語\n\nが動く\n", "主語が動く\n", [0, 0, 1, 0, 0]),
        ("前 • 一 • 二\n", "前\n\n- 一\n\n- 二\n", [0, 0, 0, 1, 0]),
        ("**注意**\n\n# h\n\n**参考**\n", "# h\n", [0, 0, 0, 0, 2]),
        ("a\n**注意**\nb\n", "a\n\n**注意**\n\nb\n", [0, 0, 0, 0, 0]),
        ("", "\n", [0, 0, 0, 0, 0]),
    ],
)
def test_blocks(body, want, counts):
    assert blocks.polish_blocks(body) == (want, counts)


def test_text_joined_to_a_block_that_went_goes_with_it():
    # The second suffix looks back at the first one's place, which has been removed.
    assert blocks.polish_blocks("設定し\n\nます\n\n択\n\n」\n")[0] == "設定し\n\nます択\n"


def page(start, body, num="1", title="T"):
    return f'---\nnum: "{num}"\ntitle: "{title}"\nsource: "M pp.{start}-{start + 4}"\n---\n\n{body}'


def test_overlap(spark):
    tail = "the next section begins here\nmore of it\n"
    long = "".join(f"line {i}\n" for i in range(12))
    rows = [("alpha", "a", page(1, long + tail)), ("alpha", "b", page(5, "# h\n\n| x |\n\n" + tail + long)), ("alpha", "c", page(9, "short\n")), ("beta", "a", page(1, long + tail))]
    pages = spark.createDataFrame(rows, "vendor string, slug string, text string")
    got = {(r["vendor"], r["slug"]): (r["text"], r["overlap"]) for r in clean.trim_overlap(pages).collect()}
    assert got["alpha", "a"] == (page(1, long), True)
    for key in (("alpha", "b"), ("alpha", "c"), ("beta", "a")):
        assert got[key] == (next(t for v, s, t in rows if (v, s) == key), False)


def test_first_h1_only(spark):
    fm = 'num: "1.2"\ntitle: "A $1 \\ b"'
    rows = spark.createDataFrame([(fm, "x\n# old\n# old\n"), ("num: 1", "# old\n"), (fm, "none\n")], "fm string, body string")
    got = [r[0] for r in rows.select(clean.canonical_h1(F.col("fm"), F.col("body"))).collect()]
    assert got == ["x\n# 1.2 A $1 \\ b\n# old\n", "# old\n", "none\n"]


def test_polish_is_idempotent_and_dry_runs_write_nothing(spark, tmp_path):
    body = "# old\n\n本章では、設定について説明します。\n\n設定し\n\nます。\n\n画面表示\n\n前 • 一 • 二\n"
    pages = spark.createDataFrame([("alpha", "a", page(1, body)), ("alpha", "b", "no front matter\n")], "vendor string, slug string, text string")
    once = polish(pages)
    twice = polish(once.select("vendor", "slug", "text"))
    first, second = ({(r["slug"]): r for r in df.collect()} for df in (once, twice))
    assert {k: r["text"] for k, r in first.items()} == {k: r["text"] for k, r in second.items()}
    assert first["a"]["changed"] and not second["a"]["changed"]
    assert first["a"]["text"].split("---\n")[2].startswith("\n# 1 T\n\n設定をまとめます。\n\n設定します。")
    totals = run(pages, str(tmp_path / "out"), dry_run=True).first()
    assert (totals["suffix_joins"], totals["bullet_expansions"]) == (1, 1) and not (tmp_path / "out").exists()
    run(pages, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
