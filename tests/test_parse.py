import pytest
from pyspark.sql import functions as F

from foliate.functions import text as T
from foliate.functions.ordering import in_order
from foliate.operators import index, parse
from foliate.sources import pages as source


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text,fm,body",
    [
        ("---\na: 1\n---\nbody\n", "a: 1", "body\n"),
        ("---\n---\nbody", "", "---\n---\nbody"),
        ("---\n\n---\nx", "", "x"),
        ("\n---\na: 1\n---\n", "", "\n---\na: 1\n---\n"),
        ("---\na\n---\nb\n---\nc", "a", "b\n---\nc"),
        ("", "", ""),
    ],
)
def test_front_matter(spark, text, fm, body):
    row = parse.split_front_matter(spark.createDataFrame([(text,)], "text string")).first()
    assert (row["fm"], row["body"]) == (fm, body)
    assert row["has_fm"] == (body != text)


def test_front_matter_map(spark):
    fm = 'a: 1\nb: "x: y"\n  c  :  "q"  \nno colon\na: 2\nd: ""u""'
    assert one(spark, fm, parse.front_matter_map) == {"b": "x: y", "c": "q", "no colon": "", "a": "2", "d": "u"}


def test_field_takes_the_next_line_of_an_empty_one(spark):
    assert one(spark, "title:\nnum: 1", lambda c: parse.field(c, "title")) == "num: 1"
    assert one(spark, 'title:  "A b"  \nnum: 1', lambda c: parse.field(c, "title")) == "A b"
    assert one(spark, "num: 1", lambda c: parse.field(c, "title")) is None


def test_source(spark):
    assert one(spark, 'source: "M pp.12-15 pp.3-4"', parse.source_start) == 12
    assert one(spark, "source: none", parse.source_start) == 10**9


def test_headings_know_unicode_blanks(spark):
    assert one(spark, "# a\n##　b\n##### e\n#c\n#### d\r\n", parse.headings) == ["a", "b", "d\r"]


def test_excerpt_keeps_the_leading_blank(spark):
    assert one(spark, "# T\n\n![a](b.png) x|y\n", parse.excerpt) == " T x y "


@pytest.mark.parametrize("num,key", [("3.1", (3, 1, 0)), ("2-10", (2, 10, 0)), ("付2", (99, 2, 0)), ("A-3", (99, 3, 0)), ("A4", (99, 4, 0)), ("7", (7, 0, 0)), ("", (98, 0, 0)), ("x", (98, 0, 0)), ("3.x", (98, 0, 0)), ("1.2.3", (1, 2, 0))])
def test_sort_key(spark, num, key):
    assert tuple(one(spark, num, parse.sort_key)) == key


@pytest.mark.parametrize("num,slug", [("3.1", "03-01"), ("2-167", "02-167"), ("付2", "ap-02"), ("A-13", "ap-13"), ("A1", "ap-01"), ("x.1", "01"), ("", "")])
def test_section_slug(spark, num, slug):
    assert one(spark, num, parse.section_slug) == slug


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\n\n", "a\r\nb\rc\x0bd\x1ce\x85f g ", "\n"])
def test_lines_are_those_of_splitlines(spark, text):
    assert one(spark, text, T.lines) == text.splitlines()


@pytest.mark.parametrize("text", ["　 a\t\x1f\n", " b", "", " \x85 "])
def test_strip_knows_all_blanks(spark, text):
    assert one(spark, text, T.strip) == text.strip()


def test_order_over_groups_matches_one_window(spark):
    rows = [(v, n // 7, n, f"s{n}") for v in "ab" for n in range(40) if (n * 7 + ord(v)) % 5]
    df = spark.createDataFrame(rows, "vendor string, g int, n int, slug string").repartition(3)
    got = {(r["vendor"], r["n"]): (r["position"], r["previous_slug"], r["next_slug"]) for r in in_order(df, ["vendor"], ["g"], ["n"], {"slug": F.col("slug")}).collect()}
    for v in "ab":
        own = [r for r in rows if r[0] == v]
        for i, r in enumerate(own):
            assert got[v, r[2]] == (i + 1, own[i - 1][3] if i else None, own[i + 1][3] if i + 1 < len(own) else None)


def test_pages_from_files(spark, tmp_path):
    for vendor, slug, content in (("alpha", "01-01", "a\n".encode()), ("beta", "02", b"bad \xff byte \xe3\x81")):
        (tmp_path / "in" / vendor).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / vendor / f"{slug}.md").write_bytes(content)
    (tmp_path / "in" / "alpha" / "note.txt").write_text("no page")
    found = source.read_pages(spark, str(tmp_path / "in"))
    got = {(r["vendor"], r["slug"]): (r["strict"], r["loose"]) for r in found.select("vendor", "slug", source.decode_strict(F.col("content")).alias("strict"), source.decode_replace(F.col("content")).alias("loose")).collect()}
    assert got == {("alpha", "01-01"): ("a\n", "a\n"), ("beta", "02"): (None, b"bad \xff byte \xe3\x81".decode(errors="replace"))}


def test_pages_to_files_and_back(spark, tmp_path):
    rows = [("alpha", "01-01", b"a\xff\n"), ("beta", "02", None), ("beta", "a b=c", "é".encode())]
    pages = spark.createDataFrame(rows, "vendor string, slug string, content binary")
    for root in (str(tmp_path / "out"), f"file://{tmp_path}/out"):  # the second time over the first
        assert source.write_page_files(pages, root) == 3
        assert {(r["vendor"], r["slug"], bytes(r["content"])) for r in source.read_pages(spark, root).collect()} == {(v, s, c) for v, s, c in rows if c}  # Spark's readers leave out files without bytes
    assert sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.endswith(".crc")) == ["01-01.md", "02.md", "a b=c.md"]
    assert source.write_page_files(pages.limit(0), str(tmp_path / "none")) == 0
    with pytest.raises(Exception, match="no file can be named"):
        source.write_page_files(spark.createDataFrame([("alpha", "../x", b"")], pages.schema), str(tmp_path / "out"))


def test_agent_index_and_nav_files(spark, tmp_path):
    rows = spark.createDataFrame([(2, 0, "c"), (0, 0, "a"), (0, 1, "b")], "part long, ord long, line string")
    source.write_agent_index(rows, str(tmp_path / "index"))
    lines = []
    for name in sorted(p for p in (tmp_path / "index").iterdir() if p.name.startswith("part")):
        lines += name.read_text().split()
    assert lines == ["a", "b", "c"]
    for write in (source.write_nav, source.write_search, source.write_catalog):
        write(rows, str(tmp_path / write.__name__))
        assert spark.read.json(str(tmp_path / write.__name__)).count() == 3


def test_search_docs_add_common_guides(spark):
    page = "---\ntitle: \"T\"\n---\n# h0\n## h1\n"
    pages = spark.createDataFrame([("alpha", "a", page)], "vendor string, slug string, text string")
    common = spark.createDataFrame([("common", "index", page), ("common", "setup", page), ("common", "debug", "no front matter")], "vendor string, slug string, text string")
    got = {(r["vendor"], r["slug"]): (r["num"], r["title"], r["cat"], r["heads"]) for r in index.search_docs(pages, common).collect()}
    assert got == {
        ("alpha", "a"): ("", "T", "reference", ["h1"]),
        ("common", "setup"): ("", "T(3社対応表)", "setup", ["h1"]),
        ("common", "debug"): ("", "debug(3社対応表)", "debug", []),
    }


def test_page_files_are_read_by_tasks(spark, tmp_path):
    rows = [("alpha", "01-01", b"a\xff\n"), ("beta", "02", b""), ("beta", "a b=c%20", "é".encode()), ("beta", "02", b"again"), ("beta", "02", None)]
    pages = spark.createDataFrame(rows, "vendor string, slug string, content binary").coalesce(1)
    root = str(tmp_path / "out %41")
    assert source.write_page_files(pages, root, apart=True) == 5
    (tmp_path / "out %41" / "x" / "alpha").mkdir(parents=True)
    (tmp_path / "out %41" / "x" / "alpha" / "note.txt").write_text("no page")
    found = source.read_page_files(spark, root)
    assert sorted(tuple(r) for r in found.select("vendor", "slug", F.col("content").cast("string")).collect() if r["slug"] == "02") == [("beta", "02", ""), ("beta", "02", ""), ("beta", "02", "again")]
    assert sorted((r["vendor"], r["slug"], bytes(r["content"])) for r in found.collect()) == sorted((v, s, c or b"") for v, s, c in rows)
    assert "FileScan binaryFile" not in found._jdf.queryExecution().executedPlan().toString()
    assert source.read_page_files(spark, str(tmp_path / "none")).count() == 0
