"""Boxes, headings and glyphs: tiles, beginnings and tables against plain loops, and how their work grows."""

import random

import pytest
from pyspark.sql import functions as F

from foliate.layout_config import glyph_map
from foliate.operators import assemble, layout
from foliate.operators.layout import Rect

LINES = "vendor string, page int, block int, x0 double, y0 double, x1 double, y1 double"
BOXES = "vendor string, page int, kind string, x0 double, y0 double, x1 double, y1 double"


def box(r, far=False):
    x, y = r.uniform(-50, 600), r.uniform(-50, 900)
    w, h = (r.choice([3.0, 60.0, 64.0, 128.0, 700.0, 5000.0] if far else [3.0, 30.0, 64.0, 200.0]) for _ in range(2))
    x, y = (r.choice([v, round(v / 64) * 64.0]) for v in (x, y))
    return x, y, x + w, y + h


def test_lines_outside_of_boxes(spark):
    r = random.Random(2)
    lines = [(r.choice(["alpha", "beta"]), r.randrange(4), i, *box(r, True)) for i in range(1500)] + [("alpha", 1, 9000, None, 1.0, None, 2.0), (None, None, 9001, 1.0, 1.0, 2.0, 2.0)]
    boxes = [(r.choice(["alpha", "beta"]), r.randrange(4), r.choice(["table", "figure"]), *box(r, k % 9 == 0)) for k in range(40)]
    boxes += [boxes[0], ("alpha", 1, "table", 500.0, 500.0, 400.0, 400.0), ("alpha", 2, "table", None, 1.0, 2.0, 3.0), ("beta", 2, "table", 1e9, 1e9, 1e12, 1e12), ("beta", 3, "figure", -1e12, -1e12, -1e9, -1e9)]

    def free(v, p, x0, y0, x1, y1):
        if x0 is None:
            return True
        cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
        return not any(v == w and p == q and None not in b and b[0] - m <= cx <= b[2] + m and b[1] - m <= cy <= b[3] + m for w, q, kind, *b in boxes for m in [2 if kind == "table" else 1])

    want = sorted(i for v, p, i, *c in lines if free(v, p, *c))
    got = sorted(x["block"] for x in layout.text_outside_boxes(spark.createDataFrame(lines, LINES), spark.createDataFrame(boxes, BOXES)).collect())
    assert got == want and 100 < len(want) < len(lines) - 50


def test_a_page_of_many_boxes_meets_few_pairs(spark):
    """Ten times the lines and boxes: ten times the pairs that the join looks at, not a hundred times."""
    def pairs(n):
        at = lambda c: F.pmod(F.xxhash64(F.lit(c), "id"), F.lit(2000)).cast("double")
        rows = spark.range(n).select(F.lit("alpha").alias("vendor"), F.lit(1).alias("page"), F.col("id").alias("block"), at("x").alias("x0"), at("y").alias("y0"), (at("x") + 4).alias("x1"), (at("y") + 4).alias("y1"))
        tiles = rows.groupBy(layout._tile((F.col("x0") + F.col("x1")) / 2).alias("tx"), layout._tile((F.col("y0") + F.col("y1")) / 2).alias("ty")).count()
        return layout.text_outside_boxes(rows, rows.withColumn("kind", F.lit("figure"))).count(), tiles.agg(F.sum(F.col("count") ** 2)).first()[0]

    assert pairs(10_000) == (0, pytest.approx(10_000**2 / 1000, rel=0.5))
    plan = layout.text_outside_boxes(spark.createDataFrame([], LINES), spark.createDataFrame([], BOXES))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftAnti" in plan and "tx#" in plan and "ty#" in plan


def plain_figures(rasters, vectors, tables, body, page):
    fits = lambda r, size, share: r.x1 - r.x0 >= size[0] and r.y1 - r.y0 >= size[1] and all(r.shared(t) <= share * r.area for t in tables)
    images = [r for r in rasters if fits(r, layout.RASTER_SIZE, layout.RASTER_IN_TABLE)]
    drawn = [r for r, n in vectors if fits(r, layout.VECTOR_SIZE, layout.VECTOR_IN_TABLE) and (n >= layout.VECTOR_ITEMS or any(r.shared(i) > 0 for i in images))]
    found = []
    for r in sorted((r for r in images + drawn if r.shared(body) > 0.5 * r.area and r.area < 0.92 * page.area), key=lambda r: (r.y0, r.x0)):
        for k, f in enumerate(found):
            if r.shared(f) > 0.25 * min(r.area, f.area):
                found[k] = f.around(r)
                break
        else:
            found.append(r)
    return found


def test_figures_are_those_of_all_pairs():
    r, body, page, merged = random.Random(3), Rect(35, 42, 545, 782), Rect(0, 0, 595, 842), 0
    for _ in range(1500):
        some = lambda n, w, h: [Rect(x, y, x + r.uniform(1, w), y + r.uniform(1, h)) for x, y in ((r.uniform(-90, 520), r.uniform(-90, 800)) for _ in range(r.randrange(n)))]
        rasters, vectors, tables = some(9, 300, 200), [(v, r.randrange(12)) for v in some(9, 400, 300)], some(4, 400, 300)
        want = plain_figures(rasters, vectors, tables, body, page)
        assert layout.figures_of(rasters, vectors, tables, body, page) == want
        merged += len(want) < len(rasters)
    assert merged > 300


def test_many_figures_meet_few_others(monkeypatch):
    looked = {"n": 0}
    shared = Rect.shared
    monkeypatch.setattr(Rect, "shared", lambda a, b: looked.__setitem__("n", looked["n"] + 1) or shared(a, b))

    def pairs(n):
        looked["n"] = 0
        boxes = [Rect(150.0 * (i % 12), 60.0 * (i // 12), 150.0 * (i % 12) + 110, 60.0 * (i // 12) + 45) for i in range(n)]
        big = Rect(0, 0, 1e6, 1e6)
        assert len(layout.figures_of(boxes, [], [], big, big)) == n
        return looked["n"]

    assert pairs(384) < 2.2 * pairs(192) + 100


ITEMS, SUBS = "vendor string, slug string, seq int, text string", "vendor string, slug string, pos int, level int, title string"


def test_headings_are_those_of_all_pairs(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("ab") for _ in range(r.randrange(n)))
    subs = [(r.choice(["alpha", "beta"]), f"s{r.randrange(3)}", i, r.randrange(1, 5), r.choice([word(5), word(12), "Ａb " + word(9), "", None])) for i in range(200)]
    items = [(r.choice(["alpha", "beta"]), f"s{r.randrange(4)}", i, r.choice([word(5), word(16), "ab" + word(12), "Ab　" + word(9), "", None])) for i in range(600)]

    def level(v, slug, text):
        norm = assemble.match_key(text or "")
        fits = [(pos, lvl) for w, s, pos, lvl, title in subs if (w, s) == (v, slug) and (key := assemble.match_key(title or "")) and text is not None and (norm == key or len(key) > 6 and norm.startswith(key))]
        return min(fits)[1] if fits else None

    got = assemble.toc_headings(spark.createDataFrame(items, ITEMS), spark.createDataFrame(subs, SUBS))
    assert {(x["vendor"], x["slug"], x["seq"]): x["toc_level"] for x in got.collect()} == {(v, s, i): level(v, s, t) for v, s, i, t in items}
    assert got.where("toc_level is not null").count() > 30


def test_a_section_of_many_headings(spark):
    """4,000 items and 4,000 headings of one section: not 16 million pairs but one for each item."""
    n = 4000
    subs = spark.range(n).select(F.lit("alpha").alias("vendor"), F.lit("s").alias("slug"), F.col("id").cast("int").alias("pos"), F.lit(2).alias("level"), F.concat(F.lit("Heading number "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("title"))
    items = subs.select("vendor", "slug", F.col("pos").alias("seq"), F.concat("title", F.lit(" and more")).alias("text"))
    found = assemble.toc_headings(items, subs)
    assert found.where("toc_level = 2").count() == n
    assert not [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x and "StartsWith" in x]


@pytest.mark.parametrize("vendor", ["alpha", "beta", "gamma"])
def test_glyphs_as_by_one_replacement_after_the_other(spark, vendor):
    r, glyphs = random.Random(5), glyph_map(vendor)
    texts = ["".join(r.choice([chr(r.randrange(0xF000, 0xF100)), "a", "語", " "]) for _ in range(60)) for _ in range(200)] + ["", None, "plain"]

    def plain(text):
        for glyph, name in glyphs.items():
            text = text.replace(glyph, name)
        return text

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", layout.map_glyphs(F.col("t"), F.lit(vendor)).alias("t"))
    assert {x["i"]: x["t"] for x in got.collect()} == {i: None if t is None else plain(t) for i, t in enumerate(texts)}


def test_a_glyph_in_what_another_becomes():
    steps = {"\uf001": "a\uf002", "\uf003": "c\uf001", "\uf002": "b"}
    text = by_steps = "x\uf001\uf002\uf003y"
    for glyph, name in steps.items():
        by_steps = by_steps.replace(glyph, name)
    assert text.translate(layout.transducer(steps)) == by_steps == "xabbc\uf001y"
    with pytest.raises(ValueError, match="single"):
        layout.transducer({"ab": "c"})


def test_other_vendors_keep_their_glyphs(spark):
    row = spark.range(1).select(layout.map_glyphs(F.lit("x\uf0ae"), F.lit("other")).alias("t")).first()
    assert row["t"] == "x\uf0ae"
