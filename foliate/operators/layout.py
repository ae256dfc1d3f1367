"""From text spans and boxes to the items of a page in reading order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from operator import and_
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import rstrip, strip
from ..layout_config import LAYOUTS, Layout, glyph_map

# Least sizes of figures, how far they may lie in a table, and when two are one.
RASTER_SIZE, VECTOR_SIZE = (100, 40), (150, 60)
RASTER_IN_TABLE, VECTOR_IN_TABLE = 0.6, 0.4
VECTOR_ITEMS = 6
IN_BODY, OF_PAGE, SAME_FIGURE, COVERED = 0.5, 0.92, 0.25, 0.5
TABLE_MARGIN, FIGURE_MARGIN = 2, 1
#: Side and number of the tiles, either way, that boxes of a page are filed under.
TILE, TILES = 64, 32
ROW_GAP, CLOSE_GAP, LABEL_CHARS, LARGE = 3, 10, 24, 11.5


class Rect(NamedTuple):
    x0: float
    y0: float
    x1: float
    y1: float

    @property
    def area(self) -> float:
        return max(0.0, self.x1 - self.x0) * max(0.0, self.y1 - self.y0)

    def shared(self, other: Rect) -> float:
        return Rect(max(self.x0, other.x0), max(self.y0, other.y0), min(self.x1, other.x1), min(self.y1, other.y1)).area

    def around(self, other: Rect) -> Rect:
        return Rect(min(self.x0, other.x0), min(self.y0, other.y0), max(self.x1, other.x1), max(self.y1, other.y1))


def config_table(spark: SparkSession, layouts: dict[str, Layout] = LAYOUTS) -> DataFrame:
    """``(vendor, bx0, by0, bx1, by1, running)``; a row for each vendor."""
    rows = [(v, *map(float, c.body_box), "|".join(c.running)) for v, c in layouts.items()]
    return spark.createDataFrame(rows, "vendor string, bx0 double, by0 double, bx1 double, by1 double, running string")


def text_lines(spans: DataFrame) -> DataFrame:
    """``(vendor, page, block, line, x0, y0, x1, y1, dir_x, text, size, bold)``: spans put together.

    Size and weight are those of spans that are not blank.
    """
    filled = strip(F.col("text")) != ""
    ordered = F.array_sort(F.collect_list(F.struct("span", "text")))
    return spans.groupBy("vendor", "page", "block", "line").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("dir_x").alias("dir_x"),
        F.array_join(F.transform(ordered, lambda s: s["text"]), "").alias("text"), F.coalesce(F.max(F.when(filled, F.col("size"))), F.lit(0.0)).alias("size"),
        F.coalesce(F.bool_or(F.when(filled, F.col("bold"))), F.lit(False)).alias("bold"),
    )


def in_body_box(rows: DataFrame, config: DataFrame) -> DataFrame:
    """Lines that run from left to right with their centre inside the vendor's body."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    met = rows.join(F.broadcast(config), "vendor").where(F.abs("dir_x") >= 0.5)
    return met.where((cx >= F.col("bx0")) & (cx <= F.col("bx1")) & (cy >= F.col("by0")) & (cy <= F.col("by1"))).select(*rows.columns)


def drop_blank(rows: DataFrame) -> DataFrame:
    return rows.where(strip(F.col("text")) != "")


def _tile(v: Column) -> Column:
    """The tile of a coordinate; what lies outside of the grid counts to its edge, so that a point in a box is always in a tile of the box."""
    return F.greatest(F.lit(0.0), F.least(F.lit(TILES - 1.0), F.floor(v / TILE))).cast("int")


def text_outside_boxes(rows: DataFrame, boxes: DataFrame) -> DataFrame:
    """Lines whose centre lies in no table and no figure of their page, margins included.

    ``boxes`` as ``taken`` makes them: vendor, page, kind (``table`` or ``figure``), x0 to y1. A box is filed under each tile of its page that it
    touches, and a line looks among the boxes of its own tile. A line without coordinates is in no box.
    """
    margin = F.when(F.col("kind") == "table", TABLE_MARGIN).otherwise(FIGURE_MARGIN)
    b = boxes.select("vendor", "page", *[(F.col(c) + s * margin).alias(f"b{c}") for c, s in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1))]).distinct().where("bx0 <= bx1 and by0 <= by1")
    for axis in "xy":
        b = b.withColumn(f"t{axis}", F.explode(F.sequence(_tile(F.col(f"b{axis}0")), _tile(F.col(f"b{axis}1")))))
    r = rows.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2})
    r = r.withColumns({"tx": _tile(F.col("cx")), "ty": _tile(F.col("cy"))})
    there = reduce(and_, [r[c] == b[c] for c in ("vendor", "page", "tx", "ty")])
    inside = there & F.col("cx").between(F.col("bx0"), F.col("bx1")) & F.col("cy").between(F.col("by0"), F.col("by1"))
    return r.join(b, inside, "left_anti").select(*rows.columns)


def _joint(a: Column, b: Column) -> Column:
    """A blank between two lines where both sides are ASCII words, else nothing."""
    return F.when(a.rlike(r"[0-9A-Za-z)\]%.,:;]\z") & b.rlike(r"\A[0-9A-Za-z(\[]"), " ").otherwise("")


def join_lines(parts: Column) -> Column:
    """An array of lines as one text."""
    return F.aggregate(F.transform(parts, rstrip), F.lit(""), lambda out, x: F.when(out == "", x).otherwise(F.concat(out, _joint(out, x), x)))


def _same_row(own: Column) -> Column:
    """Lines of a block, where one right of the other in a row is put behind it. ``own``: array of (y0, x0, y1, x1, size, text)."""
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0.0).alias("top"), F.lit(0.0).alias("low"), F.lit(0.0).alias("right"))

    def put(a: Column, n: Column) -> Column:
        last = F.element_at(a["out"], -1)
        level = F.least(n["y1"], a["low"]) - F.greatest(n["y0"], a["top"]) > (n["y1"] - n["y0"]) * 0.5
        beside = (F.size(a["out"]) > 0) & (n["size"] < LARGE) & level & (n["x0"] > a["right"] + ROW_GAP) & ~strip(last).rlike(r"\A[0-9.\-]{1,8}\z")
        label = (F.length(last) <= LABEL_CHARS) & ~F.contains(last, F.lit("。")) & ~last.rlike("[：:、，]\\z")
        mark = F.when((F.length(strip(n["text"])) <= 1) | (n["x0"] <= a["right"] + CLOSE_GAP), "").when(label, "：").otherwise(" ")
        joined = F.struct(F.concat(F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1), F.array(F.concat(last, mark, n["text"]))).alias("out"), F.least(a["top"], n["y0"]).alias("top"), F.greatest(a["low"], n["y1"]).alias("low"), n["x1"].alias("right"))
        fresh = F.struct(F.concat(a["out"], F.array(n["text"])).alias("out"), n["y0"].alias("top"), n["y1"].alias("low"), n["x1"].alias("right"))
        return F.when(F.size(a["out"]) == 0, fresh).when(beside, joined).otherwise(fresh)

    return F.aggregate(own, state, put)["out"]


def merge_same_row_lines(own: Column) -> Column:
    """The texts of ``own``, an array of lines in order, merged by row."""
    doubles = F.transform(own, lambda n: F.struct(*[n[c].cast("double").alias(c) for c in ("y0", "x0", "y1", "x1", "size")], n["text"].alias("text")))
    return _same_row(doubles)


def block_stats(rows: DataFrame) -> DataFrame:
    """``(vendor, page, block, size, bold)``: the largest font and whether any is bold."""
    return rows.groupBy("vendor", "page", "block").agg(F.max("size").alias("size"), F.bool_or("bold").alias("bold"))


def block_texts(rows: DataFrame) -> DataFrame:
    """``(vendor, page, y, x, kind, text, size, bold)``: a text item for each block of lines."""
    own = F.array_sort(F.collect_list(F.struct("line", "y0", "x0", "y1", "x1", "size", "text")))
    blocks = rows.groupBy("vendor", "page", "block").agg(own.alias("own"), F.max("size").alias("size"), F.bool_or("bold").alias("bold"))
    merged = blocks.withColumn("text", join_lines(merge_same_row_lines(F.col("own"))))
    first = F.get("own", F.lit(0))
    return merged.where(strip(F.col("text")) != "").select("vendor", "page", first["y0"].alias("y"), first["x0"].alias("x"), F.lit("text").alias("kind"), "text", "size", "bold")


def drop_running_lines(items: DataFrame, config: DataFrame) -> DataFrame:
    """Items whose text does not begin like a header or footer of the vendor."""
    met = items.join(F.broadcast(config.select("vendor", "running")), "vendor", "left")
    begins = F.rlike(strip(F.col("text")), F.concat(F.lit(r"\A(?:"), F.col("running"), F.lit(")")))
    return met.where(~F.coalesce(begins, F.lit(False))).select(*items.columns)


def taken(tables: DataFrame, figures: DataFrame) -> DataFrame:
    """The boxes of ``tables`` (those of kind ``table``) and ``figures`` that a page shows instead of their text."""
    rect = ["vendor", "page", "x0", "y0", "x1", "y1"]
    own = tables.where("kind = 'table'").select(*rect, F.lit("table").alias("kind"))
    return own.unionByName(figures.select(*rect, F.lit("figure").alias("kind")))


def items_of_lines(lines: DataFrame, tables: DataFrame, figures: DataFrame, config: DataFrame) -> DataFrame:
    """All text items outside tables and figures, from lines as ``text_lines`` makes them.

    ``tables`` as tables_of_pages makes them and ``figures`` as all_figures does: a box that no
    figure was made of hides no text.
    """
    rows = drop_blank(in_body_box(lines, config))
    return drop_running_lines(block_texts(text_outside_boxes(rows, taken(tables, figures))), config)


def page_items(spans: DataFrame, tables: DataFrame, figures: DataFrame, config: DataFrame) -> DataFrame:
    """The same from spans."""
    return items_of_lines(text_lines(spans), tables, figures, config)


def reading_order(items: DataFrame) -> DataFrame:
    """``items`` with ``seq``: by height to a tenth, then from the left."""
    return items.withColumn("seq", F.row_number().over(Window.partitionBy("vendor", "page").orderBy(F.round("y", 1), "x", "kind", "text")))


class Tiled:
    """Boxes of a page, filed under the tiles that they touch."""

    def __init__(self, boxes: Iterable[Rect] = ()):
        self.boxes: list[Rect] = []
        self.tiles: dict[tuple[int, int], list[int]] = {}
        for box in boxes:
            self.add(box)

    @staticmethod
    def _touched(r: Rect) -> Iterator[tuple[int, int]]:
        (i, k), (j, n) = ((int(max(0, min(TILES - 1, v // TILE))) for v in ends) for ends in ((r.x0, r.x1), (r.y0, r.y1)))
        return ((x, y) for x in range(i, k + 1) for y in range(j, n + 1))

    def add(self, box: Rect) -> None:
        self.boxes.append(box)
        for t in self._touched(box):
            self.tiles.setdefault(t, []).append(len(self.boxes) - 1)

    def grow(self, at: int, box: Rect) -> None:
        old = set(self._touched(self.boxes[at]))
        self.boxes[at] = box
        for t in self._touched(box):
            if t not in old:
                self.tiles.setdefault(t, []).append(at)

    def near(self, r: Rect) -> list[int]:
        """The numbers of the boxes in the tiles that ``r`` touches, in the order in which they came: all that share anything with it are among them."""
        return sorted({i for t in self._touched(r) for i in self.tiles.get(t, ())})


def figures_of(rasters: list[Rect], vectors: list[tuple[Rect, int]], tables: list[Rect], body: Rect, page: Rect) -> list[Rect]:
    """The figures of one page, see ``figure_boxes``. Boxes are compared with those of their tiles only; others share nothing with them."""
    tables_, found = Tiled(tables), Tiled()

    def fits(r: Rect, size: tuple[int, int], share: float) -> bool:
        return r.x1 - r.x0 >= size[0] and r.y1 - r.y0 >= size[1] and all(r.shared(tables[i]) <= share * r.area for i in tables_.near(r))

    images = [r for r in rasters if fits(r, RASTER_SIZE, RASTER_IN_TABLE)]
    images_ = Tiled(images)
    drawn = [r for r, n in vectors if fits(r, VECTOR_SIZE, VECTOR_IN_TABLE) and (n >= VECTOR_ITEMS or any(r.shared(images[i]) > 0 for i in images_.near(r)))]
    for r in sorted((r for r in images + drawn if r.shared(body) > IN_BODY * r.area and r.area < OF_PAGE * page.area), key=lambda r: (r.y0, r.x0)):
        at = next((k for k in found.near(r) if r.shared(found.boxes[k]) > SAME_FIGURE * min(r.area, found.boxes[k].area)), None)
        if at is None:
            found.add(r)
        else:
            found.grow(at, found.boxes[at].around(r))
    return found.boxes


def figure_boxes(boxes: DataFrame, layouts: dict[str, Layout] = LAYOUTS, page: Rect = Rect(0, 0, 595, 842)) -> DataFrame:
    """``(vendor, page, fig, x0, y0, x1, y1)`` from boxes of kinds raster, vector and table.

    Large enough, not mostly in a table, mostly in the body, not the whole page; a vector drawing
    needs a raster image in it or enough items. Each box then joins the first figure that it largely
    shares, in reading order. The boxes of one page are one row, so no page needs a task of its own.
    """
    grouped = boxes.groupBy("vendor", "page").agg(F.collect_list(F.struct("kind", "x0", "y0", "x1", "y1", "n_items")).alias("own"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for vendor, number, own in zip(frame["vendor"], frame["page"], frame["own"], strict=True):
                by = {k: [(Rect(b["x0"], b["y0"], b["x1"], b["y1"]), b["n_items"] or 0) for b in own if b["kind"] == k] for k in ("raster", "vector", "table")}
                found = figures_of([r for r, _ in by["raster"]], by["vector"], [r for r, _ in by["table"]], Rect(*layouts[vendor].body_box), page)
                out += [(vendor, number, i, *r) for i, r in enumerate(found, 1)]
            yield pd.DataFrame(out, columns=["vendor", "page", "fig", "x0", "y0", "x1", "y1"])

    return grouped.where(F.col("vendor").isin(*layouts)).mapInPandas(run, "vendor string, page int, fig int, x0 double, y0 double, x1 double, y1 double")


def _area(r: Column) -> Column:
    return F.greatest(F.lit(0.0), r["x1"] - r["x0"]) * F.greatest(F.lit(0.0), r["y1"] - r["y0"])


def _shared_area(a: Column, b: Column) -> Column:
    wide = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    return F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))


def all_figures(figures: DataFrame, tables: DataFrame) -> DataFrame:
    """``(vendor, page, fig, x0, y0, x1, y1)``: the figures, then the tables of kind ``figure``.

    Such a table is left out if a figure before it covers more than half of it.
    """
    rect = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    rows = figures.select("vendor", "page", F.lit(0).alias("late"), "fig", *rect)
    rows = rows.unionByName(tables.where("kind = 'figure'").select("vendor", "page", F.lit(1).alias("late"), F.col("number").alias("fig"), *rect))
    own = rows.groupBy("vendor", "page").agg(F.array_sort(F.collect_list(F.struct("late", "fig", "x0", "y0", "x1", "y1"))).alias("own"))
    none = F.array().cast("array<struct<late: int, fig: int, x0: double, y0: double, x1: double, y1: double>>")

    def put(kept: Column, r: Column) -> Column:
        covered = (r["late"] == 1) & F.exists(kept, lambda g: _shared_area(r, g) > COVERED * _area(r))
        return F.when(covered, kept).otherwise(F.concat(kept, F.array(r)))

    kept = own.select("vendor", "page", F.posexplode(F.aggregate("own", none, put)).alias("at", "f"))
    return kept.select("vendor", "page", (F.col("at") + 1).alias("fig"), "f.x0", "f.y0", "f.x1", "f.y1")


def figure_names(figures: DataFrame) -> DataFrame:
    """Figures of sections ``(vendor, slug, page, fig)`` with ``seq`` and ``name``: ``<slug>-NN.webp``."""
    seq = F.row_number().over(Window.partitionBy("vendor", "slug").orderBy("page", "fig"))
    two = F.when(F.col("seq") < 10, F.concat(F.lit("0"), F.col("seq").cast("string"))).otherwise(F.col("seq").cast("string"))
    return figures.withColumn("seq", seq).withColumn("name", F.concat("slug", F.lit("-"), two, F.lit(".webp")))


def transducer(glyphs: dict[str, str]) -> dict[int, str]:
    """A map of single characters as one table: what each becomes once it and, in what it has become, all later entries have been replaced."""
    if any(len(g) != 1 for g in glyphs):
        raise ValueError("glyphs are single characters")
    out: dict[int, str] = {}
    for glyph, name in reversed(glyphs.items()):
        out[ord(glyph)] = name.translate(out)
    return out


def map_glyphs(text: Column, vendor: Column, vendors: tuple[str, ...] = tuple(LAYOUTS)) -> Column:
    """Private-use glyphs as text, by the vendor's map; those that it lacks stay. A text is gone through once, however large the map is."""
    maps = {v: transducer(glyph_map(v)) for v in vendors}

    @F.pandas_udf("string")
    def mapped(texts: pd.Series, of: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or t.isascii() else t.translate(maps.get(v, {})) for t, v in zip(texts, of, strict=True)], dtype=object)

    return mapped(text, vendor)
