"""The extraction job: from tables of contents and page layout to Markdown pages and a catalog."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..layout_config import LAYOUTS, Layout
from ..operators import assemble, changes, layout, tables, toc
from ..sources import corpus
from ..sources.pages import write_catalog
from ..sources.scratch import BLOCKS, blocks_of, materialize, materialize_in_blocks, scratch_removed


def manifest_of(spark: SparkSession, out: str) -> DataFrame:
    """``changes.MANIFEST``: the sections that are done, and what they were made from."""
    rows = corpus.read_corpus(spark, f"{out}/manifest")
    return rows.select("vendor", "slug", F.from_json("text", "digest string, started boolean").alias("m")).select("vendor", "slug", "m.*")


def pages_of(spark: SparkSession, out: str) -> DataFrame:
    """``(vendor, slug, text, started)``: the pages of the sections that are done; none where there is no such corpus yet."""
    return corpus.read_corpus(spark, f"{out}/pages").join(manifest_of(spark, out).drop("digest"), ["vendor", "slug"])


#: What a block of pages is dealt by, and the sections that a block has at least.
PAGE, LEAST_SECTIONS = ("vendor", "page"), 500


def boxes_of_pages(lines: DataFrame, boxes: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables and the figures of all pages; ``lines`` as text_lines makes them, ``boxes`` of the kinds raster and vector."""
    # In blocks: the shuffles of all cells and lines would take several times the disk of the tables.
    found = materialize_in_blocks(blocks_of(PAGE, lambda of: tables.tables_of_pages(of(cells), of(lines), of(boxes))), "tables")
    rect = ["vendor", "page", "kind", "x0", "y0", "x1", "y1"]
    own = found.where("kind = 'table'").select(*rect, F.lit(0).alias("n_items"))
    figures = layout.figure_boxes(boxes.where("kind <> 'table'").select(*rect, "n_items").unionByName(own))
    return found, materialize(layout.all_figures(figures, found), "figures")


def items_of_pages(lines: DataFrame, found: DataFrame, figures: DataFrame, layouts: dict[str, Layout] = LAYOUTS) -> DataFrame:
    """``layout.items_of_lines`` as a table."""
    config = layout.config_table(lines.sparkSession, layouts)
    return materialize_in_blocks(blocks_of(PAGE, lambda of: layout.items_of_lines(of(lines), of(found), of(figures), config)), "items")


def _section_blocks(sections: DataFrame, only: DataFrame | None) -> Iterator[tuple[DataFrame, Column]]:
    """The (vendor, slug) of each block of sections that follow each other, and a condition that holds for all of their pages."""
    wanted = sections if only is None else sections.join(only.select("vendor", "slug"), ["vendor", "slug"], "left_semi")
    keys = wanted.groupBy("vendor", "slug").agg(F.min("page").alias("page"), F.max("page_end").alias("page_end"))
    few = max(1, min(BLOCKS, keys.count() // LEAST_SECTIONS))
    cuts = {r["vendor"]: r["cuts"] for r in keys.groupBy("vendor").agg(F.percentile_approx("page", [i / few for i in range(1, few)] or [1.0]).alias("cuts")).collect()}
    block = F.lit(few - 1)
    for vendor, ends in cuts.items():
        for b, end in reversed(list(enumerate((ends or ())[: few - 1]))):
            block = F.when((F.col("vendor") == vendor) & (F.col("page") <= end), b).otherwise(block)
    keys = keys.withColumn("block", block)
    ends = keys.groupBy("block", "vendor").agg(F.min("page").alias("low"), F.max("page_end").alias("high")).collect()
    for b in range(few):
        pages = [(F.col("vendor") == r["vendor"]) & F.col("page").between(r["low"], r["high"]) for r in ends if r["block"] == b and r["low"] is not None]
        yield keys.where(F.col("block") == b).select("vendor", "slug"), reduce(or_, pages, F.lit(False))


def pages_of_sections(sections: DataFrame, items: DataFrame, subs: DataFrame, found: DataFrame, figures: DataFrame, layouts: dict[str, Layout] = LAYOUTS, only: DataFrame | None = None) -> DataFrame:
    """``assemble.assemble`` as a table, made in blocks of sections from the pages that these have."""
    blocks = (assemble.assemble(sections, items.where(on), subs, found.where(on), figures.where(on), layouts, only=own) for own, on in _section_blocks(sections, only))
    return materialize_in_blocks(blocks, "sections-made")


def run(
    contents: DataFrame, page_counts: DataFrame, spans: DataFrame, boxes: DataFrame, cells: DataFrame, out: str,
    layouts: dict[str, Layout] = LAYOUTS, schemes: dict[str, toc.Scheme] = toc.SCHEMES,
) -> DataFrame:
    """Makes the sections that are new or were made from something else, writes the catalog of all as ``out/catalog``, and returns its outliers.

    ``contents``: (vendor, pos, level, title, page). Pages are merged into the corpus ``out/pages`` and only then the sections'
    digests into ``out/manifest``: a section counts as done once both are there, so a run that failed is simply repeated.
    """
    spark = contents.sparkSession
    with scratch_removed(spark):
        entries = materialize(contents, "toc")
        sections = materialize(toc.build_sections(entries, page_counts, schemes), "sections")
        subs = materialize(toc.sub_headings(sections, entries), "sub-headings")
        known = changes.section_digests(sections, subs, changes.page_digests(spans, boxes, cells), repr(layouts))
        left = materialize(changes.skip_unchanged(known, manifest_of(spark, out)).select("vendor", "slug", "digest"), "left")
        if not left.isEmpty():
            lines = materialize(layout.text_lines(spans), "lines")  # read for the tables and for the items
            found, figures = boxes_of_pages(lines, boxes, cells)
            items = items_of_pages(lines, found, figures, layouts)
            made = pages_of_sections(sections, items, subs, found, figures, layouts, only=left)
            corpus.merge_pages(made, f"{out}/pages")
            done = made.join(left, ["vendor", "slug"]).select("vendor", "slug", F.to_json(F.struct("digest", "started")).alias("text"))
            corpus.merge_pages(done, f"{out}/manifest")
        write_catalog(toc.catalog(sections, pages_of(spark, out)), f"{out}/catalog")
    return toc.outliers(spark.read.json(f"{out}/catalog"))
