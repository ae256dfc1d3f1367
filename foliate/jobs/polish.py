"""The cleaning job: overlap, lines, blocks, heading."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import BLANK
from ..operators import blocks, clean
from ..operators.parse import split_front_matter
from ..sources.corpus import merge_pages
from ..sources.scratch import materialize, scratch_removed


def polish(pages: DataFrame) -> DataFrame:
    """``(vendor, slug, text, overlap, changed, counters ...)`` of all pages; nothing is written.

    ``changed`` compares with what is left after the overlap has gone.
    """
    trimmed = clean.trim_overlap(pages)
    rows = blocks.polish_bodies(split_front_matter(trimmed).withColumn("before", F.col("text")))
    body = F.regexp_replace(clean.canonical_h1(F.col("fm"), F.col("body")), r"\A\n+", "")
    head = F.when(F.col("has_fm"), F.concat(F.lit("---\n"), "fm", F.lit("\n---\n"))).otherwise("")
    out = rows.withColumn("text", F.concat(head, F.lit("\n"), body))
    return out.select("vendor", "slug", "text", "overlap", (F.col("text") != F.col("before")).alias("changed"), *blocks.COUNTERS)


def counted(done: DataFrame, name: str = "polished") -> tuple[DataFrame, DataFrame]:
    """``done`` as a table, and the totals of the job, observed while it is written: pages are cleaned once for both.

    The rows pass the counters in the stage that writes them, so a task that is tried again counts once.
    """
    seen = Observation()
    table = materialize(done.observe(seen, *blocks.totals()), name, "zstd")
    kinds = {f.name: f.dataType for f in blocks.counter_totals(table).schema}
    totals = table.sparkSession.createDataFrame([tuple(seen.get.get(c, 0) for c in kinds)], ", ".join(f"{c} {k.simpleString()}" for c, k in kinds.items()))
    return table, totals


def run(pages: DataFrame, out: str, dry_run: bool = False) -> DataFrame:
    """Merges the cleaned pages into the corpus at ``out``, unless it is a dry run, and returns the totals.

    Pages of the corpus that are not among ``pages``, and those that come out as they are stored, stay untouched.
    """
    with scratch_removed(pages.sparkSession):
        done, totals = counted(polish(pages))
        if not dry_run:
            merge_pages(done, out, written=True)
    return totals
