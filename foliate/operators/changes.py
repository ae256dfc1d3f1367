"""What a section is made from, as a digest, and the sections whose digest a manifest does not have."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MANIFEST = "vendor string, slug string, digest string, started boolean"


def _sums(*columns: Column) -> list[Column]:
    """128 bits of the rows of a group that don't depend on their order: two sums of hashes."""
    return [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38, 0)")).alias(f"h{seed}") for seed in (1, 2)]


def page_digests(*sources: DataFrame) -> DataFrame:
    """``(vendor, page, h1, h2)`` of all rows of the sources (vendor, page, ...) on each page, whichever columns they have."""
    parts = [s.groupBy("vendor", "page").agg(*_sums(F.lit(i), *[F.col("`" + c.replace("`", "``") + "`") for c in s.columns])) for i, s in enumerate(sources)]
    return reduce(DataFrame.unionByName, parts).groupBy("vendor", "page").agg(*[F.sum(h).alias(h) for h in ("h1", "h2")])


def section_digests(sections: DataFrame, sub_headings: DataFrame, pages: DataFrame, settings: str = "") -> DataFrame:
    """``sections`` with ``digest``, which changes with the section's entry, sub-headings, pages, what follows it, or the settings.

    ``pages`` as page_digests makes them. Sections list their pages, so they meet them by equality; only digests travel.
    """
    own = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("num", "title", "cat", "page", "page_end")]
    subs = sub_headings.groupBy("vendor", "slug").agg(*_sums(F.lit("sub"), F.col("pos"), F.col("level"), F.col("title")))
    on = sections.select("vendor", "slug", F.explode(F.sequence("page", "page_end")).alias("page")).join(pages, ["vendor", "page"])
    parts = on.select("vendor", "slug", "h1", "h2").unionByName(subs).groupBy("vendor", "slug").agg(*[F.sum(h).cast("string").alias(h) for h in ("h1", "h2")])
    following = sections.select("vendor", (F.col("ord") - 1).alias("ord"), F.concat_ws("\1", "num", "title", "page").alias("_next"))
    met = sections.join(following, ["vendor", "ord"], "left").join(parts, ["vendor", "slug"], "left")
    digest = F.sha2(F.concat_ws("\1", F.lit(settings), *own, *[F.coalesce(c, F.lit("")) for c in ("_next", "h1", "h2")]), 256)
    return met.withColumn("digest", digest).drop("_next", "h1", "h2")


def skip_unchanged(sections: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sections (with ``digest``) that the manifest does not have as they are."""
    return sections.join(manifest.select("vendor", "slug", "digest"), ["vendor", "slug", "digest"], "left_anti")
