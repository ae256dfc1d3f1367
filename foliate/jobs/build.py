"""The index job: navigation, search documents and the agent index, written as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import Site
from ..operators import index, site
from ..sources.pages import write_agent_index, write_nav, write_search


def run(pages: DataFrame, common: DataFrame, out: str, vendors: DataFrame, categories: DataFrame, config: Site = Site()) -> None:
    """Writes ``nav``, ``search``, ``agent_index`` and ``sitemap`` below ``out``."""
    rows = index.entries(pages)
    write_nav(index.nav_rows(rows), f"{out}/nav")
    write_search(index.search_docs(pages, common), f"{out}/search")
    write_agent_index(index.agent_index(rows, vendors, categories), f"{out}/agent_index")
    site.sitemap(site.routes(rows, categories), config).write.mode("overwrite").json(f"{out}/sitemap")


def head(pages: DataFrame, config: Site = Site()) -> DataFrame:
    """``(vendor, slug, head, previous_slug, next_slug)``: what each vendor page is published with."""
    rows = index.entries(pages)
    docs = site.with_source(index.search_docs(pages), rows)
    return site.head_tags(site.page_metadata(docs, config), config).join(site.neighbours(rows), ["vendor", "slug"]).select("vendor", "slug", F.col("head"), "previous_slug", "next_slug")
