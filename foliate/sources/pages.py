"""Reading and writing pages, and the view that turns ``documents`` into pages."""

from __future__ import annotations

import os
import uuid
from collections import Counter
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import in_order
from .scratch import materialize


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """``(vendor, slug, content)`` of all ``root/<vendor>/<slug>.md``, by Spark's own reader, which leaves out files without bytes.

    It opens any store, but the driver holds what is listed: of more files than it has memory for, ``read_page_files`` is the reader.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(root)
    path = F.col("path")
    return files.select(F.regexp_extract(path, r"([^/]+)/[^/]+\.md$", 1).alias("vendor"), F.regexp_extract(path, r"([^/]+)\.md$", 1).alias("slug"), "content")


def decode_strict(content: Column) -> Column:
    """The text, or null where the bytes are not UTF-8."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def decode_replace(content: Column) -> Column:
    """The text, with U+FFFD for what is not UTF-8."""
    return F.make_valid_utf8(content.cast("string"))


def _opened(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{quote(os.path.abspath(root))}")


def write_page_files(pages: DataFrame, root: str, apart: bool = False) -> int:
    """Writes each page (vendor, slug, content) as ``root/<vendor>/<slug>.md``, what ``read_pages`` and ``read_page_files`` read; how many.

    Tasks write through the file system that ``root`` names, under another name first: a task that is tried again replaces its files
    whole. A null content is an empty file; a null or empty vendor or slug, or one with a slash, is an error. ``apart``: each task
    has a folder of its own below ``root``, and another one for a name that it has had, so that no folder grows with the
    corpus and rows of one name are as many files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _opened(root)
        task = TaskContext.get().partitionId()
        made: set[str] = set()
        had: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for vendor, slug, content in zip(*(batch.column(c).to_pylist() for c in ("vendor", "slug", "content")), strict=True):
                if not vendor or not slug or "/" in vendor + slug:
                    raise ValueError(f"no file can be named {vendor}/{slug}")
                base = f"{top}/{vendor}"
                if apart:
                    base = f"{top}/{task}-{had[vendor, slug]}/{vendor}"
                    had[vendor, slug] += 1
                if base not in made:
                    fs.create_dir(base, recursive=True)
                    made.add(base)
                draft = f"{base}/.{slug}.{uuid.uuid4().hex}"
                with fs.open_output_stream(draft) as out:
                    out.write(content or b"")
                fs.move(draft, f"{base}/{slug}.md")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return pages.select("vendor", "slug", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


#: Bytes of files that a task of ``read_page_files`` reads, about, and that it hands on together.
TASK_BYTES, BYTES_HELD = 1 << 26, 1 << 24


def read_page_files(spark: SparkSession, root: str) -> DataFrame:
    """``(vendor, slug, content)`` of all ``<vendor>/<slug>.md`` in the folders of ``root``, empty ones too, as ``write_page_files`` writes them.

    Tasks list these folders, each with all below it, and read the files through the file system that ``root`` names; the driver
    sees the names of the folders right below ``root`` only.
    """
    fs, top = _opened(root)
    # Without a folder there is nothing to list; the row keeps the plan the same.
    folders = [(x.base_name,) for x in fs.get_file_info(pafs.FileSelector(top, allow_not_found=True)) if x.type == pafs.FileType.Directory] or [("",)]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _opened(root)
        for batch in batches:
            for folder in filter(None, batch.column("folder").to_pylist()):
                found = fs.get_file_info(pafs.FileSelector(f"{top}/{folder}", recursive=True))
                pages = [x for x in found if x.type == pafs.FileType.File and x.base_name.endswith(".md")]
                yield pa.RecordBatch.from_arrays([pa.array([x.path for x in pages], pa.string()), pa.array([x.size for x in pages], pa.int64())], ["path", "size"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(root)
        names = ["vendor", "slug", "content"]
        rows: list[tuple[str, str, bytes]] = []
        held = 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                *_, vendor, name = path.split("/")
                with fs.open_input_stream(path) as file:
                    rows.append((vendor, name.removesuffix(".md"), file.read()))
                held += len(rows[-1][2])
                if held >= BYTES_HELD:
                    yield _batch(rows, names)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, names)

    cores = spark.sparkContext.defaultParallelism
    found = spark.createDataFrame(folders, "folder string").repartition(min(len(folders), 4 * cores)).mapInArrow(listed, "path string, size long")
    found = materialize(found, "page-names")
    tasks = max(cores, -(-(found.agg(F.sum("size")).first()[0] or 0) // TASK_BYTES))
    return found.repartition(tasks).mapInArrow(read, "vendor string, slug string, content binary")


def _batch(rows: list[tuple[str, str, bytes]], names: list[str]) -> pa.RecordBatch:
    vendors, slugs, contents = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(vendors, pa.string()), pa.array(slugs, pa.string()), pa.array(contents, pa.binary())], names)


def write_nav(nav: DataFrame, out: str) -> None:
    nav.write.mode("overwrite").json(out)


def write_search(docs: DataFrame, out: str) -> None:
    docs.write.mode("overwrite").json(out)


def write_agent_index(rows: DataFrame, out: str) -> None:
    """Lines ``(part, ord, line)`` in their order, as text; range partitions keep the order over many files."""
    rows.repartitionByRange("part", "ord").sortWithinPartitions("part", "ord").select("line").write.mode("overwrite").text(out)


def write_catalog(catalog: DataFrame, out: str) -> None:
    catalog.write.mode("overwrite").json(out)


def bridge(documents: DataFrame) -> DataFrame:
    """``(doc_id, vendor, slug, text)``: pages of three vendors with known defects, from ``documents``."""
    k = F.floor(F.col("doc_id") / 3).cast("long")
    vendor = F.when(F.col("doc_id") % 3 == 0, "alpha").when(F.col("doc_id") % 3 == 1, "beta").otherwise("gamma")
    # Only first lines travel to their neighbours, and back to the pages that end with the next one's.
    light = documents.select("doc_id", vendor.alias("vendor"), k.alias("k"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("line1"))
    light = in_order(light.withColumn("stretch", F.floor(F.col("k") / 500)), ["vendor"], ["stretch"], ["k"], {"line1": F.col("line1")})
    light = light.where("doc_id % 7 = 0").select("doc_id", "next_line1").dropDuplicates(["doc_id"])
    rows = documents.select("doc_id", F.col("text").alias("body"), k.alias("k"), vendor.alias("vendor")).join(light, "doc_id", "left")
    text = F.expr(
        """
        concat(
          CASE WHEN doc_id % 23 = 9 THEN '' ELSE concat('---\n', 'vendor: ', vendor, '\n', 'id: "', doc_id, '"\n', 'num: "', num, '"\n',
            CASE WHEN doc_id % 23 = 0 THEN '' ELSE concat('title: "', title, '"\n') END,
            'category: ', category, '\n', 'source: "Manual ', vendor, ' pp.', k * 4 + 1, '-', k * 4 + 5, '"\n', '---\n\n') END,
          '# ', num, ' ', title, CASE WHEN doc_id % 23 = 2 THEN ' (old)' ELSE '' END, '\n\n## Overview\n\n', body, '\n',
          CASE doc_id % 23
            WHEN 1 THEN '# Second title\n'
            WHEN 3 THEN '| a | b |\n|---|---|\n| 1 |\n'
            WHEN 4 THEN 'see [here]()\n'
            WHEN 5 THEN concat('![fig](images/missing-', doc_id, '.webp)\n')
            WHEN 6 THEN 'glyph \n'
            WHEN 7 THEN 'broken � text\n'
            WHEN 8 THEN '```\nx = 1\n'
            WHEN 10 THEN 'same line\nsame line\n'
            WHEN 11 THEN 'open [menu](see below)\n'
            WHEN 12 THEN '| a | b |\n|---|---|\n| 1 | x |\n'
            WHEN 13 THEN concat('![fig](images/', vendor, '/ok-', doc_id, '.webp)\n')
            WHEN 14 THEN '## ・item\n'
            ELSE '' END,
          CASE WHEN doc_id % 7 = 0 AND next_line1 IS NOT NULL THEN concat('\n', next_line1, '\ntail of the next section\n') ELSE '' END)
        """
    )
    numbered = rows.withColumns(
        {
            "category": F.expr(
                "CASE k % 9 WHEN 0 THEN 'setup' WHEN 1 THEN 'project' WHEN 2 THEN 'hardware' WHEN 3 THEN CASE vendor WHEN 'gamma' THEN 'reference' ELSE 'variables' END "
                "WHEN 4 THEN 'programming' WHEN 5 THEN 'transfer' WHEN 6 THEN 'debug' WHEN 7 THEN 'maintenance' ELSE 'reference' END"
            ),
            "title": F.expr("concat('Section ', doc_id)"),
            "num": F.expr(
                "CASE WHEN vendor = 'gamma' AND k % 17 = 0 THEN concat('A-', k) WHEN vendor = 'alpha' THEN concat(cast(floor(k / 20) + 1 AS string), '.', k % 20) "
                "ELSE concat(cast(floor(k / 20) + 1 AS string), '-', k % 20) END"
            ),
        }
    )
    return numbered.select("doc_id", "vendor", F.expr("concat('p', lpad(cast(doc_id AS string), 8, '0'))").alias("slug"), text.alias("text"))


def bridge_images(documents: DataFrame) -> DataFrame:
    """The image files that the bridge's pages may name."""
    vendor = F.when(F.col("doc_id") % 3 == 0, "alpha").when(F.col("doc_id") % 3 == 1, "beta").otherwise("gamma")
    return documents.where("doc_id % 23 = 13").select(F.concat(F.lit("images/"), vendor, F.lit("/ok-"), F.col("doc_id").cast("string"), F.lit(".webp")).alias("path"))


BRIDGE_SQL = """
  SELECT doc_id, vendor, 'p' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS slug,
    CASE WHEN doc_id % 23 = 9 THEN '' ELSE
      '---' || chr(10) || 'vendor: ' || vendor || chr(10) || 'id: "' || doc_id || '"' || chr(10) || 'num: "' || num || '"' || chr(10)
      || CASE WHEN doc_id % 23 = 0 THEN '' ELSE 'title: "' || title || '"' || chr(10) END
      || 'category: ' || category || chr(10) || 'source: "Manual ' || vendor || ' pp.' || (k * 4 + 1) || '-' || (k * 4 + 5) || '"' || chr(10)
      || '---' || chr(10) || chr(10) END
    || '# ' || num || ' ' || title || CASE WHEN doc_id % 23 = 2 THEN ' (old)' ELSE '' END || chr(10) || chr(10)
    || '## Overview' || chr(10) || chr(10) || text || chr(10)
    || CASE doc_id % 23
         WHEN 1 THEN '# Second title' || chr(10)
         WHEN 3 THEN '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 |' || chr(10)
         WHEN 4 THEN 'see [here]()' || chr(10)
         WHEN 5 THEN '![fig](images/missing-' || doc_id || '.webp)' || chr(10)
         WHEN 6 THEN 'glyph ' || chr(10)
         WHEN 7 THEN 'broken � text' || chr(10)
         WHEN 8 THEN '```' || chr(10) || 'x = 1' || chr(10)
         WHEN 10 THEN 'same line' || chr(10) || 'same line' || chr(10)
         WHEN 11 THEN 'open [menu](see below)' || chr(10)
         WHEN 12 THEN '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | x |' || chr(10)
         WHEN 13 THEN '![fig](images/' || vendor || '/ok-' || doc_id || '.webp)' || chr(10)
         WHEN 14 THEN '## ・item' || chr(10)
         ELSE '' END
    || CASE WHEN doc_id % 7 = 0 AND next_line1 IS NOT NULL THEN chr(10) || next_line1 || chr(10) || 'tail of the next section' || chr(10) ELSE '' END AS text
  FROM (
    SELECT *, 'Section ' || doc_id AS title,
      CASE k % 9 WHEN 0 THEN 'setup' WHEN 1 THEN 'project' WHEN 2 THEN 'hardware' WHEN 3 THEN CASE vendor WHEN 'gamma' THEN 'reference' ELSE 'variables' END
        WHEN 4 THEN 'programming' WHEN 5 THEN 'transfer' WHEN 6 THEN 'debug' WHEN 7 THEN 'maintenance' ELSE 'reference' END AS category,
      CASE WHEN vendor = 'gamma' AND k % 17 = 0 THEN 'A-' || k WHEN vendor = 'alpha' THEN (k // 20 + 1) || '.' || (k % 20) ELSE (k // 20 + 1) || '-' || (k % 20) END AS num,
      lead(split_part(text, chr(10), 1)) OVER (PARTITION BY vendor ORDER BY k) AS next_line1
    FROM (SELECT doc_id, text, doc_id // 3 AS k, CASE doc_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS vendor FROM documents)
  )
"""
