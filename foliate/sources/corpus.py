"""A corpus of pages that is updated in place: merges write the buckets they change, and a snapshot says which files count.

Below a corpus's folder, ``merge=<m>/bucket=<b>`` holds pages and ``_snapshots/<version>`` says which
buckets of which merges count. A merge writes whole new buckets beside the old ones and only then its snapshot,
so a merge that fails changes nothing, and readers of an older snapshot keep their files until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import BLOCKS, materialize, scratch_removed, shuffles_removed

#: A new corpus has so many buckets that each holds about so many bytes of text, and these at least. Pages are dealt to them by a hash of vendor and slug.
BUCKET_BYTES, LEAST_BUCKETS = 1 << 30, 16
PAGES = "vendor string, slug string, text string"
#: What is stored: a page, and a digest of its text that merges compare with.
_STORED = f"{PAGES}, digest binary"


class Conflict(RuntimeError):
    """Another merge has written the snapshot that this one was to write."""


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """The snapshots of a corpus, oldest first; none where there is no corpus yet."""
    at, fs = _files(spark, f"{root}/_snapshots")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n) for n in names if n.isdigit())


def _snapshot(spark: SparkSession, root: str, version: int | None) -> dict:
    if version is None:
        return {"buckets": 0, "merges": {}}
    return json.loads("\n".join(r[0] for r in spark.read.option("wholetext", "true").text(f"{root}/_snapshots/{version}").collect()))


def _publish(spark: SparkSession, root: str, version: int, snapshot: dict) -> None:
    """Written under another name and renamed: a snapshot is there whole or not at all."""
    (draft, fs), (final, _) = _files(spark, f"{root}/_snapshots/_{uuid.uuid4().hex}"), _files(spark, f"{root}/_snapshots/{version}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(snapshot).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise Conflict(f"{root} has a version {version} already")


def _stored(spark: SparkSession, root: str, snapshot: dict, only: list[int] | None = None) -> DataFrame:
    """The pages of a snapshot, or of some of its buckets, with ``bucket``; other buckets' files are not read."""
    merges = {m: [b for b in own if only is None or b in only] for m, own in snapshot["merges"].items()}
    merges = {m: own for m, own in merges.items() if own}
    if not merges:
        return spark.createDataFrame([], f"{_STORED}, bucket int")
    rows = spark.read.schema(f"{_STORED}, merge string, bucket int").option("basePath", root).parquet(*[f"{root}/merge={m}" for m in merges])
    live = reduce(or_, [(F.col("merge") == m) & F.col("bucket").isin(own) for m, own in merges.items()])
    return rows.where(live).drop("merge")


def read_corpus(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """``(vendor, slug, text)`` of the newest snapshot, or of an older one; no rows where there is no corpus yet."""
    there = versions(spark, root)
    if version is not None and version not in there:
        raise ValueError(f"{root} has no version {version}")
    return _stored(spark, root, _snapshot(spark, root, version or (there[-1] if there else None))).select("vendor", "slug", "text")


def merge_pages(pages: DataFrame, root: str, buckets: int | None = None, written: bool = False) -> int | None:
    """Puts ``pages`` (vendor, slug, text) into the corpus and returns its version, a new one only if a page is new or differs.

    Pages that ``pages`` does not name stay. Texts are compared by SHA-256; buckets without a change are neither read whole nor
    written. Of several rows for one page the greatest text counts, null being least; a null vendor or slug is a key like any other.
    ``buckets`` holds for a corpus that is not there yet, and else follows from its texts' size; it stays. ``pages`` is computed once,
    or is a table already (``written``), of which no copy is made. None: there is neither a corpus nor a page.
    """
    spark = pages.sparkSession
    there = versions(spark, root)
    last = there[-1] if there else None
    old = _snapshot(spark, root, last)
    with scratch_removed(spark):
        given = pages.select("vendor", "slug", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
        if not written:
            given = materialize(given, "given-pages", "zstd")
        count = old["buckets"] or buckets or max(LEAST_BUCKETS, -(-(given.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // BUCKET_BYTES))
        given = given.withColumn("bucket", F.pmod(F.xxhash64("vendor", "slug"), F.lit(count)).cast("int"))
        known = _stored(spark, root, old).select(*[F.col(c).alias(f"_{c}") for c in ("vendor", "slug", "digest")])
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("vendor", "slug", "digest")]
        # Keys and digests only; which rows are fresh is seen once more where the texts meet.
        with shuffles_removed(spark):
            touched = sorted(r["bucket"] for r in given.drop("text").join(known, same[0] & same[1] & same[2], "left_anti").select("bucket").distinct().collect())  # no more rows than there are buckets
        if not touched:
            return last
        merge = uuid.uuid4().hex
        blocks = (_merged(_stored(spark, root, old, own), given.where(F.col("bucket").isin(own))) for own in filter(None, (touched[b::BLOCKS] for b in range(BLOCKS))))
        for block in blocks:  # the shuffle files of one go before the next one's are made
            with shuffles_removed(spark):
                block.write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(f"{root}/merge={merge}")
    left = {m: sorted(set(own) - set(touched)) for m, own in old["merges"].items()}
    now = {"buckets": count, "merges": {m: own for m, own in left.items() if own} | {merge: touched}}
    _publish(spark, root, (last or 0) + 1, now)
    return (last or 0) + 1


def _merged(old: DataFrame, given: DataFrame) -> DataFrame:
    """The rows of some buckets after a merge: a given row whose page has its digest already is not fresh, and fresh ones go before the old one."""
    rows = old.withColumn("given", F.lit(False)).unionByName(given.withColumn("given", F.lit(True)))
    # One exchange of the texts, by bucket and a share of its pages; the windows keep to it.
    rows = rows.withColumn("_share", F.pmod(F.hash("vendor", "slug"), F.lit(BLOCKS))).repartition("bucket", "_share")
    page = Window.partitionBy("bucket", "_share", "vendor", "slug")
    rows = rows.withColumns({"_known": F.max(~F.col("given")).over(page), "_digest": F.max(F.when(~F.col("given"), F.col("digest"))).over(page)})
    rows = rows.withColumn("fresh", F.col("given") & ~(F.col("_known") & F.col("digest").eqNullSafe(F.col("_digest"))))
    newest = page.orderBy(F.desc("fresh"), F.desc("text"))
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select("vendor", "slug", "text", "digest", "bucket")


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Deletes all snapshots but the ``keep`` newest and the bucket folders that none of these names, failed merges' too; how many folders (of buckets or whole merges) went.

    Only when no merge is running.
    """
    there = versions(spark, root)
    named = {(m, b) for v in there[-keep:] for m, own in _snapshot(spark, root, v)["merges"].items() for b in own}
    for v in there[:-keep]:
        at, fs = _files(spark, f"{root}/_snapshots/{v}")
        fs.delete(at, False)
    at, fs = _files(spark, root)
    gone = 0
    for merge in fs.listStatus(at) if fs.exists(at) else []:
        if not (name := merge.getPath().getName()).startswith("merge="):
            continue
        m = name.removeprefix("merge=")
        if m not in {name for name, _ in named}:
            fs.delete(merge.getPath(), True)
            gone += 1
            continue
        for bucket in fs.listStatus(merge.getPath()):
            name = bucket.getPath().getName()
            if name.startswith("bucket=") and (m, int(name.removeprefix("bucket="))) not in named:
                fs.delete(bucket.getPath(), True)
                gone += 1
    return gone
