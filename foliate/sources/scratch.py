"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scratch tables made so far, for ``scratch_removed``.
_made: list[str] = []
_own: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where the session names none, a temporary folder in local mode, and else the warehouse.

    On a cluster a folder of one machine would lose tables, so a warehouse there is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="foliate-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        return _own[0]
    base = spark.conf.get("spark.sql.warehouse.dir")
    if urlparse(base).scheme in ("", "file"):
        raise ValueError(f"executors may not share {base}: set spark.checkpoint.dir to a folder that all machines reach")
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a table."""
    _made.append(f"{scratch_dir(spark)}/foliate/{name}-{uuid.uuid4().hex}")
    return _made[-1]


#: Whether Spark deletes the shuffle files of a query when it has ended, and not only once the driver collects its garbage.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside the block leaves no shuffle files behind."""
    before = spark.conf.get(_CLEANED)
    spark.conf.set(_CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANED, before)


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends at that table, and its shuffle files go."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write if compression is None else df.write.option("compression", compression)
    with shuffles_removed(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_in_blocks(blocks: Iterable[DataFrame], name: str, compression: str = "zstd") -> DataFrame:
    """The rows of all ``blocks``, of one schema, as one table. They are made one after another, so that only the shuffle files of one are there at a time."""
    path = ""
    for df in blocks:
        path = path or scratch_path(df.sparkSession, name)
        with shuffles_removed(df.sparkSession):
            df.write.option("compression", compression).mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Into so many blocks pages, or sections, are dealt that are made one after another.
BLOCKS = 4


def blocks_of(keys: Iterable[str], make: Callable[[Callable[[DataFrame], DataFrame]], DataFrame]) -> Iterator[DataFrame]:
    """``make`` for each block of keys: what it is given takes a table and leaves the rows of that block."""
    for b in range(BLOCKS):
        yield make(lambda df, b=b: df.where(F.pmod(F.xxhash64(*keys), F.lit(BLOCKS)) == b))


@contextlib.contextmanager
def scratch_removed(spark: SparkSession, keep: Iterable[str] = ()) -> Iterator[None]:
    """Deletes the scratch tables made inside the block when it ends, but for those named in ``keep``; results must have been written by then."""
    before = len(_made)
    try:
        yield
    finally:
        path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        left = [made for made in _made[before:] if made.rsplit("/", 1)[1][:-33] in keep]
        for made in _made[before:]:
            if made not in left:
                path = path_of(made)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _made[before:] = left
