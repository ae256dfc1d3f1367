"""Positions and neighbours in a long order without sorting a whole part in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def with_stretches(df: DataFrame, outer: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``stretch``: ranges of the order (outer columns first) of about equal size, whatever values are frequent.

    The ranges come from a sample, so the table is written: all that reads it sees the same ones.
    """
    return materialize(df.repartitionByRange(*outer, *order).withColumn("stretch", F.spark_partition_id()), "stretches")


def running_last(df: DataFrame, outer: list[str], stretch: Column, order: list[Column], values: dict[str, Column], backwards: bool = False, inclusive: bool = True) -> DataFrame:
    """``df`` with, for each name of ``values``, the last value that isn't null so far, in each outer part.

    ``stretch`` goes with the order: rows are ordered within a stretch only, and a table with one row
    for each stretch carries values over. ``backwards``: the order, of stretches too, runs from the
    highest down; ``order`` says so itself for its columns. Without ``inclusive`` a row's own value
    does not count.
    """
    rows = df.withColumns({"_stretch": stretch, **{f"_v_{k}": v for k, v in values.items()}})
    within = Window.partitionBy(*outer, "_stretch").orderBy(*order)
    up_to = within.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = rows.withColumns({f"_n_{k}": F.last(f"_v_{k}", ignorenulls=True).over(up_to) for k in values}).withColumn("_at", F.row_number().over(within))
    ends = rows.groupBy(*outer, "_stretch").agg(*[F.max_by(f"_v_{k}", F.when(F.col(f"_v_{k}").isNotNull(), F.col("_at"))).alias(f"_e_{k}") for k in values])
    across = Window.partitionBy(*outer).orderBy(F.desc("_stretch") if backwards else F.asc("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*outer, "_stretch", *[F.last(f"_e_{k}", ignorenulls=True).over(across).alias(f"_e_{k}") for k in values])
    out = rows.join(ends, [*outer, "_stretch"])
    out = out.withColumns({k: F.coalesce(f"_n_{k}", f"_e_{k}") for k in values})
    return out.drop("_stretch", "_at", *[f"_{x}_{k}" for x in "vne" for k in values])


def in_order(df: DataFrame, outer: list[str], group: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """``df`` with ``position`` (a long, from 1 in each outer part) and ``previous_x`` / ``next_x`` for each x of ``values``.

    ``group`` columns come first in the order, ``order`` columns after them. Rows are ordered within
    their group only; a table with one row for each group holds where it begins and what stands at
    its ends. Nulls sort first.
    """
    own = F.struct(*[v.alias(k) for k, v in values.items()])
    within = Window.partitionBy(*outer, *group).orderBy(*order)
    rows = df.withColumn("_own", own).withColumns(
        {"_n": F.row_number().over(within), "_back": F.lag("_own").over(within), "_on": F.lead("_own").over(within)}
    )
    ends = rows.groupBy(*outer, *group).agg(F.max("_n").alias("_size"), F.min_by("_own", "_n").alias("_first"), F.max_by("_own", "_n").alias("_last"))
    across = Window.partitionBy(*outer).orderBy(*group)
    ends = ends.withColumns(
        {
            "_before": F.coalesce(F.sum("_size").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_before_last": F.lag("_last").over(across),
            "_after_first": F.lead("_first").over(across),
        }
    ).select(*outer, *group, "_before", "_before_last", "_after_first")
    keys = [*outer, *group]
    renamed = ends.select(*[F.col(k).alias(f"_{k}") for k in keys], "_before", "_before_last", "_after_first")
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = rows.join(renamed, match)
    joined = joined.withColumns({"_back": F.coalesce("_back", "_before_last"), "_on": F.coalesce("_on", "_after_first")})
    out = joined.withColumn("position", F.col("_n") + F.col("_before"))
    for k in values:
        out = out.withColumn(f"previous_{k}", F.col("_back")[k]).withColumn(f"next_{k}", F.col("_on")[k])
    return out.drop("_own", "_n", "_back", "_on", "_before", "_before_last", "_after_first", *[f"_{k}" for k in keys])
