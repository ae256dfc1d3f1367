"""The audit job: findings as a table, and whether the corpus passes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import audit


def run(pages: DataFrame, images: DataFrame, out: str) -> bool:
    """Writes the findings below ``out`` and tells whether there are no errors."""
    audit.audit(pages, images).write.mode("overwrite").parquet(out)
    return audit.verdict(pages.sparkSession.read.parquet(out)).first()["passes"]
