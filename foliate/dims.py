"""Dimensions of a corpus and the site it is published on. All are parameters; these are defaults."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Category ids and labels, in their order.
CATEGORIES = (
    ("setup", "導入・画面・基本操作"),
    ("project", "プロジェクト管理"),
    ("hardware", "ハードウェア構成・パラメータ"),
    ("variables", "変数・デバイス"),
    ("programming", "プログラミング"),
    ("transfer", "接続・転送"),
    ("debug", "モニタ・デバッグ・シミュレーション"),
    ("maintenance", "保守・セキュリティ・運用"),
    ("reference", "リファレンス・付録"),
)
VENDORS = (("alpha", "Alpha Works", "Alpha"), ("beta", "Beta Studio", "Beta"), ("gamma", "Gamma Studio", "Gamma"))
COMMON = "common"
DEFAULT_CATEGORY = "reference"


@dataclass(frozen=True)
class Site:
    url: str = "https://docs.example.org/manuals/"
    name: str = "Manuals"
    top_title: str = "Manuals — one structure for all vendors"
    description: str = "Vendor manuals in one structure."
    language: str = "ja"
    built: str = "2024-01-01"


def categories(spark: SparkSession, rows=CATEGORIES) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "cat_ord int, id string, label string")


def vendors(spark: SparkSession, rows=VENDORS) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "vendor_ord int, id string, label string, company string")


def labelled(key: Column, rows) -> Column:
    """The label of an id from a fixed dimension, or the id itself."""
    pairs = [F.lit(x) for r in rows for x in (r[0], r[1])]
    return F.coalesce(F.create_map(*pairs)[key], key)


def vendor_label(key: Column, rows=VENDORS) -> Column:
    """``label(company)``, or the id itself."""
    pairs = [F.lit(x) for r in rows for x in (r[0], f"{r[1]}({r[2]})")]
    return F.coalesce(F.create_map(*pairs)[key], key)
