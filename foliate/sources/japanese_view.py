"""Pages with Japanese defects, made from ``documents``: what the cleaning and audit rules are about.

A page is the whole text of a document and, after it, one of the ``CASES``, by doc_id. A case is what
stands on the page, what cleaning makes of it, and the rules that it breaks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Case:
    """``before`` and ``after`` the line rules, ``joined`` after the block passes too; ``counts`` of the five passes."""

    before: str
    after: str
    joined: str
    counts: tuple[int, int, int, int, int] = (0, 0, 0, 0, 0)


def _same(before: str, after: str, counts: tuple[int, ...] = (0, 0, 0, 0, 0)) -> Case:
    return Case(before, after, after, counts)


#: Blocks of a case are parted by blank lines, as they are on a page.
CASES = (
    _same("日本 語 と ABC の 例", "日本語とABCの例"),
    _same("《製品》 名 （ 注 ） 。", "製品名 （注）。"),
    _same("値：：1", "値：1"),
    _same("本章では、設定について説明します。", "設定をまとめます。"),
    _same("項目を以下に一覧で示します。", "項目の一覧です。"),
    _same("詳細は、以下を参照してください。", "**関連項目**"),
    _same("よくご確認ください", "よく確認してください"),
    _same("必ずお読みください。", ""),
    _same("## ■ 設定", "## 設定"),
    _same("## 2設定", "## 2 設定"),
    _same("## 2 台", "## 2台"),
    _same("| a • b |", "| a / b |"),
    _same("画面表示", "**画面の開き方**"),
    Case("設定し\n\nます。", "設定し\n\nます。", "設定します。", (1, 0, 0, 0, 0)),
    Case("設定し\n\n![a](b)\n\nます。", "設定し\n\n![a](b)\n\nます。", "設定します。\n\n![a](b)", (1, 0, 0, 0, 0)),
    Case("| a | 設定し |\n\nます。", "| a | 設定し |\n\nます。", "| a | 設定します。 |", (1, 0, 0, 0, 0)),
    Case("メニューの\n\n## [開く]\n\nを選びます", "メニューの\n\n## [開く]\n\nを選びます", "メニューの[開く]を選びます", (0, 1, 0, 0, 0)),
    Case("## 1.2 機能\n\nについて", "## 1. 2 機能\n\nについて", "## 1. 2 機能\n\n1. 2 機能について", (0, 0, 1, 0, 0)),
    Case("設定した値\n\nを保存", "設定した値\n\nを保存", "設定した値を保存", (0, 0, 1, 0, 0)),
    Case("項目 • 一 • 二", "項目 • 一 • 二", "項目\n\n- 一\n\n- 二", (0, 0, 0, 1, 0)),
    Case("ポイント", "**ポイント**", "", (0, 0, 0, 0, 1)),
    Case("本文\n\n注意\n\n## 見出し", "本文\n\n**注意**\n\n## 見出し", "本文\n\n## 見出し", (0, 0, 0, 0, 1)),
    _same("plain line", "plain line"),
)

_CASES = "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join([str(i), *("'" + x.replace("\n", "~") + "'" for x in (c.before, c.after, c.joined)), *map(str, c.counts)]) + ")" for i, c in enumerate(CASES)) + ") t(n, before, after, joined, c1, c2, c3, c4, c5))"

#: ``(doc_id, vendor, slug, before, after, joined, c1 to c5, own)``: the cases in SQL, ``own`` being the document's text.
CASES_SQL = f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS vendor, 'p' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS slug, text AS own,
  replace(before, '~', chr(10)) AS before, replace(after, '~', chr(10)) AS after, replace(joined, '~', chr(10)) AS joined, c1, c2, c3, c4, c5
FROM documents JOIN {_CASES} ON n = doc_id % {len(CASES)} WHERE text IS NOT NULL"""


def _keyed(documents: DataFrame) -> DataFrame:
    vendor = F.when(F.col("doc_id") % 3 == 0, "alpha").when(F.col("doc_id") % 3 == 1, "beta").otherwise("gamma")
    slug = F.concat(F.lit("p"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    return documents.where("text is not null").select("doc_id", vendor.alias("vendor"), slug.alias("slug"), F.col("text").alias("own"))


def _one_of(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))[F.pmod("doc_id", F.lit(len(values))).cast("int")]


def pages(documents: DataFrame) -> DataFrame:
    """``(doc_id, vendor, slug, text)``."""
    text = F.concat("own", F.lit("\n\n"), _one_of(tuple(c.before for c in CASES)), F.lit("\n"))
    return _keyed(documents).select("doc_id", "vendor", "slug", text.alias("text"))


#: What breaks a rule: text, rule, severity, the line of the text that is reported (0: none), how often, detail.
FAULTS = (
    ("[開く\n\n![図](https://example.com/a.png)", "Q10 split label", "error", 0, 1),
    ("注意", "Q12 bare label", "error", 0, 1),
    ("本文\nださい。", "Q17 detached fragment", "warning", 2, 1),
    ("択", "Q17 detached fragment", "warning", 1, 1),
    ("次を参照してく", "Q18 truncated ending", "warning", 1, 1),
    ("本書と本マニュアルの本書", "Q19 manual self-reference", "warning", 0, 3),
    ("本章では設定を説明します", "Q19 manual-style introduction", "warning", 0, 1),
    ("《製品》", "Q19 ornamental product brackets", "warning", 0, 2),
    ("a • b", "Q19 raw bullet glyph", "warning", 0, 1),
    ("nothing wrong", "", "", 0, 0),
    ("", "Q1 invalid UTF-8", "error", 0, 1),
)
_FAULTS = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, '{rule}', '{severity}', {line}, {n})" for i, (_, rule, severity, line, n) in enumerate(FAULTS)) + ") t(k, rule, severity, line, n))"
FAULTS_SQL = f"""SELECT CASE doc_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS vendor, 'p' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS slug, rule, severity,
  CAST(CASE WHEN line = 0 THEN 0 ELSE 4 + len(string_split(text, chr(10))) + line END AS INTEGER) AS line_no, CAST(n AS BIGINT) AS n, '' AS detail
FROM documents JOIN {_FAULTS} ON k = doc_id % {len(FAULTS)} WHERE text IS NOT NULL AND rule <> ''"""


def contents(documents: DataFrame) -> DataFrame:
    """``(doc_id, vendor, slug, content)``: pages with front matter and one of the ``FAULTS``, as bytes; some are not UTF-8."""
    number = F.col("doc_id").cast("string")
    head = F.concat(F.lit("---\nvendor: "), F.col("vendor"), F.lit('\nid: "'), number, F.lit('"\nnum: "'), number, F.lit('"\ntitle: "T"\ncategory: setup\nsource: "M pp.1-2"\n---\n\n# '), number, F.lit(" T\n\n"))
    text = F.concat(head, F.col("own"), F.lit("\n\n"), _one_of(tuple(f[0] for f in FAULTS)), F.lit("\n"))
    broken = F.when(F.pmod("doc_id", F.lit(len(FAULTS))) == len(FAULTS) - 1, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    return _keyed(documents).select("doc_id", "vendor", "slug", F.concat(text.cast("binary"), broken).alias("content"))
