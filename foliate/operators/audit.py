"""Quality rules: one finding for each violation.

The rules of a page are one array, built in a single projection and exploded once; line rules work
on the page's array of lines, so nothing is shuffled by page. Only missing images need a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import COMMON, VENDORS
from ..functions.text import BLANK, lines, strip
from .parse import field, split_front_matter

ERROR, WARNING = "error", "warning"

# What a page must hold, and the patterns that it must not.
REQUIRED = ("vendor", "id", "title", "category", "source")
REPLACEMENT = "�"
PRIVATE_USE = r"[\x{E000}-\x{F8FF}]"
EMPTY_LINK = rf"\]\([{BLANK}]*\)"
LINK = r"(?<!!)\[([^\]\n]+)\]\(([^)\n]*)\)"
EXTERNAL = r"\A(?:https?://|mailto:|#)"
RELATIVE = rf"\A(?:\.\./)*[a-z0-9_./-]+\.md(?:#[^{BLANK}]+)?\z"
SPLIT_LABEL = rf"\[[^\]\n]*\n[{BLANK}]*\n!\["
HEADING_BULLET = rf"^#{{2,6}}[{BLANK}]+[・•●■]"
BARE_LABEL = r"^(?:ポイント|参考|注意|注意事項|使用上の注意|重要|警告|画面表示|表示内容)$"
SEPARATOR = rf"\A\|(?:[{BLANK}]*:?-+:?[{BLANK}]*\|)+\z"
IMAGE_TARGET = r"!\[[^\]]*\]\(([^)]+)\)"
REMOTE = r"\A(?:https?:)?//"
FENCE = "```"
DETACHED = r"\A(?:ジ[）)]|ページ[）)]|ださい。|択\z|」\z)"
TRUNCATED = r"(?:ペー|参照してく)\z"
EDITORIAL = (
    ("manual self-reference", r"本書|本マニュアル|本取扱説明書"),
    ("manual-style introduction", r"(?:本章|本節)では.{0,100}(?:説明|解説)します"),
    ("ornamental product brackets", r"[《》≪≫]"),
    ("raw bullet glyph", r"•"),
)


def _has(c: Column, pattern: str, flags: str = "Umd") -> Column:
    return F.coalesce(c.rlike(f"(?{flags}){pattern}"), F.lit(False))


def read(pages: DataFrame) -> DataFrame:
    """``pages`` with all that the rules look at. A null text is one that was not UTF-8."""
    rows = split_front_matter(pages)
    # The rule asks for a line feed after the closing rule, and so does the split.
    body = F.when(F.col("has_fm"), F.col("body"))
    return rows.withColumns(
        {
            "body": body,
            "lines": lines(body),
            "h1s": F.regexp_extract_all(body, F.lit(r"(?md)^# (.+)$"), F.lit(1)),
            **{f"f_{name}": field(F.col("fm"), name) for name in (*REQUIRED, "num")},
        }
    )


def with_lines(rows: DataFrame) -> DataFrame:
    """``(vendor, slug, line_no, line)`` from 1; for use where lines are wanted as rows."""
    return rows.select("vendor", "slug", F.posexplode("lines").alias("at", "line")).select("vendor", "slug", (F.col("at") + 1).alias("line_no"), "line")


def pipe_width(line: Column) -> Column:
    """Columns of a table line: its unescaped bars less one."""
    return F.regexp_count(line, F.lit(r"(?<!\\)\|")) - 1


def tables(all_lines: Column) -> Column:
    """Runs of lines that start with a bar: an array of ``(start, last)``, counted from 1."""
    is_row = lambda x: x.startswith("|")
    begins = F.filter(
        F.transform(all_lines, lambda x, i: F.when(is_row(x) & ((i == 0) | ~is_row(F.get(all_lines, i - 1))), i + 1)), lambda i: i.isNotNull()
    )
    ends = F.filter(
        F.transform(all_lines, lambda x, i: F.when(is_row(x) & ((i == F.size(all_lines) - 1) | ~is_row(F.get(all_lines, i + 1))), i + 1)), lambda i: i.isNotNull()
    )
    return F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("start"), b.alias("last")))


def table_findings(all_lines: Column) -> Column:
    """Starts of the malformed tables: too short, without a separator, or of uneven width."""

    def bad(t: Column) -> Column:
        own = F.slice(all_lines, t["start"], t["last"] - t["start"] + 1)
        widths = F.array_distinct(F.transform(own, pipe_width))
        return (F.size(own) < 2) | (F.size(widths) != 1) | ~F.coalesce(F.get(own, F.lit(1)).rlike(f"(?U){SEPARATOR}"), F.lit(False))

    return F.transform(F.filter(tables(all_lines), bad), lambda t: t["start"])


def duplicate_lines(all_lines: Column) -> Column:
    """Numbers of the lines that repeat the line before; blank lines, table rows and rules don't count."""
    own = F.transform(all_lines, strip)
    # Each line beside the one before it: within a lambda the stripped lines would be made anew for every line.
    same = F.zip_with(own, F.concat(F.array(F.lit("")), own), lambda x, before: (x != "") & (x == before) & ~x.startswith("|") & ~x.startswith("---"))
    return F.filter(F.transform(same, lambda repeated, i: F.when(repeated, i + 1)), lambda i: i.isNotNull())


def links(body: Column) -> Column:
    """``(label, target)`` of the links that are not images, targets without blanks around."""
    pairs = F.arrays_zip(F.regexp_extract_all(body, F.lit(LINK), F.lit(1)).alias("label"), F.regexp_extract_all(body, F.lit(LINK), F.lit(2)).alias("target"))
    return F.transform(pairs, lambda p: F.struct(p["label"].alias("label"), strip(p["target"]).alias("target")))


def suspicious_links(body: Column, vendors: tuple[str, ...]) -> Column:
    own = rf"\A/(?:{'|'.join(vendors)})/[a-z0-9-]+/?(?:#[^{BLANK}]+)?\z"
    return F.filter(links(body), lambda p: ~p["target"].rlike(f"(?U){EXTERNAL}") & ~p["target"].rlike(f"(?U){own}") & ~p["target"].rlike(f"(?U){RELATIVE}"))


def images(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(IMAGE_TARGET), F.lit(1))


def missing_images(rows: DataFrame, inventory: DataFrame) -> DataFrame:
    """``(vendor, slug, image)`` for each reference to a local file that ``inventory (path)`` lacks."""
    named = rows.select("vendor", "slug", F.explode(images(F.col("body"))).alias("image")).where(~F.col("image").rlike(REMOTE))
    return named.withColumn("path", F.regexp_replace("image", r"\A/+", "")).join(inventory, "path", "left_anti").select("vendor", "slug", "image")


def _one(rule: str, severity: str, when: Column, line: Column | None = None, detail: Column | None = None, n: Column | None = None) -> Column:
    found = F.struct(
        F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), (F.lit(0) if line is None else line).cast("int").alias("line_no"),
        (F.lit(1) if n is None else n).cast("long").alias("n"), (F.lit("") if detail is None else F.coalesce(detail, F.lit(""))).alias("detail"),
    )
    return F.when(F.coalesce(when, F.lit(False)), F.array(found)).otherwise(F.array().cast(_FINDINGS))


_FINDINGS = "array<struct<rule: string, severity: string, line_no: int, n: bigint, detail: string>>"


def _each(rule: str, severity: str, values: Column, line: bool = False) -> Column:
    """One finding for each value: a line number, or the detail."""
    none = F.lit(0).cast("int")
    made = F.transform(
        values,
        lambda v: F.struct(
            F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), (v.cast("int") if line else none).alias("line_no"), F.lit(1).cast("long").alias("n"), (F.lit("") if line else v.cast("string")).alias("detail")
        ),
    )
    return F.coalesce(made.cast(_FINDINGS), F.array().cast(_FINDINGS))


def page_findings(pages: DataFrame, vendors: tuple[str, ...] = tuple(v[0] for v in VENDORS)) -> DataFrame:
    """``(vendor, slug, rule, severity, line_no, n, detail)`` of all rules but missing images.

    ``line_no`` counts from 1 and is 0 for rules that look at the whole page.

    A page that is not UTF-8 or has no front matter gets no further rules.
    """
    rows = read(pages)
    body, text = F.col("body"), F.col("text")
    expected = F.when(F.coalesce(F.col("f_num"), F.lit("")) != "", F.concat("f_num", F.lit(" "), "f_title")).otherwise(F.col("f_title"))
    missing = F.filter(
        F.array(*[F.when(F.col(f"f_{name}").isNull(), name) for name in REQUIRED], F.when(F.col("f_num").isNull() & (F.coalesce(F.col("f_vendor"), F.lit("")) != COMMON), "num")), lambda x: x.isNotNull()
    )
    stripped = F.transform("lines", strip)
    numbered = lambda pattern: F.filter(F.transform(stripped, lambda x, i: F.when(x.rlike(pattern), i + 1)), lambda i: i.isNotNull())
    counts = [(label, F.regexp_count(body, F.lit(f"(?d){pattern}"))) for label, pattern in EDITORIAL]
    rules = [
        _each("Q3 field missing", ERROR, missing),
        _one("Q4 H1 count", ERROR, F.size("h1s") != 1, detail=F.size("h1s").cast("string")),
        _one("Q5 H1 differs", ERROR, (F.size("h1s") == 1) & (F.coalesce(F.col("f_title"), F.lit("")) != "") & (F.get("h1s", F.lit(0)) != expected), detail=F.get("h1s", F.lit(0))),
        _one("Q6 replacement character", ERROR, F.contains(text, F.lit(REPLACEMENT))),
        _one("Q7 private-use glyph", ERROR, _has(text, PRIVATE_USE)),
        _one("Q8 empty link", ERROR, _has(text, EMPTY_LINK)),
        _each("Q9 suspicious link", ERROR, F.transform(suspicious_links(body, (*vendors, COMMON)), lambda p: F.concat(F.lit("["), p["label"], F.lit("]("), p["target"], F.lit(")")))),
        _one("Q10 split label", ERROR, _has(body, SPLIT_LABEL)),
        _one("Q11 heading bullet", ERROR, _has(body, HEADING_BULLET)),
        _one("Q12 bare label", ERROR, _has(body, BARE_LABEL)),
        _each("Q13 malformed table", ERROR, table_findings(F.col("lines")), line=True),
        _one("Q15 unclosed fence", ERROR, F.regexp_count(body, F.lit(FENCE)) % 2 == 1),
        _each("Q16 duplicate line", WARNING, duplicate_lines(F.col("lines")), line=True),
        _each("Q17 detached fragment", WARNING, numbered(DETACHED), line=True),
        _each("Q18 truncated ending", WARNING, numbered(TRUNCATED), line=True),
        *[_one(f"Q19 {label}", WARNING, n > 0, n=n) for label, n in counts],
    ]
    first = F.when(text.isNull(), _one("Q1 invalid UTF-8", ERROR, F.lit(True))).when(~F.col("has_fm"), _one("Q2 front matter", ERROR, F.lit(True))).otherwise(F.concat(*rules))
    return rows.select("vendor", "slug", F.explode(first).alias("f")).select("vendor", "slug", "f.*")


def audit(pages: DataFrame, inventory: DataFrame, vendors: tuple[str, ...] = tuple(v[0] for v in VENDORS)) -> DataFrame:
    """All findings."""
    gone = missing_images(read(pages).where("has_fm"), inventory)
    gone = gone.select("vendor", "slug", F.lit("Q14 missing image").alias("rule"), F.lit(ERROR).alias("severity"), F.lit(0).cast("int").alias("line_no"), F.lit(1).cast("long").alias("n"), F.col("image").alias("detail"))
    return page_findings(pages, vendors).unionByName(gone)


def totals(pages: DataFrame) -> DataFrame:
    """One row: files, tables and image references."""
    rows = read(pages)
    return rows.agg(
        F.count("*").alias("files"), F.coalesce(F.sum(F.when(F.col("has_fm"), F.size(tables(F.col("lines"))))), F.lit(0)).alias("tables"),
        F.coalesce(F.sum(F.when(F.col("has_fm"), F.size(images(F.col("body"))))), F.lit(0)).alias("images"),
    )


def warning_totals(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("severity") == WARNING).groupBy("rule").agg(F.sum("n").alias("total")).where("total > 0")


def verdict(findings: DataFrame) -> DataFrame:
    """One row: the number of errors, and whether the corpus passes."""
    return findings.agg(F.coalesce(F.sum(F.when(F.col("severity") == ERROR, F.col("n"))), F.lit(0)).alias("errors")).withColumn("passes", F.col("errors") == 0)
