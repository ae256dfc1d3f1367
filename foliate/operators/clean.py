"""Line rules of the cleaning job, and the overlap between neighbouring sections: all built-in functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import in_order
from ..functions.text import BLANK, lines, literal, rstrip, starts_with_any, strip
from ..sources.scratch import materialize
from .parse import field, source_start, split_front_matter

ANCHOR_CHARS = 12
#: An overlap begins no earlier than this line, and this share of the lines.
EARLIEST_LINE = 8
EARLIEST_SHARE = 0.52

# Characters and marks that the spacing rules know.
JP = r"\x{3040}-\x{30ff}\x{3400}-\x{9fff}々〆ヶー"
GAP = r"[ \t\x{3000}]+"
SPACING = (
    (r"[《≪]([^》≫]+)[》≫]", "$1"),
    (rf"(?<=[{JP}]){GAP}(?=[{JP}])", ""),
    (rf"(?<=[{JP}]){GAP}(?=[A-Za-z0-9])", ""),
    (rf"(?<=[A-Za-z0-9)%+\]]){GAP}(?=[{JP}])", ""),
    (rf"(?<=[{JP}]){GAP}(?=[、。）」』】])", ""),
    (rf"(?<=[（「『【]){GAP}(?=[{JP}A-Za-z0-9])", ""),
    (rf"{GAP}([、。！？）」』】])", "$1"),
)
#: One of these is in every line that the spacing rules change.
SPACED = rf"[《≪{JP}、。！？（「『【）」』】]"
DROPPED = ("お使いになる前に必ずお読みください。", "必ずお読みください。")
# Whole-line rewrites in order, the first that fits counts. Pattern, replacement.
INTRODUCTION = r"\A(?:(?:本章|本節|ここ)では、?)?(.+?)について(?:簡単に)?説明し(?:ます|ています)。\z"
REWRITES = (
    (r"\A(.+?)を(?:以下|下記)に一覧で示します。\z", "$1の一覧です。"),
    (r"\A(.+?)を(?:以下|下記)に示します。\z", "$1は次のとおりです。"),
    (r"\A詳細は、?(?:以下|下記)を参照してください。\z", "**関連項目**"),
    (r"\A操作方法は、?(?:以下|下記)を参照してください。\z", "**操作方法の関連項目**"),
    (r"\A(.+?)の詳細は、?(?:以下|下記)を参照してください。\z", "**$1の関連項目**"),
)
SEE_BELOW = r"\A(.+?)は、?(?:以下|下記)を参照してください。\z"
SEE_BELOW_CHARS = 42
PHRASES = (("ご確認ください", "確認してください"),)
CAPTION = ("図(元マニュアルp.", "図(元マニュアル p.")
COUNTERS = "号機|点|台|個|本|軸|重|次元|ビット|ワード"
HEADING_NUMBERS = (
    (r"(?U)\A(#{1,6}\s+)(\d+(?:[.\-]\d+)+)(?=[^\d\s])", "$1$2 "),
    (r"(?U)\A(#{2,6}\s+)(\d{1,2})\.(?=\S)", "$1$2. "),
    (rf"(?U)\A(#{{2,6}}\s+)(\d{{1,2}})(?!(?:{COUNTERS}))(?=[^\d\s:：.\-])", "$1$2 "),
    (rf"(?U)\A(#{{2,6}}\s+)(\d{{1,2}})\s+(?=(?:{COUNTERS}))", "$1$2"),
    (r"(?U)\A(#{2,6}\s+)(\d+)\s+:[ \t]*([1n])", "$1$2:$3"),
)
# Bare labels and what they become.
LABELS = {
    "ポイント": "**ポイント**", "参考": "**参考**", "注意": "**注意**", "注意事項": "**注意事項**", "使用上の注意": "**使用上の注意**", "重要": "**重要**",
    "警告": "**警告**", "画面表示": "**画面の開き方**", "表示内容": "**画面項目**", "操作手順": "**操作手順**", "別手順": "**別の手順**", "例": "**例**",
}


def normalize_spacing(line: Column) -> Column:
    """Blanks that a line break left inside Japanese text go, and so do ornamental brackets and double colons."""
    spaced = line
    for pattern, replacement in SPACING:
        spaced = F.regexp_replace(spaced, pattern, replacement)
    line = F.when(line.rlike(SPACED), spaced).otherwise(line)
    line = F.replace(F.replace(line, F.lit("：："), F.lit("：")), F.lit(":："), F.lit("："))
    return rstrip(line)


def _bound(c: Column, *steps: Callable[[Column], Column]) -> Column:
    """``c`` after the steps; each takes the value of the one before once, however often it names it."""
    return F.get(reduce(F.transform, steps, F.array(c)), F.lit(0))


def _with_own(line: Column) -> Column:
    return F.struct(line.alias("line"), strip(line).alias("own"))


def _tone(s: Column) -> Column:
    own = s["own"]
    topic = F.regexp_replace(F.regexp_extract(own, INTRODUCTION, 1), r"\A[、 ]+|[、 ]+\z", "")
    plain = s["line"]
    for old, new in PHRASES:
        plain = F.replace(plain, F.lit(old), F.lit(new))
    # All rewrites are of whole sentences.
    out = F.when(~own.endswith("。"), plain).when(own.isin(*DROPPED), "").when(own.rlike(INTRODUCTION) & ~starts_with_any(own, "- ", "|"), F.concat(topic, F.lit("をまとめます。")))
    for pattern, replacement in REWRITES:
        out = out.when(own.rlike(pattern), F.regexp_replace(own, pattern, replacement))
    subject = F.regexp_extract(own, SEE_BELOW, 1)
    out = out.when((subject != "") & (F.length(subject) <= SEE_BELOW_CHARS), F.concat(F.lit("**"), subject, F.lit("の関連項目**")))
    return out.otherwise(plain)


def rewrite_tone(line: Column) -> Column:
    """A line in the tone of a reference: the first whole-line rewrite that fits, else the phrases."""
    return _bound(line, _with_own, _tone)


def _spacing(line: Column) -> Column:
    line = F.replace(normalize_spacing(line), F.lit(CAPTION[0]), F.lit(CAPTION[1]))
    bullet = lambda x: F.when(x.startswith("##"), F.regexp_replace(x, rf"(?Ud)\A(#{{2,6}})[{BLANK}]+[■●•・][{BLANK}]*(.+)\z", "$1 $2")).otherwise(x)
    return _bound(line, bullet)


def _bullets(line: Column) -> Column:
    return F.when(line.startswith("#"), F.regexp_replace(line, rf"(?U)[{BLANK}]+[•●][{BLANK}]+", " — ")).when(line.startswith("|"), F.regexp_replace(line, rf"(?U)[{BLANK}]*•[{BLANK}]*", " / ")).otherwise(line)


def _numbers(line: Column, spared: Column) -> Column:
    out = line
    for pattern, replacement in HEADING_NUMBERS:
        out = F.regexp_replace(out, pattern, replacement)
    return F.when(line.startswith("#") & ~spared, out).otherwise(line)


def _label_or_tone(s: Column) -> Column:
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[s["own"]]
    return F.when(s["line"].startswith("|"), s["line"]).when(label.isNotNull(), label).otherwise(_tone(s))


def _line_steps(vendor: Column, common: str) -> tuple[Callable[[Column], Column], ...]:
    return _spacing, _bullets, lambda x: _numbers(x, vendor == common), _with_own, _label_or_tone


def normalize_line(line: Column, vendor: Column, common: str = "common") -> Column:
    """Spacing, headings, table cells and labels of one line; the rules for numbers spare common guides."""
    return _bound(line, *_line_steps(vendor, common))


def normalize_lines(pages: DataFrame, common: str = "common") -> DataFrame:
    """``pages`` with ``body`` normalized line by line, in one projection: the array of lines passes the steps."""
    done = reduce(F.transform, _line_steps(F.col("vendor"), common), lines(F.col("body")))
    return pages.withColumn("body", F.array_join(done, "\n"))


def first_anchor(body: Column) -> Column:
    """The first line of text long enough to know the section by, without blanks around; null if there is none."""
    own = F.transform(lines(body), strip)
    fits = F.filter(own, lambda x: (F.length(x) >= ANCHOR_CHARS) & ~starts_with_any(x, "#", "|", "![", "---") & (F.length(F.translate(x, "*_`", "")) >= ANCHOR_CHARS))
    return F.get(fits, F.lit(0))


def trim_overlap(pages: DataFrame, stretch: int = 4000) -> DataFrame:
    """``pages`` (vendor, slug, text) with the next section's beginning cut off their ends, and ``overlap``.

    The next section is that of the same vendor by source start, then slug; it is looked at as it
    was, not as trimmed. Only the anchor line travels between neighbours, and pages are ordered
    within stretches of source pages, so no task sorts a vendor.
    """
    rows = split_front_matter(pages).withColumns({"start": source_start(F.col("fm")), "anchor": first_anchor(F.col("body"))})
    rows = rows.withColumn("stretch", F.floor(F.col("start") / stretch))
    # Written: the order reads them more than once, and anchors are looked for in whole texts.
    light = in_order(materialize(rows.select("vendor", "slug", "start", "stretch", "anchor"), "anchors"), ["vendor"], ["stretch"], ["start", "slug"], {"anchor": F.col("anchor")})
    light = light.select("vendor", "slug", "next_anchor")
    least = F.greatest(F.lit(EARLIEST_LINE).cast("long"), F.floor(F.size("own_lines") * EARLIEST_SHARE))
    places = F.filter(F.transform("own_lines", lambda x, i: F.when((i >= F.col("least")) & F.contains(x, F.col("next_anchor")) & (strip(x) == F.col("next_anchor")), i)), lambda i: i.isNotNull())
    # What stands before the body stays as it is, rules and all.
    head = F.substring(F.col("text"), F.lit(1), F.length("text") - F.length("body"))
    updated = F.concat(head, rstrip(F.array_join(F.slice("own_lines", F.lit(1), F.col("cut")), "\n")), F.lit("\n"))
    out = rows.join(light, ["vendor", "slug"]).withColumn("own_lines", lines(F.col("body"))).withColumn("least", least).withColumn("cut", F.try_element_at(places, F.lit(-1)))
    out = out.withColumn("updated", F.when(F.col("cut").isNotNull(), updated).otherwise(F.col("text")))
    return out.select("vendor", "slug", F.col("updated").alias("text"), (F.col("updated") != F.col("text")).alias("overlap"))


def canonical_h1(fm: Column, body: Column) -> Column:
    """The first H1 as ``# num title``, where the front matter has both."""
    num, title = field(fm, "num"), field(fm, "title")
    wanted = F.concat(F.lit("# "), num, F.lit(" "), title)
    at = F.regexp_instr(body, F.lit(r"(?md)^# .+$"))
    rest = F.regexp_replace(F.substring(body, at, F.length(body)), r"\A# [^\n]+", literal(wanted))
    return F.when(num.isNotNull() & title.isNotNull() & (at > 0), F.concat(F.substring(body, F.lit(1), at - 1), rest)).otherwise(body)
