"""Front matter and what is read out of a page's body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import DEFAULT_CATEGORY
from ..functions.text import BLANK, lines, strip

#: The source start of a page that names none: it comes last.
NO_SOURCE = 10**9
EXCERPT = 180
SEARCH_HEADS = 24
# What search text leaves out.
IMAGE = r"!\[[^\]]*\]\([^)]*\)"
MARKS = r"[|#*\-`>]"


def split_front_matter(pages: DataFrame, text: str = "text") -> DataFrame:
    """``pages`` with ``has_fm``, ``fm`` (what stands between the two rules) and ``body``.

    Without front matter at the very start, ``fm`` is empty and the body is the whole text.
    """
    t = F.col(text)
    # The closing rule may not overlap the opening one.
    end = F.when(t.startswith("---\n"), F.locate("\n---\n", t, 5)).otherwise(0)
    found = F.coalesce(end > 0, F.lit(False))
    fm = F.when(found, F.substring(t, F.lit(5), end - 5)).otherwise("")
    body = F.when(found, F.substring(t, end + 5, F.length(t))).otherwise(t)
    return pages.withColumns({"has_fm": found, "fm": fm, "body": body})


def front_matter_map(fm: Column) -> Column:
    """Keys and values, split at the first colon and without blanks and quotes around; of equal keys the last holds."""
    pairs = F.transform(
        lines(fm),
        lambda x: F.struct(
            strip(F.regexp_extract(x, r"(?s)\A([^:]*)", 1)).alias("key"),
            F.regexp_replace(strip(F.when(F.contains(x, F.lit(":")), F.regexp_replace(x, r"(?s)\A[^:]*:", "")).otherwise("")), r'\A"+|"+\z', "").alias("value"),
        ),
    )
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def field(fm: Column, name: str) -> Column:
    """The value of one required field, null where it has none. Blanks after the colon may include a line feed."""
    found = F.regexp_extract(fm, rf'(?Umd)^{name}:[{BLANK}]*"?([^"\n]+)"?[{BLANK}]*$', 1)
    return strip(F.nullif(found, F.lit("")))


def source_range(fm: Column) -> tuple[Column, Column]:
    """First and last page of the first range ``pp.A-B``, null where there is none."""
    pattern = r"(?U)\bpp\.(\d+)-(\d+)"
    return tuple(F.nullif(F.regexp_extract(fm, pattern, i), F.lit("")).cast("long") for i in (1, 2))


def source_start(fm: Column) -> Column:
    return F.coalesce(source_range(fm)[0], F.lit(NO_SOURCE).cast("long"))


def headings(body: Column) -> Column:
    """Texts of the headings of levels 1 to 4, in order."""
    return F.regexp_extract_all(body, F.lit(rf"(?Umd)^#{{1,4}}[{BLANK}]+(.+)$"), F.lit(1))


def search_heads(heads: Column) -> Column:
    """All headings but the first, so many at most."""
    return F.slice(heads, 2, SEARCH_HEADS)


def excerpt(body: Column, size: int = EXCERPT) -> Column:
    """The body's first characters without images, marks and runs of blanks; a leading blank stays."""
    text = F.regexp_replace(body, IMAGE, " ")
    text = F.regexp_replace(text, MARKS, " ")
    return F.substring(F.regexp_replace(text, rf"(?U)[{BLANK}]+", " "), 1, size)


def sort_key(num: Column) -> Column:
    """``(a, b, c)`` to order section numbers by: appendices after chapters, what can't be read before them."""
    number = lambda c: F.try_to_number(F.nullif(c, F.lit("")), F.lit("9999999999")).cast("long")
    appendix = F.regexp_extract(num, r"\A(?:付|A-?)(\d+)\z", 1)
    parts = F.split(num, r"[.\-]", -1)
    first, second = number(F.get(parts, F.lit(0))), number(F.get(parts, F.lit(1)))
    zero, key = F.lit(0).cast("long"), lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), F.lit(0).cast("long").alias("c"))
    plain = F.when(first.isNotNull() & ((F.size(parts) == 1) | second.isNotNull()), key(first, F.coalesce(second, zero))).otherwise(key(F.lit(98), zero))
    return F.when(appendix != "", key(F.lit(99), number(appendix))).otherwise(plain)


def section_slug(num: Column) -> Column:
    """Digit parts, two digits at least, joined by hyphens; ``ap-NN`` for an appendix."""
    # lpad would cut longer numbers.
    two = lambda x: F.when(F.length(x) < 2, F.lpad(x, 2, "0")).otherwise(x)
    plain = lambda x: F.regexp_replace(x, r"\A0+(?=\d)", "")
    appendix = F.regexp_extract(num, r"\A(?:付|A-?)(\d+)\z", 1)
    parts = F.filter(F.split(num, r"[.\-]", -1), lambda x: x.rlike(r"\A\d+\z"))
    return F.when(appendix != "", F.concat(F.lit("ap-"), two(plain(appendix)))).otherwise(F.array_join(F.transform(parts, lambda x: two(plain(x))), "-"))


def page_entries(pages: DataFrame) -> DataFrame:
    """``pages`` with ``num``, ``title`` and ``cat`` from the front matter, or their defaults."""
    fields = front_matter_map(F.col("fm"))
    rows = pages.withColumn("fields", fields)
    value = lambda name, default: F.coalesce(F.col("fields")[name], F.lit(default))
    return rows.withColumns({"num": value("num", ""), "title": value("title", ""), "cat": value("category", DEFAULT_CATEGORY), "source": F.col("fields")["source"]}).drop("fields")
