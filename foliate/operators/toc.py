"""From tables of contents to sections with page ranges and sub-headings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import in_order, running_last
from ..sources.scratch import materialize
from .parse import section_slug


@dataclass(frozen=True)
class Scheme:
    """How a vendor numbers its sections.

    ``section``: pattern of number and title of a section, at ``level``. ``appendix``: the same of an
    appendix section, at level 2; ``prefix`` is put before its number. With ``appendix_part``, the
    part of the book that starts with that mark holds the appendices, and sections end there.
    ``dropped``: numbers, or words in titles, of sections left out; they still end the one before.
    """

    section: str
    level: int
    appendix: str
    prefix: str = ""
    appendix_part: str = ""
    dropped: tuple[str, ...] = ()
    dropped_words: tuple[str, ...] = ()
    chapter_breaks: bool = False
    overviews: bool = False
    most_chapter: int = 10**6
    categories: dict[int, str] = field(default_factory=dict)
    overrides: dict[str, str] = field(default_factory=dict)


# chapters' categories and exceptions of the three schemes.
DOTTED = Scheme(
    section=r"\A(\d+\.\d+)\s+(.+)\z", level=3, appendix=r"\A(付\d+)\s+(.+)\z", dropped=("付1",), chapter_breaks=True, overviews=True,
    categories={
        1: "setup", 2: "setup", 3: "project", 4: "hardware", 5: "variables", 6: "programming", 7: "variables", 8: "variables", 9: "programming",
        10: "programming", 11: "debug", 12: "transfer", 13: "transfer", 14: "debug", 15: "maintenance", 16: "maintenance", 17: "debug", 18: "maintenance",
    },
)
PART = Scheme(
    section=r"\A(\d+-\d+)\s+(.+)\z", level=2, appendix=r"\A(\d+)\s+(.+)\z", prefix="付", appendix_part="付", dropped_words=("改訂履歴",),
    categories={
        1: "setup", 2: "project", 3: "hardware", 4: "project", 5: "programming", 6: "setup", 7: "programming", 8: "programming", 9: "debug", 10: "debug",
        11: "debug", 12: "maintenance", 13: "programming",
    },
    overrides={"6-2": "hardware", "9-1": "transfer"},
)
LETTER = Scheme(
    section=r"\A(\d+-\d+)\s+(.+)\z", level=2, appendix=r"\A(A-\d+)\s+(.+)\z", dropped=("A-13", "A-14"), most_chapter=11,
    categories={1: "setup", 2: "setup", 3: "setup", 4: "programming", 5: "hardware", 6: "transfer", 7: "debug", 8: "maintenance", 9: "programming", 10: "reference", 11: "reference"},
    overrides={"3-3": "project", "4-1": "variables", "4-3": "variables", "4-4": "variables"},
)
SCHEMES = {"alpha": DOTTED, "beta": PART, "gamma": LETTER}
OVERVIEW = "(機能概要)"  # Fixed value: ends the title of a chapter's overview.
REFERENCE = "reference"


def _int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("int")


#: Positions, or pages, that are ordered together.
STRETCH = 40_000


def _stretch(c: str) -> Column:
    return F.floor(F.col(c) / STRETCH)


def toc_chapters(toc: DataFrame) -> DataFrame:
    """``toc`` (vendor, pos, level, title, page) with ``chapter``, the last one begun, and ``in_appendix``."""
    number = _int(F.regexp_extract("title", r"\A(\d+)\s+.+\z", 1))
    mark = F.when((F.col("level") == 1) & F.col("title").startswith("付"), True)
    rows = running_last(toc, ["vendor"], _stretch("pos"), [F.col("pos")], {"chapter": F.when(F.col("level") == 2, number), "in_appendix": mark})
    return rows.withColumn("in_appendix", F.coalesce("in_appendix", F.lit(False)))


def category(num: Column, chapter: Column, scheme: Scheme) -> Column:
    """The exception of a number, else its chapter's category, else ``reference``."""
    by_chapter = F.create_map(*[F.lit(x) for pair in scheme.categories.items() for x in pair])[chapter]
    if not scheme.overrides:
        return F.coalesce(by_chapter, F.lit(REFERENCE))
    by_num = F.create_map(*[F.lit(x) for pair in scheme.overrides.items() for x in pair])[num]
    return F.coalesce(by_num, by_chapter, F.lit(REFERENCE))


def _history(rows: DataFrame, scheme: Scheme) -> Column:
    """Entries that are left out, such as revision histories."""
    out = F.regexp_extract("title", scheme.appendix, 1).isin(*scheme.dropped) if scheme.dropped else F.lit(False)
    for word in scheme.dropped_words:
        out = out | F.contains("title", F.lit(word))
    return (F.col("level") == 2) & out


def sections_of(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """``(vendor, pos, level, num, title, page, cat, sub_level)`` of one vendor's sections; ``rows`` from ``toc_chapters``."""
    num, title = F.regexp_extract("title", scheme.section, 1), F.regexp_extract("title", scheme.section, 2)
    own_chapter = _int(F.regexp_extract(num, r"\A(\d+)", 1))
    # With dotted numbers the chapter is the one begun, else the number's own.
    chapter = F.col("chapter") if scheme.level == 3 else own_chapter
    is_section = (F.col("level") == scheme.level) & (num != "") & (own_chapter <= scheme.most_chapter)
    if scheme.level == 3:
        is_section = is_section & F.col("chapter").isNotNull() & (F.col("chapter") != 0)
    number = F.regexp_extract("title", scheme.appendix, 1)
    is_appendix = (F.col("level") == 2) & (number != "") & ~_history(rows, scheme)
    if scheme.appendix_part:
        is_section, is_appendix = is_section & ~F.col("in_appendix"), is_appendix & F.col("in_appendix")
    is_appendix = is_appendix & ~is_section
    found = rows.where(is_section | is_appendix)
    return found.select(
        "vendor", "pos", "level", F.when(is_section, num).otherwise(F.concat(F.lit(scheme.prefix), number)).alias("num"),
        F.when(is_section, title).otherwise(F.regexp_extract("title", scheme.appendix, 2)).alias("title"), "page",
        F.when(is_section, category(num, chapter, scheme)).otherwise(F.lit(REFERENCE)).alias("cat"),
        F.when(is_section & F.lit(scheme.level == 3), 4).otherwise(3).alias("sub_level"),
    )


def breaks_of(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """``(vendor, page)``, each once: where parts begin, chapters if the scheme has them, and what is left out."""
    chapter = (F.col("level") == 2) & F.col("title").rlike(r"\A\d+\s") if scheme.chapter_breaks else F.lit(False)
    return rows.where((F.col("level") == 1) | chapter | _history(rows, scheme)).select("vendor", "page").distinct()


def chapter_overviews(rows: DataFrame, sections: DataFrame, scheme: Scheme) -> DataFrame:
    """A section ``N.0`` for each chapter whose first section begins on a later page.

    Its sub-headings are looked for from the chapter's own place in the table of contents.
    """
    found = F.regexp_extract("title", r"\A(\d+)\s+(.+)\z", 1)
    chapters = rows.where((F.col("level") == 2) & (found != "")).groupBy("vendor", _int(found).alias("number")).agg(F.max_by(F.struct("page", "title", "pos", "level"), "pos").alias("c"))
    first = sections.where(F.col("num").rlike(r"\A\d+\.")).groupBy("vendor", _int(F.regexp_extract("num", r"\A(\d+)\.", 1)).alias("number")).agg(F.min_by("page", "pos").alias("first"))
    out = chapters.join(first, ["vendor", "number"]).where("first > c.page")
    title = F.concat(F.regexp_extract("c.title", r"\A(\d+)\s+(.+)\z", 2), F.lit(OVERVIEW))
    return out.select("vendor", "c.pos", "c.level", F.concat(F.col("number").cast("string"), F.lit(".0")).alias("num"), title.alias("title"), "c.page", category(F.lit(""), F.col("number"), scheme).alias("cat"), F.lit(4).alias("sub_level"))


def build_sections(toc: DataFrame, page_counts: DataFrame, schemes: dict[str, Scheme] = SCHEMES) -> DataFrame:
    """``(vendor, ord, slug, num, title, cat, page, page_end, pos, level, sub_level)`` of all vendors.

    Sections follow by page and number where a scheme has overviews, else as in the table of
    contents. A section ends on the next one's first page (``page_counts``: vendor, pages), but
    before a break that comes earlier.
    """
    rows = materialize(toc_chapters(toc), "chapters")  # each vendor's sections and breaks are read from it
    found = breaks = None
    for vendor, scheme in schemes.items():
        own = rows.where(F.col("vendor") == vendor)
        part = sections_of(own, scheme)
        if scheme.overviews:
            part = part.unionByName(chapter_overviews(own, part, scheme))
            part = part.withColumns({"k1": F.col("page"), "k2": F.col("num")})
        else:
            part = part.withColumns({"k1": F.col("pos").cast("int"), "k2": F.lit("")})
        found = part if found is None else found.unionByName(part)
        cut = breaks_of(own, scheme)
        breaks = cut if breaks is None else breaks.unionByName(cut)
    found = in_order(found.withColumn("stretch", _stretch("k1")), ["vendor"], ["stretch"], ["k1", "k2", "pos"], {"page": F.col("page")})
    found = found.withColumnRenamed("position", "ord").drop("stretch", "previous_page")
    # The next break after a page: from the highest page down, the last break so far; on one page sections come before breaks.
    both = found.select("vendor", "page", "ord", F.lit(None).cast("int").alias("at")).unionByName(breaks.select("vendor", "page", F.lit(None).cast("int").alias("ord"), F.col("page").cast("int").alias("at")))
    both = running_last(both, ["vendor"], _stretch("page"), [F.desc("page"), F.col("at").isNotNull()], {"next_break": F.col("at")}, backwards=True)
    after = both.where(F.col("ord").isNotNull()).select("vendor", "ord", "next_break")
    joined = found.join(after, ["vendor", "ord"]).join(page_counts, "vendor", "left")
    end = F.coalesce("next_page", "pages", F.lit(10**9))
    end = F.when(F.col("next_break") < end, F.col("next_break") - 1).otherwise(end)
    return joined.select("vendor", "ord", section_slug(F.col("num")).alias("slug"), "num", "title", "cat", "page", F.greatest(end, F.col("page")).cast("int").alias("page_end"), "pos", "level", "sub_level")


def skip_done(sections: DataFrame, done: DataFrame) -> DataFrame:
    """Sections whose (vendor, slug) ``done`` does not list."""
    return sections.join(done.select("vendor", "slug"), ["vendor", "slug"], "left_anti")


DEEPEST = 8


def sub_headings(sections: DataFrame, toc: DataFrame) -> DataFrame:
    """``(vendor, slug, pos, level, title, page)`` of the deeper entries that belong to each section.

    They follow it in the table of contents, up to an entry of its level or above, or one that starts
    at or past its end (unless it starts on the section's first page). Levels count from the section,
    4 at most. Every entry is given the last section before it, stretch by stretch;
    chapters' overviews, inside which other sections begin, are gone through apart from these.
    """
    entries = toc.select("vendor", F.col("pos").alias("at"), F.col("level").alias("deep"), F.col("title").alias("text"), F.col("page").alias("on"))
    # Where the next entry of each level or above stands.
    nexts = {f"next_{k}": F.when(F.col("deep") <= k, F.col("at")) for k in range(1, DEEPEST + 1)}
    entries = running_last(entries, ["vendor"], _stretch("at"), [F.desc("at")], nexts, backwards=True, inclusive=False)
    bound = F.get(F.array(*nexts), F.col("deep") - 1)
    entries = materialize(entries.withColumn("bound", F.coalesce(bound, F.lit(2**31 - 1).cast(dict(toc.dtypes)["pos"]))).drop(*nexts), "bounded-entries")
    own = sections.select("vendor", F.col("pos").alias("at"), F.struct("slug", "level", F.col("page").alias("begins"), "page_end").alias("s"), F.col("num").endswith(".0").alias("overview"))
    out = None
    for overview in (False, True):
        part = entries.join(own.where(F.col("overview") == overview).drop("overview"), ["vendor", "at"], "left")
        part = running_last(part, ["vendor"], _stretch("at"), [F.col("at")], {"of": F.when(F.col("s").isNotNull(), F.struct("s", "at", "bound"))}, inclusive=False)
        part = part.where(F.col("of").isNotNull() & (F.col("at") < F.col("of.bound")))
        past = (F.col("on") >= F.col("of.s.page_end")) & (F.col("on") > F.col("of.s.begins"))
        running = Window.partitionBy("vendor", "of.at").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        part = part.withColumn("over", F.max(past.cast("int")).over(running)).where(F.col("over") == 0).where(F.col("deep") > F.col("of.s.level"))
        part = part.select("vendor", F.col("of.s.slug").alias("slug"), F.col("at").alias("pos"), F.least(F.lit(4), F.col("deep") - F.col("of.s.level") + 1).alias("level"), F.col("text").alias("title"), F.col("on").alias("page"))
        out = part if out is None else out.unionByName(part)
    return out


def catalog(units: DataFrame, markdown: DataFrame) -> DataFrame:
    """``(vendor, slug, num, title, cat, chars, started, pages)`` from sections and ``(vendor, slug, text, started)``."""
    joined = units.join(markdown.select("vendor", "slug", F.length("text").alias("chars"), "started"), ["vendor", "slug"])  # no text is dealt out
    return joined.select("vendor", "slug", "num", "title", "cat", "chars", "started", F.concat(F.col("page").cast("string"), F.lit("-"), F.col("page_end").cast("string")).alias("pages"))


def outliers(found: DataFrame, short: int = 400, most: int = 20) -> DataFrame:
    """``(reason, vendor, slug, num, chars)``: the first so many sections whose title was not found, and short ones."""
    columns = ["vendor", "slug", "num", "chars"]
    lost = found.where(~F.col("started")).orderBy("vendor", "slug").limit(most).select(F.lit("title not found").alias("reason"), *columns)
    return lost.unionByName(found.where(F.col("chars") < short).orderBy("vendor", "slug").limit(most).select(F.lit("short").alias("reason"), *columns))
