"""Mixing sources to target weights by iterative proportional fitting, with built-in functions only.

Documents are summed into cells of source, language and topic, weighed by their tokens. Raking
scales the cells until every margin has its target share of the token budget. No cell can give more
than it has, so every step is bounded: what a full cell lacks comes from the others of its category,
and what a full category lacks from the others of its margin. A cell's documents are then kept with
the probability that gives the cell its share.

The query ``op3_mixing`` is held to its SQL, which rakes without the bound and cuts afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, packed

MARGINS = ("source", "lang", "topic")
#: A margin's target shares are its own shares to this power, so small categories gain.
TEMPER = 0.5
#: Share of all tokens to keep.
BUDGET = 0.7
ROUNDS = 12
#: Rounds in one plan; the cells are written after each such run.
ROUNDS_AT_ONCE = 4
CAP_ROUNDS = 8
#: Raking under the cap ends when no margin is further from its reach, in shares of the budget, or when a run brings
#: less than a tenth, or after so many rounds.
TOLERANCE = 1e-3
MOST_ROUNDS = 48
#: So many cells at most are raked in one task and broadcast; their number doesn't depend on that of the documents.
SMALL_CELLS = 100_000
#: Topic rules in order, the first that fits wins: a name and the strings of which the text holds one. Others are "prose".
TOPICS = (
    ("legal", ("License", "licensed under", "All rights reserved")),
    ("contact", ("@",)),
    ("table", (" | ",)),
    ("markup", ("&&&", "***", "!!")),
)
NONE = "(none)"


def topic(text: Column, rules=TOPICS) -> Column:
    out = F.lit("prose")
    for name, marks in reversed(rules):
        fits = F.contains(text, F.lit(marks[0]))
        for mark in marks[1:]:
            fits = fits | F.contains(text, F.lit(mark))
        out = F.when(fits, name).otherwise(out)
    return F.when(text.isNull(), NONE).otherwise(out)


def chance(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone; null counts as an empty key."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / 4294967296.0


def cells_of(features: DataFrame) -> DataFrame:
    return features.groupBy(*MARGINS).agg(F.sum("tokens").cast("double").alias("mass")).where("mass > 0")


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, temper: float = TEMPER, together: bool = False) -> DataFrame:
    """Cells with ``weight``, shares that sum to one and meet every margin's target as nearly as can be.

    ``targets``: for each margin, shares by category; categories that have no cell are left out, and
    those without a target get none. A margin that isn't given gets its own shares to the power
    ``temper``. ``together`` rakes all cells in one task, without shuffles.
    """
    now = _with_goals(cells, targets, temper)
    now = materialize(now, "cells")
    now = now.coalesce(1) if together else now
    for r in range(rounds):
        for m in MARGINS:
            own = F.sum("weight").over(Window.partitionBy(m))
            now = now.withColumn("weight", F.when(own > 0, F.col("weight") * F.col(f"goal_{m}") / own).otherwise(0.0))
        if (r + 1) % ROUNDS_AT_ONCE == 0:
            now = materialize(now, "cells")
            now = now.coalesce(1) if together else now
    return now


def _with_goals(cells: DataFrame, targets: dict[str, dict[str, float]] | None, temper: float) -> DataFrame:
    """Cells with their own share as ``weight`` and, for each margin, the target of their category."""
    targets = targets or {}
    whole = F.sum("mass").over(Window.partitionBy())
    now = cells.withColumn("weight", F.col("mass") / whole)
    for m in MARGINS:
        own = F.sum("mass").over(Window.partitionBy(m))
        if m in targets:
            given = F.create_map(*[F.lit(x) for pair in targets[m].items() for x in pair])
            goal = F.coalesce(given[F.col(m)], F.lit(0.0))
        else:
            goal = F.pow(own / whole, F.lit(temper))
        # Each category counts once in the total: its cells share it out by their mass.
        now = now.withColumn(f"goal_{m}", goal).withColumn(f"goal_{m}", F.col(f"goal_{m}") / F.sum(F.col(f"goal_{m}") * F.col("mass") / own).over(Window.partitionBy()))
    return now


def _factor(have: Column, want: Column, total: Column, part: list[str], tie: list[str]) -> Column:
    """The least f with sum(least(have, f * want)) = total in each part, or all of ``have`` where that is less.

    That sum is the least, over k, of the haves of the k fullest rows and f times the wants of the others.
    """
    own = Window.partitionBy(*part)
    before = F.sum(have).over(own.orderBy(have / want, *tie).rowsBetween(Window.unboundedPreceding, -1))
    after = F.sum(want).over(own.orderBy((have / want).desc(), *[F.col(c).desc() for c in tie]).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return F.max((total - F.coalesce(before, F.lit(0.0))) / after).over(own)


def rake_bounded(
    cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, rounds: int = MOST_ROUNDS, temper: float = TEMPER, together: bool = False,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Cells with ``p``, the probability of keeping a document, so that the expected tokens are the
    budget's share and meet every margin's target as nearly as can be.

    A category that has less than its target is kept whole; the others of its margin share out what
    it lacks, in proportion to their targets. ``targets``, ``temper`` and ``together`` are as in
    ``rake``; cells of a category without a target are left out.
    """
    everywhere = Window.partitionBy()
    one = lambda df: df.coalesce(1) if together else df
    now = _with_goals(cells, targets, temper).withColumn("room", F.col("mass") / (F.sum("mass").over(everywhere) * budget))
    now = now.where(F.least(*[F.col(f"goal_{m}") for m in MARGINS]) > 0)
    now = one(materialize(now.withColumn("total", F.least(F.lit(1.0), F.sum("room").over(everywhere))), "cells"))
    for m in MARGINS:
        kinds = now.groupBy(m).agg(F.sum("room").alias("room"), F.first(f"goal_{m}").alias("goal"), F.first("total").alias("total"))
        reach = F.least("room", F.col("goal") * _factor(F.col("room"), F.col("goal"), F.col("total"), [], [m]))
        now = now.join(kinds.select(m, reach.alias(f"reach_{m}")), m)
    now = one(materialize(now, "cells"))
    before = float("inf")
    for r in range(rounds):
        for m in MARGINS:
            factor = _factor(F.col("room"), F.col("weight"), F.col(f"reach_{m}"), [m], list(MARGINS))
            now = now.withColumn("weight", F.least("room", F.col("weight") * factor))
        if (r + 1) % ROUNDS_AT_ONCE == 0:
            now = one(materialize(now, "cells"))
            off = _off(now)
            if off <= tolerance or off > 0.9 * before:
                break
            before = off
    return now.withColumn("p", F.round(F.col("weight") / F.col("room"), 9))


def _off(cells: DataFrame) -> float:
    """How far the margin that is furthest from its reach is from it."""
    margins = [cells.groupBy(m).agg(F.abs(F.sum("weight") - F.first(f"reach_{m}")).alias("off")).select("off") for m in MARGINS]
    return margins[0].unionByName(margins[1]).unionByName(margins[2]).agg(F.max("off")).first()[0] or 0.0


def probabilities(cells: DataFrame, budget: float = BUDGET, rounds: int = CAP_ROUNDS) -> DataFrame:
    """Raked cells with ``p``, cut at one without regard to the margins: the expected tokens are the budget's share."""
    everywhere = Window.partitionBy()
    now = cells.withColumn("goal", F.sum("mass").over(everywhere) * budget).withColumn("p", F.lit(0.0))
    for _ in range(rounds):
        full = F.col("p") >= 1
        left = F.col("goal") - F.sum(F.when(full, F.col("mass")).otherwise(0.0)).over(everywhere)
        share = F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).over(everywhere)
        p = F.when(full, 1.0).when(share > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), left) * F.col("weight") / share / F.col("mass"))).otherwise(0.0)
        now = now.withColumn("p", p)
    return now.withColumn("p", F.round("p", 9)).drop("goal")


def features(docs: DataFrame, rules=TOPICS, *keep: str) -> DataFrame:
    """``(doc_id, source, lang, topic, tokens)`` and ``keep``; a missing source or language is ``(none)``."""
    tokens = F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    return docs.select("doc_id", F.coalesce("source", F.lit(NONE)).alias("source"), F.coalesce("lang", F.lit(NONE)).alias("lang"), topic(F.col("text"), rules).alias("topic"), tokens.alias("tokens"), *keep)


def chances(rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, bounded: bool = True) -> DataFrame:
    """``(source, lang, topic, p)`` from ``features``; broadcast where the cells are few."""
    cells = materialize(cells_of(rows), "cells")
    small = cells.count() <= SMALL_CELLS
    own = cells.coalesce(1) if small else cells
    found = rake_bounded(own, targets, budget, together=small) if bounded else probabilities(rake(own, targets, together=small), budget)
    found = found.select(*MARGINS, "p")
    return F.broadcast(found) if small else found


def _decided(rows: DataFrame, found: DataFrame) -> DataFrame:
    out = rows.join(found, list(MARGINS), "left").withColumn("p", F.when(F.col("tokens") == 0, 1.0).otherwise(F.coalesce("p", F.lit(0.0))))
    return out.withColumn("kept", chance(F.col("doc_id")) < F.col("p"))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, rules=TOPICS, bounded: bool = True) -> DataFrame:
    """``(doc_id, source, lang, topic, tokens, p, kept)`` for each input row.

    A document is kept if a hash of its doc_id, as a number in [0, 1), is below ``p``: repeated rows
    share their fate. Texts without words weigh nothing and are kept (p = 1). Without ``bounded`` the cells
    are raked first and cut at p = 1 afterwards, as ``mix_sql`` does.
    """
    rows = materialize(features(docs, rules), "features")
    return _decided(rows, chances(rows, targets, budget, bounded)).select("doc_id", *MARGINS, "tokens", "p", "kept")


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, rules=TOPICS) -> DataFrame:
    """The rows of ``docs`` that ``mix`` keeps."""
    found = chances(materialize(features(docs, rules), "features"), targets, budget)
    own = features(packed(docs, "doc_id", "text", "source", "lang"), rules, "row")
    return _decided(own, found).where("kept").select("row.*")


def mix_sql(budget: float = BUDGET, rounds: int = ROUNDS, temper: float = TEMPER, caps: int = CAP_ROUNDS, rules=TOPICS) -> str:
    """The same in SQL over ``documents``, with the rounds written out."""
    when = " ".join(f"WHEN {' OR '.join(f'contains(text, {chr(39)}{m}{chr(39)})' for m in marks)} THEN '{name}'" for name, marks in rules)
    parts = [
        f"f AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, CASE WHEN text IS NULL THEN '{NONE}' {when} ELSE 'prose' END AS topic, "
        "CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS tokens FROM documents)",
        "c AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS mass FROM f GROUP BY ALL HAVING sum(tokens) > 0)",
        "g AS (SELECT *, " + ", ".join(f"pow(sum(mass) OVER (PARTITION BY {m}) / sum(mass) OVER (), {temper}) AS raw_{m}, sum(mass) OVER (PARTITION BY {m}) AS own_{m}" for m in MARGINS) + " FROM c)",
        "w0 AS (SELECT *, mass / sum(mass) OVER () AS weight, " + ", ".join(f"raw_{m} / sum(raw_{m} * mass / own_{m}) OVER () AS goal_{m}" for m in MARGINS) + " FROM g)",
    ]
    n = 0
    for _ in range(rounds):
        for m in MARGINS:
            parts.append(f"w{n + 1} AS MATERIALIZED (SELECT * REPLACE (weight * goal_{m} / sum(weight) OVER (PARTITION BY {m}) AS weight) FROM w{n})")
            n += 1
    parts.append(f"p0 AS (SELECT source, lang, topic, mass, weight, sum(mass) OVER () * {budget} AS goal, 0.0::DOUBLE AS p FROM w{n})")
    for k in range(caps):
        left = "(goal - sum(CASE WHEN p >= 1 THEN mass ELSE 0 END) OVER ())"
        share = "sum(CASE WHEN p >= 1 THEN 0 ELSE weight END) OVER ()"
        parts.append(f"p{k + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN p >= 1 THEN 1.0 WHEN {share} > 0 THEN least(1.0, greatest(0.0, {left}) * weight / {share} / mass) ELSE 0.0 END AS p) FROM p{k})")
    return (
        "WITH " + ",\n".join(parts) + f", r AS (SELECT f.*, CASE WHEN tokens = 0 THEN 1.0 ELSE coalesce(round(q.p, 9), 0.0) END AS p FROM f LEFT JOIN p{caps} q USING (source, lang, topic))\n"
        "SELECT doc_id, source, lang, topic, tokens, p, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < p AS kept FROM r"
    )
