"""Source divergence audit: how far apart the sources of a language are in their words, and by which terms.

An inverted index holds, for each kept term, the sources that use it. A pair of sources starts at
``V`` times the value of a term that neither uses. Corrections follow, and only where they are not
zero: a source's postings bring those for its own terms against the other's zero count, summed up by
count (terms of one count have one share); a term's posting list brings those for pairs that both use
it. No pair ever meets a term that neither has.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Letters; of these only A-Z have a lower case here.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that a kept term must occur in.
LEAST_DOCUMENTS = 10
#: What shares are multiplied by, and the counts added to each term.
SCALE, ADDED = 1_000_000_000, 2
#: Counts that a task holds before it passes them on.
ENTRIES = 300_000
#: Terms told of each source.
TOP = 10
PAIR, TERMS = "pair", "term"


def share(count: str, total: str, kept: str = "v") -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * V)) as a long; the product is a decimal, since it passes a long's range."""
    wide = lambda x: f"cast({x} AS decimal(19, 0))"
    return F.expr(f"1 + ({wide(count)} + {ADDED}) * cast({SCALE} AS decimal(10, 0)) div ({wide(total)} + {ADDED} * {wide(kept)})")


def gap(p: str, q: str) -> str:
    """floor((p - q)^2 / (p + q)) as a SQL expression; shares are at most SCALE + 1, so the square fits a long."""
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


#: Each byte of UTF-8 as it stands in a term; a blank where it can't. Bytes of letters beyond ASCII stay.
_BYTES = bytes(ord(chr(b).lower()) if chr(b).isascii() and chr(b).isalpha() else b if b >= 0x80 else 0x20 for b in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts summed over the task's documents, passed on whenever ``ENTRIES`` terms of all sources have come together."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def passed_on() -> pa.RecordBatch:
        rows = [(*key, term, n, docs[term]) for key, (ns, docs) in held.items() for term, n in ns.items()]
        held.clear()
        lang, source, term, n, docs = zip(*rows, strict=True) if rows else ((),) * 5
        columns = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            terms = text.translate(_BYTES).split()
            ns, docs = held.setdefault((lang, source), (Counter(), Counter()))
            ns.update(terms)
            docs.update(set(terms))
        if sum(len(ns) for ns, _ in held.values()) > ENTRIES:
            yield passed_on()
    if held:
        yield passed_on()


def counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of each term and documents with it. ``docs``: lang, source, text without nulls.

    Tasks count terms over their batches before the shuffle, so a frequent word is a row for each task and source, not for each document.
    """
    found = docs.select("lang", "source", "text").mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def index(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The postings, the groups and the languages' terms.

    Postings ``(lang, source, term, n, p)`` for kept terms; groups ``(lang, source, v, total, p0)`` for every lang and source,
    p0 the share of a term with no occurrence; terms ``(lang, term, q)`` with the language's own shares.
    """
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = materialize(counts(rows), "counts")
    kept = materialize(found.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs"), "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_total"))
    postings = materialize(found.drop("docs").join(kept.select("lang", "term"), ["lang", "term"]), "postings")
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(langs.select("lang", "v"), "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["v", "total"])
    groups = materialize(groups.withColumn("p0", F.when(F.col("v") > 0, share("0", "total"))), "groups")
    postings = postings.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", share("n", "total").alias("p"))
    return postings, groups, kept.join(langs, "lang").select("lang", "term", share("all_n", "lang_total").alias("q"))


def pairs(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for each ordered pair of a language's sources."""
    here = groups.select("lang", "source", F.col("p0").alias("p0"), "v")
    there = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    both = materialize(here.join(there, "lang").where("source < item"), "pairs")
    start = both.select("lang", "source", "item", F.expr(f"coalesce(v * {gap('p0', 'q0')}, 0L)").alias("value"))
    # Terms of one source, as if the other had none of them: terms of one count together.
    same = materialize(postings.groupBy("lang", "source", "p").agg(F.count("*").alias("terms")), "shares")
    left = same.join(both, ["lang", "source"]).select("lang", "source", "item", F.expr(f"terms * ({gap('p', 'q0')} - {gap('p0', 'q0')})").alias("value"))
    right = same.withColumnRenamed("source", "item").join(both, ["lang", "item"]).select("lang", "source", "item", F.expr(f"terms * ({gap('p0', 'p')} - {gap('p0', 'q0')})").alias("value"))
    # Terms of both: what the two sums above have wrong. A posting list is at most as long as the language has sources.
    zero = groups.select("lang", "source", "p0")
    listed = materialize(postings.join(zero, ["lang", "source"]).select("lang", "term", "source", "p", "p0"), "lists")
    other = listed.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    wrong = f"{gap('p', 'q')} - {gap('p', 'q0')} - {gap('p0', 'q')} + {gap('p0', 'q0')}"
    met = listed.join(other, ["lang", "term"]).where("source < item").select("lang", "source", "item", F.expr(wrong).alias("value")).where("value <> 0")
    one = start.unionByName(left).unionByName(right).unionByName(met).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    one = materialize(one, "sums")
    return one.unionByName(one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    """``rows`` with their ranks within lang and source; with ``most``, tasks drop what can't be among the first before rows are shuffled."""
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    out = rows.withColumn("rank", F.row_number().over(order))
    out = out if most is None else out.where(F.col("rank") <= most)
    return out.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)``, part ``pair`` (each other source of the lang) and ``term`` (the ``top`` terms that set a source apart).

    Null text, lang and source count as empty. A source without terms takes part in pairs; a language
    of one source has none, one without kept terms has values 0 and no terms. Repeated rows are
    documents of their own. Ties rank by item, in the order of UTF-8 bytes. An empty table gives no rows.
    """
    postings, groups, terms = index(docs, least)
    apart = postings.join(terms, ["lang", "term"]).where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value"))
    return ranked(pairs(postings, groups), PAIR).unionByName(ranked(apart, TERMS, top))


def audit_sql(least: int = LEAST_DOCUMENTS, top: int = TOP) -> str:
    """The same from all shares of all groups, without an index."""
    p = lambda n, total: f"1 + CAST({SCALE} AS HUGEINT) * ({n} + {ADDED}) // ({total} + {ADDED} * v)"
    f = "(p - q) * (p - q) // (p + q)"
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERM}') AS terms FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
words AS (SELECT id, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= {least}),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
found AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS total FROM found GROUP BY lang, source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(w.n, 0) AS n, {p('coalesce(w.n, 0)', 'coalesce(t.total, 0)')} AS p, {p('k.n', 'l.total')} AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN found w ON w.lang = g.lang AND w.source = g.source AND w.term = k.term),
pair_values AS (
  SELECT a.lang, a.source, b.source AS item, sum({f.replace('p', 'a.p').replace('q', 'b.p')}) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(x.value, 0) AS value FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN pair_values x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source),
terms AS (SELECT lang, source, term AS item, {f} AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, '{PAIR}' AS part, item, value FROM pairs UNION ALL SELECT lang, source, '{TERMS}', item, value FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item ASC) AS rank FROM ranked)
WHERE part = '{PAIR}' OR rank <= {top}
"""
