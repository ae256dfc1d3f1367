"""Secret scans with multipart credential linking.

Strong parts (assignments, access identifiers, long hex strings) are reported wherever they occur.
Weak parts prove nothing alone: user names, endpoints, and mixed strings that may be keys. They are
reported only where complementary parts lie within ``SCOPE`` code points in the same text: an
identifier needs a secret, a possible secret an identifier or an endpoint, an endpoint both an
identifier and a secret. Parts are joined as intervals, by bins of the scope's width.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_keys

#: Code points between two parts that may still belong together.
SCOPE = 200
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "user", "blob", "endpoint")
#: What a kind can stand for in a credential.
ROLES = {"assign": "secret", "hex": "secret", "blob": "secret", "access": "identifier", "user": "identifier", "endpoint": "endpoint"}
#: For a weak kind, the sets of roles of which each must have a member nearby.
NEEDS = {"user": (("secret",),), "blob": (("identifier", "endpoint"),), "endpoint": (("identifier",), ("secret",))}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_USER = re.compile(r"""(?<![A-Za-z0-9_])(?:user(?:_?name)?|login|account|client_?id)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9._@-]{3,}""", re.I | re.A)
_BLOB = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"""[a-z]{2,12}://[^\s"'<>]{4,}""")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Strong parts as ``(start, end, kind)`` in code points."""
    out = []
    if ":" in text or "=" in text:
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return out


def weak_spans(text: str) -> list[tuple[int, int, str]]:
    """Parts that count only together with others."""
    out = []
    if ":" in text or "=" in text:
        out += [(*m.span(), "user") for m in _USER.finditer(text)]
    if "://" in text:
        out += [(*m.span(), "endpoint") for m in _ENDPOINT.finditer(text)]
    for m in _BLOB.finditer(text):
        if re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0]) and re.search("[0-9]", m[0]):
            out.append((*m.span(), "blob"))
    return out


_KEY = ("k1", "k2")
_PART = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def parts(docs: DataFrame) -> DataFrame:
    """``(k1, k2, doc_id, base, weak)`` for each input row, the spans as arrays of (kind, start, end); no texts.

    ``k1`` and ``k2`` are shared by equal rows only. A null text has no parts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("*", *row_keys())

    def listed(spans: list[tuple[int, int, str]]) -> list[dict]:
        return [{"kind": k, "start": i, "end": j} for i, j, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, weak, digest = [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base.append(own := listed(base_spans(text)))
                digest.append(hashlib.sha256(",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in own).encode()).hexdigest())
                weak.append(listed(weak_spans(text)))
            columns = [*(batch.column(c) for c in ("k1", "k2", "doc_id")), pa.array(base, pa.list_(_PART)), pa.array(weak, pa.list_(_PART)), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "doc_id", "base", "weak", "base_sha256"])

    span = "array<struct<kind: string, start: long, end: long>>"
    return rows.mapInArrow(run, f"k1 long, k2 long, doc_id long, base {span}, weak {span}, base_sha256 string")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``(k1, k2, added)``: the weak parts of each text that complementary parts confirm.

    ``found`` comes from ``parts``. Two parts are together if at most ``scope`` code points lie
    between them. A bin has room for a bounded number of parts, so no key brings many pairs.
    """
    rows = found.where(F.size("weak") > 0).select(*_KEY, "base", "weak").dropDuplicates([*_KEY])
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    every = rows.select(*_KEY, F.explode(F.concat("base", "weak")).alias("p")).select(*_KEY, "p.kind", "p.start", "p.end")
    # A long part lies in every bin that it covers; one bin to either side then reaches the scope.
    other = every.select(*_KEY, role[F.col("kind")].alias("role"), F.col("start").alias("from"), F.col("end").alias("to"))
    other = other.withColumn("bin", F.explode(F.sequence(F.floor((F.col("from") - scope) / scope), F.floor((F.col("to") + scope) / scope))))
    weak = every.where(F.col("kind").isin(*NEEDS)).withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))))
    near = (F.col("from") <= F.col("end") + scope) & (F.col("to") >= F.col("start") - scope)
    met = weak.join(other, [*_KEY, "bin"]).where(near).groupBy(*_KEY, "kind", "start", "end").agg(*[F.max(F.col("role") == r).alias(r) for r in ("identifier", "secret", "endpoint")])
    good = F.lit(False)
    for kind, needs in NEEDS.items():
        fits = F.col("kind") == kind
        for roles in needs:
            fits = fits & F.greatest(*[F.col(r) for r in roles], F.lit(False))
        good = good | fits
    return met.where(good).groupBy(*_KEY).agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked)`` for each input row.

    ``spans`` lists ``kind:start:end`` of the strong parts and of the weak ones that were confirmed,
    by start, then by kind in the order of ``KINDS``; positions are code points, the end exclusive.
    A null text counts as empty.
    """
    found = materialize(parts(docs), "secret-parts")
    out = found.join(linked(found, scope), [*_KEY], "left").withColumn("added", F.coalesce("added", F.array().cast("array<struct<kind: string, start: long, end: long>>")))
    order = F.create_map(*[F.lit(x) for pair in zip(KINDS, range(len(KINDS)), strict=True) for x in pair])
    ordered = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    listed = F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *counts, "base_sha256", listed.alias("spans"), F.size("added").cast("long").alias("n_linked"))
