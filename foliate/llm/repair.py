"""Conversation structure repair: the cheapest edits that make a conversation ``(system? (user assistant)+)?``.

A turn is kept (0), gets another role (1), is deleted (2; blank and repeated turns must be), or an empty
turn is put before it (5); a truncated turn that stays costs 5 more. A dynamic program runs backward
over turns and grammar states and gives the cost to go; a walk forward then takes the ASCII-least edit
among those on a cheapest path, which gives the least edit string of all.

Rows are dealt out by ranges of (conversation, turn), so no conversation has to fit a task. One that
lies whole within a task's range is repaired there. One that is cut goes on in stretches: each stretch
is a matrix of costs from state to state; their product from the end gives the cost to go after each
stretch; the walks through it from all four states then join up to one from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KEEP, RENAME, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows of a stretch, and rows and characters of a conversation that a task holds at once.
STRETCH, HELD_ROWS, HELD_CHARS = 4096, 50_000, 32 << 20
#: Bytes of repaired text handed on at once.
CHUNK = 1 << 20
BLANKS = r"\x20\x09-\x0D"
_BLANK = " \t\n\x0b\x0c\r"

#: Grammar states: nothing yet, after the system turn, after a user turn, after an assistant turn.
_NEXT: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_ROLE = ("user", "user", "assistant", "user")
_TURN = tuple(2 if role == "user" else 3 for role in _ROLE)
_FAR = 1 << 60
Costs = tuple[int, int, int, int]
#: What may end a conversation: nothing, or an assistant turn; other states still need turns.
END: Costs = (0, 2 * INSERT, INSERT, 0)
NOTHING = hashlib.sha256(b"").hexdigest()

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
_ROW = "turn long, role string, text string, gone boolean, part int, pos long"
_FIRST_PASS = f"{RESULT}, whole boolean, {_ROW}"


def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, gone)`` after the damage that crc32 of ``conv_id:turn`` modulo 20 does: 0 takes the row out (``gone``),
    1 empties its text, 2 takes ``.!?`` out of it, 3 doubles the row, 4 makes its role user. Null role and text, and nulls in the key, count as one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    out = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    out = out.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return out.drop("copy")


def _initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "-"


def symbol(role: str, text: str, repeated: bool) -> str:
    """Two letters for a turn: its role's initial (``-``: outside the grammar), and its first fault (``-``: none)."""
    words = text.rstrip(_BLANK)
    fault = "b" if not words else "d" if repeated else "t" if words[-1] not in ".!?" else "-"
    return _initial(role) + fault


def _closed(costs: list[int]) -> Costs:
    """Costs before a turn, once turns may be put in."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[_TURN[s]]) for s, c in enumerate(costs)]
    return tuple(min(c, _FAR) for c in costs)


def _stays(sym: str) -> int:
    """What it costs that a turn stays, apart from its edit; _FAR: it can't."""
    return {"b": _FAR, "d": _FAR, "t": TRUNCATED}.get(sym[1], 0)


def _kept(sym: str, state: int) -> int | None:
    return _NEXT[state].get(sym[0])


@lru_cache(maxsize=100_000)
def _before(sym: str, after: Costs) -> Costs:
    extra, out = _stays(sym), []
    for state in range(4):
        ways = [DELETE + after[state]]
        if extra < _FAR:
            ways.append(RENAME + extra + after[_TURN[state]])
            if (kept := _kept(sym, state)) is not None:
                ways.append(KEEP + extra + after[kept])
        out.append(min(ways))
    return _closed(out)


def before(sym: str, after: Costs) -> Costs:
    """Backward step: the cost to go before a turn, for each state, from that after it."""
    least = min(after)
    relative = _before(sym, tuple(c - least if c < _FAR else _FAR for c in after))
    return tuple(min(c + least, _FAR) for c in relative)


def to_go(symbols: list[str], end: Costs = END) -> list[Costs]:
    """Costs to go before each turn and, last, after all."""
    out = [end]
    for sym in reversed(symbols):
        out.append(before(sym, out[-1]))
    return out[::-1]


def matrix(symbols: list[str]) -> list[int]:
    """Costs from each state before the turns to each state right after the last, row by row."""
    columns = [to_go(symbols, tuple(0 if s == b else _FAR for s in range(4)))[0] for b in range(4)]
    return [columns[b][a] for a in range(4) for b in range(4)]


def walk(symbols: list[str], costs: list[Costs], state: int, last: bool) -> tuple[str, int]:
    """The ASCII-least edits on a cheapest path from ``state``, and the state they end in; ``last``: turns may be put in at the end."""
    edits = []
    for sym, now, after in zip(symbols, costs, costs[1:], strict=False):
        extra = _stays(sym)
        while True:
            left = now[state]
            if left == DELETE + after[state]:
                edits.append("D")
                break
            if left == INSERT + now[_TURN[state]]:
                edits.append("I")
                state = _TURN[state]
                continue
            kept = _kept(sym, state)
            if kept is not None and left == KEEP + extra + after[kept]:
                edits.append("K")
                state = kept
                break
            edits.append("R")
            state = _TURN[state]
            break
    while last and costs[-1][state]:
        edits.append("I")
        state = _TURN[state]
    return "".join(edits), state


def rebuilt(edits: str, rows: Iterable[tuple[str, str]], state: int = 0) -> Iterator[str]:
    """The repaired turns as ``role:text``; ``rows``: role and text of each turn."""
    left = iter(rows)
    for edit in edits:
        if edit == "I":
            yield f"{_ROLE[state]}:"
            state = _TURN[state]
            continue
        role, text = next(left)
        if edit == "R":
            yield f"{_ROLE[state]}:{text}"
            state = _TURN[state]
        elif edit == "K":
            yield f"{role}:{text}"
            state = _NEXT[state][role[:1]]


def legal(one: str, two: str) -> bool:
    """Whether these role initials may follow each other."""
    return one + two in ("su", "ua", "au")


def _illegal(initials: list[str]) -> int:
    return sum(not legal(a, b) for a, b in zip(initials, initials[1:], strict=False))


def _span(low: int | None, high: int | None, different: int) -> int:
    return 0 if low is None else min(high - low + 1 - different, (1 << 63) - 1)


def repaired(conv_id: int | None, rows: list[tuple[int | None, str, str]]) -> tuple:
    """A row of the result for one whole conversation, ``rows`` being its turn, role and text in order."""
    seen: set[bytes] = set()
    symbols = []
    for _, role, text in rows:
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        symbols.append(symbol(role, text, key in seen))
        seen.add(key)
    turns = [r[0] for r in rows if r[0] is not None]
    costs = to_go(symbols)
    edits, _ = walk(symbols, costs, 0, True)
    lines = "\n".join(rebuilt(edits, ((role, text) for _, role, text in rows)))
    faults = [sum(s[1] == f for s in symbols) for f in "bdt"]
    gaps = _span(min(turns, default=None), max(turns, default=None), len(set(turns)))
    return (conv_id, gaps, *faults, _illegal([s[0] for s in symbols]), costs[0][0], edits, hashlib.sha256(lines.encode("utf-8", "surrogatepass")).hexdigest())


def _schema(spec: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in spec.split(", "))])


def _batch(rows: list[tuple], spec: str) -> pa.RecordBatch:
    schema = _schema(spec)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _whole_or_cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Results of the conversations that lie whole within this task; the rows of its first and last one, and of any of over ``most`` rows, as they are."""
    part, pos, runs = TaskContext.get().partitionId(), 0, 0
    width, tail = len(RESULT.split(", ")), len(_ROW.split(", "))
    done: list[tuple] = []
    held: list[tuple] = []
    size, current, cut = 0, None, True

    def passed_on(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        nonlocal pos
        for at in range(0, len(rows), 1000):
            some = rows[at : at + 1000]
            yield _batch([(current[0], *[None] * (width - 1), False, *r, part, pos + at + i) for i, r in enumerate(some)], _FIRST_PASS)
        pos += len(rows)

    for batch in batches:
        for conv_id, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone")), strict=True):
            if current != (conv_id,):
                if current and not cut:
                    done.append((*repaired(current[0], [r[:3] for r in held if not r[3]]), True, *[None] * tail))
                elif current:
                    yield from passed_on(held)
                if len(done) >= 1000:
                    yield _batch(done, _FIRST_PASS)
                    done = []
                current, held, size, cut = (conv_id,), [], 0, runs == 0
                runs += 1
            held.append(tuple(row))
            size += len(row[2])
            if cut and len(held) >= 1000 or len(held) > most or size > HELD_CHARS:
                cut = True
                yield from passed_on(held)
                held, size = [], 0
    if current:
        yield from passed_on(held)
    if done:
        yield _batch(done, _FIRST_PASS)


_KEY = ("conv_id", "part", "stretch")


def _matrices(table: pa.Table) -> pa.Table:
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("pos", "sym")), strict=True))
    symbols = [s for _, s in rows]
    key = [table.column(c)[0].as_py() for c in _KEY]
    faults = [sum(s[1] == f for s in symbols) for f in "bdt"]
    return pa.Table.from_batches([_batch([(*key, *faults, _illegal([s[0] for s in symbols]), symbols[0][0] + symbols[-1][0], matrix(symbols))], _MATRICES)])


_MATRICES = "conv_id long, part int, stretch long, blank long, duplicate long, truncated long, illegal long, ends string, costs array<long>"
_ENDS = "conv_id long, part int, stretch long, after array<long>, last boolean, meets long, cost long"


def _costs_after(table: pa.Table) -> pa.Table:
    """The stretches of a conversation, each with the cost to go after it; the first has the cost of all."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("part", "stretch", "ends", "costs")), strict=True))
    conv_id, now, out = table.column("conv_id")[0].as_py(), END, []
    for i in range(len(rows) - 1, -1, -1):
        part, stretch, ends, costs = rows[i]
        meets = int(i + 1 < len(rows) and not legal(ends[1], rows[i + 1][2][0]))
        after, now = now, tuple(min(costs[4 * a + b] + now[b] for b in range(4)) for a in range(4))
        out.append((conv_id, part, stretch, list(after), i + 1 == len(rows), meets, now[0] if i == 0 else 0))
    return pa.Table.from_batches([_batch(out, _ENDS)])


_WALKS = "conv_id long, part int, stretch long, edits array<string>, leaves array<long>"


def _walks(symbols: pa.Table, ends: pa.Table) -> pa.Table:
    """The walk through a stretch from each state."""
    listed = [s for _, s in sorted(zip(*(symbols.column(c).to_pylist() for c in ("pos", "sym")), strict=True))]
    costs = to_go(listed, tuple(ends.column("after")[0].as_py()))
    found = [walk(listed, costs, state, ends.column("last")[0].as_py()) for state in range(4)]
    key = [ends.column(c)[0].as_py() for c in _KEY]
    return pa.Table.from_batches([_batch([(*key, [f[0] for f in found], [f[1] for f in found])], _WALKS)])


_STATES = "conv_id long, part int, stretch long, state long"


def _joined_up(table: pa.Table) -> pa.Table:
    rows, state, out = sorted(zip(*(table.column(c).to_pylist() for c in ("part", "stretch", "leaves")), strict=True)), 0, []
    for part, stretch, leaves in rows:
        out.append((table.column("conv_id")[0].as_py(), part, stretch, state))
        state = leaves[state]
    return pa.Table.from_batches([_batch(out, _STATES)])


_PIECES = "conv_id long, part int, stretch long, piece long, edits string, lines binary"


def _pieces(rows: pa.Table, chosen: pa.Table) -> pa.Table:
    """The repaired turns of a stretch, each after a line end, in pieces; the first has the edits."""
    turns = [(r, t) for _, r, t in sorted(zip(*(rows.column(c).to_pylist() for c in ("pos", "role", "text")), strict=True))]
    edits, key = chosen.column("edits")[0].as_py(), [chosen.column(c)[0].as_py() for c in _KEY]
    pieces, held = [], bytearray()
    for line in rebuilt(edits, turns, chosen.column("state")[0].as_py()):
        held += b"\n" + line.encode("utf-8", "surrogatepass")
        if len(held) > CHUNK:
            pieces.append(bytes(held))
            held.clear()
    pieces.append(bytes(held))
    return pa.Table.from_batches([_batch([(*key, i, "" if i else edits, p) for i, p in enumerate(pieces)], _PIECES)])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of conversations whose pieces come in order; only one piece is held."""
    current, edits, digest, begun = None, [], hashlib.sha256(), False
    for batch in batches:
        for conv_id, some, lines in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edits", "lines")), strict=True):
            if current != (conv_id,):
                if current:
                    yield _batch([(current[0], "".join(edits), digest.hexdigest())], "conv_id long, audit string, repaired_sha256 string")
                current, edits, digest, begun = (conv_id,), [], hashlib.sha256(), False
            edits.append(some)
            digest.update(lines if begun else lines[1:])
            begun = begun or bool(lines)
    if current:
        yield _batch([(current[0], "".join(edits), digest.hexdigest())], "conv_id long, audit string, repaired_sha256 string")


def _same(a: DataFrame, b: DataFrame, names: tuple[str, ...], how: str = "inner") -> DataFrame:
    """Join on ``names``, nulls being equal to nulls."""
    other = b.select(*[F.col(c).alias(f"_{c}") if c in names else F.col(c) for c in b.columns])
    on: Column = F.lit(True)
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(other, on, how).drop(*[f"_{c}" for c in names])


def across_stretches(rows: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The result for conversations given as ``(conv_id, turn, role, text, gone, part, pos)``, in stretches of so many rows that tasks share out."""
    rows = rows.withColumn("stretch", F.floor(F.col("pos") / stretch).cast("long"))
    there = rows.where("not gone")
    keyed = there.select(*_KEY, "pos", "turn", "role", "text", F.sha2("text", 256).alias("digest"))
    first = materialize(keyed.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("part", "pos")).alias("first")), "first")
    met = _same(keyed.drop("text"), first, ("conv_id", "role", "digest")).select(*_KEY, "pos", (F.col("first") < F.struct("part", "pos")).alias("repeated"))
    words = F.regexp_replace("text", f"[{BLANKS}]+\\z", "")
    marked = _same(there.select(*_KEY, "pos", "role", words.alias("words")), met, (*_KEY, "pos"))
    initial = F.substring("role", 1, 1)
    fault = F.when(F.col("words") == "", "b").when(F.col("repeated"), "d").when(~F.substring("words", -1, 1).isin(".", "!", "?"), "t").otherwise("-")
    symbols = materialize(marked.select(*_KEY, "pos", F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("-"), fault).alias("sym")), "symbols")
    matrices = materialize(symbols.groupBy(*_KEY).applyInArrow(_matrices, _MATRICES), "matrices")
    ends = materialize(matrices.groupBy("conv_id").applyInArrow(_costs_after, _ENDS), "ends")
    walks = materialize(symbols.groupBy(*_KEY).cogroup(ends.groupBy(*_KEY)).applyInArrow(_walks, _WALKS), "walks")
    states = walks.drop("edits").groupBy("conv_id").applyInArrow(_joined_up, _STATES)
    chosen = _same(walks, states, _KEY).select(*_KEY, "state", F.expr("edits[cast(state AS int)]").alias("edits"))
    pieces = there.select(*_KEY, "pos", "role", "text").groupBy(*_KEY).cogroup(chosen.groupBy(*_KEY)).applyInArrow(_pieces, _PIECES)
    order = ("conv_id", "part", "stretch", "piece")
    digests = pieces.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "edits", "lines").mapInArrow(_digests, "conv_id long, audit string, repaired_sha256 string")
    faults = matrices.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    costs = ends.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.sum("meets").alias("meets"))
    wide = "cast(max(turn) AS decimal(20, 0)) - min(turn) + 1 - count(turn)"
    turns = there.select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.expr(f"cast(coalesce(least({wide}, {(1 << 63) - 1}), 0) AS long)").alias("gaps"))
    out = rows.select("conv_id").distinct()
    for part in (turns, faults, costs, digests):
        out = _same(out, part, ("conv_id",), "left")
    out = out.withColumn("illegal", F.col("illegal") + F.col("meets")).na.fill(0, list(COUNTS)).na.fill({"audit": "", "repaired_sha256": NOTHING})
    return out.select("conv_id", *COUNTS, "audit", "repaired_sha256")


def repair(conversations: DataFrame, held: int = HELD_ROWS, stretch: int = STRETCH) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` for each conversation, after its damage.

    Turns stand in the order of turn (nulls first), then role and a hash of the text. Roles count by their first letter;
    one outside ``s``, ``u``, ``a``, an empty one too, can't be kept. Null conv_ids are one conversation; null role and text
    count as one space. A conversation that the damage leaves without rows has zeros, no edits and the
    hash of nothing. An empty table gives no rows; other columns are left out. A hash reads its conversation in order,
    so one task streams the pieces of the longest; everything else is spread over its stretches.
    """
    rows = damaged(conversations.select("conv_id", "turn", "role", "text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64("text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    found = materialize(placed.mapInArrow(lambda batches: _whole_or_cut(batches, held), _FIRST_PASS), "conversations")
    whole = found.where("whole").select(*[c.split()[0] for c in RESULT.split(", ")])
    return whole.unionByName(across_stretches(found.where("not whole").select("conv_id", *[c.split()[0] for c in _ROW.split(", ")]), stretch))
