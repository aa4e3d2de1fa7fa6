"""Repair of chat roles at minimum cost, and rendering.

A legal conversation is an optional system turn, then user and assistant turns in
alternation that end with an assistant's. Each given turn is kept, relabelled, or
merged into the turn before it, and empty turns may be inserted; dynamic programming
over the states of that automaton finds the cheapest way (ties: the earlier of keep,
merge, relabel, insert). The states are the role of the last turn, so a run of
turns is a small min-plus matrix from the state before to the state after it.

Turns are dealt to ranges by (conversation, position), which cuts a conversation of
any length into runs of bounded size. Every range first yields the matrices of the
two conversations it may share with its neighbours; those of a conversation, one per
20,000 of its turns, are chained in one place; then every range repairs its turns on
its own, with the states before and after them.

Defined results: a null or unknown role costs a relabelling of 1; null text renders
as empty, and texts of any length whole; turns of equal position go by role, then text,
and are never told apart by ranges; repeated rows are turns of their own; null
conversation ids are one conversation, null positions come first; other columns are not
looked at, whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize

SYSTEM, USER, ASSISTANT = "system", "user", "assistant"
ROLES = (SYSTEM, USER, ASSISTANT)
#: States: nothing yet, or the role of the last turn (index into ROLES, plus one).
STATES = 4
MERGE, RELABEL, RELABEL_UNKNOWN, INSERT = 1, 2, 1, 3
_NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
_INF = 1 << 40
#: Turns in a range.
RANGE_TURNS = 20_000

_STATE = "at_part int, at_conv long, start int, end int, closes boolean"
#: Parts that share a conversation up to which their states are broadcast (under 64 MB).
BROADCAST_PARTS = 1_000_000
_MATRIX = "part int, conv_id long, last boolean, whole boolean, costs array<long>"
PIECE = "conv_id long, turn long, piece int, action string, role string, rendered string"


def state_of(role: str | None) -> int:
    """The state after a turn of this role; 0 for an unknown one."""
    return ROLES.index(role) + 1 if role in ROLES else 0


def moves(state: int, given: int) -> list[tuple[int, int, str, tuple[int, ...]]]:
    """(cost, state after, action, inserted) of each way to take a turn of role ``given`` (0: unknown)."""
    change = RELABEL if given else RELABEL_UNKNOWN
    out = []
    for to in _NEXT[state]:
        out.append((0, to, "keep", ()) if to == given else (change, to, "relabel", ()))
    if state:
        out.append((MERGE + (0 if state == given else change), state, "merge", ()))
    for step in _NEXT[state]:
        for to in _NEXT[step]:
            out.append((INSERT + (0 if to == given else change), to, "insert", (step,)))
            for last in _NEXT[to]:
                if last == given:
                    out.append((2 * INSERT, last, "insert", (step, to)))
    rank = {"keep": 0, "merge": 1, "relabel": 2, "insert": 3}
    return sorted(out, key=lambda m: (m[0], rank[m[2]], m[1], m[3]))


_MOVES = {(s, g): moves(s, g) for s in range(STATES) for g in range(STATES)}
#: Turns to add at the end, by state.
ENDING = {0: (), 1: (2, 3), 2: (3,), 3: ()}


def forward(given: list[int], start: int) -> tuple[list[int], list[list]]:
    """Least cost to each state, and for each turn the move into each state."""
    cost = [_INF] * STATES
    cost[start] = 0
    back = []
    for g in given:
        new, via = [_INF] * STATES, [None] * STATES
        for s in range(STATES):
            if cost[s] < _INF:
                for price, to, action, inserted in _MOVES[s, g]:
                    if cost[s] + price < new[to]:
                        new[to], via[to] = cost[s] + price, (s, action, inserted)
        cost = new
        back.append(via)
    return cost, back


def closing(state: int) -> int:
    return INSERT * len(ENDING[state])


def path(back: list[list], end: int) -> list[tuple[int, str, tuple[int, ...]]]:
    """(state after, action, inserted) of each turn on the way to ``end``."""
    out, state = [], end
    for via in reversed(back):
        before, action, inserted = via[state]
        out.append((state, action, inserted))
        state = before
    return out[::-1]


def chain(matrices: list[list[int]]) -> tuple[int, list[tuple[int, int]]]:
    """Least cost of a conversation in several runs, and the states before and after each."""
    cost, back = [0] + [_INF] * (STATES - 1), []
    for m in matrices:
        new, via = [_INF] * STATES, [0] * STATES
        for s in range(STATES):
            for t in range(STATES):
                if cost[s] + m[s * STATES + t] < new[t]:
                    new[t], via[t] = cost[s] + m[s * STATES + t], s
        cost = new
        back.append(via)
    end = min(range(STATES), key=lambda s: (cost[s] + closing(s), s))
    total, states = cost[end] + closing(end), []
    for via in reversed(back):
        states.append((via[end], end))
        end = via[end]
    return total, states[::-1]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, list[dict], bool]]:
    """(part, conversation, turns, whether the part ends with it) of a partition sorted by part and conversation."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["part"], row["conv_id"]) != (held[0]["part"], held[0]["conv_id"]):
                yield held[0]["part"], held[0]["conv_id"], held, row["part"] != held[0]["part"]
                held = []
            held.append(row)
    if held:
        yield held[0]["part"], held[0]["conv_id"], held, True


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matrices of the first and the last conversation of each part."""
    rows, part = [], None
    for now, conv, turns, last in _runs(batches):
        first = now != part
        part = now
        if first or last:
            given = [state_of(t["role"]) for t in turns]
            costs = [c for s in range(STATES) for c in forward(given, s)[0]]
            rows.append((now, conv, last, first and last, costs))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    types = [pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.int64())]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "conv_id", "last", "whole", "costs"])


def header(state: int, opened: bool) -> str:
    return f"{'<|im_end|>' + chr(10) if opened else ''}<|im_start|>{ROLES[state - 1]}\n"


def repair(turns: list[dict], start: int = 0, end: int | None = None, is_last: bool = True) -> list[tuple]:
    """Pieces (turn, piece, action, role, rendered) of a run; joined they are the rendered conversation.

    ``start``, ``end``: the states before and after the run (None: the cheapest end).
    """
    given = [state_of(t["role"]) for t in turns]
    cost, back = forward(given, start)
    if end is None:
        end = min(range(STATES), key=lambda s: (cost[s] + closing(s), s))
    out, opened = [], start > 0
    for t, (state, action, inserted) in zip(turns, path(back, end), strict=True):
        n = 0
        for s in inserted:
            out.append((t["turn"], n, "insert", ROLES[s - 1], header(s, opened)))
            opened, n = True, n + 1
        text = t["text"] or ""
        if action == "insert":
            action = "keep" if state_of(t["role"]) == state else "relabel"
        rendered = "\n" + text if action == "merge" else header(state, opened) + text
        opened = True
        out.append((t["turn"], n, action, ROLES[state - 1], rendered))
    if is_last:
        turn, n = (turns[-1]["turn"], out[-1][1] + 1) if turns else (None, 0)
        for s in ENDING[end]:
            out.append((turn, n, "insert", ROLES[s - 1], header(s, opened)))
            opened, n = True, n + 1
        if out:
            out[-1] = (*out[-1][:4], out[-1][4] + "<|im_end|>\n")
    return out


def _chained(edges: pa.Table) -> pa.Table:
    """The states before and after each run of one conversation, and whether it closes there."""
    rows = sorted(edges.to_pylist(), key=lambda e: (e["part"], e["last"]))
    runs = [e for i, e in enumerate(rows) if i == 0 or e["part"] != rows[i - 1]["part"]]
    ways = chain([e["costs"] for e in runs])[1] if len(runs) > 1 else []
    states = [(e["part"], e["conv_id"], start, end, e is runs[-1]) for e, (start, end) in zip(runs, ways, strict=False)]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
    columns = list(zip(*states, strict=True)) if states else [[]] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split(" ")[0] for c in _STATE.split(", ")])


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired runs of turns that carry the states of a conversation with several runs."""
    rows = []
    for _, conv, turns, _ in _runs(batches):
        first = turns[0]
        shared = first["start"] is not None
        rows += [(conv, *piece) for piece in (repair(turns, first["start"], first["end"], first["closes"]) if shared else repair(turns))]
        if len(rows) > 5000:
            yield _pieces(rows)
            rows = []
    yield _pieces(rows)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
    names = [c.split(" ")[0] for c in PIECE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def repair_roles(turns: DataFrame) -> DataFrame:
    """Pieces of the repaired conversations of ``turns`` (conv_id, turn, role, text), in order of (turn, piece).

    A piece per given turn and per inserted one. Turns that share a position share it here too.
    """
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    parts = max(1, -(-rows.count() // RANGE_TURNS))
    dealt = rows.repartitionByRange(parts, "conv_id", "turn").withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt.select("part", *order), "turns")
    sorted_ = dealt.repartition(parts, "part").sortWithinPartitions("part", *order)
    edges = sorted_.mapInArrow(_edges, _MATRIX)
    states = materialize(edges.groupBy("conv_id").applyInArrow(_chained, _STATE), "states")
    few = F.broadcast(states) if states.count() <= BROADCAST_PARTS else states
    same = (F.col("part") == F.col("at_part")) & F.col("conv_id").eqNullSafe(F.col("at_conv"))
    met = dealt.join(few, same, "left").drop("at_part", "at_conv")
    return met.repartition(parts, "part").sortWithinPartitions("part", *order).mapInArrow(_repairs, PIECE)


def query(spark, sf_dir: str) -> DataFrame:
    from .store import table

    return repair_roles(table(spark, sf_dir, "conversations"))
