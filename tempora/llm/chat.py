"""Chat formatting with minimum-cost role repair.

A conversation is legal if an optional system turn comes first, then user and assistant take turns,
the user first, and a user or assistant turn is last.  Dynamic programming over the automaton of
last roles chooses, turn by turn, the cheapest of

* keep the turn (0) or relabel it (``RELABEL``),
* merge it into the turn before (``MERGE``, and ``RELABEL`` if the roles differ),
* insert an empty turn before it (``INSERT``) or, at the end, after it;

of equal costs the choice listed first in ``ACTIONS`` wins.  Then the repaired sequence is rendered.

Scale: turns of a conversation are cut into parts of ``PART`` turn numbers.  A part's effect on
the automaton is a 4 x 4 matrix of least costs, and matrices of consecutive parts multiply (min for
sum, sum for product); so the parts of a long conversation are worked on side by side, their matrices
chained, and each part repaired between the states the chain gives it.  A conversation of one part,
the usual case, needs no chain.  Each part is one row of output, so no row grows with a conversation;
rendered parts put together in order are the whole conversation.

Defined results: turns are ordered by turn, then role and text, null turns last; rows repeated in
conversation, turn, role and text are one turn; a row without conv_id is a conversation of its own;
roles are compared without case and outer blanks, a null or other role fits nothing and must be
relabelled; a null text is empty; ``<|`` in a text becomes ``< |``, so that no text can pass for a
turn; an empty table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm import common

PART = 4096
MERGE, RELABEL, INSERT = 1.0, 2.0, 3.0
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("start", "system", "user", "assistant")
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FINAL = (USER, ASSISTANT)
ACTIONS = ("keep", "merge", "relabel", "insert", "insert+relabel", "merge+relabel")
LAST_PART = 1 << 62


def role_of(role: str | None) -> int | None:
    name = (role or "").strip().lower()
    return NAMES.index(name) if name in NAMES[1:] else None


def moves(role: int | None) -> list[tuple[float, int, int, int, int | None]]:
    """(cost, action, state before, state after, role of an inserted turn)"""
    out = []
    for s in range(4):
        if s != START:
            same = s == role
            out.append((MERGE if same else MERGE + RELABEL, 1 if same else 5, s, s, None))
        for q in NEXT[s]:
            out.append((0.0, 0, s, q, None) if q == role else (RELABEL, 2, s, q, None))
        for p in NEXT[s]:
            for q in NEXT[p]:
                out.append((INSERT, 3, s, q, p) if q == role else (INSERT + RELABEL, 4, s, q, p))
    return sorted(out, key=lambda m: (m[0], m[1], m[2], m[3], m[4] or 0))


MOVES = {r: moves(r) for r in (None, SYSTEM, USER, ASSISTANT)}


def advance(costs: list[float], role: int | None) -> tuple[list[float], list[tuple | None]]:
    after, how = [math.inf] * 4, [None] * 4
    for move in MOVES[role]:
        c = costs[move[2]] + move[0]
        if c < after[move[3]]:
            after[move[3]], how[move[3]] = c, move
    return after, how


def effect(roles: list[int | None]) -> list[list[float]]:
    """Least cost from each state before the turns to each state after them."""
    out = []
    for s in range(4):
        costs = [0.0 if i == s else math.inf for i in range(4)]
        for r in roles:
            costs, _ = advance(costs, r)
        out.append(costs)
    return out


def finish(state: int) -> tuple[float, int | None]:
    """Cost of ending here, and the role of an empty turn that must be added."""
    return (0.0, None) if state in FINAL else (INSERT, NEXT[state][-1])


def best_end(costs: list[float]) -> int:
    return min(range(4), key=lambda s: (costs[s] + finish(s)[0], s))


def repair_part(roles: list[int | None], enter: int, leave: int | None) -> tuple[float, list[tuple]]:
    """Cost and moves from state ``enter`` to state ``leave`` (None: the best end)."""
    costs, trail = [0.0 if s == enter else math.inf for s in range(4)], []
    for r in roles:
        costs, how = advance(costs, r)
        trail.append(how)
    state = best_end(costs) if leave is None else leave
    cost, chosen = costs[state], []
    for how in reversed(trail):
        chosen.append(how[state])
        state = how[state][2]
    return cost, chosen[::-1]


def chain(effects: list[list[list[float]]]) -> list[tuple[int, int]]:
    """States before and after each part on the cheapest way through all of them."""
    prefix = [[0.0 if s == START else math.inf for s in range(4)]]
    for m in effects:
        prefix.append([min(prefix[-1][i] + m[i][j] for i in range(4)) for j in range(4)])
    state, out = best_end(prefix[-1]), []
    for i in range(len(effects) - 1, -1, -1):
        before = min(range(4), key=lambda s: (prefix[i][s] + effects[i][s][state], s))
        out.append((before, state))
        state = before
    return out[::-1]


def render(texts: list[str | None], chosen: list[tuple], enter: int, last: bool) -> tuple[str, list[str]]:
    """The text of a part, which continues that of the part before it, and its turns' roles."""
    out, roles, state = [], [], enter

    def begin(role: int) -> None:
        out.append(("" if state == START else "<|end|>\n") + f"<|{NAMES[role]}|>\n")
        roles.append(NAMES[role])

    for text, (_, _, _, after, inserted) in zip(texts, chosen, strict=True):
        text = (text or "").replace("<|", "< |")
        merged = after == state and inserted is None
        if inserted is not None:
            begin(inserted)
            state = inserted
        if merged:
            out.append("\n")
        else:
            begin(after)
        state = after
        out.append(text)
    if last:
        added = finish(state)[1]
        if added is not None:
            begin(added)
        out.append("<|end|>\n")
    return "".join(out), roles


def parts_of(turns: DataFrame) -> DataFrame:
    """``conv_id, alone, part, turns``: turns in order, at most ``PART`` turn numbers in a row."""
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    rows = turns.select("conv_id", alone.alias("alone"), "turn", "role", "text").distinct()
    part = F.when(F.col("conv_id").isNull(), 0).otherwise(F.coalesce(F.floor(F.col("turn") / PART), F.lit(LAST_PART))).cast("long")
    turn = F.struct(F.col("turn").isNull().alias("late"), "turn", F.col("role").isNull().alias("bare"), "role", "text")
    return rows.groupBy("conv_id", "alone", part.alias("part")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def repair(turns: DataFrame) -> DataFrame:
    """``conv_id, part, n_turns, cost, actions, roles, rendered``: one row per part of a conversation."""
    common.ship(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()
    parts = common.stored(parts_of(turns), "parts")
    many = parts.where("alone is null").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv_id")
    many = common.stored(many, "long-conversations")

    def effects(batches):
        for batch in batches:
            found = [[c for row in effect([role_of(t["role"]) for t in p]) for c in row] for p in batch.column("turns").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), pa.array(found, pa.list_(pa.float64()))], names=["conv_id", "part", "effect"])

    def chains(batches):
        for batch in batches:
            rows = []
            for conv, held in zip(batch.column("conv_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                ends = chain([[p["effect"][4 * i:4 * i + 4] for i in range(4)] for p in held])
                rows += [(conv, p["part"], a, b, i + 1 == len(held)) for i, (p, (a, b)) in enumerate(zip(held, ends, strict=True))]
            types = (batch.schema.field("conv_id").type, pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["conv_id", "part", "enter", "leave", "last"])

    longer = parts.where("alone is null").join(many, "conv_id").select("conv_id", "part", "turns")
    matrices = longer.mapInArrow(effects, f"conv_id {kind}, part bigint, effect array<double>")
    whole = matrices.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "effect"))).alias("parts"))
    ends = whole.mapInArrow(chains, f"conv_id {kind}, part bigint, enter int, leave int, last boolean")

    def apply(batches):
        for batch in batches:
            out = []
            columns = (batch.column(n).to_pylist() for n in ("turns", "enter", "leave", "last"))
            for held, enter, leave, last in zip(*columns, strict=True):
                enter, last = (START, True) if enter is None else (enter, last)
                cost, chosen = repair_part([role_of(t["role"]) for t in held], enter, leave)
                text, roles = render([t["text"] for t in held], chosen, enter, last)
                state = chosen[-1][3]
                out.append((len(held), cost + (finish(state)[0] if last else 0.0), ",".join(ACTIONS[m[1]] for m in chosen), ",".join(roles), text))
            types = (pa.int64(), pa.float64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("part"), *(pa.array([o[i] for o in out], t) for i, t in enumerate(types))],
                names=["conv_id", "part", "n_turns", "cost", "actions", "roles", "rendered"])

    told = parts.join(ends, ["conv_id", "part"], "left").select("conv_id", "part", "turns", "enter", "leave", "last")
    return told.mapInArrow(apply, f"conv_id {kind}, part bigint, n_turns bigint, cost double, actions string, roles string, rendered string")
