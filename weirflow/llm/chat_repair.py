"""Chat formatting: minimum-cost repair of roles over a legal-turn automaton, and rendering of the repaired sequence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import freeze

MERGE, RELABEL, INSERT = 1, 2, 3  # cost of joining the message before, of another role, of an empty message
CHUNK = 4096  # turns that are decided together; longer conversations are joined by their chunks' cost matrices
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "human": USER, "assistant": ASSISTANT, "bot": ASSISTANT}
NAMES = ["", "system", "user", "assistant"]
FAR = 1 << 50

# empty messages that must be inserted between a message of one state and a new one of another; absent: not legal
BETWEEN = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,), (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,), (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
AFTER = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def _steps() -> list[list[tuple[int, int, int, int]]]:
    """Per own role (0: unknown) the moves (from, to, cost, code); a move's code is 8 from + 2 to + merged."""
    out = []
    for own in range(4):
        moves = []
        for to in (SYSTEM, USER, ASSISTANT):
            named = 0 if to == own else RELABEL
            moves.append((to, to, named + MERGE, 8 * to + 2 * to + 1))
            moves += [(q, to, named + INSERT * len(b), 8 * q + 2 * to) for (q, s), b in BETWEEN.items() if s == to]
        out.append(sorted(moves, key=lambda m: m[2]))
    return out


STEPS = _steps()


def _forward(own: list[int], start: int) -> tuple[list[int], list[list[int]]]:
    """Least cost of ending in each state, and per turn and state the code of the move that got there."""
    cost, codes = [FAR] * 4, []
    cost[start] = 0
    for r in own:
        new, by = [FAR] * 4, [-1] * 4
        for q, s, c, code in STEPS[r]:
            if cost[q] + c < new[s]:
                new[s], by[s] = cost[q] + c, code
        cost = new
        codes.append(by)
    return cost, codes


def _trace(codes: list[list[int]], end: int) -> list[int]:
    out = []
    for by in reversed(codes):
        out.append(by[end])
        if by[end] < 0:
            return [-1] * len(codes)
        end = by[end] >> 3
    return out[::-1]


def _ending(cost: list[int]) -> int:
    return min((SYSTEM, USER, ASSISTANT), key=lambda s: cost[s] + INSERT * len(AFTER[s]))


def repaired(own: list[int]) -> list[int]:
    """Codes of the cheapest legal repair of a whole conversation."""
    cost, codes = _forward(own, START)
    return _trace(codes, _ending(cost))


_SCHEMA = "conv_id long, turn long, role string, text string, chunk long, pos int, last boolean, codes array<int>, costs array<long>"


def _decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Decide the conversations that lie whole inside the partition; give parts of others for all states at their ends.

    Rows arrive sorted. A part's rows carry the twelve codes for (state before, state after), and a row without a
    position carries the part's cost matrix.
    """
    pid, seq = TaskContext.get().partitionId(), 0
    held: pd.DataFrame | None = None
    fresh = False  # whether the held conversation began inside this partition

    def told(run: pd.DataFrame, whole: bool) -> pd.DataFrame:
        nonlocal seq
        own = [ROLES.get(str(x).strip().lower(), 0) for x in run["role"]]
        out = run.assign(chunk=(pid << 24) + seq, pos=np.arange(len(run), dtype=np.int32), last=False, costs=None)
        seq += 1
        if whole:
            out["codes"] = [[c] for c in repaired(own)]
            out.iloc[-1, out.columns.get_loc("last")] = True
            return out
        paths, matrix = [], []
        for q in range(4):
            cost, codes = _forward(own, q)
            matrix += cost[1:]
            paths += [_trace(codes, s) for s in (SYSTEM, USER, ASSISTANT)]
        out["codes"] = [list(x) for x in zip(*paths)]
        note = out.iloc[[0]].assign(text=None, role=None, pos=-1, codes=None)
        note["costs"] = [matrix]
        return pd.concat([out, note], ignore_index=True)

    def cut(run: pd.DataFrame, whole: bool) -> Iterator[pd.DataFrame]:
        if len(run) <= CHUNK:
            yield told(run, whole)
        else:
            for k in range(0, len(run), CHUNK):
                yield told(run.iloc[k:k + CHUNK].reset_index(drop=True), False)

    for part in batches:
        if not len(part):
            continue
        rows = part if held is None else pd.concat([held, part], ignore_index=True)
        conv = rows["conv_id"]
        change = np.nonzero(((conv != conv.shift()) & ~(conv.isna() & conv.shift().isna())).to_numpy()[1:])[0] + 1
        edges = [0, *change.tolist()]
        out = []
        for a, b in zip(edges, edges[1:]):
            out += cut(rows.iloc[a:b].reset_index(drop=True), fresh)
            fresh = True
        held = rows.iloc[edges[-1]:]
        while len(held) >= 2 * CHUNK:  # a long conversation leaves in chunks, so that no more is held
            out.append(told(held.iloc[:CHUNK].reset_index(drop=True), False))
            held, fresh = held.iloc[CHUNK:], False
        if out:
            yield pd.concat(out, ignore_index=True)
    if held is not None and len(held):
        yield pd.concat(list(cut(held.reset_index(drop=True), False)), ignore_index=True)


def _joined(parts: pd.DataFrame) -> pd.DataFrame:
    """States before and after each part of one conversation, from the parts' cost matrices in order."""
    parts = parts.sort_values("chunk")
    cost, ways = [0, FAR, FAR, FAR], []
    for m in parts["costs"]:
        options = [[cost[q] + int(m[3 * q + s - 1]) for q in range(4)] for s in (SYSTEM, USER, ASSISTANT)]
        ways.append([0] + [min(range(4), key=o.__getitem__) for o in options])
        cost = [FAR] + [min(o) for o in options]
    end, found = _ending(cost), []
    for way in reversed(ways):
        found.append((way[end], end))
        end = way[end]
    before, after = zip(*found[::-1])
    return pd.DataFrame({"chunk": parts["chunk"], "before": before, "after": after, "ends": [False] * (len(parts) - 1) + [True]})


def _empty(state: int) -> str:
    return f"<|im_start|>{NAMES[state]}\n<|im_end|>\n"


def repair(turns: DataFrame) -> DataFrame:
    """`conv_id, turn, role, place, new_role, action, inserted, rendered`: one row per turn of the repaired conversations.

    Legal is: one system message at most, first; then user and assistant in turn, the assistant last. A dynamic
    programme over that automaton finds the cheapest of merging a turn into the message before (`MERGE`), giving it
    another role (`RELABEL`) and inserting empty messages (`INSERT` each). `action` is keep, relabel, merge or
    relabel+merge; `inserted` counts the empty messages put before the turn (after it, if it is the last). The `rendered`
    parts of a conversation, in order of `place`, are its text with chat marks.

    Turns go by `turn`, then role and text, nulls first; repeated rows are turns of their own. A null or unknown role
    costs as a relabelling whatever it becomes; null text renders as empty. Turns without conv_id are one conversation.
    Rows are sorted over ranges, so a conversation may lie in many tasks: each part gives its least costs from any state
    to any state, and these small matrices are joined per conversation. No rows give no rows.
    """
    own = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )
    own = own.withColumn("salt", F.rand(7))  # equal rows may lie in several ranges
    order = ["conv_id", "turn", "role", "text", "salt"]
    laid = own.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
    decided = freeze(laid.mapInPandas(_decide, _SCHEMA))
    notes = decided.filter("pos = -1").groupBy("conv_id").applyInPandas(_joined, "chunk long, before int, after int, ends boolean")
    ends = decided.filter("pos >= 0").groupBy("chunk").agg(F.max("pos").alias("final"))
    rows = decided.filter("pos >= 0").join(notes, "chunk", "left").join(ends, "chunk")
    code = F.when(F.col("before").isNull(), F.element_at("codes", 1)).otherwise(
        F.element_at("codes", (F.col("before") * 3 + F.col("after")).cast("int"))
    )
    last = F.col("last") | (F.coalesce("ends", F.lit(False)) & (F.col("pos") == F.col("final")))
    rows = rows.withColumn("code", code).withColumn("last", last)
    q, s, merged = F.shiftright("code", 3), F.shiftright("code", 1).bitwiseAND(3), F.col("code").bitwiseAND(1) == 1

    def per(pairs, default=""):
        out = F.lit(default)
        for cond, value in pairs:
            out = F.when(cond, F.lit(value)).otherwise(out)
        return out

    put = per([((q == a) & (s == b) & ~merged, "".join(map(_empty, x))) for (a, b), x in BETWEEN.items() if x])
    n_before = per([((q == a) & (s == b) & ~merged, len(x)) for (a, b), x in BETWEEN.items() if x], 0)
    tail = per([(s == a, "".join(map(_empty, x))) for a, x in AFTER.items() if x])
    n_after = per([(s == a, len(x)) for a, x in AFTER.items() if x], 0)
    new_role = per([(s == i, NAMES[i]) for i in (SYSTEM, USER, ASSISTANT)])
    known = per([(F.lower(F.trim("role")) == k, NAMES[v]) for k, v in ROLES.items()], "?")
    words = F.coalesce("text", F.lit(""))
    opened = F.concat(F.when(q == START, "").otherwise("<|im_end|>\n"), put, F.lit("<|im_start|>"), new_role, F.lit("\n"), words)
    rendered = F.concat(
        F.when(merged, F.concat(F.lit("\n"), words)).otherwise(opened), F.when(F.col("last"), F.concat(F.lit("<|im_end|>\n"), tail)).otherwise("")
    )
    action = F.concat_ws("+", F.when(known != new_role, "relabel"), F.when(merged, "merge"))
    return rows.select(
        "conv_id", "turn", "role", (F.col("chunk") * (2 * CHUNK) + F.col("pos")).alias("place"), new_role.alias("new_role"),
        F.when(action == "", "keep").otherwise(action).alias("action"), (n_before + F.when(F.col("last"), n_after).otherwise(0)).alias("inserted"),
        rendered.alias("rendered"),
    )


def conversations(repaired_turns: DataFrame) -> DataFrame:
    """`conv_id, rendered`: whole conversations as one text each, for conversations that fit a row."""
    parts = F.sort_array(F.collect_list(F.struct("place", "rendered")))
    return repaired_turns.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["rendered"]), "").alias("rendered"))
