"""Conversation structure repair: Wagner-Fischer alignment of turns with the alternating grammar, in Ukkonen bands."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import freeze, slices

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3  # costs; the last is added for a truncated turn that stays
CHUNK = 2048  # turns that are aligned together; a longer conversation is joined by its chunks' costs
MEMO = 200_000  # aligned conversations that a task remembers
_FAR = 1 << 40

# a turn as one letter: its role's initial (s, u, a or any other) and its fault
_INITIALS, _FAULTS = "sua?", ("", "truncated", "blank", "duplicate")
_SIGNS = "ABCDEFGHIJKLMNOP"  # 4 * initial + fault
_SIGN = {(i, f): _SIGNS[4 * x + y] for x, i in enumerate(_INITIALS) for y, f in enumerate(_FAULTS)}
_READ = {v: k for k, v in _SIGN.items()}

# where a repaired conversation may stand: at its start, or behind a role
START, S, U, A = range(4)
_NEXT = {START: U, S: U, U: A, A: U}  # what a rerole or an insertion gives
_END = (0, 2 * INSERT, INSERT, 0)  # cost of the insertions that end it from there
_INITIAL_OF = {"s": S, "u": U, "a": A}


# ---- one stretch of turns


class Alignment:
    """Turns against grammar strings that end in the role `end`.

    `cost[i]` holds, by k, the least cost of aligning the turns from i on with the last k signs of the string ...uaua.
    One table serves all feasible lengths, as each string is the end of the next longer one. Deletions and matches come
    from the row below, insertions run along the row. Cells from which the rest costs more than `most`, the incumbent,
    are outside the band. Unless the table is `closed`, nothing is inserted after the last turn.
    """

    def __init__(self, turns: list[tuple[str, str]], end: int, most: int, closed: bool):
        n = len(turns)
        self.turns, self.end, self.n = turns, end, n
        dead = [f in ("blank", "duplicate") for _, f in turns]
        stay = np.concatenate([np.cumsum(np.logical_not(dead)[::-1])[::-1], [0]]).astype(int)  # turns from i on that may stay
        self.low = np.maximum(stay - most // DELETE, 0).tolist()
        self.high = (stay + most // INSERT).tolist()
        last = INSERT * np.arange(self.high[n] + 1)
        if not closed:
            last[1:] = _FAR
        self.cost: list[np.ndarray] = [last] * (n + 1)
        for i in range(n - 1, -1, -1):
            k = np.arange(self.low[i], self.high[i] + 1)
            cell = self._row(i + 1, 0, i) + DELETE
            if not dead[i]:
                initial, fault = turns[i]
                change = np.where(self.sign(k) == _INITIAL_OF.get(initial, -1), KEEP, REROLE) + (CUT_OFF if fault else 0)
                cell = np.minimum(cell, self._row(i + 1, 1, i) + change)
            self.cost[i] = np.minimum(np.minimum.accumulate(cell - INSERT * k) + INSERT * k, _FAR)

    def sign(self, k):
        """Role that stands k places before the end of the string, the last one for k = 1."""
        return np.where(np.asarray(k) % 2 == 1, self.end, U + A - self.end)

    def _row(self, i: int, back: int, like: int) -> np.ndarray:
        """Row i, moved by `back` places, over the band of row `like`."""
        out = np.full(self.high[like] - self.low[like] + 1, _FAR, np.int64)
        shift = self.low[i] + back - self.low[like]
        a, b = max(shift, 0), min(len(out), shift + len(self.cost[i]))
        if a < b:
            out[a:b] = self.cost[i][a - shift:b - shift]
        return out

    def at(self, i: int, k: int) -> int:
        return int(self.cost[i][k - self.low[i]]) if self.low[i] <= k <= self.high[i] else _FAR

    def best(self, first: int, i: int = 0) -> tuple[int, list[int]]:
        """Least cost of aligning the turns from i on with a string that begins with the role `first`, and its lengths."""
        lo = max(self.low[i], 1)
        lo += int(self.sign(lo) != first)
        costs = self.cost[i][lo - self.low[i]::2]
        least = int(costs.min()) if len(costs) else _FAR
        return least, [] if least >= _FAR else [lo + 2 * int(j) for j in np.nonzero(costs == least)[0]]

    def audit(self, i: int, k: int) -> str:
        """ASCII-least edits of one string, traced from turn i on: D before I before K before R."""
        out = []
        while i < self.n or k:
            here = self.at(i, k)
            if i < self.n and here == DELETE + self.at(i + 1, k):
                out.append("D")
                i += 1
                continue
            if k and here == INSERT + self.at(i, k - 1):
                out.append("I")
            else:
                out.append("K" if _INITIAL_OF.get(self.turns[i][0]) == self.sign(k) else "R")
                i += 1
            k -= 1
        return "".join(out)


def _turns(signs: str) -> list[tuple[str, str]]:
    return [_READ[x] for x in signs]


def _incumbent(turns: list[tuple[str, str]], state: int, end: int) -> int:
    """Cost of the plain repair: turns that may stay get the role that is due, insertions end it in the role `end`.

    An open table must put these before the last turn instead, which may change that turn's role.
    """
    cost = 0
    for initial, fault in turns:
        if fault in ("blank", "duplicate"):
            cost += DELETE
        else:
            state = _NEXT[state]
            cost += (KEEP if _INITIAL_OF.get(initial) == state else REROLE) + (CUT_OFF if fault else 0)
    return cost + 2 * INSERT + REROLE


def ways(turns: list[tuple[str, str]], starts: tuple[int, ...], ends: tuple[int, ...], closed: bool, trace: bool):
    """{(state before, state after): (least cost, ASCII-least audit)}; without `trace` the audits stay empty."""
    n = len(turns)
    out = {(q, q): (DELETE * n, "D" * n if trace else "") for q in starts}

    def offer(key: tuple[int, int], cost: int, audit: str) -> None:
        if key not in out or (cost, audit) < out[key]:
            out[key] = (cost, audit)

    first = [i for i, (initial, fault) in enumerate(turns) if initial == "s" and fault in ("", "truncated")] if START in starts else []
    kept = [(i, DELETE * i + KEEP + (CUT_OFF if turns[i][1] else 0)) for i in first]
    if not closed:
        for i, cost in kept:
            offer((START, S), cost + DELETE * (n - 1 - i), "D" * i + "K" + "D" * (n - 1 - i) if trace else "")
    for end in ends:
        table = Alignment(turns, end, max(_incumbent(turns, s, end) for s in starts), closed)
        for s in starts:
            found = [("", 0, 0, *table.best(_NEXT[s]))]
            if s == START:
                found += [("D" * i + "K", i + 1, cost, *table.best(U, i + 1)) for i, cost in kept]
            least = min(c + rest for _, _, c, rest, _ in found)
            for head, i, c, rest, lengths in found:
                if c + rest == least < _FAR:
                    for k in lengths if trace else lengths[:1]:
                        offer((s, end), least, head + table.audit(i, k) if trace else "")
    return out


def whole(signs: str) -> tuple[int, str]:
    """Cost and audit of a conversation that is aligned at once with the strings '', uaua... and suaua..."""
    out = ways(_turns(signs), (START,), (A,), True, True)
    return min(out.values())


def costs(signs: str) -> list[int]:
    """Least costs of a chunk from each state to each state, row by row."""
    out = ways(_turns(signs), (START, S, U, A), (U, A), False, False)
    return [out.get((q, t), (_FAR, ""))[0] for q in range(4) for t in range(4)]


def choices(signs: str, togo: list[int]) -> list[tuple[int, int, str]]:
    """Per state before a chunk the (state after, cost, audit) that the whole conversation takes, given the costs from there.

    Equally cheap ways differ in some edit inside the chunk, so the least audit here is that of the conversation.
    """
    out = ways(_turns(signs), (START, S, U, A), (U, A), False, True)
    found = []
    for q in range(4):
        c, audit, t = min((cost + togo[t], audit, t) for (p, t), (cost, audit) in out.items() if p == q)
        found.append((t, c - togo[t], audit))
    return found


# ---- conversations over all tasks

KEY = ["nil", "conv"]  # null ids are one conversation


def _keyed(turns: DataFrame) -> DataFrame:
    return turns.select(
        F.col("conv_id").isNull().alias("nil"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0).cast("long")).alias("conv"),
        F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))


def _conv_id() -> Column:
    return F.when(~F.col("nil"), F.col("conv")).alias("conv_id")


def chunks(rows: DataFrame) -> DataFrame:
    """Turns in order as letters, at most `CHUNK` to a row, with the counts of what is wrong.

    Only ids and digests are sorted, over ranges that end with the row id and so split conversations and ties alike.
    """
    said = F.unhex(F.sha2("text", 256))
    ends = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    thin = rows.select(*KEY, "turn", "role", said.alias("said"), "rid", (ends == "").alias("blank"), (~ends.isin(".", "!", "?")).alias("truncated"))
    seen = thin.filter(~F.col("blank")).groupBy(*KEY, "role", "said").agg(F.min(F.struct("turn", "rid"))["rid"].alias("rid"))
    thin = thin.join(seen.select("rid", F.lit(True).alias("first")), "rid", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("truncated"), "truncated").otherwise("")
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("?"), fault)
    letter = F.create_map(*[F.lit(x) for (i, f), sign in _SIGN.items() for x in (i + f, sign)])[pair]
    order = [*KEY, "turn", "role", "said", "rid"]
    laid = thin.withColumn("sign", letter).repartitionByRange(*order).sortWithinPartitions(*order).select(*KEY, "sign", "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seq = TaskContext.get().partitionId(), 0
        held: tuple | None = None
        signs: list[str] = []
        rids: list[int] = []

        def given() -> tuple:
            nonlocal seq
            text = "".join(signs)
            turns = _turns(text)
            wrong = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
            out = (*held, (pid << 32) + seq, text, list(rids), *(sum(f == x for _, f in turns) for x in ("blank", "duplicate", "truncated")),
                   wrong, turns[0][0], turns[-1][0])
            seq += 1
            signs.clear()
            rids.clear()
            return out

        for batch in batches:
            rows = []
            for nil, conv, sign, rid in zip(*(batch.column(c).to_pylist() for c in (*KEY, "sign", "rid"))):
                if signs and ((nil, conv) != held or len(signs) == CHUNK):
                    rows.append(given())
                held = (nil, conv)
                signs.append(sign)
                rids.append(rid)
            if rows:
                yield _batch(rows, _CHUNKS)
        if signs:
            yield _batch([given()], _CHUNKS)

    return laid.mapInArrow(run, _ddl(_CHUNKS))


_CHUNKS = {"nil": "boolean", "conv": "long", "chunk": "long", "signs": "string", "rids": "array<long>", "blank": "long", "duplicate": "long",
           "truncated": "long", "illegal": "long", "opens": "string", "closes": "string"}
_ARROW = {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{k} {v}" for k, v in columns.items())


def _batch(rows: list[tuple], columns: dict[str, str]) -> pa.RecordBatch:
    arrays = [pa.array(x, _ARROW[t]) for x, t in zip(zip(*rows), columns.values())]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def _alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, tuple[int, str]] = {}
    for part in batches:
        if len(known) > MEMO:
            known.clear()
        for signs in set(part["signs"]).difference(known):
            known[signs] = whole(signs)
        found = [known[s] for s in part["signs"]]
        yield part.drop(columns="signs").assign(before=START, cost=[c for c, _ in found], audit=[a for _, a in found])


def _from_behind(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks from the last of each conversation to the first: the least costs from the end of each to the end of all."""
    held, togo = None, list(_END)
    for part in batches:
        out = []
        for nil, conv, chunk, matrix in zip(part["nil"], part["conv"], part["chunk"], part["matrix"]):
            if (nil, conv) != held:
                held, togo = (nil, conv), list(_END)
                out.append((chunk, list(togo), True))
            else:
                out.append((chunk, list(togo), False))
            togo = [min(int(matrix[4 * q + t]) + togo[t] for t in range(4)) for q in range(4)]
        yield pd.DataFrame(out, columns=["chunk", "togo", "final"])


def _chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        if not len(part):
            continue
        rows = []
        for chunk, signs, togo, final in zip(part["chunk"], part["signs"], part["togo"], part["final"]):
            after, cost, audit = zip(*choices(signs, [int(x) for x in togo]))
            if final:
                cost = [c + _END[t] for c, t in zip(cost, after)]
                audit = [a + "I" * (_END[t] // INSERT) for a, t in zip(audit, after)]
            rows.append((list(after), list(cost), list(audit)))
        yield part[[*KEY, "chunk"]].assign(**{c: list(x) for c, x in zip(("afters", "costs", "audits"), zip(*rows))})


def _from_before(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks in order: the state before each."""
    held, state = None, START
    for part in batches:
        out = []
        for nil, conv, chunk, afters in zip(part["nil"], part["conv"], part["chunk"], part["afters"]):
            if (nil, conv) != held:
                held, state = (nil, conv), START
            out.append((chunk, state))
            state = int(afters[state])
        yield pd.DataFrame(out, columns=["chunk", "before"])


def decide(cut: DataFrame) -> DataFrame:
    """`nil, conv, chunk, before, cost, audit`: the edits of each chunk, and the state that its conversation is in before it.

    Conversations of one chunk are aligned with whole grammar strings. For longer ones each chunk tells its least costs
    from state to state; two passes over these few numbers, backwards for costs and forwards for states, say which of a
    chunk's audits holds. These passes read a conversation's chunks in order and keep four numbers.
    """
    parts = cut.groupBy(*KEY).agg(F.count("*").alias("parts"))
    thin = cut.select(*KEY, "chunk", "signs").join(parts, KEY)
    cores = cut.sparkSession.sparkContext.defaultParallelism
    alone = thin.filter("parts = 1").drop("parts").repartition(cores).mapInPandas(
        _alone, "nil boolean, conv long, chunk long, before int, cost long, audit string")
    long = freeze(thin.filter("parts > 1").drop("parts").repartition(cores))

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield part.drop(columns="signs").assign(matrix=[costs(s) for s in part["signs"]])

    steps = long.mapInPandas(matrices, "nil boolean, conv long, chunk long, matrix array<long>").repartition(*KEY)
    togo = steps.sortWithinPartitions(*KEY, F.desc("chunk")).mapInPandas(_from_behind, "chunk long, togo array<long>, final boolean")
    schema = "nil boolean, conv long, chunk long, afters array<int>, costs array<long>, audits array<string>"
    chosen = freeze(long.join(togo, "chunk").repartition(cores).mapInPandas(_chosen, schema))
    order = chosen.select(*KEY, "chunk", "afters").repartition(*KEY).sortWithinPartitions(*KEY, "chunk")
    states = order.mapInPandas(_from_before, "chunk long, before int")
    at = F.col("before") + 1
    joined = chosen.join(states, "chunk").select(
        *KEY, "chunk", "before", F.element_at("costs", at).alias("cost"), F.element_at("audits", at).alias("audit"))
    return alone.unionByName(joined)


def edits(decided: DataFrame, cut: DataFrame) -> DataFrame:
    """One row per edit: its place (`chunk`, `step`), the row it is about (null: an insertion) and the role given."""
    schema = {"nil": "boolean", "conv": "long", "chunk": "long", "step": "int", "edit": "string", "rid": "long", "given": "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                turns, rids, state = _turns(row["signs"]), row["rids"], row["before"]
                out, n = [], 0
                for step, edit in enumerate(row["audit"]):
                    rid = None if edit == "I" else rids[n]
                    given = None
                    if edit == "K":
                        state = _INITIAL_OF[turns[n][0]]
                    elif edit != "D":
                        state = _NEXT[state]
                        given = "user" if state == U else "assistant"
                    out.append((row["nil"], row["conv"], row["chunk"], step, edit, rid, given))
                    n += edit != "I"
                if out:
                    yield _batch(out, schema)

    rows = decided.drop("cost").join(cut.select("chunk", "signs", "rids"), "chunk")
    return rows.mapInArrow(run, _ddl(schema))


class Repair:
    """Cheapest repairs of conversations `conv_id, turn, role, text` to role initials `(s?(ua)+)?`.

    Turns go by `turn`, nulls first, then by role and the text's digest; repeated rows are turns of their own. A turn is
    faulty if it is blank, else if role and text were seen earlier in the conversation, else if its last character that
    is no white space is none of `.!?`. Blank and repeated turns must go (`DELETE`), truncated ones that stay cost
    `CUT_OFF`, a new role `REROLE`, an inserted empty turn `INSERT`. Of equally cheap edits the ASCII-least hold.

    Null role or text reads as one blank; null conv_id is a conversation of its own; other columns are left out,
    whatever their names. Texts of any length pass unread through one join; turns are aligned as letters. No rows give
    no rows.
    """

    def __init__(self, turns: DataFrame):
        self.rows = freeze(_keyed(turns).withColumn("rid", F.monotonically_increasing_id()))
        self.chunks = freeze(chunks(self.rows))
        self.decided = freeze(decide(self.chunks))

    def turns(self) -> DataFrame:
        """`conv_id, chunk, step, edit, turn, role, text`: all turns, deleted ones (edit D) and inserted ones (I) too.

        `chunk` and `step` give their order; `role` is the repaired one.
        """
        steps = edits(self.decided, self.chunks)
        old = steps.filter("rid is not null").join(self.rows.drop(*KEY), "rid").withColumn("role", F.coalesce("given", "role"))
        new = steps.filter("rid is null").withColumn("turn", F.lit(None).cast("long")).withColumn("text", F.lit("")).withColumn("role", F.col("given"))
        return old.unionByName(new).select(_conv_id(), *KEY, "chunk", "step", "edit", "turn", "role", "text")

    def audits(self) -> DataFrame:
        """`conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`: one row per conversation."""
        turns = self.rows.groupBy(*KEY, "turn").agg(F.lit(1)).groupBy(*KEY).agg(
            (F.max("turn").cast("decimal(20,0)") - F.min("turn") + 1 - F.count("turn")).cast("long").alias("gaps"))
        faults = ["blank", "duplicate", "truncated", "illegal"]
        inside = self.chunks.select(*KEY, *faults)
        parts = self.chunks.groupBy(*KEY).agg(F.count("*").alias("parts")).filter("parts > 1")
        rims = self.chunks.select(*KEY, "chunk", "opens", "closes").join(parts.drop("parts"), KEY)
        between = rims.repartition(*KEY).sortWithinPartitions(*KEY, "chunk").mapInPandas(_borders, "nil boolean, conv long, illegal long")
        zero = F.lit(0).cast("long")
        found = inside.unionByName(between.select(*KEY, *[zero.alias(f) for f in faults[:3]], "illegal"))
        found = found.groupBy(*KEY).agg(*[F.sum(f).alias(f) for f in faults])
        told = self.decided.groupBy(*KEY).agg(F.sum("cost").alias("cost"), F.sort_array(F.collect_list(F.struct("chunk", "audit"))).alias("a"))
        told = told.select(*KEY, "cost", F.array_join(F.transform("a", lambda x: x["audit"]), "").alias("audit"))
        out = turns.join(found, KEY).join(told, KEY)
        return out.select(_conv_id(), *KEY, F.coalesce("gaps", zero).alias("gaps"), *faults, "cost", "audit")

    def digests(self) -> DataFrame:
        """SHA-256 of each repaired conversation, `role:text` by line. A digest is sequential: one task streams through it."""
        rows = self.turns().filter("edit <> 'D'").select(*KEY, "chunk", "step", F.concat_ws(":", "role", "text").alias("line"))
        laid = rows.repartition(*KEY).sortWithinPartitions(*KEY, "chunk", "step").select(*KEY, "line")
        schema = {"nil": "boolean", "conv": "long", "sha256": "string"}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, digest = None, None
            for batch in batches:
                for part in slices([batch]):
                    out = []
                    for nil, conv, line in zip(*(part.column(c).to_pylist() for c in (*KEY, "line"))):
                        if (nil, conv) != held:
                            if held is not None:
                                out.append((*held, digest.hexdigest()))
                            held, digest = (nil, conv), hashlib.sha256()
                        else:
                            digest.update(b"\n")
                        digest.update(line.encode())
                    if out:
                        yield _batch(out, schema)
            if held is not None:
                yield _batch([(*held, digest.hexdigest())], schema)

        return laid.mapInArrow(run, _ddl(schema))


def _borders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Illegal neighbours across the borders of a conversation's chunks, which come in order."""
    held, before = None, ""
    for part in batches:
        out = []
        for nil, conv, opens, closes in zip(part["nil"], part["conv"], part["opens"], part["closes"]):
            out.append((nil, conv, int((nil, conv) == held and before + opens not in ("su", "ua", "au"))))
            held, before = (nil, conv), closes
        yield pd.DataFrame(out, columns=[*KEY, "illegal"])


def damage(turns: DataFrame) -> DataFrame:
    """Turns with known faults, by crc32 of `conv_id:turn` (nulls: one blank) mod 20.

    0 drops a row, 1 empties its text, 2 removes `.!?` from it, 3 repeats the row, 4 makes it the user's.
    """
    blank = F.lit(" ")
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[
        F.coalesce(F.col(c).cast("string"), blank).alias(c) for c in ("role", "text")])
    how = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("how") == 3, 2).otherwise(1)))
    left = own.withColumn("how", how).filter("how <> 0")
    return left.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies).drop("col")


def damaged_audits(turns: DataFrame) -> DataFrame:
    """Audits and digests of all conversations after `damage`; one of which no row is left has zeros and empty texts."""
    repair = Repair(damage(turns))
    zero = F.lit(0).cast("long")
    ids = _keyed(turns).select(*KEY).distinct()
    joined = ids.join(repair.audits().drop("conv_id"), KEY, "left").join(repair.digests(), KEY, "left")
    return joined.select(
        _conv_id(), *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
