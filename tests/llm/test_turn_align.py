"""Conversation repair against a plain search over turns and grammar states, whole and in chunks."""

import hashlib
import random
import re
import zlib

import pytest

from weirflow.llm import turn_align as ta

CONVERSATIONS = "conv_id long, turn long, role string, text string"
DUE = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(turns):
    """(cost, least audit) of turns (initial, fault), from the last turn to the first."""
    far = (10**9, "")
    after = {"": (0, ""), "a": (0, ""), "u": (3, "I"), "s": (6, "II")}
    for initial, fault in reversed(turns):
        dead, extra = fault in ("blank", "duplicate"), 3 * (fault == "truncated")
        here = {}
        for q in after:
            options = [(after[q][0] + 4, "D" + after[q][1])]
            if not dead:
                kept = initial if initial == DUE[q] or (initial == "s" and q == "") else None
                if kept:
                    options.append((after[kept][0] + extra, "K" + after[kept][1]))
                options.append((after[DUE[q]][0] + 3 + extra, "R" + after[DUE[q]][1]))
            here[q] = min(options, default=far)
        for _ in range(3):  # insertions before the turn
            for q in here:
                c, a = here[DUE[q]]
                here[q] = min(here[q], (c + 3, "I" + a))
        after = here
    return after[""]


def brute(rows):
    """Expected rows of the damaged table, by conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            how = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if how == 0:
                continue
            text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
            own += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).digest()))
        seen, turns = set(), []
        for _, role, text in own:
            solid = re.sub("[\x20\x09-\x0d]", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            turns.append((role[:1], fault))
        cost, audit = cheapest(turns)
        state, lines, n = "", [], 0
        for e in audit:
            if e == "D":
                n += 1
                continue
            if e == "K":
                state, line = own[n][1][:1], f"{own[n][1]}:{own[n][2]}"
            else:
                state = DUE[state]
                line = f"{'user' if state == 'u' else 'assistant'}:{'' if e == 'I' else own[n][2]}"
            lines.append(line)
            n += e != "I"
        known = [x[0] for x in own if x[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        faults = [sum(f == x for _, f in turns) for x in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def table(seed, n, longest):
    r = random.Random(seed)
    texts = ["Good.", "Why?", "No!", "half a", "", " \t\n", None, "tail.  \n", "odd. ", "x" * 20, "ü", "Good. "]
    roles = ["user"] * 8 + ["assistant"] * 8 + ["system", "tool", "", None, "User", " "]
    rows = []
    for c in range(n):
        for t in range(r.randint(1, longest)):
            role = r.choice(roles) if r.random() < 0.4 else ("system" if t == 0 and r.random() < 0.5 else ["user", "assistant"][t % 2])
            rows.append((c if c else None, None if r.random() < 0.03 else t + 2 * (r.random() < 0.1), role,
                         r.choice(texts) if r.random() < 0.3 else f"Turn {r.randint(0, 60)}."))
    rows += [rows[0], rows[0], rows[-1]]
    return rows


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("chunk", [2, 5, 2048])
def test_audits_equal_a_plain_search(spark, monkeypatch, chunk):
    monkeypatch.setattr(ta, "CHUNK", chunk)
    rows = table(5, 60, 9) + [(1000, t, "user", f"Line {t}.") for t in range(90)] + [(1001, None, None, None)]
    r = random.Random(3)
    rows += [(1002, t, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", "no", "", f"N {t}."])) for t in range(120)]
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(5)
    assert got(ta.damaged_audits(df)) == brute(rows)


def test_single_alignments_equal_a_plain_search():
    r = random.Random(2)
    for n in [*range(12)] * 25 + [40, 200]:
        turns = [(r.choice("suuaa?"), r.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(n)]
        signs = "".join(ta._SIGN[t] for t in turns)
        assert ta.whole(signs) == cheapest(turns)


def test_an_incumbent_keeps_the_band_narrow():
    table_ = ta.Alignment([("u", ""), ("a", "")] * 1000, ta.A, ta._incumbent([("u", ""), ("a", "")] * 1000, ta.START, ta.A), True)
    assert max(len(x) for x in table_.cost) < 10 and table_.best(ta.U) == (0, [2000])


def test_repaired_turns_and_clashing_columns(spark):
    rows = [(7, 1, "assistant", "Hi.", "a", 1), (7, 2, "assistant", "So?", "b", 2), (7, 3, "user", "x", "c", 3), (7, 3, "user", "x", "d", 4)]
    df = spark.createDataFrame(rows, CONVERSATIONS + ", rid string, nil long")
    turns = ta.Repair(df).turns().orderBy("chunk", "step").collect()
    assert [(t.edit, t.turn, t.role, t.text) for t in turns] == [
        ("R", 1, "user", "Hi."), ("K", 2, "assistant", "So?"), ("D", 3, "user", "x"), ("D", 3, "user", "x")]
    opened = ta.Repair(spark.createDataFrame([(1, 0, "system", "Be."), (1, 1, "user", "Go.")], CONVERSATIONS)).turns().orderBy("chunk", "step")
    assert [(t.edit, t.turn, t.role, t.text) for t in opened.collect()] == [
        ("K", 0, "system", "Be."), ("K", 1, "user", "Go."), ("I", None, "assistant", "")]
    long = [(1, t, ["user", "assistant"][t % 2], "w " * 200_000 + str(t) + ".", "", 0) for t in range(2)]
    whole = ta.damaged_audits(spark.createDataFrame(long, CONVERSATIONS + ", rid string, nil long"))
    assert got(whole) == brute([x[:4] for x in long])


def test_empty_and_wholly_dropped(spark):
    assert ta.damaged_audits(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    gone = next((c, 0, "user", "Yes.") for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    one = got(ta.damaged_audits(spark.createDataFrame([gone], CONVERSATIONS)))
    assert one == {gone[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} == brute([gone])
