"""Conversation repair against plain enumeration and a plain reading of the contract."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from lumenread.llm import turn_repair

SCHEMA = "conv_id long, turn long, role string, text string"
FORM = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, roles) of the least of all edit sequences with at most two insertions in a row; rows: (role, fault)."""
    best = None

    def go(i, cost, audit, roles, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows):
            if FORM.fullmatch("".join(roles)):
                best = min(best or (cost, audit, roles), (cost, audit, roles))
        else:
            role, fault = rows[i]
            go(i + 1, cost + 4, audit + "D", roles, 0)
            if fault not in (1, 2):
                more = 3 * (fault == 3)
                go(i + 1, cost + more, audit + "K", [*roles, role[:1] or "-"], 0)
                for letter in "ua":
                    go(i + 1, cost + more + 3, audit + "R", [*roles, letter], 0)
        if inserted < 2:
            for letter in "ua":
                go(i, cost + 3, audit + "I", [*roles, letter], inserted + 1)

    go(0, 0, "", [], 0)
    return best


def test_every_short_conversation():
    kinds = [("system", 0), ("user", 0), ("assistant", 0), ("tool", 0), ("user", 3), ("user", 1)]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            cost, edits = turn_repair.audit(list(rows))
            want = cheapest(list(rows))
            assert (cost, "".join(e for e, _ in edits)) == want[:2]
            assert [letter for e, letter in edits if e != "D"] == want[2]


def test_some_longer_conversations():
    rng = random.Random(5)
    for _ in range(60):
        rows = [(rng.choice(["system", "user", "user", "assistant", "assistant", ""]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(5)]
        cost, edits = turn_repair.audit(rows)
        assert (cost, "".join(e for e, _ in edits)) == cheapest(rows)[:2]


def test_table_stays_small():
    machine, vectors = turn_repair.Automaton(), set()
    todo = [machine.end]
    while todo:
        vector = todo.pop()
        if vector not in vectors:
            vectors.add(vector)
            assert min(vector) == 0 and max(vector) <= 7
            assert turn_repair._unpacked(turn_repair._packed(vector)) == vector
            todo += [machine.move(vector, kind)[0] for kind in range(9)]
    assert len(vectors) < 100


def plain(rows):
    """The contract's result, conversation by conversation, by dynamic programming over whole strings."""
    out = []
    for conv in {r[0] for r in rows}:
        found = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            h = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            found += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in found:
            inside = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            faults.append(1 if not inside else 2 if (role, text) in seen else 3 if inside[-1] not in ".!?" else 0)
            seen.add((role, text))
        arcs = {"": "su", "s": "u", "u": "a", "a": "u"}
        best = {q: ((0, "", []) if q in ("", "a") else (99, "", [])) for q in arcs}

        def inserted(best):
            for _ in range(3):
                best = {q: min([best[q], *((3 + best[x][0], "I" + best[x][1], [({"u": "user", "a": "assistant"}[x], ""), *best[x][2]]) for x in arcs[q] if x in "ua")]) for q in arcs}
            return best

        best = inserted(best)
        for (_, role, text), fault in list(zip(found, faults, strict=True))[::-1]:
            new = {}
            for q in arcs:
                options = [(4 + best[q][0], "D" + best[q][1], best[q][2])]
                if fault not in (1, 2):
                    more = 3 * (fault == 3)
                    for x in arcs[q]:
                        if role[:1] == x:
                            options.append((more + best[x][0], "K" + best[x][1], [(role, text), *best[x][2]]))
                        if x in "ua":
                            options.append((more + 3 + best[x][0], "R" + best[x][1], [({"u": "user", "a": "assistant"}[x], text), *best[x][2]]))
                new[q] = min(options)
            best = inserted(new)
        cost, audit, kept = best[""]
        turns = [t for t, _, _ in found if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(found)]
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(k) for k in (1, 2, 3)), sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()))
    return sorted(out, key=str)


def strange(seed, n):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", " ", "\t\n", "Yes.", "No!", "Cut", "So? ", "é漢.\x0b", "Yes.", "a|b:c\nuser:x."])
    rows = [(rng.choice([None, *range(n // 6)]), rng.choice([None, *range(7)]), rng.choice([None, "", "system", "user", "user", "assistant", "assistant", "tool"]), text()) for _ in range(n)]
    return [*rows, *rows[: n // 5]]


def result(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("live", "fault", "place", "left", "after", "seen"):
        frame = frame.selectExpr("*", f"7 as {name}")
    return sorted(map(tuple, turn_repair.summaries(turn_repair._edits(turn_repair.damaged(frame))).collect()), key=str)


@pytest.mark.parametrize("rows", [[], strange(1, 60), strange(2, 400)], ids=["empty", "few", "many"])
def test_whole_contract(spark, rows):
    assert result(spark, rows) == plain(rows)


def test_dropped_as_a_whole(spark):
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert result(spark, [(conv, 0, "user", "Hello.")]) == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_conversation_over_batches(spark):
    rng = random.Random(9)
    rows = [(7, i // 2, rng.choice(["user", "assistant", "system"]), f"Row {rng.randint(0, 3000)}{rng.choice('.!?,')}") for i in range(9000)] + [(8, 0, "user", "x" * 300_000 + ".")]
    assert result(spark, rows) == plain(rows)


def test_given_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, turn_repair.query(spark, "/root/testdata/sf0.01").collect()), key=str) == plain(rows)


def test_repair_by_itself(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Yes?"), (1, 2, "user", "Yes?"), (1, 3, "assistant", "Right"), (None, None, None, None), (2, 0, "system", "Be."), (2, 1, "user", "Go.")]
    frame = spark.createDataFrame(rows, SCHEMA)
    edits = [tuple(r) for r in turn_repair.repair(frame).orderBy("conv_id", "place").collect()]
    assert edits[0] == (None, 0, "D", None, " ", " ", "blank")
    assert [(e[2], e[4], e[6]) for e in edits if e[0] == 1] == [("I", "user", ""), ("K", "assistant", ""), ("K", "user", ""), ("D", "user", "duplicate"), ("K", "assistant", "truncated")]
    kept = [tuple(r) for r in turn_repair.repaired(frame).orderBy("conv_id", "turn").collect()]
    assert kept == [(1, 0, "user", ""), (1, 1, "assistant", "Hi."), (1, 2, "user", "Yes?"), (1, 3, "assistant", "Right"), (2, 0, "system", "Be."), (2, 1, "user", "Go."), (2, 2, "assistant", "")]
    exchanges = turn_repair.repair(frame)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges == 1
