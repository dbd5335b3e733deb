"""Conversation repair against plain dynamic programming over whole strings."""

import hashlib
import random
import re
import zlib

import pytest

from gridprep.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def plain_edits(rows):
    """The least (cost, audit) over all edits of (initial, kind), by states and whole audits."""
    following = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def with_inserts(best):
        for _ in range(3):
            for state, (cost, audit) in list(best.items()):
                for role in "ua":
                    if (state, role) in following:
                        to = following[state, role]
                        best[to] = min(best.get(to, (10 ** 9, "")), (cost + 2, audit + "I"))
        return best

    best = with_inserts({"": (0, "")})
    for initial, kind in rows:
        new = {}
        for state, (cost, audit) in best.items():
            options = [(state, 3, "D")]
            if kind != repair.BAD:
                more = int(kind == repair.CUT_OFF)
                options += [(following[state, initial], more, "K")] if (state, initial) in following else []
                options += [(following[state, r], 2 + more, "R") for r in "ua" if (state, r) in following]
            for to, price, edit in options:
                new[to] = min(new.get(to, (10 ** 9, "")), (cost + price, audit + edit))
        best = with_inserts(new)
    return min(best[s] for s in ("", "a") if s in best)


@pytest.mark.parametrize("seed", range(6))
def test_edits(seed):
    chance = random.Random(seed)
    for _ in range(400):
        rows = [(chance.choice("suuaaaxs "), chance.choice([0, 0, 0, 1, 2])) for _ in range(chance.randrange(0, 11))]
        assert repair.cheapest_edits(rows) == plain_edits(rows), rows


def test_a_long_conversation():
    rows = [("ua"[i % 2] if i % 997 else "s", int(i % 500 == 0)) for i in range(20_000)]
    cost, audit = repair.cheapest_edits(rows)
    assert cost < 200 and len(audit) >= 20_000


def plain_report(rows):
    """{conv_id: result} of (conv_id, turn, role, text), by the contract's words."""
    out = {}
    for conv_id in {r[0] for r in rows}:
        damaged = []
        for _, turn, role, text in [r for r in rows if r[0] == conv_id]:
            role, text = (" " if v is None else v for v in (role, text))
            chance = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(chance, text)
            damaged += [(turn, "user" if chance == 4 else role, text)] * {0: 0, 3: 2}.get(chance, 1)
        damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {t for t, _, _ in damaged if t is not None}
        kinds, counts = [], [0, 0, 0]
        for i, (_, role, text) in enumerate(damaged):
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            faults = [not ink, (role, text) in [r[1:] for r in damaged[:i]], bool(ink) and ink[-1] not in ".!?"]
            first = faults.index(True) if True in faults else None
            if first is not None:
                counts[first] += 1
            kinds.append({None: repair.CLEAN, 2: repair.CUT_OFF}.get(first, repair.BAD))
        initials = [r[1][:1] for r in damaged]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = plain_edits(list(zip(initials, kinds)))
        result, state, rest = [], "", list(damaged)
        for edit in audit:
            row = rest.pop(0) if edit != "I" else (None, "", "")
            if edit != "D":
                role = row[1] if edit == "K" else "assistant" if state == "u" else "user"
                result.append(f"{role}:{row[2]}")
                state = role[:1]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv_id] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(result).encode()).hexdigest())
    return out


def reports(spark, rows, schema=SCHEMA):
    found = repair.repair_report(repair.damage(spark.createDataFrame(rows, schema))).collect()
    assert len(found) == len({r.conv_id for r in found})
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found}


def test_reports(spark):
    chance = random.Random(1)
    rows = []
    for conv_id in [*range(150), None]:
        for turn in range(chance.randrange(1, 9)):
            role = chance.choice(["system", "user", "assistant", "user", "assistant", None, "", "tool"])
            text = chance.choice(["Well. ", "So what?\n", "no end", "", " \t", None, "ü!", "a\x0bb.\x0c"])
            rows.append((conv_id, chance.choice([turn, turn, turn, turn * 3, None, 2]), role, text))
    rows += [(500, 0, "user", "x. " * 200_000), (500, 1, "assistant", "y."), (501, None, None, None), (-7, 5, "user", "same."), (-7, 5, "user", "same.")]
    assert reports(spark, rows) == plain_report(rows)


def test_a_long_conversation_and_extra_columns(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i}.") for i in range(3000)]
    found = reports(spark, [(*r, "x", 1) for r in rows], SCHEMA + ", audit string, dropped int")
    assert found[1][1:5] != (0, 0, 0, 0) and len(found[1][6]) > 2500


def test_all_rows_dropped_and_an_empty_table(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    assert reports(spark, [(9, turn, "user", "gone.")]) == {9: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert reports(spark, []) == {}


def test_repaired_turns(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "user", "Well?"), (1, 1, "user", "Well?")], SCHEMA).selectExpr("*", "false AS dropped")
    plans = repair.plan_repairs(rows)
    assert (plans.head().cost, plans.head().audit) == (7, "IKKDI")
    turns = [(r.position, r.role, r.text) for r in repair.repaired(rows, plans).collect()]
    assert turns == [(0, "user", ""), (1, "assistant", "Hello."), (2, "user", "Well?"), (3, "assistant", "")]
