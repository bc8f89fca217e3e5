"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from graphsig.llm import conversation_repair as cr

TABLE = "conv_id long, turn long, role string, text string, n int, seq string"
ENDS = {"": True, "a": True, "u": False, "s": False}
AFTER = {"": "su", "s": "u", "u": "a", "a": "u"}


def brute_report(rows):
    """``rows``: (turn, role, text) after damage, in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        if not said:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, last, spare):
        """Cheapest (cost, edits, turns) of the rows from i on; ``spare`` insertions may follow each other."""
        ways = [(0, "", ())] if i == len(rows) and ENDS[last] else []
        if spare:
            for role in ("user", "assistant"):
                if role[0] in AFTER[last] and (more := best(i, role[0], spare - 1)):
                    ways.append((5 + more[0], "I" + more[1], (role + ":", *more[2])))
        if i < len(rows):
            _, role, text = rows[i]
            if more := best(i + 1, last, 3):
                ways.append((2 + more[0], "D" + more[1], more[2]))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 * (faults[i] == "truncated")
                for new, price, name in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                    if new and new[0] in AFTER[last] and (more := best(i + 1, new[0], 3)):
                        ways.append((price + extra + more[0], name + more[1], (new + ":" + text, *more[2])))
        return min(ways, key=lambda w: w[:2], default=None)

    for i in range(len(rows), -1, -1):  # from the end, so that no call goes deep
        for last in ENDS:
            best(i, last, 3)
    cost, audit, turns = best(0, "", 3)
    turn = [t for t, _, _ in rows if t is not None]
    gaps = max(turn) - min(turn) + 1 - len(set(turn)) if turn else 0
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:], strict=False))
    counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())


def brute(table):
    """The whole query on (conv_id, turn, role, text) rows in the order of their turns."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in sorted((r for r in table if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0)):
            role, text = " " if role is None else role, " " if text is None else text
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            case = zlib.crc32(key.encode()) % 20
            if case == 0:
                continue
            text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
            rows += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
        out[conv] = brute_report(rows)
    return out


@pytest.fixture(scope="module")
def table():
    rng = random.Random(1)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "u2", "Assistant", "silly"]
    texts = ["Yes.", "No!", "Why?", "cut", "", " \t\n", None, "é。", "Long. text ", "x ", "a. ", "Z?\n"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(300) for t in rng.sample(range(12), rng.randint(1, 8))]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for c in range(300, 340) for t in range(8)]
    rows += [(400, None, "user", "Hm."), (400, 3, None, None), (401, None, None, None), (None, 0, "user", "Who?"), (None, 4, "assistant", "Me.")]
    rows += [(402, t, "assistant" if t % 3 else "user", f"{t % 7} ok" + "." * (t % 4)) for t in range(400)]
    rows += [(403, t, "user", "ok.") for t in range(200)]
    rows += [(404, 0, "user", "x" * 300_000 + "."), (404, 1, "assistant", "y " * 100_000)]
    return rows


@pytest.mark.parametrize("hold", [cr.HOLD, 3])
def test_report_equals_a_plain_search(spark, table, hold):
    """With three rows held, nearly all conversations spill and are traced backwards."""
    shuffled = random.Random(2).sample(table, len(table))
    frame = spark.createDataFrame([(*r, 9, "mine") for r in shuffled], TABLE)
    got = {r[0]: tuple(r[1:]) for r in cr.damaged_report(frame, hold).collect()}
    want = brute(table)
    assert set(got) == set(want)
    for c in want:
        assert got[c] == want[c], c


def test_equal_rows_count_each(spark):
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Yo."), (1, 1, "assistant", "Yo."), (2, None, None, None), (2, None, None, None)]
    frame = spark.createDataFrame([(*r, 1, "") for r in rows], TABLE)
    got = {r[0]: tuple(r[1:]) for r in cr.report(frame).collect()}
    for c in (1, 2):
        assert got[c] == brute_report([(t, role or " ", text or " ") for k, t, role, text in rows if k == c])[1:]


def test_repaired_turns(spark):
    rows = [(7, 0, "system", "Be kind."), (7, 1, "user", "Hi."), (7, 2, "user", "There?"), (7, 3, "assistant", "Yes."), (7, 4, "assistant", "Yes."), (8, 0, "assistant", "So.")]
    frame = spark.createDataFrame([(*r, 1, "") for r in rows], TABLE)
    got = [tuple(r) for r in cr.repair(frame).orderBy("conv_id", "position").collect()]
    # of the two users one goes for 2, the repeated answer must go; the lone answer costs 2 to delete and 5 to introduce
    assert got == [(7, 0, 0, "system", "Be kind."), (7, 1, 2, "user", "There?"), (7, 2, 3, "assistant", "Yes.")]
    assert cr.repair(frame.limit(0)).count() == 0 and cr.damaged_report(frame.limit(0)).count() == 0


def test_text_ids(spark):
    frame = spark.createDataFrame([("b", 0, "user", "Hi."), ("b", 1, "assistant", "Yo."), (None, 0, "user", "Hi.")], "conv_id string, turn int, role string, text string")
    assert {r[0] for r in cr.damaged_report(frame).collect()} == {"b", None}


def test_few_states_are_worked_out(spark):
    """However long a conversation is, the state stays one of a few."""
    rng, (costs, ranks) = random.Random(4), cr.FIRST
    cr.step.cache_clear()
    for _ in range(20_000):
        _, costs, ranks, _ = cr.step(costs, ranks, rng.choice([cr.BAD, cr.SOUND, cr.SOUND, cr.CUT]), rng.choice("sua?"))
    assert cr.step.cache_info().currsize < 2_000
