"""Repairs of conversations against a plain dynamic program."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from helpers import ordered

from demandloom.llm.turn_repair import repair_damaged, solve

SCHEMA = "conv_id long, turn long, role string, text string, conv string, name string, copies string, part string"
WORD = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def cheapest(faults: list[str], roles: list[str]) -> tuple[int, str, list]:
    """Cost, audit and kept rows of the cheapest repair, by a table over all rows and states."""

    def inserts(table):
        for _ in range(3):
            for state, to, role in ((0, 2, "user"), (1, 2, "user"), (3, 2, "user"), (2, 3, "assistant")):
                if state in table:
                    cost, audit, kept = table[state]
                    new = (cost + 3, audit + "I", [*kept, (role, None)])
                    if to not in table or new[:2] < table[to][:2]:
                        table[to] = new
        return table

    table = inserts({0: (0, "", [])})
    for k, (fault, role) in enumerate(zip(faults, roles, strict=True)):
        after = {}

        def offer(state, cost, audit, kept, after=after):
            if state not in after or (cost, audit) < after[state][:2]:
                after[state] = (cost, audit, kept)

        for state, (cost, audit, kept) in table.items():
            offer(state, cost + 4, audit + "D", kept)
            if fault in ("blank", "duplicate"):
                continue
            cost += 3 * (fault == "truncated")
            if state in NEXT.get(role[:1], {}):
                offer(NEXT[role[0]][state], cost, audit + "K", [*kept, (role, k)])
            for to in ("user", "assistant"):
                if state in NEXT[to[0]]:
                    offer(NEXT[to[0]][state], cost + 3, audit + "R", [*kept, (to, k)])
        table = inserts(after)
    return min((table[s] for s in (0, 3) if s in table), key=lambda x: x[:2])


def plain(rows: list[tuple]) -> list[tuple]:
    groups = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        conv_, turn_ = (" " if x is None else x for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        deal = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        text = "" if deal == 1 else re.sub("[.!?]", "", text) if deal == 2 else text
        role = "user" if deal == 4 else role
        groups[conv] += [(turn is not None, turn or 0, role, text)] * (0 if deal == 0 else 2 if deal == 3 else 1)
    out = []
    for conv, found in groups.items():
        found.sort()
        seen, faults = set(), []
        for _, _, role, text in found:
            last = WORD.findall(text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
            seen.add((role, text))
        roles = [r[2] for r in found]
        illegal = sum(len(a) == 0 or a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
        turns = [r[1] for r in found if r[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, kept = cheapest(faults, roles)
        text = "\n".join(f"{role}:{'' if k is None else found[k][3]}" for role, k in kept)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha))
    return out


def table(seed: int = 3) -> list[tuple]:
    """Conversations of many lengths and shapes, null ids, turns, roles and texts, repeated rows and a long one."""
    rng = random.Random(seed)
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rng.choice([1, 2, 3, 6, 9, 30])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "Assistant", "unknown", "", None])
            text = rng.choice(["Yes.", "No!", "so", "a b", " \t\n", "", None, "é?", f"row {turn}.", "x\n. "])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn - 40]), role, text, "c", "n", "1", "p"))
    rows += rows[:40]
    rows += [(500, turn, ["user", "assistant", "system"][turn * turn % 3], "long " * 2000 + ".", "c", "n", "1", "p") for turn in range(90)]
    rows += [(501, 5, "user", "same.", "c", "n", "1", "p")] * 300
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", [{}, {"part_rows": 7, "part_chars": 3000}])
def test_repairs_equal_the_dynamic_program(spark, parts):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert ordered(repair_damaged(df, **parts).collect()) == ordered(plain(rows))


def test_auction_costs_and_audits():
    rng = random.Random(5)
    names = ["", "blank", "duplicate", "truncated"]
    for _ in range(1500):
        codes = bytes(rng.randrange(16) for _ in range(rng.randrange(50)))
        want = cheapest([names[c >> 2] for c in codes], ["suax"[c & 3] for c in codes])
        assert solve(codes) == want[:2]


def test_a_dropped_conversation_and_an_empty_table(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.", "", "", "", "")], SCHEMA)
    assert ordered(repair_damaged(df).collect()) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair_damaged(df.limit(0)).collect() == []
