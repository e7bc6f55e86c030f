"""Conversation repair against Dijkstra with whole strings, inside partitions and across them."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from crawlprism.llm import repair

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def step(state: str, role: str) -> str | None:
    """The last role letter after one more; None where the grammar forbids it."""
    return role if (role == "s" and state == "") or (role == "u" and state != "u") or (role == "a" and state == "u") else None


def faults_of(rows: list[tuple]) -> list[str]:
    seen, made = set(), []
    for _, role, text in rows:
        body = text.strip(BLANKS)
        made.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return made


def cheapest(rows: list[tuple]) -> tuple[int, str, tuple[str, ...]]:
    """(cost, letters, repaired messages) of the cheapest, then least repair."""
    faults, done = faults_of(rows), {}
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, i, state, said = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done[i, state] = cost, audit, said

        def push(more: int, letter: str, by: int, to: str | None, *message: str) -> None:
            if to is not None:
                heapq.heappush(heap, (cost + more, audit + letter, i + by, to, said + message))

        for name in ("user", "assistant"):
            push(5, "I", 0, step(state, name[0]), f"{name}:")
        if i < len(rows):
            _, role, text = rows[i]
            push(2, "D", 1, state)
            if faults[i] in ("", "truncated"):
                more = 5 * (faults[i] == "truncated")
                push(more, "K", 1, step(state, role[0]) if role else None, f"{role}:{text}")
                for name in ("user", "assistant"):
                    push(1 + more, "R", 1, step(state, name[0]), f"{name}:{text}")
    return min(done[k] for k in done if k[0] == len(rows) and k[1] in ("", "a"))


def told(rows: list[tuple]) -> tuple:
    faults, turns = faults_of(rows), [t for t, *_ in rows if t is not None]
    cost, audit, said = cheapest(rows)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *map(faults.count, ("blank", "duplicate", "truncated")), illegal,
            cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def broken(rows: list[tuple]) -> dict:
    """The results of damaged rows of (conv_id, turn, role, text)."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: told(sorted(v, key=lambda r: (r[0] is not None, r[0] or 0))) for c, v in held.items()}


def conversation(pick: random.Random, n: int, roles: list[str]) -> list[tuple]:
    made = []
    for i in range(n):
        text = pick.choice(["a", "b.", "", "c! ", "same."]) + (str(i) if pick.random() < 0.6 else "") + pick.choice([".", "", "?\n"])
        made.append((i + pick.randrange(2), pick.choice(roles), text))
    return sorted(made, key=lambda r: r[0])


@pytest.mark.parametrize("seed", range(4))
def test_repairs_equal_dijkstra(seed):
    pick = random.Random(seed)
    for case in range(250):
        roles = [["user", "assistant"], ["user", "assistant", "system"], ["user", "assistant", "system", "tool", "", "ugly"]][case % 3]
        rows = conversation(pick, pick.randrange(9) if case % 10 else pick.randrange(30, 100), roles)
        assert repair.repaired(rows) == told(rows), rows


def test_fragments_compose():
    """Costs by matrices and letters by exit prices are those of the whole."""
    pick = random.Random(9)
    for _ in range(40):
        rows = conversation(pick, pick.randrange(2, 90), ["user", "assistant", "system"])
        seen, codes = set(), bytearray()
        for _, role, text in rows:
            codes.append(repair.code_of(role, text, (role, text) in seen))
            seen.add((role, text))
        cuts = sorted({0, len(codes), *(pick.randrange(1, len(codes)) for _ in range(3))})
        parts = [bytes(codes[a:b]) for a, b in zip(cuts, cuts[1:])]
        exits, made = repair.END, []
        for i, part in reversed(list(enumerate(parts))):
            last = i == len(parts) - 1
            costs = repair.matrix(part, last)
            made.append(repair.solve(part, exits, last=last, first=False)[1])
            exits = tuple(min(costs[4 * q + out] + exits[out] for out in range(4)) for q in range(4))
        letters, state = "", 0
        for walks in reversed(made):
            more, state = walks[state]
            letters += more
        cost, audit, _ = cheapest(rows)
        assert (exits[0], letters) == (cost, audit)


def table(pick: random.Random) -> list[tuple]:
    rows = {}
    for conv in [*range(40), None]:
        n = 500 if conv == 7 else pick.randrange(1, 9)  # one conversation has most of the rows
        for t in range(n):
            role = ["user", "assistant"][t % 2] if pick.random() < 0.7 else pick.choice(["user", "assistant", "system", None])
            text = pick.choice(["hi.", "yo", None, "same.", f"x{t}.", f"y{t}", f"z{t}!", f"q{t}."])
            turn = None if pick.random() < 0.03 else t
            if pick.random() > 0.1:
                rows.setdefault((conv, turn), (conv, turn, role, text))
    return list(rows.values())


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_one_conversation_over_many_partitions(spark, coalesced):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    rows = table(random.Random(3))
    spark.conf.set(key, coalesced)
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 AS part", "'x' AS conv", "turn AS serial")
        got = {r[0]: tuple(r)[1:] for r in repair.repair(repair.damaged(df)).collect()}
    finally:
        spark.conf.set(key, before)
    assert got == broken(rows)


def test_defined_cases(spark):
    rows = [(1, 0, "user", None), (2, 0, None, "hi."), (3, 0, "", "hi."), (4, None, "user", "x."), (4, None, "user", "x."),
            (None, 0, "user", "a."), (None, 1, "assistant", "b." * 200_000)]
    got = {r[0]: tuple(r)[1:] for r in repair.repair(repair.given(spark.createDataFrame(rows, SCHEMA))).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1] == (0, 1, 0, 0, 0, 2, "D", empty)
    assert got[2] == (0, 0, 0, 0, 0, 2, "D", empty) == got[3]
    assert got[4] == (0, 0, 1, 0, 1, 4, "DD", empty)
    assert got[None] == (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(("user:a.\nassistant:" + "b." * 200_000).encode()).hexdigest())
    dropped = next(i for i in range(999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = repair.repair(repair.damaged(spark.createDataFrame([(dropped, 0, "user", "x.")], SCHEMA))).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", empty)]
    assert repair.repair(repair.damaged(spark.createDataFrame([], SCHEMA))).collect() == []
