"""Conversation repair against a search over all edits, and its parts put together from segments of any size."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from textlattice.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, hit int, kind int, audit string, number long"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage(rows):
    """rows: (conv, turn, role, text)."""
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        for _ in range(2 if hit == 3 else 1):
            yield conv, turn, "user" if hit == 4 else role, text


def search(rows):
    """The cheapest edits of [(role, text, fault)], by a search over every sequence of single edits; of equal costs the ASCII-least."""
    queue, seen = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, j, state, lines = heapq.heappop(queue)
        if (j, state) in seen:
            continue
        seen.add((j, state))
        if j == len(rows) and state in ("", "a"):
            return cost, audit, "\n".join(lines)
        steps = []
        if len(audit) < 4 * len(rows) + 4:
            steps += [(3, "I", j, r, (f"{r}:",)) for r in ("user", "assistant")]
        if j < len(rows):
            role, text, fault = rows[j]
            steps.append((4, "D", j + 1, None, ()))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                steps.append((more, "K", j + 1, role, (f"{role}:{text}",)))
                steps += [(3 + more, "R", j + 1, r, (f"{r}:{text}",)) for r in ("user", "assistant")]
        for price, letter, k, role, line in steps:
            first = state if role is None else role[:1]
            if role is None or (state, first) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                heapq.heappush(queue, (cost + price, audit + letter, k, first, lines + line))
    raise AssertionError


def brute(rows, damaged=True):
    out = []
    for conv in {r[0] for r in rows}:
        own = [r for r in (damage(rows) if damaged else rows) if r[0] == conv]
        own = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in own]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest()))
        faults, before = [], set()
        for _, _, role, text in own:
            kept = text.strip(" \t\n\r\x0b\x0c")
            faults.append("blank" if not kept else "duplicate" if (role, text) in before else "truncated" if kept[-1] not in ".!?" else "")
            before.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, text = search([(r[2], r[3], f) for r, f in zip(own, faults, strict=True)])
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def reported(spark, rows, **how):
    rows = [(*r, 1, 2, "x", 3) for r in rows]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in conversations.report(docs, **how).select(*COLUMNS).collect()), key=repr)


def made(n, seed, most=7):
    r = random.Random(seed)
    roles, texts = ("system", "user", "assistant", "user", "assistant", "tool"), ("Yes.", "Why?", "no end", "", " \n", "So!  ", "a. b")
    return [(c, t * r.choice((1, 1, 1, 2)), r.choice(roles), r.choice(texts) + r.choice(("", f"{t}.", str(t)))) for c in range(n) for t in range(r.randrange(1, most))]


ODD = [
    (None, None, None, None),
    (None, 1, "user", "A."),
    (5, None, "assistant", "B."),
    (5, None, "assistant", "B."),
    (5, 3, "", "C"),
    (5, 3, "", "D."),
    (6, 1, "user", "long. " * 50_000),
    (6, 2, "assistant", "x" * 200_000),
    (7, 1, "system", "s."),
    (8, -4, "Ünï", "漢字."),
    (9, 1, "user", "q?\x0b"),
    (9, 2, "assistant", "a.\u00a0"),
]


@pytest.mark.parametrize("bits", [8, 1])
def test_against_the_search(spark, bits):
    rows = made(120, bits) + [(1000 + (c or 0), t, r, x) for c, t, r, x in ODD] + ODD
    assert reported(spark, rows, bits=bits) == brute(rows)


def test_without_damage(spark):
    rows = made(60, 5)
    assert reported(spark, rows, damage=False, bits=1) == brute(rows, damaged=False)


def test_composed_segments_equal_one(spark):
    r = random.Random(3)
    rows = [(1, t, r.choice(("system", "user", "assistant")), r.choice(("Yes.", "no", f"{t}.", f"{t}?", f"{t}"))) for t in range(3000)] + made(20, 8)
    small, large = reported(spark, rows, bits=3), reported(spark, rows, bits=20)
    assert small == large and max(len(x[7]) for x in small) > 2000


@pytest.mark.parametrize("seed", range(3))
def test_cheapest_in_parts(seed):
    r = random.Random(seed)
    codes = "".join(r.choice("suao") + r.choice("0000123") for _ in range(60))
    work = conversations.Composer()
    for k in range(0, len(codes), 14):
        part = codes[k : k + 14]
        ways = [conversations.cheapest(part, s) for s in conversations.STATES]
        orders = [sorted(conversations.STATES, key=lambda s, w=w: w[s][1]) for w in ways]
        work.add(k, part[0], part[-2], 0, [c for w in ways for c, _ in w], [o.index(s) for o in orders for s in conversations.STATES])
    paths = work.paths()[::-1]
    audit = "".join(conversations.cheapest(codes[k : k + 14], q)[s][1] for k, q, s, _, _ in paths)
    end = conversations.AT_END
    assert (paths[-1][3], audit + "I" * end[paths[-1][2]]) == min((c + 3 * end[s], a + "I" * end[s]) for s, (c, a) in enumerate(conversations.cheapest(codes, 0)))


def test_repaired_rows(spark):
    rows = [(1, 1, "assistant", "Hi."), (1, 2, "assistant", ""), (1, 3, "tool", "what"), (2, 1, "system", "Be brief."), (3, 1, "user", " ")]
    table = conversations.whole(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = conversations.repaired(table, conversations.plan(table)[1]).orderBy("conv_id", "place").collect()
    assert [tuple(r) for r in out] == [(1, 0, "I", "user", ""), (1, 1, "K", "assistant", "Hi.")]


def test_empty_table(spark):
    assert reported(spark, []) == []
