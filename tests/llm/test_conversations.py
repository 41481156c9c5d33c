"""Operator 13 against a plain search for the cheapest edits."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lectern.llm import conversations as c
from lectern.llm.common import table
from tests.conftest import DATA

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(x for x in text if x not in ".!?")
        out += [] if kind == 0 else [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows, spread=4):
    """conv: (gaps, blank, duplicate, truncated, illegal, cost, audit, digest), by all edits with inserts in steps."""
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r[1:])
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faults = set(), []
        for _, role, text in turns:
            body = text.rstrip(" \t\n\v\f\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        best = {0: (0, "", ())}

        def inserted(best):
            for _ in range(spread):
                for s, (cost, audit, lines) in list(best.items()):
                    for role in ("user", "assistant"):
                        to = NEXT.get((s, role[0]))
                        if to is not None:
                            made = (cost + 3, audit + "I", (*lines, f"{role}:"))
                            best[to] = min(best.get(to, made), made, key=lambda x: x[:2])
            return best

        for (_, role, text), fault in zip(turns, faults, strict=True):
            new = {}
            for s, (cost, audit, lines) in inserted(best).items():
                ways = [(s, 4, "D", lines)]
                if fault in ("", "truncated"):
                    extra = 3 if fault else 0
                    ways += [(NEXT.get((s, role[:1])), extra, "K", (*lines, f"{role}:{text}"))]
                    ways += [(NEXT.get((s, x[0])), 3 + extra, "R", (*lines, f"{x}:{text}")) for x in ("user", "assistant")]
                for to, more, letter, kept in ways:
                    if to is not None:
                        made = (cost + more, audit + letter, kept)
                        new[to] = min(new.get(to, made), made, key=lambda x: x[:2])
            best = new
        cost, audit, lines = min((x for s, x in inserted(best).items() if s in (0, 3)), key=lambda x: x[:2])
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)
    return out


def made(spark, rows, partitions=3):
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string").repartition(partitions)
    reports, lines = c.repaired(df)
    digest = {r.conv: r.sha256 for r in c.digests(lines).collect()}
    got = {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digest[r.conv]) for r in reports.collect()}
    assert reports.count() == len(got) == len(digest)
    return got


def conversation(rng, conv, n):
    roles = ["user", "assistant", "system", "tool", "", "user", "assistant"]
    texts = ["", " \n", "Yes.", "No", "Why?", "Well, yes!", "x "]
    return [(conv, k + rng.choice([0, 0, 0, 7]) * (k == n // 2), rng.choice(roles), rng.choice([*texts, f"It is {k}.", f"Then {k}"])) for k in range(n)]


@pytest.mark.parametrize("rows,size", [(256, 1 << 20), (3, 1 << 20), (1, 1 << 20), (7, 12)])
def test_brute_force(spark, monkeypatch, rows, size):
    monkeypatch.setattr(c, "ROWS", rows)
    monkeypatch.setattr(c, "BYTES", size)
    monkeypatch.setattr(c, "FAN", 3)
    rng = random.Random(rows)
    turns = [r for conv in range(-5, 40) for r in conversation(rng, conv, rng.randrange(1, 14))]
    turns += conversation(rng, 99, 70)
    turns = list({(conv, turn): (conv, turn, role, text) for conv, turn, role, text in turns}.values())
    assert made(spark, turns) == brute(turns)


def test_nulls_and_ties(spark):
    rows = [(None, 1, "user", "Hi."), (None, 2, None, "Yes."), (None, None, "system", "Be good."), (1, None, "user", "Hi."), (2, 1, None, None)]
    rows += [(3, 1, "user", "Same.")] * 5 + [(4, 1, "assistant", "B."), (4, 1, "assistant", "A.")]
    got = made(spark, rows)
    spaced = sorted(((a, b, c_ or " ", d or " ") for a, b, c_, d in rows), key=lambda r: (r[2], r[3]))
    assert got == brute(spaced)
    assert made(spark, []) == {}


def test_one_long_conversation(spark):
    """One conversation over many partitions, with copies of one row."""
    rng = random.Random(5)
    rows = conversation(rng, 1, 1200)
    rows = list({r[1]: r for r in rows}.values()) + [(1, 5000, "user", "Again.")] * 900 + conversation(rng, 2, 5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert made(spark, rows, 5) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_damage(spark):
    rows = [(k // 7 if k % 5 else None, k % 7 if k % 6 else None, None if k % 11 == 0 else "assistant", None if k % 13 == 0 else "Go! Now?") for k in range(300)]
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    assert sorted(map(tuple, c.damaged(df).collect()), key=str) == sorted(damage(rows), key=str)


def test_product_is_associative():
    rng = random.Random(8)
    for _ in range(200):
        a, b, d = (c.product("".join(rng.choices("sua?", k=n)), "".join(rng.choices("bdt-", k=n))) for n in rng.choices(range(1, 5), k=3))
        assert c.times(c.times(a, b), d) == c.times(a, c.times(b, d))


def test_query(spark):
    rows = [tuple(r) for r in table(spark, DATA, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = brute(damage(rows))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {r[0]: r[1:] for r in map(tuple, c.op13_conversations(spark, DATA).collect())} == {k: want.get(k, empty) for k in {r[0] for r in rows}}
