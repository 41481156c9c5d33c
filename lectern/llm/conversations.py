"""Operator 13: conversation structure repair as a scan of min-plus matrices.

A repaired conversation gives role initials ``(s?(ua)+)?``, a language of four states. Each
turn becomes a 4x4 matrix: from state to state the cheapest edit as (cost, audit), after
any inserts (the closure of the insert matrix). Elements are added by taking the lesser
one, cost first, then the audit in ASCII order, and multiplied by adding costs and joining
audits. Edits that lead from one state to the same other over the same turns at the same
cost are never a prefix of each other (one more insert costs more), so the product is
associative and any tree of products gives the least repair.

Rows are range-sorted by conversation and turn, so a conversation of any length lies in
neighbouring partitions. Each is cut there into cells of bounded rows and bytes. One
that is a single cell is repaired where it is read. Of a longer one the matrices of all
cells are multiplied in a tree, sixteen at a time, together with what else is associative
(counts, turn numbers, neighbours at the seams); duplicates are found by an aggregation of
first places over all its rows. The audit is then cut along the cells, and each cell is
repaired where its texts are. Only results that are one value for a conversation (its
audit, the digest of its text, which is taken as a stream) pass through one task.

Edge cases: a null role or text is one space, so such a turn is blank; null turns come
first and count for no gap; rows of one turn come by role, then by the first 64 characters
and a hash of the text; repeated rows are duplicates; a null conversation id is a
conversation; very long texts are a cell of their own; roles are judged by their first
character as it is, and an empty one fits nowhere; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import table, written

#: Rows and bytes of a cell (one longer text is a cell).
ROWS, BYTES = 256, 1 << 20
#: Elements that are multiplied at a time.
FAN = 16
_SPACE = " \t\n\v\f\r"
KEEP, REROLE, DELETE, INSERT, MEND = 0, 3, 4, 3, 3
_USER, _ASSISTANT = ((0, 2), (1, 2), (3, 2)), ((2, 3),)
_MOVES = {"s": ((0, 1),), "u": _USER, "a": _ASSISTANT}
_NONE = (None,) * 4
_IDENTITY = tuple(tuple((0, "") if i == j else None for j in range(4)) for i in range(4))

_CELL = "part int, n long, start long, turns array<long>, roles array<string>, texts array<string>, initials string, faults string"
_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_LINES = "array<struct<role: string, text: string>>"
_NUMBERS = ["lo", "hi", "distinct", "illegal", "blank", "duplicate", "truncated"]
_ELEMENT = "cells array<struct<cell: long, n: int>>, initials string, " + ", ".join(f"{c} long" for c in _NUMBERS) + ", costs array<long>, audits array<string>"
_FIELDS = ["cells", "initials", *_NUMBERS, "costs", "audits"]


def plus(a: tuple | None, b: tuple | None) -> tuple | None:
    return b if a is None else a if b is None else min(a, b)


def times(a: tuple, b: tuple) -> tuple:
    """The product of two matrices of (cost, audit) or None, if there is no way."""
    out = []
    for row in a:
        made = list(_NONE)
        for k, left in enumerate(row):
            if left is not None:
                for j, right in enumerate(b[k]):
                    if right is not None:
                        made[j] = plus(made[j], (left[0] + right[0], left[1] + right[1]))
        out.append(tuple(made))
    return tuple(out)


def _matrix(moves: dict) -> tuple:
    return tuple(tuple(moves.get((i, j)) for j in range(4)) for i in range(4))


def closure(a: tuple) -> tuple:
    """Any number of steps of a matrix of four states (three at most: costs are positive)."""
    once = tuple(tuple(map(plus, x, y)) for x, y in zip(a, _IDENTITY, strict=True))
    return times(times(once, once), once)


INSERTS = closure(_matrix({m: (INSERT, "I") for m in _USER + _ASSISTANT}))


@lru_cache(maxsize=None)
def turn_matrix(initial: str, fault: str) -> tuple:
    """Inserts, then one edit of a turn. ``fault``: b(lank), d(uplicate), t(runcated) or none."""
    moves = {(i, i): (DELETE, "D") for i in range(4)}
    if fault not in "bd":
        extra = MEND * (fault == "t")
        for way, cost, letter in ((_USER + _ASSISTANT, REROLE, "R"), (_MOVES.get(initial, ()), KEEP, "K")):
            for m in way:
                moves[m] = plus(moves.get(m), (cost + extra, letter))
    return times(INSERTS, _matrix(moves))


@lru_cache(maxsize=5_000)
def product(initials: str, faults: str) -> tuple:
    """The matrix of successive turns, as a balanced tree."""
    if len(initials) == 1:
        return turn_matrix(initials, faults)
    half = len(initials) // 2
    return times(product(initials[:half], faults[:half]), product(initials[half:], faults[half:]))


def cheapest(matrix: tuple) -> tuple[int, str]:
    ends = times((matrix[0], _NONE, _NONE, _NONE), INSERTS)[0]
    return plus(ends[0], ends[3])


def illegal_pairs(initials: str) -> int:
    return sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1))


def apply_edits(state: int, audit: str, roles: list[str], texts: list[str]) -> tuple[list[dict], int]:
    """The lines that an audit leaves of some turns, from a state on; and the state after them."""
    lines, k = [], 0
    for edit in audit:
        if edit == "K":
            role, state = roles[k], {"s": 1, "u": 2, "a": 3}[roles[k][0]]
        elif edit != "D":
            role, state = ("assistant", 3) if state == 2 else ("user", 2)
        if edit != "D":
            lines.append({"role": role, "text": "" if edit == "I" else texts[k]})
        k += edit != "I"
    return lines, state


def cut_audit(audit: str, sizes: list[int], initials: str) -> list[tuple[int, str]]:
    """The audit along cells of some turns: the state before each, and its edits (with the inserts before its turns; the last has those at the end)."""
    out, at, turn, state = [], 0, 0, 0
    for c, n in enumerate(sizes):
        begin, entered, end = at, state, turn + n
        while at < len(audit) and (turn < end or c == len(sizes) - 1):
            edit = audit[at]
            if edit == "K":
                state = {"s": 1, "u": 2, "a": 3}[initials[turn]]
            elif edit != "D":
                state = 3 if state == 2 else 2
            turn += edit != "I"
            at += 1
        out.append((entered, audit[begin:at]))
    return out


def faults_alone(texts: list[str]) -> str:
    """Of each text whether it is b(lank) or t(runcated) or neither (-)."""
    ends = [t.rstrip(_SPACE)[-1:] for t in texts]
    return "".join("b" if not e else "-" if e in ".!?" else "t" for e in ends)


def with_duplicates(faults: str, is_first: list[bool]) -> str:
    return "".join(f if f == "b" or new else "d" for f, new in zip(faults, is_first, strict=True))


def element(cell: int, turns: list, initials: str, faults: str) -> dict:
    """What of a cell is multiplied."""
    known = [t for t in turns if t is not None]
    matrix = product(initials, faults)
    flat = [x for row in matrix for x in row]
    return {
        "cells": [{"cell": cell, "n": len(initials)}],
        "initials": initials,
        "lo": known[0] if known else None,
        "hi": known[-1] if known else None,
        "distinct": len(set(known)),
        "illegal": illegal_pairs(initials),
        "blank": faults.count("b"),
        "duplicate": faults.count("d"),
        "truncated": faults.count("t"),
        "costs": [None if x is None else x[0] for x in flat],
        "audits": [None if x is None else x[1] for x in flat],
    }


def matrix_of(e: dict) -> tuple:
    flat = [None if c is None else (c, a) for c, a in zip(e["costs"], e["audits"], strict=True)]
    return tuple(tuple(flat[k : k + 4]) for k in range(0, 16, 4))


def joined(a: dict, b: dict) -> dict:
    """The product of two neighbours."""
    flat = [x for row in times(matrix_of(a), matrix_of(b)) for x in row]
    out = {c: a[c] + b[c] for c in ("cells", "initials", "blank", "duplicate", "truncated")}
    out["lo"], out["hi"] = (b["lo"] if a["lo"] is None else a["lo"]), (a["hi"] if b["hi"] is None else b["hi"])
    out["distinct"] = a["distinct"] + b["distinct"] - (a["hi"] is not None and a["hi"] == b["lo"])
    out["illegal"] = a["illegal"] + b["illegal"] + illegal_pairs(a["initials"][-1] + b["initials"][0])
    return out | {"costs": [None if x is None else x[0] for x in flat], "audits": [None if x is None else x[1] for x in flat]}


def report(e: dict) -> dict:
    cost, audit = cheapest(matrix_of(e))
    gaps = 0 if e["lo"] is None else e["hi"] - e["lo"] + 1 - e["distinct"]
    return {c: e[c] for c in ("blank", "duplicate", "truncated", "illegal")} | {"gaps": gaps, "cost": cost, "audit": audit}


def _arrow(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def cells_of(rows: DataFrame) -> DataFrame:
    """Conversations that are whole in one cell, repaired (report and lines); of all others the cells (part, n and their turns).

    A cell is number ``n`` of partition ``part``; ``start`` is the first one of its conversation there.
    """
    schema = f"conv long, {_CELL}, {_COUNTS}, lines {_LINES}"
    arrow = _arrow(rows.sparkSession, schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, held = TaskContext.get().partitionId(), [], 0
        own: list[list] = [[], [], []]
        conv = start = None
        n = size = 0
        is_open = True

        def cell() -> dict:
            nonlocal n
            turns, roles, texts = own
            made = {"conv": conv, "part": part, "n": n, "start": n if start is None else start, "turns": turns, "roles": roles, "texts": texts}
            n += 1
            return made | {"initials": "".join(r[0] if r and r[0] in "sua" else "?" for r in roles), "faults": faults_alone(texts)}

        def whole() -> dict:
            turns, roles, texts = own
            seen: set = set()
            first = [pair not in seen and not seen.add(pair) for pair in zip(roles, texts, strict=True)]
            initials = "".join(r[0] if r and r[0] in "sua" else "?" for r in roles)
            made = report(element(0, turns, initials, with_duplicates(faults_alone(texts), first)))
            return {"conv": conv} | made | {"lines": apply_edits(0, made["audit"], roles, texts)[0]}

        for batch in batches:
            for key, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text")), strict=True):
                if own[1] and (key != conv or len(own[1]) == ROWS or size + len(text) > BYTES):
                    ends = key != conv
                    # The first and the last conversation of a partition may go on in another.
                    if ends and start is None and not is_open:
                        out.append(whole())
                    else:
                        made = cell()
                        start = made["start"]
                        out.append(made)
                    held += size
                    own, size = [[], [], []], 0
                    if ends:
                        start, is_open = None, False
                    if held > BYTES or len(out) >= 4 * ROWS:
                        yield pa.RecordBatch.from_pylist(out, arrow)
                        out, held = [], 0
                conv = key
                size += len(text)
                for column, value in zip(own, (turn, role, text), strict=True):
                    column.append(value)
        if own[1]:
            out.append(cell())
        yield pa.RecordBatch.from_pylist(out, arrow)

    rows = rows.select("conv", "turn", "role", "text", F.substring("text", 1, 64).alias("head"), F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("id"))
    # The last key lets rows that are alike be spread.
    order = ["conv", "turn", "role", "head", "mark", F.xxhash64("id")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text").mapInArrow(walk, schema)


class Numbering:
    """Of each cell how many of its conversation are before it, from one row for each partition."""

    def __init__(self, cells: DataFrame):
        by_part = cells.groupBy("part").agg(
            (F.max("n") + 1).alias("count"),
            F.min_by(F.struct("conv"), "n").alias("first"),
            F.max_by(F.struct("conv"), "n").alias("last"),
            F.max_by("start", "n").alias("start"),
            F.max(F.col("n") - F.col("start")).alias("most"),
        )
        self.base, self.begun, self.most = {}, {}, 0
        before, past, began = None, 0, 0
        for p in sorted(by_part.collect(), key=lambda r: r.part):
            self.base[p.part] = past
            # Where the first conversation of the partition began, if that was in an earlier one.
            self.begun[p.part] = began if before is not None and before == p["first"] else past
            began = self.begun[p.part] if p.start == 0 else past + p.start
            past += p["count"]
            self.most = max(self.most, p.most, past - 1 - began)
            before = p["last"]

    def rank(self, part: int, n: int, start: int) -> int:
        return self.base[part] + n - (self.begun[part] if start == 0 else self.base[part] + start)


def multiplied(cells: DataFrame, numbering: Numbering) -> DataFrame:
    """conv and its element, for conversations of several cells."""
    place = F.shiftleft("cell", 10) + F.col("at")
    turns = cells.select("conv", "cell", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "row"))
    digest = F.unhex(F.md5(F.concat("row.roles", F.lit("\0"), "row.texts")))
    firsts = turns.groupBy("conv", digest.alias("digest")).agg(F.min(place).alias("place"))
    firsts = firsts.groupBy(F.shiftright("place", 10).alias("cell")).agg(F.collect_list(F.col("place").bitwiseAND(1023)).alias("firsts"))
    schema = f"conv long, rank long, {_ELEMENT}"
    arrow = _arrow(cells.sparkSession, schema)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                new = set(r["firsts"] or ())
                faults = with_duplicates(r["faults"], [k in new for k in range(len(r["faults"]))])
                out.append({"conv": r["conv"], "rank": numbering.rank(r["part"], r["n"], r["start"])} | element(r["cell"], r["turns"], r["initials"], faults))
            yield pa.RecordBatch.from_pylist(out, arrow)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (r,) = batch.slice(k, 1).to_pylist()
                parts = sorted(r["parts"], key=lambda e: e["rank"])
                while len(parts) > 1:
                    parts = [joined(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
                yield pa.RecordBatch.from_pylist([parts[0] | {"conv": r["conv"], "rank": r["rank"]}], arrow)

    slim = cells.select("conv", "cell", "part", "n", "start", "turns", "initials", "faults")
    made = slim.join(firsts, "cell", "left").mapInArrow(leaves, schema)
    most = numbering.most
    while most:
        most //= FAN
        groups = made.groupBy("conv", F.floor(F.col("rank") / FAN).alias("up")).agg(F.collect_list(F.struct("rank", *_FIELDS)).alias("parts"))
        made = groups.select("conv", F.col("up").alias("rank"), "parts").mapInArrow(nodes, schema)
    return made


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the turns of conversations (conv long, turn long, role, text) the reports and the repaired lines.

    Reports: conv, gaps, blank, duplicate, truncated, illegal, cost, audit. Lines: conv,
    piece (in order), alone (whether it is the only one), lines (role, text).
    """
    rows = rows.select("conv", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    walked = written(cells_of(rows))
    counts = [f.split()[0] for f in _COUNTS.split(", ")]
    reports = walked.filter("part is null").select("conv", *counts)
    lines = walked.filter("part is null").select("conv", F.lit(0).cast("long").alias("piece"), F.lit(True).alias("alone"), "lines")
    cells = walked.filter("part is not null").withColumn("cell", F.shiftleft(F.col("part").cast("long"), 30) + F.col("n"))
    edits = f"{_COUNTS}, pieces array<struct<cell: long, state: int, edits: string>>"
    arrow = _arrow(rows.sparkSession, f"conv long, {edits}")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (e,) = batch.slice(k, 1).to_pylist()
                made = report(e)
                cut = cut_audit(made["audit"], [c["n"] for c in e["cells"]], e["initials"])
                yield pa.RecordBatch.from_pylist([{"conv": e["conv"], "pieces": [{"cell": c["cell"], "state": s, "edits": a} for c, (s, a) in zip(e["cells"], cut, strict=True)]} | made], arrow)

    decided = written(multiplied(cells, Numbering(cells)).mapInArrow(decide, f"conv long, {edits}"))
    line_schema = f"conv long, piece long, alone boolean, lines {_LINES}"
    line_arrow = _arrow(rows.sparkSession, line_schema)

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (r,) = batch.slice(k, 1).to_pylist()
                yield pa.RecordBatch.from_pylist([{"conv": r["conv"], "piece": r["cell"], "alone": False, "lines": apply_edits(r["state"], r["edits"], r["roles"], r["texts"])[0]}], line_arrow)

    pieces = decided.select(F.explode("pieces").alias("p")).select("p.*")
    mended = cells.select("conv", "cell", "roles", "texts").join(pieces, "cell").mapInArrow(mend, line_schema)
    return reports.unionByName(decided.select("conv", *counts)), lines.unionByName(mended)


def digests(lines: DataFrame) -> DataFrame:
    """conv, sha256 of its lines ``role:text``, joined by newlines."""
    text = F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    short = lines.filter("alone").select("conv", F.sha2(text, 256).alias("sha256"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = known = any_line = None
        done: list[tuple] = []
        for batch in batches:
            for key, part, n in zip(*(batch.column(c).to_pylist() for c in ("conv", "text", "n")), strict=True):
                if known is None or key != conv:
                    if known is not None:
                        done.append((conv, known.hexdigest()))
                    conv, known, any_line = key, hashlib.sha256(), False
                if n:
                    known.update(("\n" if any_line else "").encode() + part.encode())
                    any_line = True
        if known is not None:
            done.append((conv, known.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([h for _, h in done], pa.string())], ["conv", "sha256"])

    long = lines.filter("not alone").select("conv", "piece", text.alias("text"), F.size("lines").alias("n"))
    return short.unionAll(long.repartition("conv").sortWithinPartitions("conv", "piece").select("conv", "text", "n").mapInArrow(stream, "conv long, sha256 string"))


def damaged(rows: DataFrame) -> DataFrame:
    """Turns (conv, turn, role, text) with faults by a hash of conversation and turn; nulls are one space."""
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn", "role", "text")}
    kind = (F.crc32(F.concat(spaced["conv"], F.lit(":"), spaced["turn"])) % 20).alias("kind")
    hit = rows.select("conv", "turn", spaced["role"].alias("role"), spaced["text"].alias("text"), kind).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times_ = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return hit.select("conv", "turn", role.alias("role"), text.alias("text"), times_.alias("copy")).drop("copy")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    reports, lines = repaired(damaged(rows))
    known = reports.withColumnRenamed("conv", "c").join(digests(lines).withColumnRenamed("conv", "d"), F.col("c").eqNullSafe(F.col("d")))
    all_of = rows.select("conv").distinct().join(known, F.col("conv").eqNullSafe(F.col("c")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return all_of.select(F.col("conv").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _sql() -> str:
    """The same in SQL: a fold over the turns of a conversation that keeps the cheapest edits to each state."""
    after = lambda s, cost, letter: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}'}}"
    to_user = f"list_min([z.s2, {after('z.s0', INSERT, 'I')}, {after('z.s1', INSERT, 'I')}, {after('z.s3', INSERT, 'I')}])"
    to_assistant = f"list_min([z.s3, {after(to_user, INSERT, 'I')}])"
    states = ["z.s0", "z.s1", to_user, to_assistant]
    far, extra, kept = "{'c': 1000000000, 'a': ''}", f"(CASE WHEN x.f = 't' THEN {MEND} ELSE 0 END)", "x.f IN ('-', 't')"

    def new(state: int) -> str:
        """The cheapest edits to a state after one more turn."""
        ways = [after(states[state], DELETE, "D")]
        for initial, moves in _MOVES.items():
            for begin in [a for a, b in moves if b == state]:
                ways.append(f"CASE WHEN {kept} AND x.i = '{initial}' THEN {after(states[begin], extra, 'K')} ELSE {far} END")
                if initial != "s":
                    ways.append(f"CASE WHEN {kept} THEN {after(states[begin], f'{REROLE} + {extra}', 'R')} ELSE {far} END")
        return f"list_min([{', '.join(ways)}])"

    begin = f"{{'i': '', 'f': '', 's0': {{'c': 0, 'a': ''}}, 's1': {far}, 's2': {far}, 's3': {far}}}"
    fold = f"list_reduce(list_prepend({begin}, ts), lambda z, x: {{'i': '', 'f': '', {', '.join(f"'s{k}': {new(k)}" for k in range(4))}}})"
    best = f"list_min([z.s0, {to_assistant}])"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda b: ascii(b)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda q, k: xor(q >> 1, 3988292384 * (q & 1)))), 4294967295)"
    space = r"\x20\x09-\x0D"
    return f"""WITH k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS key FROM conversations),
h AS (SELECT conv_id, turn, role, text, {crc} % 20 AS kind FROM k),
g AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM g),
f AS (SELECT *, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^{space}]') THEN 'b' WHEN seen > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][{space}]*$') THEN 't' ELSE '-' END AS f, concat(lag(left(role, 1)) OVER w, left(role, 1)) AS pair, lag(p) OVER w AS before FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal,
  list({{'i': i, 'f': f, 's0': {far}, 's1': {far}, 's2': {far}, 's3': {far}}} ORDER BY p) AS ts, list(role ORDER BY p) AS roles, list(text ORDER BY p) AS texts FROM f GROUP BY conv_id),
b AS (SELECT *, list_transform([{fold}], lambda z: {best})[1] AS best FROM c),
l AS (SELECT conv_id, list_reduce(list_prepend({{'e': '', 'k': 0, 's': 0, 'o': []::VARCHAR[]}}, list_transform(list_filter(string_split(best.a, ''), lambda q: q <> ''), lambda q: {{'e': q, 'k': 0, 's': 0, 'o': []::VARCHAR[]}})), lambda a, x:
  {{'e': '', 'k': CASE x.e WHEN 'I' THEN a.k ELSE a.k + 1 END,
   's': CASE x.e WHEN 'D' THEN a.s WHEN 'K' THEN CASE left(roles[a.k + 1], 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE a.s WHEN 2 THEN 3 ELSE 2 END END,
   'o': CASE x.e WHEN 'D' THEN a.o ELSE list_append(a.o, concat(CASE WHEN x.e = 'K' THEN roles[a.k + 1] WHEN a.s = 2 THEN 'assistant' ELSE 'user' END, ':', CASE x.e WHEN 'I' THEN '' ELSE texts[a.k + 1] END)) END}}).o AS o FROM b)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit,
sha256(coalesce(array_to_string(o, chr(10)), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN b ON a.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN l ON a.conv_id IS NOT DISTINCT FROM l.conv_id"""


SQL = _sql()
