"""Operator 11 against brute force; its SQL is compared with the others."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from lectern.llm import codebooks


def brute(rows):
    """(id, code, error, label_error) and the codebooks' digest, in plain Python integers."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = next((len(r[1]) for r in kept if r[1]), 0)
    usable = [(i, [int(np.floor(1024 * float(c))) for c in v], lab) for i, v, lab in kept if len(v) == dim and dim]
    d = dim // 4
    cut = [[w[p * d : p * d + d] for _, w, _ in usable] for p in range(4)]
    books = [c[:256] for c in cut]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(4):
        for p in range(4):
            own = defaultdict(list)
            for x in cut[p]:
                own[nearest(x, books[p])[1]].append(x)
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if own[e] else x for e, x in enumerate(books[p])]
    found = [[nearest(cut[p][k], books[p]) for p in range(4)] for k in range(len(usable))]
    errors = [sum(f[0] for f in near) for near in found]
    totals = defaultdict(int)
    for (_, _, lab), e in zip(usable, errors, strict=True):
        totals[lab] += e
    out = [(i, "".join(f"{f[1]:02x}" for f in near), e, totals[lab]) for (i, _, lab), near, e in zip(usable, found, errors, strict=True)]
    out += [(i, None, None, totals.get(lab)) for i, v, lab in kept if len(v) != dim or not dim]
    return sorted(out, key=str), hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def check(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    codes, books = codebooks.vector_codes(df)
    want, digest = brute(df.select("vec_id", "embedding", "label").collect())
    assert sorted(map(tuple, codes.collect()), key=str) == want
    assert not books or codebooks.fingerprint(books) == digest


def test_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k) * 3 - 90, [float(c) for c in rng.normal(size=8) * 0.4], int(rng.integers(3)) or None) for k in rng.permutation(700)]
    rows += [(None, rows[0][1], 1), (5, rows[1][1], 2), (5, rows[2][1], 2), (rows[3][0], rows[3][1], rows[3][2])] + [(2000 + k, rows[4][1], 9) for k in range(50)]
    rows += [(9000, None, 1), (9001, [0.5] * 7 + [float("nan")], 1), (9002, [float("inf")] + [0.1] * 7, 1), (9003, [0.1] * 4, 7), (9004, [], 1)]
    rows += [(9005, [None] + [0.1] * 7, 1)]
    check(spark, rows)


def test_few_tied_and_large(spark):
    check(spark, [(k, [float(k % 2)] * 4, None) for k in range(9)])
    check(spark, [(k, [1e6 * (k * k % 11), -1.0, 3e5, 0.0], k) for k in range(20)], "double")
    rng = np.random.default_rng(2)
    check(spark, [(k, [float(c) for c in rng.integers(-2, 3, 12) / 1024], 1) for k in range(400)])


def test_empty_and_odd(spark, monkeypatch):
    df = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert codebooks.vector_codes(df)[0].collect() == []
    assert codebooks.vector_codes(df.limit(0))[0].collect() == []
    with pytest.raises(ValueError):
        codebooks.vector_codes(spark.createDataFrame([(1, [0.5] * 6, 1)], "vec_id long, embedding array<float>, label int"))
    monkeypatch.setattr(codebooks, "LABELS", 0)
    check(spark, [(k, [float(k % 5)] * 4, k % 3 or None) for k in range(30)])


def test_bounds_hold():
    rng = np.random.default_rng(3)
    entries, x = rng.integers(-900, 900, (256, 5)), rng.integers(-1500, 1500, (300, 5))
    lower, upper = codebooks.Cells(entries).bounds(x, float)
    apart = ((x[:, None] - entries) ** 2).sum(axis=2)
    assert (lower <= apart).all() and (apart <= upper).all()
    assert (lower <= upper.min(axis=1)[:, None]).mean() < 0.5
