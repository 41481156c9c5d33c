"""Operator 12 against brute force."""

import hashlib
import random

import numpy as np
import pytest

from lectern.llm import repeats
from lectern.llm.common import table
from tests.conftest import DATA


def brute(docs, width):
    """(id, bytes, removed, spans, kept) by looking up every string of the texts in order."""
    seen, out = set(), []
    for key, text in docs:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - width + 1):
            string = raw[k : k + width]
            if string in seen:
                gone[k : k + width] = True
            seen.add(string)
        spans = int((np.diff(np.append(False, gone).astype(int)) == 1).sum())
        out.append((key, len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def result(df, width):
    rows = repeats.without_repeats(df, width=width).collect()
    return [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows]


def noise(rng, n):
    return "".join(rng.choice("abcdefgh é\n") for _ in range(n))


@pytest.mark.parametrize("width", [16, 40, 100, 300])
def test_brute_force(spark, width, monkeypatch):
    monkeypatch.setattr(repeats, "PART", 4096)
    rng = random.Random(width)
    parts = [noise(rng, n) for n in (width // 2, width - 1, width, width + 1, 2 * width, 5 * width)]
    texts = []
    for _ in range(60):
        t = "".join(rng.choice(parts) if rng.random() < 0.5 else noise(rng, rng.randrange(2 * width)) for _ in range(rng.randrange(6)))
        texts.append(t)
    texts += ["", None, "a" * 7 * width, "ab" * 3 * width, texts[3], texts[4] + "x", noise(rng, 9000) + parts[5] + noise(rng, 9000), parts[5] * 3]
    docs = [(3 * k - 50, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(result(df, width)) == sorted(brute(docs, width))


def test_borders(spark, monkeypatch):
    """With very many partitions buckets lie across borders."""
    rng = random.Random(1)
    line = noise(rng, 150)
    docs = [(k, noise(rng, 30) + line + (noise(rng, 20) if k % 2 else "")) for k in range(80)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        got = result(spark.createDataFrame(docs, "doc_id long, text string"), 100)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got) == sorted(brute(docs, 100))


def test_odd_rows(spark):
    rng = random.Random(2)
    a, b = noise(rng, 400), noise(rng, 400)
    rows = [(None, a, 1), (5, a, 2), (5, a, 3), (6, a + b, 4), (None, a, 5), (7, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id long").withColumnRenamed("id", "low")
    got = sorted(repeats.without_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans").collect(), key=str)
    size, rest = len(a.encode()), len((a + b).encode())
    want = [(None, size, 0, 0), (None, size, 0, 0), (5, size, size, 1), (5, size, size, 1), (6, rest, size, 1), (7, 0, 0, 0)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert repeats.without_repeats(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        repeats.without_repeats(df, width=8)


def test_same_id(spark):
    """Different texts of one id: one of them comes first, and only what the other repeats goes."""
    rng = random.Random(3)
    a, b = noise(rng, 300), noise(rng, 300)
    df = spark.createDataFrame([(1, a + b), (1, b + a)], "doc_id long, text string")
    got = repeats.without_repeats(df).collect()
    assert sorted(r.n_removed > 0 for r in got) == [False, True]
    assert max(r.n_removed for r in got) == len((a + b).encode())


def test_query(spark):
    docs = sorted((r.doc_id, r.text) for r in table(spark, DATA, "documents").collect())
    got = repeats.op12_repeats(spark, DATA).collect()
    assert sorted(map(tuple, got)) == brute(docs, 100)
