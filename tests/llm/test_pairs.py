"""Operators 1 and 7 against brute force, with edge cases."""

import random
import re
from collections import defaultdict

import pytest

from lectern.llm import jaccard_join, topk
from lectern.llm.components import components

DOCS = "doc_id long, text string, unit string, node long"


def brute(docs, width, percent):
    """(id, set size, component, links) by comparing all pairs that share a shingle."""
    sets = []
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append((d, frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])))
    root, links = list(range(len(sets))), [0] * len(sets)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, (d, s) in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for k in holders[x]:
                shared[k] += 1
            holders[x] += [i] if d is not None else []
        for k, n in shared.items() if d is not None else ():
            if 100 * n >= percent * (len(s) + len(sets[k][1]) - n):
                root[find(i)] = find(k)
                links[i] += 1
                links[k] += 1
    name = {}
    for i, (d, _) in enumerate(sets):
        name[find(i)] = d if name.get(find(i)) is None else min(name[find(i)], d)
    return sorted(((d, len(s), name[find(i)], links[i]) for i, (d, s) in enumerate(sets)), key=repr)


def corpus(seed, n=60):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.choice([3, 12, 40, 150, 600]))) for _ in range(8)]
    passage = " ".join(f"p{k}" for k in range(60))
    docs = []
    for k in range(n):
        words = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 5, len(words) // 30])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
        docs.append((k, " ".join(words) + (f" {passage}" if rng.random() < 0.3 else "")))
    return docs + [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "É x y z"), (n + 6, "é x y z"), (None, docs[0][1]), docs[1], docs[1]]


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_join(spark, width, percent):
    docs = corpus(width)
    df = spark.createDataFrame([(d, t, "u", 1) for d, t in docs], DOCS)
    got = sorted((tuple(r) for r in jaccard_join.jaccard_join(df, width=width, percent=percent).collect()), key=repr)
    assert got == brute(docs, width, percent)


def test_tiles_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE_SETS", 7)
    monkeypatch.setattr(jaccard_join, "TILE_SIGNATURES", (9, 13))
    docs = corpus(3, 40)
    df = spark.createDataFrame([(d, t, "u", 1) for d, t in docs], DOCS)
    got = sorted((tuple(r) for r in jaccard_join.jaccard_join(df).collect()), key=repr)
    assert got == brute(docs, 4, 85)


def test_empty_join_and_stage(spark):
    none = spark.createDataFrame([], DOCS)
    assert jaccard_join.jaccard_join(none).collect() == []
    docs = corpus(5, 25)
    df = spark.createDataFrame([(d, t, "u", 1) for d, t in docs], DOCS)
    kept = jaccard_join.distinct_documents(spark, df, "")
    want = [r[0] for r in brute(docs, 5, 80) if r[0] == r[2]]
    assert sorted(kept.toPandas()["doc_id"].dropna().astype(int)) == sorted({x for x in want if x is not None})
    assert kept.columns == df.columns and kept.filter("doc_id IS NULL").count() == 1


def test_stage_keeps_texts_that_share_an_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    docs = [(1, a), (2, b), (2, f"{a} more"), (3, c), (3, "few words"), (3, "few other"), (3, c), (4, c.upper()), (4, b), (5, "d " * 9), (5, "D " * 9)]
    for order in (docs, docs[::-1]):
        df = spark.createDataFrame([(d, t, "u", 1) for d, t in order], DOCS)
        kept = sorted((r.doc_id, r.text) for r in jaccard_join.distinct_documents(spark, df, "").collect())
        assert [(d, t.lower()) for d, t in kept] == [(1, a), (2, b), (3, c), (3, "few other"), (3, "few words"), (5, "d " * 9)]


def test_components(spark):
    edges = [(9, 8), (8, 7), (7, 6), (6, 5), (1, 2), (2, 2), (3, 1), (None, 1), (12, 11)]
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == [(2, 1), (3, 1), (6, 5), (7, 5), (8, 5), (9, 5), (12, 11)]


def test_segments_lose_no_pair():
    import numpy as np

    rng = np.random.default_rng(0)
    for percent in (80, 85):
        for n in [1, 2, 5, 6, 7, 13, 40, 200, 901, 3000]:
            for _ in range(20):
                a = np.unique(jaccard_join.mix(rng.integers(0, 2**63, n).astype(np.uint64)))
                gone, new = (0, 0) if n < 3 else sorted(rng.integers(0, n * (100 - percent) // 100 + 1, 2))
                b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, new).astype(np.uint64)]))
                shared = len(np.intersect1d(a, b))
                if shared * (100 + percent) >= percent * (len(a) + len(b)):
                    assert len(np.intersect1d(jaccard_join.keys(a, percent), jaccard_join.keys(b, percent)))
                    sign = [np.frombuffer(jaccard_join.signature(x), "<u8")[None] for x in (a, b)]
                    w = min(s.shape[1] for s in sign)
                    assert jaccard_join.most_shared(jaccard_join.folded(sign[0], w)[0], jaccard_join.folded(sign[1], w), len(a), np.array([len(b)]))[0] >= shared


def top_brute(rows, every, k):
    import math

    whole = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    whole = list(dict.fromkeys(whole))
    out = []
    for q, v in whole:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 22, 28])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "RUN", 2)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(80)] + [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(200, 210)]
    rows += [(300, None), (305, [1.0, None, 0.0, 0.0]), (310, [float("nan"), 0.0, 0.0, 0.0]), (315, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]), (400, [1.0, 2.0]), (402, [3.0, 2.0]), (80, [])]
    rows += rows[:3] + [(1000, [1e9, -1e9, 3.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, dim string, rank int")
    assert sorted(tuple(r) for r in topk.top_k(df, every=5, k=3).collect()) == top_brute(rows, 5, 3)


def test_top_k_leaves_far_blocks_out(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 80)
    rng = random.Random(2)
    rows = [(10 * c + k, [100.0 * (c == d) + rng.random() for d in range(8)]) for c in range(8) for k in range(10)]
    seen, real = [], topk.reachable
    monkeypatch.setattr(topk, "reachable", lambda q, c, n: seen.append((real(q, c, n).count(), q.select("q_block").distinct().count() * c.select("block").distinct().count())) or real(q, c, n))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df, every=1, k=3).collect()) == top_brute(rows, 1, 3)
    assert seen[0][0] < seen[0][1] // 2


def test_top_k_empty(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
