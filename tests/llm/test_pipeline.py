"""The pipeline from end to end: against plain Python, and over rows with nulls, repeats and clashing columns."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lectern.llm.batches import vocabulary
from tests.llm.test_pairs import brute
from tests.llm.test_tables import queued


def through(spark, docs):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        docs = stage(spark, docs, "")
        if k + 1 < len(corpus_pipeline.STAGES):
            docs = corpus_pipeline.written(docs)
            assert docs.columns == columns
    return docs


def pieces(docs):
    """(doc_id, start, length, crc, tokens) of all pieces of (id, text) rows."""
    t, made = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), Counter()
    for d, text in docs:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        for s in range(0, len(ids), 4096):
            made[d, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()), len(ids)] += 1
    return made


def prose(rng, n):
    words = [rng.choice(["tree", "river", "stone", "light", "cloud", "garden", "winter", "letter"]) + rng.choice("abcdefghijklm") for _ in range(n)]
    return "\n".join(" ".join(words[k : k + 9]).capitalize() + "." for k in range(0, n, 9))


def test_against_plain_python(spark):
    rng = random.Random(8)
    docs = []
    for k in range(60):
        text = prose(rng, rng.choice([30, 80, 200])) if k < 40 or k % 3 else prose(rng, rng.choice([4, 12]))
        docs.append((k, text, ["a", "b", "c", None][min(k % 7, 3)]))
    docs += [(100 + k, docs[k][1], "b") for k in range(5)]
    docs += [(200 + k, docs[k][1].replace("\n", f"\nExtra{k} words here now.\n", 1), "a") for k in range(5, 9) if len(docs[k][1]) > 800]
    docs += [(300 + k, "Noise*** more### noise%%% here$$$ " * 12, "c") for k in range(3)] + [(400, prose(rng, 9000), "a")]
    kept = [(d, t, s) for d, t, s in docs if len(t.split()) >= 20 and "***" not in t]
    alone = {x[0] for x in brute([(d, t) for d, t, _ in kept], 5, 80) if x[0] == x[2]}
    kept = [x for x in kept if x[0] in alone]
    assert 20 < len(kept) < len(docs) - 10
    _, _, taken, key, words = queued(kept)
    want = []
    for d, t, s in kept:
        n, size = taken[s, key(d, t), words(t)][0], words(t)
        for part in (min(n, size), n - min(n, size)):
            if part:
                # A cut text ends with its last word served.
                at = -1
                for _ in range(part):
                    at = next(i for i in range(at + 1, len(t) + 1) if i == len(t) or t[i] in " \n")
                want.append((d, t if part == size else t[:at]))
    got = through(spark, spark.createDataFrame([(d, t, s, len(t)) for d, t, s in docs], "doc_id long, text string, source string, n_chars long")).toPandas()
    assert Counter(tuple(map(int, x)) for x in got[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].to_numpy()) == pieces(want)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["length"].sum() <= 4096 and list(s["offset"]) == [0, *s["length"].cumsum()[:-1]]


CLASHING = "row text_ key size node unit hits n_words kept words id n target cell kind mark length start finish pass copies"


@pytest.mark.parametrize("part", ["rows", "none", "nulls", "twice"])
def test_odd_rows(spark, part):
    rng = random.Random(4)
    good = prose(rng, 60)
    odd = [(1, good, "a"), (2, None, "a"), (3, "", "b"), (None, good, "a"), (None, prose(rng, 40), None), (5, prose(rng, 40), None), (5, prose(rng, 50), "a"), (6, "word " * 20_000, "a"), (7, good + "\nMail a.b@mail1.example.com.", "b"), (8, prose(rng, 9000), "b")]
    data = {"rows": odd, "none": [], "nulls": [(None, None, None)] * 3, "twice": odd * 2}[part]
    names = CLASHING.split()
    docs = spark.createDataFrame([(*r, *([None] * len(names))) for r in data], "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    got = through(spark, docs).toPandas()
    if part in ("none", "nulls"):
        assert not len(got)
        return
    ids = set(got["doc_id"].dropna().astype(int))
    # 7 is a near copy of 1; of the rows without an id, and of the two texts that share one, none is lost.
    assert ids == {1, 5, 8} and got["doc_id"].isna().any()
    assert got[got["doc_id"] == 5]["doc_tokens"].nunique() >= 1
    assert got.groupby("sequence_id")["length"].sum().max() <= 4096
