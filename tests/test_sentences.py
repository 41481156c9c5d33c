"""Sentence ends learnt from the corpus."""

import math
import time
from collections import Counter

from pyspark.sql import functions as F

from lectern.functions.rules import strip
from lectern.operators import chunks, sentences

TEXTS = [
    "Dr. Smith met Mr. Jones at 5 p.m. in the U.S. Navy base. It was late. He went home.",
    "I saw Dr. Brown. She said it was fine. The boat came at 6 p.m. sharp. Then it left.",
    "Mr. White and Mr. Black met. They saw the U.S. flag. We like it. In the end it rained.",
    'J. R. Tolkien wrote it. No. 5 is here. The book was long. It ended. What now? "Yes." He left.\n\nNew one etc.\n\nAgain.',
    "Wait... what? She smiled. It rained. The day was over.  \n",
]


def told(df, model):
    masked = sentences.protected(df, model)
    split = F.flatten(F.transform(chunks.paragraphs(F.col("text")), lambda p: F.transform(chunks.sentences(p), sentences.unmasked)))
    return {r.id: r.s for r in masked.select("id", split.alias("s")).collect()}


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_abbreviations_stay_inside(spark):
    df = frame(spark, TEXTS * 3)
    got = told(df, sentences.trained(df))
    assert got[0] == ["Dr. Smith met Mr. Jones at 5 p.m. in the U.S. Navy base.", "It was late.", "He went home."]
    assert got[1] == ["I saw Dr. Brown.", "She said it was fine.", "The boat came at 6 p.m. sharp.", "Then it left."]
    assert got[2][:2] == ["Mr. White and Mr. Black met.", "They saw the U.S. flag."]
    assert got[3] == ["J. R. Tolkien wrote it.", "No. 5 is here.", "The book was long.", "It ended.", "What now?", '"Yes."', "He left.", "New one etc.", "Again."]
    assert got[4] == ["Wait...", "what?", "She smiled.", "It rained.", "The day was over."]


def test_starter_after_an_abbreviation(spark):
    """A word that is also written small ends the sentence before it; one that is not does not."""
    df = frame(spark, ["We met at 5 p.m. The men left. Then the men slept at 6 p.m. sharp. It was on the hill."] * 4 + ["He came at 5 p.m. Rome time."])
    got = told(df, sentences.trained(df))
    assert got[0][0] == "We met at 5 p.m." and got[4] == ["He came at 5 p.m. Rome time."]


def test_scores(spark):
    """The counts and scores against plain Python."""
    df = frame(spark, TEXTS * 2)
    types = {r.kind: r for r in sentences.trained(df).types.collect()}
    own, plain = Counter(), Counter()
    for t in TEXTS * 2:
        for token in t.split():
            c = token.lstrip("([{\"'").rstrip(")]}\"',;:")
            ends = c.endswith(".") and not c.endswith("..")
            k = c[:-1].lower() if ends else c.lower()
            k = "##" if k.isdigit() else k
            (own if ends else plain)[k] += 1
    n, p = sum(own.values()) + sum(plain.values()), sum(own.values())
    assert {k: (r.n_period, r.n_plain) for k, r in types.items()} == {k: (own[k], plain[k]) for k in own | plain}
    log = lambda x, y: x * math.log(y) if x else 0.0
    for k in ("dr", "p.m", "it", "left"):
        a, b = own[k], plain[k]
        ratio = -2 * (log(a, p / n) + log(b, 1 - p / n) - log(a, 0.99) - log(b, 0.01))
        letters = len(k.replace(".", ""))
        assert math.isclose(types[k].score, ratio * math.exp(-letters) * (k.count(".") + 1) * letters**-b if a else 0.0)


def test_odd_texts(spark):
    odd = [None, "", " ", ".", "...", "!", "a. b. c.", "J. J. J.", "5. 6. 7.", "Dr.", "x\n\n\n\ny.", "Dr.\tSmith. " * 3, " Mr. X ", "﷐ a. b", TEXTS[0], TEXTS[0]]
    df = frame(spark, odd).withColumn("_inside", F.lit(1)).withColumn("key", F.lit(2))
    model = sentences.trained(df)
    masked = sentences.protected(df, model)
    assert masked.columns == df.columns and masked.count() == len(odd)
    assert {r.id: r.t for r in masked.select("id", sentences.unmasked(F.col("text")).alias("t")).collect() if r.id != 13} == {k: t for k, t in enumerate(odd) if k != 13}
    empty = sentences.trained(df.limit(0))
    assert empty.types.collect() == empty.collocations.collect() == []
    assert told(df, empty)[14][0] == "Dr."


def test_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(sentences, "SMALL", -1)
    test_abbreviations_stay_inside(spark)


def test_chunks_keep_words_and_white_space(spark):
    df = frame(spark, TEXTS * 3)
    rows = chunks.chunked(df, most=60, model=sentences.trained(df)).orderBy("id", "chunk_index").collect()
    for k, t in enumerate(TEXTS * 3):
        own = [r for r in rows if r.id == k]
        assert " ".join(r.text for r in own).split() == t.split()
        assert all(len(r.text) <= 60 for r in own)


def test_parts_and_gaps_of_odd_texts(spark):
    """What is searched from the mark on is what the pattern of an end itself finds."""
    texts = ["", " ", "a", "A. B! C?", "x.') y.')] z.\")') w", "a..  b.  \n\nc.\x1dd. ", "?!) ' . \" .\" ", "a. b\ufdee. c. d", ".\n", None, "\U0001f600. \U0001f600! "]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = rows.select(sentences.parts(F.col("text")), F.split("text", sentences.END, -1), sentences.gaps(F.col("text")), F.regexp_extract_all("text", F.lit(sentences.END), F.lit(0))).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in got)


def test_ends_behind_long_words_take_linear_time(spark):
    """A long word inside a sentence was looked through from each of its characters."""
    texts = spark.createDataFrame([("x" * 200_000 + " etc. Next one. ",)], "text string")
    begun = time.monotonic()
    assert [(r.at, r.before, r.next) for r in sentences.ends(texts, "text").collect()] == [(0, "etc.", "Next")]
    assert time.monotonic() - begun < 30


def test_strip_takes_all_white_space(spark):
    space = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
    rows = spark.createDataFrame([(space + "a" + space + "b\u200b" + space,), (space,), ("",), (None,), ("é😀",)], "t string")
    assert [r[0] for r in rows.select(strip(F.col("t"))).collect()] == ["a" + space + "b\u200b", "", "", None, "é😀"]
