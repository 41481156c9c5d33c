"""Cuts by a search give the pieces of the scan."""

import random
import time

from pyspark.sql import functions as F

from lectern.operators import chapters
from lectern.operators.chunks import packed_strings


def test_search_and_scan_agree(spark):
    made = random.Random(7)
    texts = ["".join(made.choice("ab   \n\n\n.é") for _ in range(made.randrange(60))) for _ in range(300)] + ["", " ", "   ", "a" * 30, " " * 30, "\U0001f600 a " * 9]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for mark in (" ", "\n"):
        for most in (1, 2, 7):
            scan = F.filter(packed_strings(F.split("t", mark, -1), most, mark), lambda q: q != "")
            got = rows.select("t", chapters._gathered(F.col("t"), most, mark), scan).collect()
            assert [tuple(r) for r in got if r[1] != r[2]] == []


def test_cuts_of_many_words_are_fast(spark):
    """Each word was a step that copied up to 512 codes."""
    rows = spark.range(40, numPartitions=4).select(F.repeat(F.lit("a "), 400_000).alias("t"))
    begun = time.monotonic()
    assert rows.select(F.sum(F.size(chapters.cut(F.col("t"), 40_000)))).first()[0] == 40 * 20
    assert time.monotonic() - begun < 10
