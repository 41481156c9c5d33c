"""Patterns that look first at where a match may begin find what the plain ones find."""

import time

from pyspark.sql import functions as F

from lectern.functions import patterns as P
from lectern.functions import rules

PLAIN_FOOTNOTE = rf"""(?<=[a-zA-Z.,!?"']){P.SP}*(?:\[\p{{Nd}}{{1,3}}\]|\(\p{{Nd}}{{1,3}}\)|[¹²³⁰-⁹]+)(?={P.SP}|\z|\n\z)"""
PLAIN_DASH = rf"{P.SP}*[–—]{P.SP}*"
PLAIN_NUMBER = rf"{P.CURRENCY}|(?:{P.DECIMAL}|{P.ORDINAL}|{P.YEAR}|{P.PLAIN})(?!{P.CURRENCY})"
TEXTS = [
    "a[1] b  (22)\nc¹² d [4444] .[5] é(6) x[7]y z[8]\n", "–", "a – — b\x1d— c  ", "  —  ", "$5 £ 1,000.50 €x 3rd 42. 1999 2.50 x7 7x 12$3 1999$5", "٣ a[٣] ", "", "  \xa0 ",
    "e-\nn-\nd -\nx-\n", "St. Dr.x nono. no. Mr.Mr. e.g. No.", "a \t\n\n\n\n  b\t\tc \n", "‘’“”",
]


def test_patterns_with_a_first_look(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for fast, plain in ((P.FOOTNOTE, PLAIN_FOOTNOTE), (P.DASH, PLAIN_DASH), (P.NUMBER, PLAIN_NUMBER)):
        got = rows.select(F.regexp_replace("t", fast, "~"), F.regexp_replace("t", plain, "~")).collect()
        assert all(a == b for a, b in got)


def test_rules_on_texts_with_and_without_their_marks(spark):
    rows = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string")
    made = lambda rule: [r[0] for r in rows.select(rule(F.col("t"))).collect()]
    assert made(rules.join_split_words)[8] == "en-\nd -\nx-\n"
    assert made(rules.expand_abbreviations)[9] == "Saint Dr.x nono. number Mr.Mister for example Number"
    assert made(rules.tidy_white_space)[10] == "a\n\n b c"
    assert made(rules.plain_quotes_and_dashes)[11] == "''\"\""
    assert all(made(rule)[-1] is None for rule in rules.RULES)


def test_inner_white_space_takes_linear_time(spark):
    """Runs of white space were looked through from each of their places, for those at the end."""
    rows = spark.createDataFrame([("a" + "\xa0" * 300_000 + "b ",)], "t string")
    begun = time.monotonic()
    assert rows.select(F.length(rules.tidy_white_space(F.col("t")))).first()[0] == 300_002
    assert time.monotonic() - begun < 30
