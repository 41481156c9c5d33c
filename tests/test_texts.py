import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import rules, speech, spoken
from lectern.operators import chapters, chunks


def of(spark, text, made):
    return spark.createDataFrame([(text,)], "t string").select(made(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "part"),
    [
        ("<p>Hello &amp; welcome</p>", "Hello & welcome"),
        ("This is a claim[12] worth noting.", "This is a claim worth noting."),
        ("This is an exam-\nple of a split word.", "example"),
        ("I have 42 apples.", "forty-two"),
        ("It costs $19.", "nineteen dollars"),
        ("This is his 3rd attempt.", "third"),
        ("It happened in 1999.", "nineteen ninety-nine"),
        ("Dr. Smith met Mr. Jones, e.g. at noon.", "Doctor Smith met Mister Jones, for example at noon."),
        ("She said “hello” — then left.", '"hello" — then'),
        ("He said, “She told me ‘no’ yesterday.”", "'no'"),
        ("Intro\n| a | b |\n|---|---|\nOutro", "Intro\n[table content skipped]\nOutro"),
        ("x[1].", "x[one]."),
        ("a paragraph\n\n– a dash", "a paragraph — a dash"),
        ("1,234 men", "one,two hundred and thirty-four men"),
        ("the 42. of", "the 42. of"),
        ("I said no.", "I said number"),
        ("$19.50", "nineteen point five dollars"),
        ("2th", "second"),
    ],
)
def test_rules(spark, text, part):
    assert part in of(spark, text, rules.cleaned)


def test_white_space(spark):
    v = of(spark, " \x1cParagraph one.\n\n\n\n\nParagraph two.    With  spaces. \n", rules.cleaned)
    assert v == "Paragraph one.\n\nParagraph two. With spaces."


def test_rule_subsets_and_nulls(spark):
    assert of(spark, "<b>Hi</b>   there", lambda t: rules.cleaned(t, [rules.strip_markup, rules.tidy_white_space])) == "Hi there"
    assert of(spark, "<b>x", lambda t: rules.cleaned(t, [])) == "<b>x"
    assert of(spark, None, rules.cleaned) is None
    assert of(spark, "", rules.cleaned) == ""


def test_clean_text_stays(spark):
    clean = "A plain sentence. And another one, with a clause."
    assert of(spark, clean, rules.cleaned) == clean


def test_entities_against_the_library(spark):
    import html
    import random

    rng = random.Random(3)
    some = ["&amp;", "&AMP", "&lt", "&gt;", "&notit;", "&notin;", "&eacute", "&Eacute;x", "&#233;", "&#xE9", "&#X1F600;", "&#0;", "&#128;", "&#x81;", "&#13;", "&#11;", "&#55296;", "&#1114112;", "&#99999999999999999999;", "&#xFFFE;", "&#x00000000041;", "&", "&&amp;", "& x", "&unknown;", "&copycat", "&#;", "&#x;", "&ngE;", "&acE;"]
    texts = ["".join(rng.choice(some) + rng.choice(["", " ", "x", ";", "<", "é"]) for _ in range(rng.randint(1, 12))) for _ in range(300)] + some
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", rules._unescape(F.col("t")).alias("v")).collect()
    assert [(r.t, r.v) for r in got] == [(t, html.unescape(t)) for t in texts]


def test_foreign(spark):
    assert of(spark, "It is 早稲田大学 there, né.", rules.foreign_phrases) == ["早稲田大学"]


@pytest.mark.parametrize(
    ("digits", "said"),
    [
        ("0", "zero"),
        ("123", "one hundred and twenty-three"),
        ("1234", "one thousand, two hundred and thirty-four"),
        ("1001", "one thousand and one"),
        ("1000000", "one million"),
        ("1002005", "one million, two thousand and five"),
        ("1000000000000000000", "one quintillion"),
        ("2000000000000000000000000000000000000005", "two duodecillion and five"),
        ("000000000000000000000000000000000000000000000000000000000000000000000000000012", "twelve"),
        ("9" * 70, "9" * 70),
    ],
)
def test_cardinals(spark, digits, said):
    assert of(spark, digits, spoken.cardinal) == said


@pytest.mark.parametrize(("digits", "said"), [("21", "twenty-first"), ("100", "one hundredth"), ("12", "twelfth"), ("30", "thirtieth"), ("1002", "one thousand and second")])
def test_ordinals(spark, digits, said):
    assert of(spark, digits, spoken.ordinal) == said


@pytest.mark.parametrize(("digits", "said"), [("1999", "nineteen ninety-nine"), ("1905", "nineteen oh-five"), ("2000", "two thousand"), ("2024", "twenty twenty-four"), ("1500", "fifteen hundred"), ("1007", "one thousand and seven")])
def test_years(spark, digits, said):
    assert of(spark, digits, spoken.year) == said


def test_numbers_in_one_pass_as_in_five(spark):
    import random

    rng = random.Random(2)
    bits = ["5", "$10", "£ 3", "1999", "2150", "3rd", "1.5", "12,345", ".", ",", " ", "x", "_", "th", "€", "$", "0", "1005", "42.", "$1.50", "7ST", "٣"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    five = lambda t: spoken.speak_plain(spoken.speak_years(spoken.speak_ordinals(spoken.speak_decimals(spoken.speak_currency(t)))))
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", spoken.speak_numbers(F.col("t")).alias("one"), five(F.col("t")).alias("five")).collect()
    assert [(r.t, r.one) for r in got] == [(r.t, r.five) for r in got]


def chunk_rows(spark, text, most):
    return chunks.chunked(spark.createDataFrame([(1, text)], "c int, text string"), most=most).orderBy("chunk_index").collect()


def test_chunk_words(spark):
    got = [r.text for r in chunk_rows(spark, "one two three four five six seven eight nine ten", 10)]
    assert all(len(t) <= 10 for t in got)
    assert " ".join(got) == "one two three four five six seven eight nine ten"


def test_chunk_clauses(spark):
    text = "first clause here, second clause there, third clause; fourth clause that is long enough, end"
    got = chunk_rows(spark, text, 40)
    assert all(len(r.text) <= 40 for r in got)
    assert re.findall(r"\w+", " ".join(r.text for r in got)) == re.findall(r"\w+", text)
    assert [r.chunk_index for r in got] == list(range(len(got)))


def test_chunk_lineage_and_empty(spark):
    got = chunk_rows(spark, "One a. Two b.\n\n  \n\nThree c.\n\nFour d.", 14)
    assert [(r.text, r.paragraph_start, r.paragraph_end) for r in got] == [("One a. Two b.", 0, 0), ("Three c.", 1, 1), ("Four d.", 2, 2)]
    assert chunk_rows(spark, "", 14) == []
    assert [r.text for r in chunk_rows(spark, "x" * 30, 14)] == ["x" * 30]


def brute_chunks(text, most):
    """The packing rule in plain Python, for texts of short sentences."""
    out, at = [], ""
    for p in text.split("\n\n"):
        for s in re.split(r"(?<=[.!?])\s+", p.strip()):
            if at and len(at) + 1 + len(s) <= most:
                at += " " + s
            else:
                out += [at] if at else []
                at = s
    return out + ([at] if at else [])


def test_chunks_against_brute_force(spark):
    text = "\n\n".join(" ".join(f"S{k} {'w' * (1 + k * j % 17)} e." for j in range(1, 9)) for k in range(12))
    assert [r.text for r in chunk_rows(spark, text, 60)] == brute_chunks(text, 60)


def test_segments_and_pauses(spark):
    text = "First sentence. Second, with a clause. Third — with a dash."
    got = of(spark, text, speech.plan)
    assert [x["segment"] for x in got] == ["First sentence.", "Second,", "with a clause.", "Third —", "with a dash."]
    assert [x["pause"] for x in got] == [0.4, 0.18, 0.4, 0.18, 0.0]
    assert of(spark, "] ... !!", speech.plan) == []
    for segment, seconds in (("Done.", 0.4), ("wait,", 0.18), ("wait —", 0.18), ("none", 0.0)):
        assert of(spark, segment, speech.pause) == seconds


def test_voice_and_key(spark):
    assert tuple(of(spark, "af_heart", speech.voice)) == ("af_heart", "Heart", "en-us", "female")
    assert tuple(of(spark, "plain", speech.voice))[2:] == (None, None)
    assert tuple(of(spark, "afx_heart", speech.voice))[1:] == ("Heart", "en-us", "female")
    assert tuple(of(spark, "xm_o'neil-two_3d", speech.voice))[1:] == ("O'Neil-Two 3D", None, "male")
    assert tuple(of(spark, "", speech.voice)) == ("", "", None, None)
    key = of(spark, "af_heart", lambda v: speech.preview_key(v, F.lit("Hi"), F.lit(1.0)))
    import hashlib

    assert key == hashlib.sha256(b"af_heart|Hi|1.0").hexdigest()[:32]


def greedy(units, most, separator):
    """Units gathered up to a limit, one after the other."""
    out = []
    for u in units:
        if out and out[-1] and len(out[-1]) + len(separator) + len(u) > most:
            out.append(u)
        else:
            out[-1:] = [out[-1] + separator + u if out and out[-1] else u]
    return out


def test_gathering_against_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(chunks, "BLOCK", 4)
    rng = random.Random(4)
    lists = [["x" * rng.choice([0, 1, 2, 3, 5, 9]) for _ in range(rng.randrange(1, 30))] for _ in range(80)] + [["", ""], ["", "abc", ""], ["a" * 20]]
    df = spark.createDataFrame(list(enumerate(lists)), "id long, units array<string>")
    for most, separator in ((6, " "), (9, "\n\n"), (1, "-")):
        got = {r.id: r.g for r in df.select("id", chunks.packed_strings(F.col("units"), most, separator).alias("g")).collect()}
        assert got == {k: greedy(u, most, separator) for k, u in enumerate(lists)}
    assert spark.createDataFrame([([],)], "u array<string>").select(chunks.packed_strings(F.col("u"), 5)).first()[0] == []


def test_pieces_of_oversized_texts(spark):
    """The finer separators and the limit itself, against recursion."""
    def cut(text, most, marks=("\n\n", "\n", " ")):
        if len(text) <= most:
            return [text] if text.strip() else []
        mark = next((m for m in marks if m in text), None)
        if mark is None:
            return [text[k : k + most] for k in range(0, len(text), most)]
        return [p for g in greedy(text.split(mark), most, mark) if g for p in cut(g, most)]

    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "bb", " ", " ", "\n", "\n\n", "cccc"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for most in (5, 11):
        got = {r.id: r.p for r in df.select("id", chapters.cut(F.col("text"), most).alias("p")).collect()}
        assert got == {k: cut(t, most) for k, t in enumerate(texts)}


def test_long_texts_are_packed_in_time(spark):
    import time

    n = 60_000
    df = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("Sentence "), i.cast("string"), F.lit(" is here."))), " ").alias("text"))
    begun = time.monotonic()
    got = chunks.chunked(df).agg(F.count("*"), F.max(F.length("text"))).first()
    assert got[0] > n // 20 and got[1] <= 400 and time.monotonic() - begun < 60
