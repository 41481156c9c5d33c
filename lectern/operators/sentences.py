"""Sentence ends learnt from the corpus: abbreviations, collocations, starters and letter case (Kiss and Strunk, 2006).

The statistics are aggregations over all tokens: distinct (token, token before) pairs are
counted first, and everything else is made of those counts. A period ends a sentence
unless the corpus says that the word before it is an abbreviation (it hardly occurs
without its period, measured by log-likelihood and scaled by its length and inner periods),
an initial or a number that goes with the next word. After an abbreviation a sentence may
still end, if the next word is one that begins sentences, or is capitalised though it is
written small inside of them.

``protected`` applies a model to texts: the places that end no sentence are looked up for
all period ends of all distinct texts, and their white space is masked by noncharacters of
the same number, which ``unmasked`` turns back. Tables of a model are sent to all tasks up
to ``SMALL`` rows, else joined by shuffle; a text is met by its hash, by shuffle too where
many have such places.

Edge cases: null and blank texts have no tokens; equal texts are counted each and have
the same ends; a paragraph break always ends a sentence; marks other than periods do too; an
empty table gives an empty model.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.binding import let
from lectern.functions.patterns import SP, SPACES
from lectern.storage import written

#: Thresholds and the share of periods that an abbreviation is expected to have.
ABBREVIATION, COLLOCATION, STARTER, EXPECTED = 0.3, 7.88, 30.0, 0.99
#: Rows of a table that is sent to all tasks.
SMALL = 50_000
#: A possible sentence end: white space after a mark and closing quotes or brackets.
END = rf"(?<=[.!?]|[.!?][\"')\]]|[.!?][\"')\]]{{2}}){SP}+"
#: The same with its mark, which is searched fast: the white space is its second group.
_MARKED_END = rf"([.!?][\"')\]]{{0,2}})({SP}+)"
NUMBER = "##"
_OPEN, _CLOSE = "(\"'[{«“‘", ")\"']}»”’,;:"
_NUMBER = r"^[+$€£-]?[0-9][0-9.,:/-]*%?$"
#: A noncharacter for each kind of white space.
_MASKS = "".join(chr(0xFDD0 + k) for k in range(len(SPACES)))
#: A noncharacter that stands for possible ends.
_CUT = "\ufdee"


def core(token: Column) -> Column:
    """A token without the quotes, brackets and commas around it."""
    return F.rtrim(F.ltrim(token, F.lit(_OPEN)), F.lit(_CLOSE))


def ending(core: Column) -> Column:
    """How a token ends: period, mark, dots (an ellipsis) or word."""
    return F.when(core.endswith(".."), "dots").when(core.endswith("."), "period").when(core.endswith("!") | core.endswith("?"), "mark").otherwise("word")


def kind(core: Column) -> Column:
    """The type of a token: small letters without a final period; all numbers are one."""
    base = F.lower(F.when(core.endswith(".") & ~core.endswith(".."), F.substring(core, F.lit(1), F.length(core) - 1)).otherwise(core))
    return F.when(base.rlike(_NUMBER), F.lit(NUMBER)).otherwise(base)


def letter_case(core: Column) -> Column:
    return F.when(core.rlike(r"^\p{Lu}"), "upper").when(core.rlike(r"^\p{Ll}"), "lower").otherwise("none")


def is_initial(core: Column) -> Column:
    return core.rlike(r"^\p{L}\.$")


@dataclass
class Model:
    """Tables of what the corpus says: types (kind, n_period, n_plain, score, is_abbreviation, starts, upper_mid, upper_seen, lower_seen, lower_start) and collocations (before, kind)."""

    types: DataFrame
    collocations: DataFrame


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n\n", -1)


def parts(text: Column) -> Column:
    """What lies between the possible sentence ends; a text that holds the noncharacter is cut by the pattern itself."""
    cut = lambda t: F.when(t.contains(_CUT), F.split(t, END, -1)).otherwise(F.split(F.regexp_replace(t, _MARKED_END, "$1" + _CUT), _CUT, -1))
    return let(text, cut)


def gaps(text: Column) -> Column:
    """The white space of the possible sentence ends."""
    return F.regexp_extract_all(text, F.lit(_MARKED_END), F.lit(2))


def token_pairs(texts: DataFrame, text_col: str) -> DataFrame:
    """token, before (of the same paragraph, or null), n: how often the corpus has them."""
    tokens = texts.select(F.explode(paragraphs(F.col(text_col))).alias("p")).select(F.array_remove(F.split("p", rf"{SP}+", -1), "").alias("token"))
    # Each token beside the one before it; the last one stands before none.
    pairs = F.arrays_zip("token", F.concat(F.array(F.lit(None).cast("string")), "token").alias("before"))
    rows = tokens.select(F.explode(pairs).alias("p")).filter("p.token IS NOT NULL")
    # What stands before matters only where it may end a sentence.
    end = F.rtrim(F.col("p.before"), F.lit(_CLOSE))
    before = F.when(F.col("p.before").isNull() | end.endswith("."), F.col("p.before")).when(end.endswith("!") | end.endswith("?"), "!").otherwise("-")
    return rows.select("p.token", before.alias("before")).groupBy("token", "before").agg(F.count("*").alias("n"))


def binomial(hits: Column, tries: Column, p: Column) -> Column:
    """Log-likelihood of so many hits, 0 where the probability is one of theirs for sure."""
    part = lambda k, q: F.when(k > 0, k * F.log(q)).otherwise(0.0)
    return part(hits, p) + part(tries - hits, 1 - p)


def abbreviation_score(n_period: Column, n_plain: Column, kind: Column, tokens: Column, periods: Column) -> Column:
    n, p = n_period + n_plain, periods / tokens
    likelihood = -2 * (binomial(n_period, n, p) - binomial(n_period, n, F.lit(EXPECTED)))
    inner = F.length(kind) - F.length(F.replace(kind, F.lit("."), F.lit("")))
    letters = F.length(kind) - inner
    return likelihood * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -n_plain)


def association(both: Column, first: Column, second: Column, tokens: Column) -> Column:
    """Log-likelihood ratio of two words that follow each other so often."""
    alone = binomial(both, first, second / tokens) + binomial(second - both, tokens - first, second / tokens)
    tied = binomial(both, first, F.try_divide(both, first)) + binomial(second - both, tokens - first, F.try_divide(second - both, tokens - first))
    return -2 * (alone - tied)


def trained(texts: DataFrame, text_col: str = "text") -> Model:
    """The model of all texts."""
    # Distinct pairs first, then what they are, then everything by kinds: each step has fewer rows.
    pairs = token_pairs(texts, text_col).select(core(F.col("token")).alias("c"), F.when(F.col("before") != "-", core(F.col("before"))).alias("b"), F.col("before").isNull().alias("first"), "n")
    seen = pairs.select(
        kind(F.col("c")).alias("kind"),
        ending(F.col("c")).alias("own"),
        letter_case(F.col("c")).alias("letters"),
        (F.col("c") != "").alias("counts"),
        kind(F.col("b")).alias("k"),
        F.when(F.col("first"), "none").when(F.col("b").isNull(), "word").otherwise(ending(F.col("b"))).alias("ending"),
        F.coalesce(is_initial(F.col("b")) | (kind(F.col("b")) == NUMBER), F.lit(False)).alias("loose"),
        "n",
    )
    kinds = written(seen.groupBy(*[c for c in seen.columns if c != "n"]).agg(F.sum("n").alias("n")))
    period = F.sum(F.when(F.col("own") == "period", F.col("n")).otherwise(0))
    counts = kinds.filter("counts").groupBy("kind").agg(period.alias("n_period"), (F.sum("n") - period).alias("n_plain"))
    total = counts.agg(F.sum(F.col("n_period") + F.col("n_plain")).alias("t"), F.sum("n_period").alias("p")).first()
    n_tokens, n_periods = F.lit(float(total.t or 1)), F.lit(float(total.p or 1))
    score = F.when((F.col("n_period") > 0) & F.col("kind").rlike(r"\p{L}"), abbreviation_score(F.col("n_period"), F.col("n_plain"), F.col("kind"), n_tokens, n_periods)).otherwise(0.0)
    scored = written(counts.withColumn("score", score).withColumn("is_abbreviation", F.col("score") >= ABBREVIATION))

    # What stands before a token, by type: it decides whether the token begins a sentence.
    told = kinds.filter("kind <> ''").groupBy("kind", "letters", "k", "ending", "loose").agg(F.sum("n").alias("n"))
    abbreviations = small(scored.filter("is_abbreviation").select(F.col("kind").alias("k"), F.lit(True).alias("short")))
    told = written(told.join(abbreviations, "k", "left").withColumn("short", F.coalesce("short", F.lit(False))))
    by_period = F.col("ending") == "period"
    ends = by_period & ~F.col("short")
    place = F.when((F.col("ending") == "dots") | (by_period & (F.col("short") | F.col("loose"))), "unknown").when(F.col("ending").isin("none", "mark") | ends, "start").otherwise("mid")
    seen = lambda letters, at=None: F.coalesce(F.bool_or((F.col("letters") == letters) & (F.lit(True) if at is None else F.col("at") == at)), F.lit(False))
    case = told.withColumn("at", place).groupBy("kind").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(ends & ~F.col("loose"), F.col("n")).otherwise(0)).alias("first"),
        seen("upper", "mid").alias("upper_mid"),
        seen("upper").alias("upper_seen"),
        seen("lower").alias("lower_seen"),
        seen("lower", "start").alias("lower_start"),
    )
    breaks = F.lit(float(told.filter(ends & ~F.col("loose")).agg(F.sum("n")).first()[0] or 0))
    often = (F.col("first") > 0) & (F.try_divide(n_tokens, breaks) > F.try_divide("n", "first"))
    starts = F.when(often & F.col("kind").rlike(r"^\p{L}"), association(F.col("first").cast("double"), breaks, F.col("n").cast("double"), n_tokens) >= STARTER).otherwise(False)
    types = scored.join(case.withColumn("starts", starts).drop("n", "first"), "kind", "left")

    # Initials and numbers with their period, and the words that go with them.
    met = told.filter(by_period & F.col("loose")).groupBy("k", "kind").agg(F.sum("n").alias("both")).filter("both > 1 AND kind RLIKE '^\\\\p{L}'")
    size = lambda c, n: scored.select(F.col("kind").alias(c), (F.col("n_period") + F.col("n_plain")).cast("double").alias(n))
    met = met.join(size("k", "a"), "k").join(size("kind", "b"), "kind")
    tied = (n_tokens / F.col("a") > F.col("b") / F.col("both")) & (F.col("both") <= F.least("a", "b")) & (association(F.col("both").cast("double"), F.col("a"), F.col("b"), n_tokens) >= COLLOCATION)
    return Model(written(types.select("kind", "n_period", "n_plain", "score", "is_abbreviation", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("starts", "upper_mid", "upper_seen", "lower_seen", "lower_start")])), written(met.filter(tied).select(F.col("k").alias("before"), "kind")))


def small(table: DataFrame) -> DataFrame:
    """The table, to be sent to all tasks if it has few rows."""
    return F.broadcast(table) if table.limit(SMALL + 1).count() <= SMALL else table


def ends(texts: DataFrame, text_col: str) -> DataFrame:
    """key, at, before, next: the words around the white space of every possible end (number ``at`` of its text) after a period in a paragraph; equal texts have equal keys."""
    text = F.col("_text")
    rows = texts.select(F.col(text_col).alias("_text")).filter(text.rlike(rf"\.[\"')\]]{{0,2}}{SP}")).select(F.md5(text).alias("key"), "_text")
    # The last word of a part is what its last white space leaves.
    around = let(
        parts(text),
        lambda ps: F.transform(
            gaps(text),
            lambda g, i: F.struct(i.alias("at"), F.regexp_replace(F.get(ps, i), rf"(?s)\A.*{SP}", "").alias("before"), F.regexp_extract(F.get(ps, i + 1), rf"\A{_NO_SPACE}+", 0).alias("next"), g.contains("\n\n").alias("apart")),
        ),
    )
    found = rows.select("key", F.explode(around).alias("e")).select("key", "e.*")
    return found.filter(~F.col("apart") & (F.col("next") != "")).select("key", "at", core(F.col("before")).alias("before"), core(F.col("next")).alias("next")).filter(ending(F.col("before")) == "period")


_NO_SPACE = r"(?U:[^\s\x1c-\x1f])"


def inside(found: DataFrame, model: Model) -> DataFrame:
    """Those of the possible ends (key, at, before, next) that end no sentence."""
    rows = found.select("key", "at", "next", kind(F.col("before")).alias("k"), kind(F.col("next")).alias("n"), is_initial(F.col("before")).alias("initial"), letter_case(F.col("next")).alias("letters"))
    abbreviations = small(model.types.filter("is_abbreviation").select(F.col("kind").alias("k"), F.lit(True).alias("short")))
    rows = rows.join(abbreviations, "k", "left").withColumn("number", F.col("k") == NUMBER)
    # All other ends are settled: periods after plain words end sentences.
    rows = rows.filter(F.col("short") | F.col("initial") | F.col("number"))
    flags = model.types.select(F.col("kind").alias("n"), "starts", "upper_mid", "upper_seen", "lower_seen", "lower_start")
    rows = rows.join(small(flags), "n", "left").join(small(model.collocations.select(F.col("before").alias("k"), F.col("kind").alias("n"), F.lit(True).alias("tied"))), ["k", "n"], "left")
    no = F.lit(False)
    seen = {c: F.coalesce(c, no) for c in ("starts", "upper_mid", "upper_seen", "lower_seen", "lower_start", "tied", "short")}
    upper, lower = F.col("letters") == "upper", F.col("letters") == "lower"
    ends_before = upper & seen["lower_seen"] & ~seen["upper_mid"]
    goes_on = F.col("next").rlike("^[;:,.!?]") | (lower & (seen["upper_seen"] | ~seen["lower_start"]))
    after_short = ~ends_before & ~(upper & seen["starts"])
    after_loose = goes_on | (~ends_before & F.col("initial") & upper & ~seen["lower_seen"])
    return rows.filter(seen["tied"] | F.when(seen["short"] & ~F.col("initial"), after_short).otherwise(after_loose)).select("key", "at")


def protected(texts: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows and columns, with the white space masked where no sentence ends."""
    found = written(inside(ends(texts, text_col), model))
    marks = small(written(found.groupBy("key").agg(F.array_sort(F.collect_set("at")).alias("_inside"))).withColumnRenamed("key", "_key"))
    # Rows travel as structs, so that no column name clashes.
    text = F.col("_row")[text_col]
    flags = F.flatten(F.transform("_inside", lambda x, j: F.concat(F.array_repeat(F.lit(False), x - F.coalesce(F.get("_inside", j - 1), F.lit(-1)) - 1), F.array(F.lit(True)))))
    told_gaps = lambda fs: F.transform(gaps(text), lambda g, i: F.when(F.coalesce(F.get(fs, i), F.lit(False)), F.translate(g, SPACES, _MASKS)).otherwise(g))
    masked = lambda fs: F.array_join(F.zip_with(parts(text), told_gaps(fs), lambda p, g: F.concat(p, F.coalesce(g, F.lit("")))), "")
    told = texts.select(F.struct(*texts.columns).alias("_row")).join(marks, F.md5(text) == F.col("_key"), "left")
    return told.select(*[(F.when(F.col("_inside").isNotNull(), let(flags, masked)).otherwise(text) if c == text_col else F.col("_row")[c]).alias(c) for c in texts.columns])


def unmasked(text: Column) -> Column:
    return F.when(text.rlike(f"[{_MASKS[0]}-{_MASKS[-1]}]"), F.translate(text, _MASKS, SPACES)).otherwise(text)
