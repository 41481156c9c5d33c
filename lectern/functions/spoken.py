"""Numbers in words, as column expressions.

Numbers are read in groups of three digits, up to ``LONGEST`` digits; longer ones
stay as they are. Sub-rules apply in order: currency, decimals, ordinals, years,
plain numbers; their results hold no digits, so none applies twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import patterns as P
from lectern.functions.binding import let

UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
#: Names of the groups of three digits, the last one first.
SCALES = ["", *"thousand million billion trillion quadrillion quintillion sextillion septillion octillion nonillion decillion undecillion duodecillion tredecillion quattuordecillion quindecillion sexdecillion septendecillion octodecillion novemdecillion vigintillion".split()]
#: Ordinals that are not made by "th" or "ieth".
IRREGULAR = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
CURRENCIES = {"$": "dollars", "£": "pounds", "€": "euros"}
LONGEST = 3 * len(SCALES)

#: 0 to 99.
SMALL = UNITS + [t + (f"-{u}" if k else "") for t in TENS for k, u in enumerate(["", *UNITS[1:10]])]


def replace_each(text: Column, pattern: str, to: Callable[[Column], Column]) -> Column:
    """Every match replaced by what ``to`` makes of it."""

    def joined(t: Column) -> Column:
        made = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), to)
        parts = F.zip_with(F.split(t, pattern, -1), F.concat(made, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
        return F.when(t.rlike(pattern), F.array_join(parts, "")).otherwise(t)

    return let(text, joined)


def _small(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in SMALL]), n + 1)


def _group(n: Column) -> Column:
    """Words of 1 to 999."""
    hundreds, rest = F.floor(n / 100).cast("int"), n % 100
    return F.when(n < 100, _small(n)).otherwise(F.concat(_small(hundreds), F.lit(" hundred"), F.when(rest > 0, F.concat(F.lit(" and "), _small(rest))).otherwise("")))


def cardinal(digits: Column) -> Column:
    """Words of a string of digits."""
    return let(F.regexp_replace(digits, "^0+(?=[0-9])", ""), lambda short: let(digits, lambda d: _cardinal(short, d)))


def _cardinal(short: Column, digits: Column) -> Column:
    count = F.least(F.ceil(F.length(short) / 3), F.lit(len(SCALES))).cast("int")
    padded = F.lpad(short, count * 3, F.lit("0"))
    scales = F.array(*[F.lit(s) for s in SCALES])
    groups = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.struct(F.substring(padded, i * 3 - 2, F.lit(3)).cast("int").alias("n"), F.element_at(scales, count - i + 1).alias("scale")))
    told = F.filter(groups, lambda g: g["n"] > 0)

    def add(said: Column, g: Column) -> Column:
        # The last group is tied on by "and" if it is under a hundred, all others by a comma.
        tie = F.when(said == "", "").when((g["scale"] == "") & (g["n"] < 100), " and ").otherwise(", ")
        return F.concat(said, tie, _group(g["n"]), F.when(g["scale"] == "", "").otherwise(F.concat(F.lit(" "), g["scale"])))

    words = let(F.aggregate(told, F.lit(""), add), lambda w: F.when(w == "", UNITS[0]).otherwise(w))
    return F.when(F.length(short) > LONGEST, digits).otherwise(words)


def ordinal(digits: Column) -> Column:
    return let(cardinal(digits), _as_ordinal)


def _as_ordinal(words: Column) -> Column:
    head, last = F.regexp_extract(words, r"^(.*?)([a-z]+)$", 1), F.regexp_extract(words, r"([a-z]+)$", 1)
    irregular = F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])
    regular = F.when(last.endswith("y"), F.concat(F.regexp_replace(last, "y$", ""), F.lit("ieth"))).otherwise(F.concat(last, F.lit("th")))
    return F.concat(head, F.coalesce(F.try_element_at(irregular, last), regular))


def year(digits: Column) -> Column:
    """Words of a four-digit year: in two halves, unless it is in the first ten of a thousand."""
    high, low = F.substring(digits, F.lit(1), F.lit(2)).cast("int"), F.substring(digits, F.lit(3), F.lit(2)).cast("int")
    tail = F.when(low == 0, "hundred").when(low < 10, F.concat(F.lit("oh-"), _small(low))).otherwise(_small(low))
    return F.when((high % 10 == 0) & (low < 10), cardinal(digits)).otherwise(F.concat(_small(high), F.lit(" "), tail))


def spelled(digits: Column) -> Column:
    """One word for each digit."""
    return F.array_join(F.transform(F.split(digits, ""), lambda d: _small(d.cast("int"))), " ")


def amount(match: Column) -> Column:
    unit = F.element_at(F.create_map(*[F.lit(x) for kv in CURRENCIES.items() for x in kv]), F.substring(match, 1, 1))
    return F.concat(let(F.regexp_replace(match, r"[^0-9.]", ""), _decimal), F.lit(" "), unit)


def _decimal(number: Column) -> Column:
    """Words of a number with or without a fraction, trailing zeros of which are not read but for the first."""
    whole, part = F.substring_index(number, ".", 1), F.regexp_replace(F.regexp_extract(number, r"\.([0-9]+)$", 1), r"(?<=[0-9])0+$", "")
    return F.concat(cardinal(whole), F.when(number.contains("."), F.concat(F.lit(" point "), spelled(part))).otherwise(""))


def speak_currency(text: Column) -> Column:
    return replace_each(text, P.CURRENCY, amount)


def decimal(match: Column) -> Column:
    return F.concat(cardinal(F.substring_index(match, ".", 1)), F.lit(" point "), spelled(F.substring_index(match, ".", -1)))


def speak_decimals(text: Column) -> Column:
    return replace_each(text, P.DECIMAL, decimal)


def place(match: Column) -> Column:
    return ordinal(F.regexp_replace(match, "[^0-9]", ""))


def speak_ordinals(text: Column) -> Column:
    return replace_each(text, P.ORDINAL, place)


def speak_years(text: Column) -> Column:
    return replace_each(text, P.YEAR, year)


def speak_plain(text: Column) -> Column:
    return replace_each(text, P.PLAIN, cardinal)


def speak_numbers(text: Column) -> Column:
    """All sub-rules in one pass, with the result of one after another; texts without digits skip it."""
    kinds = lambda m: F.when(m.rlike("^[$£€]"), amount(m)).when(m.contains("."), decimal(m)).when(m.rlike("[a-zA-Z]$"), place(m)).when(m.rlike("^(?:1[0-9]{3}|20[0-9]{2})$"), year(m)).otherwise(cardinal(m))
    return let(text, lambda t: F.when(t.rlike("[0-9]"), replace_each(t, P.NUMBER, lambda m: let(m, kinds))).otherwise(t))
