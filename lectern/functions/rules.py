"""Cleaning rules, each a function from a text column to a text column, applied in order."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import patterns as P
from lectern.functions.binding import let
from lectern.functions.spoken import replace_each, speak_numbers

Rule = Callable[[Column], Column]

TABLE_NOTE = "[table content skipped]"

#: Abbreviations and what is read instead.
ABBREVIATIONS = {
    "Mr.": "Mister",
    "Mrs.": "Missus",
    "Ms.": "Miz",
    "Dr.": "Doctor",
    "Prof.": "Professor",
    "St.": "Saint",
    "Jr.": "Junior",
    "Sr.": "Senior",
    "vs.": "versus",
    "etc.": "et cetera",
    "e.g.": "for example",
    "i.e.": "that is",
    "approx.": "approximately",
    "no.": "number",
    "No.": "Number",
}


def _unescape(text: Column) -> Column:
    """Entities resolved as browsers do: named ones (the old ones also without their semicolon), decimal and hexadecimal ones."""
    return let(text, lambda t: F.when(t.contains("&"), replace_each(t, P.ENTITY, lambda m: let(F.substring(m, F.lit(2), F.length(m)), _entity))).otherwise(t))


#: Names that are known without a semicolon, the longest first.
_OLD = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
#: Numbers that stand for another character: those of the Windows code page, the null and the carriage return.
_OTHER = {0: "\ufffd", 13: "\r", **{k: bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(0x80, 0xA0)}}


def _entity(name: Column) -> Column:
    """What an entity stands for, given without its ampersand; unknown ones stay."""
    # Parsed once: the text of the table is a constant.
    named = lambda n: F.try_element_at(F.from_json(F.lit(json.dumps(html5)), "map<string,string>"), n)
    old = F.regexp_extract(name, f"^(?:{'|'.join(_OLD)})", 0)
    by_old = F.when(old != "", F.concat(named(old), F.substring(name, F.length(old) + 1, F.length(name))))
    return F.when(name.startswith("#"), let(_number(name), _character)).otherwise(F.coalesce(named(name), by_old, F.concat(F.lit("&"), name)))


def _number(name: Column) -> Column:
    hexadecimal = F.regexp_extract(name, "^#[xX]0*([0-9a-fA-F]*)", 1)
    decimal = F.regexp_extract(name, "^#0*([0-9]*)", 1)
    most = F.lit(0x110000).cast("long")
    value = lambda digits, base, longest: F.when(F.length(digits) > longest, most).when(digits == "", 0).otherwise(F.conv(digits, base, 10).cast("long"))
    return F.when(name.rlike("^#[xX]"), value(hexadecimal, 16, 6)).otherwise(value(decimal, 10, 7))


def _character(code: Column) -> Column:
    other = F.create_map(*[F.lit(x) for k, v in _OTHER.items() for x in (k, v)])
    none = (code < 32) & ~code.isin(9, 10, 12, 13) | code.between(0x7F, 0x9F) | code.between(0xFDD0, 0xFDEF) | (F.pmod(code, F.lit(0x10000)) >= 0xFFFE)
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(code.isin(*_OTHER), F.try_element_at(other, code.cast("int"))).when(code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "\ufffd").when(none, "").otherwise(plain)


def strip(text: Column) -> Column:
    """Without white space at both ends, all Unicode kinds of it."""
    return F.btrim(text, F.lit(P.SPACES))


def where(text: Column, marks: tuple[str, ...], rule: Rule) -> Column:
    """The rule on texts that hold one of some literals, without which it changes nothing: they are searched by bytes."""
    return let(text, lambda t: F.when(reduce(Column.__or__, [t.contains(m) for m in marks]), rule(t)).otherwise(t))


def drop_tags(text: Column) -> Column:
    return where(text, ("<",), lambda t: F.regexp_replace(t, P.TAG, ""))


def strip_markup(text: Column) -> Column:
    """Tags away, then entities resolved."""
    return _unescape(drop_tags(text))


def drop_footnotes(text: Column) -> Column:
    return F.regexp_replace(text, P.FOOTNOTE, "")


def join_split_words(text: Column) -> Column:
    return where(text, ("-\n",), lambda t: F.regexp_replace(t, P.SPLIT_WORD, "$1$2"))


def plain_quotes_and_dashes(text: Column) -> Column:
    plain = reduce(lambda t, q: F.replace(t, F.lit(q[0]), F.lit(q[1])), ["‘'", "’'", '“"', '”"'], text)
    return where(plain, ("–", "—"), lambda t: F.regexp_replace(t, P.DASH, " — "))


def skip_tables(text: Column) -> Column:
    """Each run of adjacent table lines becomes one note; texts without such lines stay as they are."""

    def noted(t: Column) -> Column:
        lines = F.split(F.regexp_replace(t, rf"(?:{P.LINE_BREAK})\z", ""), P.LINE_BREAK, -1)
        return F.when(t.rlike(P.TABLE_LINE), let(F.transform(lines, lambda x: F.when(x.rlike(P.TABLE_LINE), TABLE_NOTE).otherwise(x)), merged)).otherwise(t)

    def merged(lines: Column) -> Column:
        # Each line beside the one before it; a note after a note goes.
        pairs = F.zip_with(lines, F.slice(F.concat(F.array(F.lit("")), lines), F.lit(1), F.size(lines)), lambda x, before: F.when((x == TABLE_NOTE) & (before == TABLE_NOTE), None).otherwise(x))
        return F.array_join(F.array_compact(pairs), "\n")

    return let(text, noted)


def tidy_white_space(text: Column) -> Column:
    steps = [((" \n", "\t\n"), r"[ \t]+\n", "\n"), (("  ", " \t", "\t\t", "\t "), r"[ \t]{2,}", " "), (("\n\n\n",), r"\n{3,}", "\n\n")]
    return strip(reduce(lambda t, s: where(t, s[0], lambda x: F.regexp_replace(x, s[1], s[2])), steps, text))


def expand_abbreviations(text: Column) -> Column:
    """No expansion contains an abbreviation and none overlap, so one replacement after another is one pass.

    Each pattern begins with its literal, which is searched fast, and looks at what stands before it afterwards.
    """
    known = sorted(ABBREVIATIONS, key=len, reverse=True)
    told = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(rf"\Q{k}\E(?<!{P.W}\Q{k}\E)(?!{P.W})").alias("pattern"), F.lit(ABBREVIATIONS[k]).alias("to")) for k in known])
    # A step for each, in one expression; what a text does not hold is not looked for by pattern.
    return F.aggregate(told, text, lambda t, k: F.when(t.contains(k["key"]), F.regexp_replace(t, k["pattern"], k["to"])).otherwise(t))


def close_up_marks(text: Column) -> Column:
    return F.regexp_replace(text, P.SPACE_BEFORE_MARK, "$1")


def foreign_phrases(text: Column) -> Column:
    """Runs of four or more characters beyond ASCII."""
    return F.regexp_extract_all(text, F.lit(P.FOREIGN), F.lit(0))


RULES: list[Rule] = [strip_markup, drop_footnotes, join_split_words, plain_quotes_and_dashes, skip_tables, tidy_white_space, expand_abbreviations, speak_numbers, close_up_marks]


def cleaned(text: Column, rules: list[Rule] | None = None) -> Column:
    """The text after the rules in order; an empty list changes nothing."""
    return reduce(lambda t, rule: rule(t), RULES if rules is None else rules, text)
