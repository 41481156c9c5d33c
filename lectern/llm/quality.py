"""Operator 4: line-first quality rules, with built-in functions only.

Each line is judged by shares of its own words and characters, so that a rule says
the same of a line of any length: a punctuation rule (too many symbols or shouted
words, or a line that ends without a mark and has hardly one inside, unless the next
line continues it, as in wrapped text), a navigation rule (separator-ridden or
menu-like lines), a boilerplate rule (lines that are legal and cookie notices by a good
part, repeats of an earlier line) and a repetition rule (a few words again and again).
Failing lines go; a document that loses more than half of its word characters is
rejected, as is one that fails the base rules.

Edge cases: a null text counts as empty, has no words and fails the base rules;
an empty table gives an empty result; repeated rows are judged each on its own, and a
null id is a valid row; of equal lines of a document the first stays; very long texts
are processed whole (sorting, never pairwise); of scripts with marks of their own Chinese, Japanese,
Devanagari, Arabic, Urdu, Ethiopic and Armenian ones end sentences, and lines of other
scripts count as lines without marks; columns of the input other than id and
text are not read, and whatever they are called they are carried by the stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import GAP, WORD, table, words

#: Words of a window whose repeats count.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A document may lose this share of its word characters.
MAX_LOST_PERCENT = 50
#: A line needs one mark in so many words, if it ends without one.
WORDS_A_MARK = 30
#: Characters of a line that may be a wrapped one because its neighbours are about as long.
WRAPPED = 40
#: A line is a notice if the phrases of notices are one part in so many of it.
NOTICE = 6
#: Words of a line that must not be of a few kinds; more do not count, for new words get rarer along a line.
VARIED = 50

_SYMBOL = r"[#*$%&|<>]"
#: What may follow the mark that ends a sentence, and the marks.
_CLOSERS = "\"'\u201d\u2019\u00bb)] \t\x0b\x0c\r"
_MARKS = (".", "!", "?", ":", ";", "\u2026", "\u3002", "\uff01", "\uff1f", "\u0964", "\u0965", "\u061f", "\u06d4", "\u1362", "\u0589")
_MARK = "[.!?:;\u2026\u3002\uff01\uff1f\u0964\u0965\u061f\u06d4\u1362\u0589]"
_LOWER = r"^[\x20\t]*\p{Ll}"
_SEPARATOR = r"[|\x{203a}\x{bb}\x{2022}\x{b7}]"
_MENU = r"(?i)^[\x20\x09-\x0D]*(home|menu|log ?in|log ?out|sign ?(in|up)|register|search|next|previous|back to top|share|tweet|subscribe|read more|click here|contact us|about us|sitemap)[\x20\x09-\x0D]*[.!>\x{bb}]*[\x20\x09-\x0D]*$"
_LEGAL = ("all rights reserved", "use cookies", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "lorem ipsum", "licensed under", "released under", "copyright (c)", "\u00a9")


def repeated_words(windows: Column, ordered: Column) -> Column:
    """Words inside windows that occur twice or more, from hashes in order and sorted (hash, place) pairs."""
    twice = F.filter(ordered, lambda e, i: (e["x"] == F.get(ordered, i - 1)["x"]) | (e["x"] == F.get(ordered, i + 1)["x"]))
    places = F.array_sort(F.transform(twice, lambda e: e["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(places, start, lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end")), lambda a: a["n"])
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered).otherwise(F.lit(0).cast("long"))


def with_windows(df: DataFrame) -> DataFrame:
    """Adds ``_words``, ``_windows`` (hash of each window) and ``_ordered`` (sorted hash and place, where hashes repeat)."""
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    parts = [lambda i, k=k: F.get("_hashes", i + k) for k in range(WINDOW)]
    df = df.withColumn("_windows", F.when(F.size("_hashes") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_hashes") - WINDOW), lambda i: F.xxhash64(*[p(i) for p in parts]))).otherwise(F.array().cast("array<long>")))
    return df.withColumn("_ordered", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))


def line_fails(line: Column, n: Column, before: Column, after: Column) -> Column:
    """Whether a line of ``n`` words between two others fails the punctuation, navigation, boilerplate or repetition rule; blank lines do not."""
    shouts = F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("!")))
    ends = F.right(F.rtrim(line, F.lit(_CLOSERS)), F.lit(1)).isin(*_MARKS)
    bare = (n >= 3) & ~ends & (F.regexp_count(line, F.lit(_MARK)) * WORDS_A_MARK < n)
    alike = (F.length(line) >= WRAPPED) & (F.length(line) * 3 >= F.greatest(F.coalesce(F.length(before), F.lit(0)), F.length(after)) * 2)
    goes_on = after.rlike(_LOWER) | (alike & after.rlike(WORD))
    punctuation = (F.regexp_count(line, F.lit(_SYMBOL)) * 4 >= n) | (shouts * 4 >= n) | (bare & ~F.coalesce(goes_on, F.lit(False)))
    separators = F.regexp_count(line, F.lit(_SEPARATOR))
    navigation = ((separators >= 3) & (separators * 4 >= n)) | ((n <= 4) & line.rlike(_MENU))
    low = F.lower(line)
    told = reduce(lambda rest, phrase: rest + F.when(low.contains(phrase), len(phrase)).otherwise(0), _LEGAL, F.lit(0))
    repeats = (n >= 8) & (F.size(F.array_distinct(F.split(line, " "))) * 5 <= F.least(n, F.lit(VARIED)))
    return (n > 0) & (punctuation | navigation | repeats | ((told > 0) & (told * NOTICE >= F.length(line))))


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, GAP, "")).cast("long")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """The counts, ``base_failed``, ``kept`` and the text left by the line rules, a row per input row; ``whole`` carries the input row as ``row``."""
    row = [F.struct(*docs.columns).alias("row")] if whole else []
    df = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"), *row)
    df = df.withColumn("_words", words(F.col("_text"))).withColumn("_lines", F.split("_text", "\n", -1))
    df = with_windows(df)
    df = df.withColumn("_full", F.filter("_lines", lambda x: x.rlike(WORD)))
    counted = F.transform("_lines", lambda x, i: F.struct(x.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("n"), F.get("_lines", i - 1).alias("before"), F.get("_lines", i + 1).alias("after")))
    passed = F.transform(F.filter(counted, lambda x: (x["n"] > 0) & ~line_fails(x["line"], x["n"], x["before"], x["after"])), lambda x: x["line"])
    df = df.withColumn("_left", F.array_distinct(passed))
    base = df.select(
        F.col("_id").alias(id_col),
        *(["row"] if whole else []),
        F.size("_words").cast("long").alias("n_words"),
        word_chars(F.col("_text")).alias("word_chars"),
        F.regexp_count("_text", F.lit(_SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_windows"), F.col("_ordered")).alias("n_repeat_words"),
        F.array_join("_left", "\n").alias("clean_text"),
    )
    base = base.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
    lost = (F.col("word_chars") - word_chars(F.col("clean_text"))) * 100 > F.col("word_chars") * MAX_LOST_PERCENT
    return base.withColumn("kept", ~F.col("base_failed") & ~lost)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("clean_text")


def kept_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the accepted documents, with the lines that the rules left."""
    judged = quality_rules(docs, whole=True)
    row = F.struct(*[(F.length("clean_text").cast("long") if c == "n_chars" else F.col("clean_text") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
    # A filter would be pushed below the projections and repeat their expressions; a generator is not.
    return judged.select(F.inline(F.when(F.col("kept"), F.array(row))))


_W = r"[^\x20\x09-\x0D]+"
_TOLD = "(" + " + ".join(f"CASE WHEN contains(lower(x), '{p}') THEN {len(p)} ELSE 0 END" for p in _LEGAL) + ")"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT r, doc_id, text, regexp_extract_all(text, '{_W}') AS w, string_split(text, chr(10)) AS every, list_filter(every, lambda x: regexp_matches(x, '{_W}')) AS lines FROM d),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM b WHERE len(w) >= 8)),
dup AS (SELECT r, s FROM win GROUP BY r, s HAVING count(*) > 1),
hit AS (SELECT DISTINCT r, unnest(range(i, i + 8)) AS p FROM win JOIN dup USING (r, s)),
rep AS (SELECT r, count(*) AS k FROM hit GROUP BY r),
left_over AS (SELECT r, string_agg(x, '' ORDER BY x) AS kept_text FROM (
  SELECT DISTINCT r, x FROM (SELECT r, x, before, after, len(regexp_extract_all(x, '{_W}')) AS n, right(rtrim(x, '{_CLOSERS.replace("'", "''")}'), 1) AS mark, len(regexp_extract_all(x, '{_SEPARATOR}')) AS seps
    FROM (SELECT r, unnest(every) AS x, unnest(list_prepend(NULL, every[:-2])) AS before, unnest(list_append(every[2:], NULL)) AS after FROM b)) WHERE n > 0 AND NOT (
    len(regexp_extract_all(x, '[#*$%&|<>]')) * 4 >= n OR (length(x) - length(replace(x, '!!', '!'))) * 4 >= n
    OR n >= 3 AND mark NOT IN {_MARKS} AND len(regexp_extract_all(x, '{_MARK}')) * {WORDS_A_MARK} < n
      AND NOT coalesce(regexp_matches(after, '{_LOWER}') OR regexp_matches(after, '{_W}') AND length(x) >= {WRAPPED} AND length(x) * 3 >= greatest(coalesce(length(before), 0), length(after)) * 2, false)
    OR seps >= 3 AND seps * 4 >= n OR n <= 4 AND regexp_matches(x, '{_MENU}')
    OR n >= 8 AND len(list_distinct(string_split(x, ' '))) * 5 <= least(n, {VARIED})
    OR {_TOLD} > 0 AND {_TOLD} * {NOTICE} >= length(x))) GROUP BY r),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(k, 0)::BIGINT AS n_repeat_words, length(regexp_replace(coalesce(kept_text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS left_chars
  FROM b LEFT JOIN rep USING (r) LEFT JOIN left_over USING (r)),
g AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (word_chars - left_chars) * 100 > word_chars * {MAX_LOST_PERCENT} AS kept FROM g
"""
