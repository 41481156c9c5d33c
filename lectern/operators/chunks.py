"""Chunking: paragraphs, sentences, long-sentence split and greedy packing with paragraph lineage.

Sentences end at ``.``, ``!`` or ``?`` (with closing quotes or brackets) before white
space; with a model of the corpus (``sentences.trained``) not after abbreviations,
initials and numbers that go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.binding import let
from lectern.functions.patterns import SP
from lectern.functions.rules import strip
from lectern.operators.sentences import Model, parts, protected, unmasked

MAX_CHARS = 400
CLAUSE_MARKS = (";", ":", ",")
#: How units join, how many of them a step of the scan goes over, and a noncharacter that stands between pieces.
CLOSE, JOINED, APART, BLOCK = 0, 1, 2, 512
_MARK = "\ufdef"


def paragraphs(text: Column) -> Column:
    """Parts between blank lines that are not blank."""
    return F.filter(F.split(text, "\n\n", -1), lambda p: p.rlike(rf"(?!{SP})[\s\S]"))


def sentences(paragraph: Column) -> Column:
    return F.filter(F.transform(parts(paragraph), strip), lambda s: s != "")


def _by_mark(piece: Column, mark: str, most: int) -> Column:
    """A piece over the limit cut after every ``mark`` (the last part without one), if that makes several."""
    cut = F.filter(F.transform(F.split(piece, mark, -1), strip), lambda p: p != "")
    # Joining with a mark and a separator puts the mark behind all parts but the last.
    told = let(cut, lambda ps: F.when(F.size(ps) > 1, F.split(F.array_join(ps, mark + _MARK), _MARK, -1)).otherwise(F.array(piece)))
    return F.when(F.length(piece) > most, told).otherwise(F.array(piece))


def joints(sizes: Column, most: int, width: int) -> Column:
    """How each of some units (of these sizes) joins the one before it: APART, CLOSE (nothing was there yet) or with a separator of ``width``.

    Units are gathered greedily as long as they stay within the limit. The scan goes over
    blocks: what a step adds to is never longer than a block or the list of blocks, so that
    time stays linear for texts of any practical length.
    """
    none = F.array().cast("array<tinyint>")
    code = lambda c: F.lit(c).cast("tinyint")

    def add(acc: Column, at: Column) -> Column:
        size = F.get(sizes, at)
        open_, joined = acc["open"], acc["open"] + width + size
        told = F.when(open_ == 0, code(CLOSE)).when(joined > most, code(APART)).otherwise(code(JOINED))
        return F.struct(F.array_append(acc["codes"], told).alias("codes"), F.when((open_ == 0) | (joined > most), size).otherwise(joined).alias("open"))

    def add_block(acc: Column, block: Column) -> Column:
        places = F.sequence(block * BLOCK, F.least((block + 1) * BLOCK, F.size(sizes)) - 1)
        made = F.aggregate(places, F.struct(none.alias("codes"), acc["open"].alias("open")), add)
        return let(made, lambda m: F.struct(F.array_append(acc["done"], m["codes"]).alias("done"), m["open"].alias("open")))

    blocks = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int"))
    start = F.struct(F.array().cast("array<array<tinyint>>").alias("done"), F.lit(0).alias("open"))
    return F.when(F.size(sizes) > 0, F.aggregate(blocks, start, add_block, lambda acc: F.flatten(acc["done"]))).otherwise(none)


def gathered(units: Column, codes: Column, separator: str) -> Column:
    """The units joined as their codes say."""
    before = lambda c: F.when(c == APART, F.lit(_MARK)).when(c == JOINED, F.lit(separator)).otherwise("")
    told = F.array_join(F.zip_with(units, codes, lambda u, c: F.concat(before(c), u)), "")
    return F.when(F.size(units) > 0, F.split(told, _MARK, -1)).otherwise(F.array().cast("array<string>"))


def packed_strings(parts: Column, most: int, separator: str = " ") -> Column:
    """Strings joined by a separator as long as they stay within the limit."""
    return let(parts, lambda ps: let(F.transform(ps, F.length), lambda sizes: gathered(ps, joints(sizes, most, len(separator)), separator)))


def split_long(sentence: Column, most: int = MAX_CHARS) -> Column:
    """A sentence in pieces within the limit: by clause marks, then by words; a longer word stays whole."""
    pieces = F.array(sentence)
    for mark in CLAUSE_MARKS:
        pieces = _flat(pieces, mark, most)
    words = lambda p: F.when(F.length(p) > most, packed_strings(F.array_remove(F.split(p, " ", -1), ""), most)).otherwise(F.array(p))
    return F.flatten(F.transform(pieces, words))


def _flat(pieces: Column, mark: str, most: int) -> Column:
    return F.flatten(F.transform(pieces, lambda p: _by_mark(p, mark, most)))


def pieces(text: Column, most: int = MAX_CHARS, masked: bool = False) -> Column:
    """(text, paragraph) of all sentences or their parts in order; ``masked`` texts come from ``sentences.protected``."""
    plain = unmasked if masked else lambda s: s
    in_paragraph = lambda p, i: F.transform(F.flatten(F.transform(sentences(p), lambda s: split_long(plain(s), most))), lambda s: F.struct(s.alias("text"), i.alias("para")))
    return F.flatten(F.transform(paragraphs(text), in_paragraph))


def pack(parts: Column, most: int = MAX_CHARS) -> Column:
    """Chunks (text, paragraph_start, paragraph_end) packed greedily across paragraphs."""

    def made(ps: Column, codes: Column) -> Column:
        firsts = F.filter(ps, lambda p, i: (i == 0) | (F.get(codes, i) == APART))
        lasts = F.filter(ps, lambda p, i: (i == F.size(ps) - 1) | (F.get(codes, i + 1) == APART))
        texts = gathered(F.transform(ps, lambda p: p["text"]), codes, " ")
        ends = F.zip_with(firsts, lasts, lambda a, b: F.struct(a["para"].alias("a"), b["para"].alias("b")))
        return F.zip_with(texts, ends, lambda t, e: F.struct(t.alias("text"), e["a"].alias("paragraph_start"), e["b"].alias("paragraph_end")))

    return let(parts, lambda ps: let(F.transform(ps, lambda p: F.length(p["text"])), lambda sizes: let(joints(sizes, most, 1), lambda codes: made(ps, codes))))


def chunked(chapters: DataFrame, text_col: str = "text", most: int = MAX_CHARS, model: Model | None = None) -> DataFrame:
    """A row per chunk: the other columns, chunk_index from 0, text, paragraph_start, paragraph_end; empty texts give none."""
    keep = [c for c in chapters.columns if c != text_col]
    texts = chapters if model is None else protected(chapters, model, text_col)
    parts = texts.withColumn("_parts", pieces(F.col(text_col), most, model is not None))
    return parts.select(*keep, F.posexplode(pack(F.col("_parts"), most)).alias("chunk_index", "_chunk")).select(*keep, "chunk_index", "_chunk.*")
