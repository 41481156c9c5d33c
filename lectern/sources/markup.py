"""HTML and XHTML into blocks: one tag walk per document in Arrow batches, all chapter logic in columns.

The tree is the one that a lenient parser without auto-closing builds: void
elements close at once, an end tag closes up to its nearest open tag, other end
tags are ignored; comments, scripts and styles are no text. A walk notes each piece
of text once; blocks are ranges of pieces, so unclosed tags cost no more than others.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.binding import let
from lectern.functions.rules import strip
from lectern.operators.chapters import section_chapters
from lectern.operators.timing import title_or
from lectern.sources.batches import batched, rows_of

#: Elements that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(["h1", "h2", "h3"])
PARAGRAPHS = frozenset(["p", "div"])
CODE = frozenset(["pre", "code"])
_SILENT = frozenset(["script", "style"])

#: ``start`` and ``stop`` are places in ``pieces``; ``prose`` holds null for pieces of code.
BLOCK = "struct<tag:string,start:int,stop:int,leaf:boolean,in_body:boolean>"
BLOCK_ARROW = pa.struct([("tag", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("leaf", pa.bool_()), ("in_body", pa.bool_())])
WALK = f"error string, title string, author string, has_body boolean, body_start int, body_stop int, pieces array<string>, prose array<string>, blocks array<{BLOCK}>"
_ARROW = [("error", pa.string()), ("title", pa.string()), ("author", pa.string()), ("has_body", pa.bool_()), ("body_start", pa.int32()), ("body_stop", pa.int32()), ("pieces", pa.list_(pa.string())), ("prose", pa.list_(pa.string())), ("blocks", pa.list_(BLOCK_ARROW))]


class _Walk(HTMLParser):
    """Notes the pieces of text and, in document order, the h1-h3, p and div elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, dict | None]] = []
        self.inside: Counter = Counter()
        self.nested: list[dict] = []
        self.blocks: list[dict] = []
        self.pieces: list[str] = []
        self.prose: list[str | None] = []
        self.title: list[str] | None = None
        self.titled = False
        self.author: str | None = None
        self.body: list[int] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        if tag == "meta" and self.author is None and re.fullmatch("author", given.get("name") or "", re.IGNORECASE):
            self.author = given.get("content") or ""
        if tag in VOID:
            return
        block = None
        if tag in PARAGRAPHS:
            # What is around a block that is no leaf is none either.
            for outer in reversed(self.nested):
                if not outer["leaf"]:
                    break
                outer["leaf"] = False
        if tag in HEADINGS or tag in PARAGRAPHS:
            block = {"tag": tag, "start": len(self.pieces), "stop": None, "leaf": True, "in_body": self.inside["body"] > 0}
            self.blocks.append(block)
            self.nested.append(block)
        if tag == "body" and self.body is None:
            self.body = [len(self.pieces)]
        if tag == "title" and self.title is None:
            self.title = []
        self.inside[tag] += 1
        self.open.append((tag, block))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self) -> str:
        tag, block = self.open.pop()
        self.inside[tag] -= 1
        if block is not None:
            block["stop"] = len(self.pieces)
            self.nested.pop()
        if not self.inside[tag]:
            self.titled |= tag == "title"
            if tag == "body" and len(self.body) == 1:
                self.body.append(len(self.pieces))
        return tag

    def handle_endtag(self, tag: str) -> None:
        if self.inside[tag]:
            while self._close() != tag:
                pass

    def handle_data(self, data: str) -> None:
        piece = data.strip()
        if not piece or any(self.inside[t] for t in _SILENT):
            return
        if self.inside["title"] and not self.titled:
            self.title.append(piece)
        self.pieces.append(piece)
        self.prose.append(None if any(self.inside[t] for t in CODE) else piece)

    def finish(self) -> None:
        self.close()
        while self.open:
            self._close()


def walked(text: str | None) -> dict:
    """Title, author, pieces and blocks of a document; an error and none of them where its markup cannot be read."""
    walk, error = _Walk(), None
    try:
        walk.feed(text or "")
        walk.finish()
    except (AssertionError, ValueError, RecursionError) as wrong:
        walk, error = _Walk(), f"{type(wrong).__name__}: {wrong}"
    span = walk.body or [0, len(walk.pieces)]
    title = None if walk.title is None else "".join(walk.title)
    return {"error": error, "title": title, "author": walk.author, "has_body": walk.body is not None, "body_start": span[0], "body_stop": span[1], "pieces": walk.pieces, "prose": walk.prose, "blocks": walk.blocks}


#: What the bytes 80 to 9F stand for in pages that say Latin-1 or nothing (bytes without a sign keep their number).
_WINDOWS = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
_CONTROLS = "".join(map(chr, range(0x80, 0xA0)))
#: Names of the charsets that expressions decode.
CHARSETS = {"utf-8": ("utf-8", "utf8", "unicode-1-1-utf-8"), "windows-1252": ("windows-1252", "cp1252", "x-cp1252", "iso-8859-1", "iso8859-1", "latin1", "latin-1", "l1", "us-ascii", "ascii"), "utf-16le": ("utf-16le", "utf-16", "unicode"), "utf-16be": ("utf-16be",)}
#: Bytes that are looked through for a declaration.
PRESCAN = 1024


def charset(content: Column) -> Column:
    """The charset of a page: by its byte order mark, by what its meta element says, by whether it is valid UTF-8, else Windows-1252."""
    start = F.decode(F.substring(content, 1, PRESCAN), "ISO-8859-1")
    bom = F.when(start.startswith("\xef\xbb\xbf"), "utf-8").when(start.startswith("\xff\xfe"), "utf-16le").when(start.startswith("\xfe\xff"), "utf-16be")
    said = F.lower(F.regexp_extract(F.regexp_replace(start, "(?s)<!--.*?-->", ""), r"""(?is)<meta\s[^>]*?charset\s*=\s*["']?\s*([\w:.\-]+)""", 1))
    named = F.when(said == "", None)
    for name, labels in CHARSETS.items():
        # A page whose declaration can be read as ASCII is not in UTF-16, whatever it says.
        named = named.when(said.isin(*labels), "utf-8" if name.startswith("utf-16") else name)
    valid = F.when(F.is_valid_utf8(content.cast("string")), "utf-8").otherwise("windows-1252")
    return F.coalesce(bom, named.otherwise(said), valid)


def decoded(files: DataFrame, content_col: str = "content") -> DataFrame:
    """All columns, ``charset``, and as ``markup`` the text of the bytes; null where the charset is not known.

    UTF-8, UTF-16 and Windows-1252 (which pages that say Latin-1 are in) are decoded by
    expressions, bytes that are no characters become U+FFFD; pages in other charsets, if
    there are any, go through Python's codecs.
    """
    content = F.col(content_col)
    rows = files.withColumn("charset", charset(content))
    native = list(CHARSETS)
    skip = lambda mark: F.when(F.hex(F.substring(content, 1, len(mark) // 2)) == mark, F.substring(content, F.lit(len(mark) // 2 + 1), F.length(content))).otherwise(content)
    text = (
        F.when(F.col("charset") == "utf-8", F.make_valid_utf8(skip("EFBBBF").cast("string")))
        .when(F.col("charset") == "windows-1252", F.translate(F.decode(content, "ISO-8859-1"), _CONTROLS, _WINDOWS))
        .when(F.col("charset") == "utf-16le", F.decode(_even(skip("FFFE")), "UTF-16LE"))
        .when(F.col("charset") == "utf-16be", F.decode(_even(skip("FEFF")), "UTF-16BE"))
    )
    known = rows.filter(F.coalesce(F.col("charset").isin(*native), F.lit(True))).withColumn("markup", text)

    def other(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(markup=[_by_codec(c, name) for c, name in zip(batch[content_col], batch["charset"], strict=True)])

    schema = T.StructType([*rows.schema.fields, T.StructField("markup", T.StringType())])
    return known.unionByName(rows.filter(~F.col("charset").isin(*native)).mapInPandas(other, schema))


def _even(content: Column) -> Column:
    """Bytes in pairs; one that is left over is dropped."""
    return F.substring(content, F.lit(1), F.length(content) - F.pmod(F.length(content), F.lit(2)))


def _by_codec(content: bytes, name: str) -> str | None:
    try:
        return content.decode(name, "replace")
    except (LookupError, UnicodeError):
        return None


def told(pieces: Column, block: Column, separator: str) -> Column:
    """The text of a block."""
    return F.array_join(F.slice(pieces, block["start"] + 1, block["stop"] - block["start"]), separator)


def paragraphs(pieces: Column, blocks: Column) -> Column:
    """Texts of the p and div elements that hold no other ones, blank ones left out."""
    leaves = F.filter(blocks, lambda b: b["tag"].isin(*PARAGRAPHS) & b["leaf"])
    return F.filter(F.transform(leaves, lambda b: told(pieces, b, " ")), lambda t: t != "")


def loose_lines(pieces: Column) -> Column:
    """For documents without paragraphs: the lines of all pieces, blank ones left out."""
    return F.filter(F.split(F.array_join(pieces, "\n"), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", -1), lambda x: strip(x) != "")


def body_text(prose: Column, blocks: Column) -> Column:
    leaves = paragraphs(prose, blocks)
    return F.array_join(F.when(F.size(leaves) > 0, leaves).otherwise(loose_lines(prose)), "\n\n")


def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of id and markup to batches of id and what the walks find, which hold few documents each."""
    first = next(batches, None)
    if first is not None:
        schema, given = pa.schema([first.schema.field(0), *_ARROW]), chain(iter([first]), batches)
        del first  # else it is held until the task ends, as a list in the chain would be
        yield from batched(((({"id": r["id"]} | walked(r["markup"])), len(r["markup"] or "")) for r in rows_of(given)), schema)


def parsed(docs: DataFrame, id_col: str, markup_col: str) -> DataFrame:
    """A row per document: id, error, title, author, has_body, body_start, body_stop, pieces, prose, blocks."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(markup_col).alias("markup"))
    return rows.mapInArrow(walks, f"id {kind}, {WALK}").withColumnRenamed("id", id_col)


def html_books(docs: DataFrame, id_col: str, markup_col: str, stem: str = "book") -> DataFrame:
    """book, title, author; documents without title or author get defaults."""
    made = parsed(docs, id_col, markup_col)
    return made.select(F.col(id_col).alias("book"), title_or(F.col("title"), F.lit(stem)).alias("title"), title_or(strip(F.col("author")), F.lit("Unknown")).alias("author"))


def html_errors(docs: DataFrame, id_col: str, markup_col: str) -> DataFrame:
    """book, error of the documents whose markup cannot be read; they have no chapters."""
    return parsed(docs, id_col, markup_col).filter("error IS NOT NULL").select(F.col(id_col).alias("book"), "error")


def html_chapters(docs: DataFrame, id_col: str, markup_col: str, stem: str = "book") -> DataFrame:
    """book, chapter_index, title, text of HTML documents: sections by heading, or else the whole body.

    All of a document's chapters are made in the row of its walk: nothing is shuffled or written.
    """
    made = parsed(docs, id_col, markup_col).withColumnRenamed(id_col, "book").withColumn("blocks", F.filter("blocks", lambda b: ~F.col("has_body") | b["in_body"]))
    is_heading = lambda b: b["tag"].isin(*HEADINGS)
    text = lambda b: F.when(is_heading(b), told(F.col("pieces"), b, "")).otherwise(told(F.col("pieces"), b, " "))
    flat = F.filter("blocks", lambda b: (b["tag"] != "div") | b["leaf"])
    headed = section_chapters(F.transform(flat, lambda b: F.struct(is_heading(b).alias("is_heading"), text(b).alias("text"))))
    prose = F.slice("prose", F.col("body_start") + 1, F.col("body_stop") - F.col("body_start"))
    # Places of blocks are places in all pieces; only the lines of a body without paragraphs need its own.
    body = let(paragraphs(F.col("prose"), F.col("blocks")), lambda leaves: F.array_join(F.when(F.size(leaves) > 0, leaves).otherwise(loose_lines(prose)), "\n\n"))
    whole = F.filter(F.array(F.struct(F.lit(0).alias("chapter_index"), title_or(F.col("title"), F.lit(stem)).alias("title"), body.alias("text"))), lambda c: strip(c["text"]) != "")
    return made.select("book", F.inline(let(headed, lambda chapters: F.when(F.size(chapters) > 0, chapters).otherwise(whole))))
