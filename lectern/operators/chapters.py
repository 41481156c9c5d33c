"""From ordered parts of a document to chapters: spine items, page texts, sections, size caps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import patterns as P
from lectern.functions.binding import let
from lectern.functions.rules import strip
from lectern.operators.chunks import packed_strings
from lectern.operators.sentences import SMALL
from lectern.storage import written

SHORT_ITEM = 200
PREAMBLE = 200
EARLY_PARAGRAPHS, PSEUDO_HEADING = 6, 80
PAGES_PER_GROUP = 15
MAX_CHAPTER = 40_000


def blank(text: Column) -> Column:
    return strip(text) == ""


def ordered_join(order: str, text: str, separator: str) -> Column:
    """Aggregate: texts joined in the order of a column; nulls are left out."""
    rows = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(F.col(order).alias("o"), F.col(text).alias("t")))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), separator)


def in_cells(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` as a table, dealt by range of book and ``order`` into cells, with the cell as ``_cell``.

    A book may hold any share of the rows: it then lies in many cells, and equal places in one.
    """
    return written(written(rows).repartitionByRange("book", *order).withColumn("_cell", F.spark_partition_id()))


def with_ahead(rows: DataFrame, counts: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``_ahead``: of ``counts`` (book, ``order`` and _n, a row per place) the sum over the places of the book before the row's own.

    Sums come in two steps, over cells and inside them, on rows without text.
    """
    cells = in_cells(counts, *order)
    sums = cells.groupBy("book", "_cell").agg(F.sum("_n").alias("s"))
    before = W.partitionBy("book").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    lead = sums.select(F.col("book").alias("_book"), F.col("_cell").alias("_lead"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("_s"))
    inside = W.partitionBy("book", "_cell").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    told = cells.join(lead, F.col("book").eqNullSafe(F.col("_book")) & (F.col("_cell") == F.col("_lead")))
    names = [f"_by_{c}" for c in ("book", *order)]
    told = told.select(*[F.col(c).alias(n) for c, n in zip(("book", *order), names, strict=True)], (F.col("_s") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("_ahead"))
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(("book", *order), names, strict=True)]
    return rows.join(told, reduce(Column.__and__, same)).drop(*names)


def numbered(made: DataFrame, places: DataFrame, order: str) -> DataFrame:
    """``made`` with chapter_index, from 0 by book over the different ``places`` (book, ``order``)."""
    return with_ahead(made, places.distinct().withColumn("_n", F.lit(1)), order).withColumn("chapter_index", F.col("_ahead").cast("int"))


def spine_chapters(items: DataFrame) -> DataFrame:
    """book, chapter_index, title, text from spine items.

    ``items`` has book, pos, item_id, href, heading (first heading or null),
    paragraphs (array) and text. Front matter and contents pages go; short items
    without heading go; one with a heading starts a chapter whatever its text; an item
    without heading or chapter-like name continues the chapter before it.
    """
    named = items.filter(~(F.col("href").rlike(P.SPINE_SKIP) | F.col("item_id").rlike(P.SPINE_SKIP)))
    heading = strip(F.col("heading"))
    rows = named.withColumn("heading", heading).filter(F.col("heading").isNull() | ~F.col("heading").rlike(P.CONTENTS_TITLE))
    rows = rows.filter(F.col("heading").isNotNull() | (~blank(F.col("text")) & (F.length("text") >= SHORT_ITEM)))
    book = W.partitionBy("book").orderBy("pos")
    signal = F.col("href").rlike(P.FILE_CHAPTER) | F.col("item_id").rlike(P.FILE_CHAPTER)
    rows = rows.withColumn("starts", F.col("heading").isNotNull() | signal | (F.row_number().over(book) == 1))
    rows = rows.withColumn("n", F.sum(F.col("starts").cast("int")).over(book))
    early = F.filter(F.slice("paragraphs", 1, EARLY_PARAGRAPHS), lambda p: (F.length(strip(p)) > 0) & (F.length(strip(p)) <= PSEUDO_HEADING) & ~strip(p).rlike(P.BARE_NUMBER) & ~strip(p).rlike(P.BARE_CHAPTER))
    positional = F.concat(F.lit("Chapter "), F.col("n").cast("string"))
    title = F.when(F.col("heading").rlike(P.BARE_NUMBER), positional).when(F.col("heading").isNotNull(), F.when(F.col("heading") == "", positional).otherwise(F.col("heading")))
    rows = rows.withColumn("title", F.coalesce(title, strip(F.try_element_at(early, F.lit(1))), positional))
    made = rows.groupBy("book", "n").agg(F.max(F.when(F.col("starts"), F.col("title"))).alias("title"), ordered_join("pos", "text", "\n\n").alias("text"))
    return made.select("book", (F.col("n") - 1).cast("int").alias("chapter_index"), "title", "text")


def section_chapters(blocks: Column) -> Column:
    """Chapters (chapter_index, title, text) of a document, from its blocks (is_heading, text) in order.

    Text before the first heading is a preface if it is long enough; blank sections go; a
    heading that is empty or a bare number becomes its position. A block is looked at once
    and belongs to one section, so time and memory are linear in the document.
    """

    def between(parts: Column, at: Column) -> Column:
        """A section for each heading and one before the first; headings are at the places ``at``."""
        first, stop = F.array(F.lit(-1)), F.array(F.size(parts))
        spans = F.arrays_zip(F.concat(first, at).alias("at"), F.concat(at, stop).alias("stop"))
        own = lambda s: F.transform(F.slice(parts, s["at"] + 2, s["stop"] - s["at"] - 1), lambda p: p["text"])
        text = lambda s: F.array_join(F.filter(own(s), lambda t: t != ""), "\n\n")
        return F.transform(spans, lambda s: F.struct(F.when(s["at"] >= 0, F.get(parts, s["at"])["text"]).alias("heading"), text(s).alias("text")))

    def titled(s: Column, k: Column) -> Column:
        heading = s["heading"]
        bare = (heading == "") | heading.rlike(P.BARE_NUMBER) | heading.rlike(P.BARE_CHAPTER)
        title = F.when(heading.isNull(), "Preface").when(bare, F.concat(F.lit("Chapter "), (k + 1).cast("string"))).otherwise(heading)
        return F.struct(k.alias("chapter_index"), title.alias("title"), s["text"].alias("text"))

    places = lambda parts: F.array_compact(F.transform(parts, lambda p, k: F.when(p["is_heading"], k)))
    sections = let(blocks, lambda parts: let(places(parts), lambda at: between(parts, at)))
    kept = F.filter(sections, lambda s: ~blank(s["text"]) & (s["heading"].isNotNull() | (F.length(s["text"]) >= PREAMBLE)))
    return F.transform(kept, titled)


def page_headings(pages: DataFrame) -> DataFrame:
    """book, chapter_index, title, text split at heading-like lines of page texts (book, page_no, text); text before the first one goes.

    Texts are looked through once for the places of headings. All numbering is done on pages,
    with lists of their sections; then each text is shuffled once to what its sections are.
    Only chapters that go on over pages are put together by another shuffle.
    """
    mark = F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")
    heads_of = lambda lines: F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(P.HEADING_LINE), i + 1)), lambda k: k.isNotNull())

    def lines_of(lines: Column, heads: Column, start: Column, j: Column) -> Column:
        """The lines from a heading (of section 0: from the first line) to the next one."""
        skip = (j > 0).cast("int")
        inner = F.slice(lines, start + skip, F.coalesce(F.get(heads, j), F.size(lines) + 1) - start - skip)
        return F.filter(inner, lambda x: x.rlike(rf"(?!{P.SP})[\s\S]"))

    def flagged(lines: Column, heads: Column) -> Column:
        starts = F.concat(F.array(F.lit(1)), heads)
        full = F.filter(F.transform(starts, lambda start, j: F.when(F.size(lines_of(lines, heads, start, j)) > 0, j)), lambda j: j.isNotNull())
        return F.struct(heads.alias("heads"), full.alias("full"))

    # A text is split once, and its lines are held as they are: they are sliced for every section.
    found = let(F.split("text", "\n", -1), lambda lines: let(heads_of(lines), lambda heads: flagged(lines, heads)))
    placed = written(pages.filter("text IS NOT NULL").select("book", "page_no", mark, found.alias("f")).select("book", "page_no", "mark", "f.*"))
    said = written(_told(placed))
    texts = pages.select("book", "page_no", mark, "text")

    def met(kind: str) -> DataFrame:
        """The sections of one kind with their lines."""
        some = said.filter(F.size(kind) > 0).select(F.col("book").alias("_book"), F.col("page_no").alias("_page"), F.col("mark").alias("_mark"), "heads", F.col(kind).alias("sections"))
        some = F.broadcast(some) if some.limit(SMALL + 1).count() <= SMALL else some.hint("shuffle_hash")
        rows = texts.join(some, F.col("book").eqNullSafe(F.col("_book")) & F.col("page_no").eqNullSafe(F.col("_page")) & (F.col("mark") == F.col("_mark")))
        made = let(F.split("text", "\n", -1), lambda lines: F.transform("sections", lambda s: section(lines, s)))
        return rows.select("book", "page_no", F.explode(made).alias("p")).select("book", "page_no", "p.*")

    def section(lines: Column, s: Column) -> Column:
        start = F.when(s["j"] > 0, F.get("heads", s["j"] - 1)).otherwise(1)
        body = lines_of(lines, F.col("heads"), start, s["j"])
        told = lambda b: F.struct(s["chapter_index"].alias("chapter_index"), F.when(s["j"] > 0, strip(F.get(lines, start - 1))).alias("title"), F.when(F.size(b) > 0, F.array_join(b, "\n")).alias("body"))
        return let(body, told)

    whole = met("alone").select("book", "chapter_index", "title", F.col("body").alias("text"))
    if said.filter(F.size("shared") > 0).isEmpty():
        return whole
    parts = met("shared").groupBy("book", "chapter_index").agg(F.max("title").alias("title"), ordered_join("page_no", "body", "\n").alias("text"))
    return whole.unionByName(parts.select("book", "chapter_index", "title", "text"))


def _told(placed: DataFrame) -> DataFrame:
    """book, page_no, mark, heads and two lists (j, chapter_index) of a text's sections: those that are ``alone`` a chapter and those of chapters with other parts (``shared``).

    ``placed`` has the places of headings in each text and ``full``, the numbers j of its sections
    that hold lines. Section j of a place is part j + a of its book, where a is the number of
    headings in the places before; so only a place's first and last parts go on over places.
    """
    by_place = placed.groupBy("book", "page_no").agg(F.sum(F.size("heads")).alias("k"), F.count("*").alias("copies"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("full")))).alias("js"))
    rows = written(with_ahead(by_place, by_place.select("book", "page_no", F.col("k").alias("_n")), "page_no").withColumnRenamed("_ahead", "a"))
    first = rows.select("book", F.col("a").alias("n"), F.array_contains("js", 0).alias("has"), F.when(F.array_contains("js", 0), F.col("copies")).otherwise(0).alias("copies"))
    last = rows.filter("k > 0").select("book", (F.col("a") + F.col("k")).alias("n"), F.array_contains("js", F.col("k").cast("int")).alias("has"), "copies")
    ends = first.filter("n > 0").unionByName(last).groupBy("book", "n").agg(F.bool_or("has").alias("_goes"), (F.sum("copies") > 1).alias("_many")).select(F.col("book").alias("_book"), F.col("n").alias("_end"), "_goes", "_many")
    rows = rows.join(ends, F.col("book").eqNullSafe(F.col("_book")) & (F.col("a") + F.col("k") == F.col("_end")) & (F.col("k") > 0), "left").drop("_book", "_end")
    # The parts of a place that begin in it and hold lines, there or (the last one) in a place behind it.
    own = F.filter("js", lambda j: (j > 0) & (j < F.col("k")))
    own = F.when(F.coalesce("_goes", F.lit(False)), F.concat(own, F.array(F.col("k").cast("int")))).otherwise(own)
    rows = written(rows.select("book", "page_no", "k", "a", "copies", own.alias("own"), F.coalesce("_many", F.lit(False)).alias("many")))
    rows = with_ahead(rows, rows.select("book", "page_no", F.size("own").alias("_n")), "page_no")
    rows = rows.select(F.col("book").alias("_book"), F.col("page_no").alias("_page"), "k", "a", "copies", "own", "many", F.col("_ahead").cast("int").alias("at"))
    # Rows of one place and text are alike, and so is what is said of them.
    texts = placed.dropDuplicates(["book", "page_no", "mark"])
    texts = texts.join(rows, F.col("book").eqNullSafe(F.col("_book")) & F.col("page_no").eqNullSafe(F.col("_page")))
    numbered_own = F.filter(F.transform("own", lambda j, i: F.struct(j.alias("j"), (F.col("at") + i).alias("chapter_index"))), lambda s: s["j"] <= F.size("heads"))
    lone = lambda s: F.when(s["j"] == F.col("k"), ~F.col("many")).otherwise(F.col("copies") == 1)
    ahead = F.when((F.col("a") > 0) & F.array_contains("full", 0), F.array(F.struct(F.lit(0).alias("j"), (F.col("at") - 1).alias("chapter_index"))))
    ahead = F.coalesce(ahead, F.array().cast("array<struct<j:int,chapter_index:int>>"))
    told = texts.select("book", "page_no", "mark", "heads", "k", "copies", "many", numbered_own.alias("_own"), ahead.alias("_first"))
    return told.select("book", "page_no", "mark", "heads", F.filter("_own", lone).alias("alone"), F.concat("_first", F.filter("_own", lambda s: ~lone(s))).alias("shared"))


def page_groups(pages: DataFrame, size: int = PAGES_PER_GROUP) -> DataFrame:
    """book, chapter_index, title, text of so many pages each; page_no counts from 0."""
    rows = pages.withColumn("group", F.floor(F.col("page_no") / size)).withColumn("body", F.when(~blank(F.col("text")), F.col("text")))
    made = rows.groupBy("book", "group").agg(ordered_join("page_no", "body", "\n\n").alias("text")).filter(~blank(F.col("text")))
    return numbered(made, rows.filter("body IS NOT NULL").select("book", "group"), "group").select("book", "chapter_index", F.concat(F.lit("Chapter "), (F.col("chapter_index") + 1).cast("string")).alias("title"), "text")


def page_chapters(pages: DataFrame) -> DataFrame:
    """Chapters by headings, or by page groups for books without any; oversized ones are split."""
    headed = written(page_headings(pages))
    grouped = page_groups(pages.join(headed.select("book").distinct(), "book", "left_anti"))
    return cap_chapters(headed.unionByName(grouped))


#: Separators of an oversized text, coarse ones first.
SEPARATORS = ("\n\n", "\n", " ")


def _gathered(piece: Column, most: int, mark: str) -> Column:
    """Units between marks, gathered greedily up to the limit; without empty pieces.

    For a mark of one character a piece is the longest match that ends before a mark: a search, not a
    step for every unit. Characters beyond the basic plane would nest such a search, and two-character
    marks may overlap: these take the scan, with the same pieces.
    """
    scan = F.filter(packed_strings(F.split(piece, mark, -1), most, mark), lambda q: q != "")
    if len(mark) > 1:
        return scan
    found = F.regexp_extract_all(piece, F.lit(rf"[^{mark}](?s:.{{0,{most - 1}}})(?=[{mark}]|\z)|[^{mark}]+"), F.lit(0))
    return F.when(piece.rlike(r"[\x{10000}-\x{10ffff}]"), scan).otherwise(found)


def cut(text: Column, most: int) -> Column:
    """Pieces within the limit: units of the coarsest separator are gathered, what is larger than the limit is cut by finer ones, then by length."""
    large = lambda p: F.length(p) > most
    by = lambda pieces, mark: F.flatten(F.transform(pieces, lambda p: F.when(large(p) & p.contains(mark), _gathered(p, most, mark)).otherwise(F.array(p))))
    pieces = reduce(by, SEPARATORS, F.array(text))
    kept = F.filter(pieces, lambda p: large(p) | ~blank(p))
    slices = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda k: F.substring(p, k * most + 1, F.lit(most)))
    return F.flatten(F.transform(kept, lambda p: F.when(large(p), slices(p)).otherwise(F.array(p))))


def cap_chapters(chapters: DataFrame, most: int = MAX_CHAPTER) -> DataFrame:
    """No chapter longer than the limit; pieces are numbered in the title, chapters anew."""
    fits = chapters.filter(F.length("text") <= most).withColumn("piece", F.lit(0)).withColumn("n", F.lit(1))
    large = chapters.filter(F.length("text") > most).withColumn("_pieces", cut(F.col("text"), most))
    large = large.select("book", "chapter_index", "title", F.size("_pieces").alias("n"), F.posexplode("_pieces").alias("piece", "text"))
    rows = fits.unionByName(large.select(*fits.columns))
    title = F.when(F.col("n") > 1, F.concat("title", F.lit(" (part "), (F.col("piece") + 1).cast("string"), F.lit(")"))).otherwise(F.col("title"))
    made = rows.select("book", F.col("chapter_index").alias("from"), "piece", title.alias("title"), "text")
    places = made.groupBy("book", "from").agg(F.count("*").alias("_n"))
    inside = W.partitionBy("book", "from").orderBy("piece")
    at = (F.col("_ahead") + F.row_number().over(inside) - 1).cast("int")
    return with_ahead(made, places, "from").select("book", at.alias("chapter_index"), "title", "text")
