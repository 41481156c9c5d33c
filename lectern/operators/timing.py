"""Estimates, chapter durations and timings, progress and metadata of a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators.chapters import with_ahead

CHARS_PER_SECOND, OVERHEAD = 100.0, 1.05
BYTES_PER_CHAR = 15
GAP_SECONDS = 0.3


def estimates(chapters: DataFrame, free_bytes: int | None = None) -> DataFrame:
    """By book: chapters, characters, seconds of conversion, bytes of disk and, for a given free space, admission with a reason."""
    made = chapters.groupBy("book").agg(F.count("*").alias("n_chapters"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("total_chars"))
    made = made.withColumn("seconds", F.col("total_chars") / CHARS_PER_SECOND * OVERHEAD).withColumn("disk_bytes", F.col("total_chars") * BYTES_PER_CHAR)
    if free_bytes is None:
        return made
    mb = lambda c: F.format_string("%d", (c / 1_000_000).cast("long"))
    fits = F.lit(free_bytes) >= F.col("disk_bytes")
    reason = F.when(~fits, F.concat(F.lit("needs "), mb(F.col("disk_bytes")), F.lit(" MB, "), mb(F.lit(free_bytes)), F.lit(" MB free")))
    return made.withColumn("admitted", fits).withColumn("reason", reason)


def chapter_durations(chunks: DataFrame, gap: float = GAP_SECONDS) -> DataFrame:
    """By book and chapter: chunk seconds and the gaps between chunks; chapters without chunks do not occur."""
    total = F.sum("seconds") + F.lit(max(gap, 0.0)) * (F.count("*") - 1)
    return chunks.groupBy("book", "chapter_index").agg(total.alias("seconds"), F.count("*").alias("n_chunks"))


def timings(durations: DataFrame) -> DataFrame:
    """Start and end of every chapter: running sums in chapter order, and whole milliseconds."""
    before = W.partitionBy("book").orderBy("chapter_index").rowsBetween(W.unboundedPreceding, -1)
    rows = durations.withColumn("start_sec", F.coalesce(F.sum("seconds").over(before), F.lit(0.0)))
    rows = rows.withColumn("end_sec", F.col("start_sec") + F.col("seconds"))
    return rows.withColumn("start_ms", (F.col("start_sec") * 1000).cast("long")).withColumn("end_ms", (F.col("end_sec") * 1000).cast("long"))


def sample_marks(offsets: DataFrame, rate: int) -> DataFrame:
    """book, chapter_index, start, end (samples from the start of the book), start_ms, end_ms: exact, from whole numbers of samples.

    ``offsets`` has length (samples of the chapter, see ``audio.sample_offsets``) by book and
    chapter. Sums of whole numbers do not depend on their order, so neither do the marks.
    """
    lengths = offsets.select("book", "chapter_index", F.col("length").alias("_n")).distinct()
    placed = with_ahead(lengths.select("book", "chapter_index"), lengths, "chapter_index")
    told = placed.join(lengths.withColumnsRenamed({"book": "_book", "chapter_index": "_chapter"}), F.col("book").eqNullSafe(F.col("_book")) & (F.col("chapter_index") == F.col("_chapter")))
    ms = lambda n: F.expr(f"`{n}` * 1000 DIV {rate}")
    return told.select("book", "chapter_index", F.col("_ahead").alias("start"), (F.col("_ahead") + F.col("_n")).alias("end")).select("*", ms("start").alias("start_ms"), ms("end").alias("end_ms"))


def progress(chapters: DataFrame) -> DataFrame:
    """Percent done before each chapter: chapters share the first 80."""
    book = W.partitionBy("book")
    done = F.row_number().over(book.orderBy("chapter_index")) - 1
    return chapters.select("book", "chapter_index", (done / F.count("*").over(book) * 80).alias("progress_pct"))


#: What is reported after all chapters, with the percentage done.
MILESTONES = (("assembling", 85.0), ("assembling", 95.0), ("done", 100.0))


def reports(chapters: DataFrame) -> DataFrame:
    """book, place, status, progress_pct, current_chapter (its index): everything that a job reports, in order: each chapter before it is read, then the milestones."""
    steps = progress(chapters).select("book", F.col("chapter_index").cast("long").alias("current_chapter"), F.lit("synthesizing").alias("status"), "progress_pct")
    place = F.row_number().over(W.partitionBy("book").orderBy("current_chapter")).cast("int")
    steps = steps.withColumn("place", place)
    after = F.array(*[F.struct(F.lit(k + 1).alias("k"), F.lit(s).alias("status"), F.lit(p).alias("progress_pct")) for k, (s, p) in enumerate(MILESTONES)])
    last = steps.groupBy("book").agg(F.max("place").alias("n")).select("book", "n", F.explode(after).alias("m"))
    last = last.select("book", F.lit(None).cast("long").alias("current_chapter"), "m.status", "m.progress_pct", (F.col("n") + F.col("m.k")).cast("int").alias("place"))
    return steps.unionByName(last)


def metadata_text(timed: DataFrame, books: DataFrame) -> DataFrame:
    """By book: the chapter metadata file as one string. ``timed`` has title and marks, ``books`` book, title, author."""
    block = F.concat(F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.col("start_ms").cast("string"), F.lit("\nEND="), F.col("end_ms").cast("string"), F.lit("\ntitle="), F.col("title"))
    parts = timed.withColumn("block", block).groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter_index", "block"))), lambda x: x["block"]), "\n").alias("blocks"))
    head = F.concat(F.lit(";FFMETADATA1\ntitle="), F.col("title"), F.lit("\nartist="), F.col("author"), F.lit("\n"))
    return books.join(parts, "book").select("book", F.concat(head, F.col("blocks"), F.lit("\n")).alias("metadata"))


def checked(timed: DataFrame, covers: DataFrame | None = None) -> DataFrame:
    """By book: whether a plan is complete: titles, positive length, chapters that follow on each other; with ``covers`` (book, cover) also whether there is one."""
    book = W.partitionBy("book").orderBy("chapter_index")
    follows = F.col("start_sec") == F.coalesce(F.lag("end_sec").over(book), F.lit(0.0))
    rows = timed.withColumn("ok", follows & F.col("title").isNotNull() & (F.col("title") != "") & (F.col("seconds") >= 0))
    made = rows.groupBy("book").agg(F.count("*").alias("n_chapters"), F.max("end_sec").alias("length_sec"), (F.bool_and("ok") & (F.max("end_sec") > 0)).alias("complete"))
    if covers is None:
        return made
    known = covers.groupBy("book").agg(F.bool_or(F.col("cover").isNotNull()).alias("has_cover"))
    return made.join(known, "book", "left").withColumn("has_cover", F.coalesce("has_cover", F.lit(False)))


def throughput(runs: DataFrame) -> DataFrame:
    """Characters a second by voice; ``runs`` has voice, chars, seconds."""
    return runs.groupBy("voice").agg((F.sum("chars") / F.sum("seconds")).alias("chars_per_second"))


def title_or(value: Column, fallback: Column) -> Column:
    """A value, or the fallback where it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), fallback)
