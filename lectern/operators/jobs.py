"""Jobs over tables: latest state, library, joins to books, what is left to do, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.timing import BYTES_PER_CHAR, CHARS_PER_SECOND, OVERHEAD
from lectern.tables import Table

#: States that no event changes.
TERMINAL = ("done", "failed", "cancelled")
MAX_UPLOAD = 200 * 1024 * 1024
#: Bits of the filter of what is done at most: 64 MB.
MOST_BITS = 1 << 29
EXTENSIONS = (".epub", ".pdf", ".html", ".htm")

CHAPTER = T.StructType([T.StructField("index", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])
BOOKS = T.StructType(
    [T.StructField(n, T.StringType(), n not in ("id", "title")) for n in ("id", "title", "author", "cover_path", "language")]
    + [T.StructField("chapter_count", T.IntegerType()), T.StructField("source_path", T.StringType()), T.StructField("chapters_json", T.StringType()), T.StructField("created_at", T.TimestampType())]
)
JOBS = T.StructType(
    [T.StructField(n, T.StringType(), n not in ("id", "book_id")) for n in ("id", "book_id", "book_title", "voice")]
    + [T.StructField("speed", T.DoubleType()), T.StructField("status", T.StringType()), T.StructField("progress_pct", T.DoubleType())]
    + [T.StructField(n, T.StringType()) for n in ("current_chapter", "error_msg", "output_path")]
    + [T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType())]
)


def latest(events: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """By key the last value of each field that is not null, in the given order: updates that leave a field out keep it."""
    place = F.struct(*order)
    return events.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), place)).alias(f) for f in fields], F.count("*").alias("n_events"))


def log_lines(events: DataFrame, order: list[str]) -> DataFrame:
    """job_id, line: the log of each job, a line per event in order; ``write.partitionBy("job_id").text`` makes a file of each."""
    said = [F.concat(F.lit(f" {c}="), F.col(c).cast("string")) for c in ("status", "progress_pct", "current_chapter")]
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), *[F.coalesce(s, F.lit("")) for s in said])
    return events.sort("job_id", *order).select("job_id", line.alias("line"))


def absorbing(events: DataFrame, key: str, order: list[str], status: str = "status") -> DataFrame:
    """Events up to and including the first terminal one of each key: what comes later changes nothing."""
    place = F.struct(*order)
    first = events.filter(F.col(status).isin(*TERMINAL)).groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*events.columns), place).alias("_last"))
    # A null-safe join is no partitioning by the key: a key with very many events can be split.
    told = events.join(first, F.col(key).eqNullSafe(F.col("_key")), "left")
    before = told.filter(F.col("_last").isNull() | (place < F.struct(*[F.col("_last")[c].alias(c) for c in order])))
    return before.select(*events.columns).unionByName(first.select("_last.*"))


def library(jobs: DataFrame) -> DataFrame:
    """Newest first; ties by id."""
    return jobs.orderBy(F.desc("created_at"), "id")


def by_id(table: DataFrame, value) -> DataFrame:
    return table.filter(F.col("id") == F.lit(value))


def updated(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Jobs after updates (one per id at most): fields that an update has and does not leave null replace those of the job."""
    fields = [c for c in updates.columns if c != "id"]
    new = updates.select("id", *[F.col(c).alias(f"_{c}") for c in fields])
    told = [F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in jobs.columns]
    return jobs.join(new, "id", "left").select(*told) if fields else jobs


def appended(rows: DataFrame, path: str) -> DataFrame:
    """Adds the rows whose id is new to the table at a path, all of them or, where the job fails, none; gives the table."""
    table = Table(rows.sparkSession, path, rows.schema)
    table.append(rows)
    return table.read()


def created(requests: DataFrame, books: DataFrame, free_bytes: int, ready: Column) -> DataFrame:
    """A row per request (id, book_id, voice, speed): the queued job with its estimate, or why it is refused; ``books`` has id, title, total_chars."""
    told = requests.join(books.select(F.col("id").alias("book_id"), F.col("title").alias("_title"), F.col("total_chars").alias("_chars"), F.lit(True).alias("_known")), "book_id", "left")
    refused = F.when(~ready, "no engine").when(F.col("_known").isNull(), "no such book").when(F.col("_chars") * BYTES_PER_CHAR > free_bytes, "not enough disk space")
    taken = lambda c: F.when(F.col("refused").isNull(), c)
    seconds = F.col("_chars") / CHARS_PER_SECOND * OVERHEAD
    return told.withColumn("refused", refused).select("id", "book_id", taken(F.col("_title")).alias("book_title"), "voice", "speed", taken(F.lit("queued")).alias("status"), "refused", taken(seconds).alias("estimated_seconds"))


def with_book(jobs: DataFrame, books: DataFrame) -> DataFrame:
    """Jobs with their books; jobs without one do not occur (see ``orphans``)."""
    return jobs.join(books.withColumnRenamed("id", "book_id"), "book_id")


def orphans(jobs: DataFrame, books: DataFrame) -> DataFrame:
    return jobs.join(books.select(F.col("id").alias("book_id")), "book_id", "left_anti")


def to_do(chapters: DataFrame, done: DataFrame, keys: list[str], bits: int = MOST_BITS) -> DataFrame:
    """Chapters not built yet; with a content hash among the keys, changed ones are built again.

    Chapters that a Bloom filter of what is done does not know are to do and are never
    shuffled; the others, the done ones and a few more, are told apart by an exact
    anti-join. For that the chapters are read twice, which costs less than moving their
    texts. Null keys equal nothing, so their chapters are to do; an empty ``done`` leaves
    every chapter; keys whose types differ are only joined, since their hashes do.
    """
    ready = done.select(*keys).dropna()
    if any(chapters.schema[k].dataType != done.schema[k].dataType for k in keys):
        return chapters.join(ready, keys, "left_anti").select(*chapters.columns)
    told = perhaps_done(chapters, ready, keys, bits)
    new, met = told.filter("NOT perhaps").select("row.*"), told.filter("perhaps").select("row.*")
    return new.unionByName(met.join(ready, keys, "left_anti"))


def perhaps_done(chapters: DataFrame, ready: DataFrame, keys: list[str], bits: int = MOST_BITS) -> DataFrame:
    """row (a chapter as a struct, so that no column name clashes), perhaps: false where no row of ``ready`` has its keys, for sure.

    The filter is a bitmap of hashed keys in blocks of 4 KB, sent to all tasks. It has 16
    bits or more for each ready row, up to ``bits``: a limit on what is sent, not on what is
    done, since a fuller filter only says "perhaps" more often.
    """
    size = min(max(1 << (16 * ready.count() - 1).bit_length(), 1 << 15), bits)
    bit = F.pmod(F.xxhash64(*keys), F.lit(size))
    blocks = ready.select(F.bitmap_bucket_number(bit).alias("block"), F.bitmap_bit_position(bit).alias("bit"))
    blocks = F.broadcast(blocks.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap")))
    rows = chapters.select(F.struct(*chapters.columns).alias("row"), F.bitmap_bucket_number(bit).alias("block"), F.bitmap_bit_position(bit).alias("bit"))
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    # A byte is 0 to 255, so its bit k is the last one of its k-th halving.
    found = F.floor(byte / F.pow(F.lit(2), F.col("bit") % 8)) % 2 == 1
    return rows.join(blocks, "block", "left").select("row", F.coalesce(found, F.lit(False)).alias("perhaps"))


def with_chapters(books: DataFrame) -> DataFrame:
    """The chapters column parsed from its JSON text."""
    return books.withColumn("chapters", F.from_json("chapters_json", T.ArrayType(CHAPTER))).drop("chapters_json")


def chapters_json(chapters: Column) -> Column:
    return F.to_json(chapters)


def rejection(name: Column, size: Column, free: Column, encrypted: Column, n_chapters: Column) -> Column:
    """Why an upload is refused, or null: checks in the order in which they are made."""
    ext = F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))
    return (
        F.when(~ext.isin(*EXTENSIONS), "unsupported type")
        .when(size == 0, "empty file")
        .when(size > MAX_UPLOAD, "too large")
        .when(free < size * 3, "not enough disk space")
        .when(F.coalesce(encrypted, F.lit(False)), "protected")
        .when(n_chapters.isNull(), "cannot be parsed")
        .when(n_chapters == 0, "no chapters")
    )


def next_status(status: Column, action: Column) -> Column:
    """The state after an action, or null where the action is refused."""
    return F.when((action == "cancel") & ~status.isin(*TERMINAL), "cancelled").when((action == "retry") & (status != "done"), "queued").when((action == "download") & (status == "done"), "done")
