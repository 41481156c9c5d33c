"""PDF inputs: page texts come from outside (no reader is at hand), files are only checked for encryption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.rules import strip
from lectern.operators.timing import title_or


def encrypted(content: Column) -> Column:
    """Whether a file names an encryption dictionary as trailers do: by reference or in place; an approximation that a reader would refine."""
    return F.coalesce(F.decode(content, "ISO-8859-1").rlike(r"/Encrypt\s*(?:\d+\s+\d+\s+R|<<)"), F.lit(False))


def pages(rows: DataFrame) -> DataFrame:
    """book, page_no, text: a page that could not be read is empty, not missing."""
    return rows.select("book", "page_no", F.coalesce("text", F.lit("")).alias("text"))


def books(info: DataFrame, stem: str = "book") -> DataFrame:
    """book, title, author from the info dictionaries (book, title, author)."""
    return info.select("book", title_or(strip(F.col("title")), F.lit(stem)).alias("title"), title_or(strip(F.col("author")), F.lit("Unknown")).alias("author"))
