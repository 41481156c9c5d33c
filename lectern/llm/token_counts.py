"""Operator 9: token counts from pre-token frequencies.

A first pass sums the frequency of every distinct pre-token over the corpus, and
each is tokenized once. A second pass emits the pre-tokens of each document with
their frequency in it, which are joined to the counted ones by shuffle and summed.
So go nine tenths of the distinct pre-tokens or more, at every size of the corpus. The
most frequent ones, a tenth at most and never more than ``HELD``, are in nearly every
document: they are sent to all tasks, and their side of the join is a look-up where
the documents are. Token ids are never kept.

The pre-tokens are cut only where a byte-level BPE with the usual split pattern
cuts in any case: between a word and white space, before the last blank in front
of a word, and between letters and a plain mark. Strings of special tokens split
a text first and count as the library counts them.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows come
back as often as they came in; a null id is a valid row; very long texts are cut
whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.batches import slices, specials, tokenizer, vocabulary
from lectern.llm.common import table, written

#: The share of distinct pre-tokens that tasks may hold, the most frequent ones, and how many at most.
FREQUENT, HELD = 0.1, 1_000_000
#: Bytes of a pre-token that a task holds; longer ones are joined.
HELD_BYTES = 64
#: Distinct pre-tokens that a task gathers before it passes them on.
GATHERED = 300_000
LIMIT = 1024

_CUT = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[.,!?;:\s]|\Z)| ?\S+|\s+(?= \S)|\s+\S*")


def pre_tokens(text: str, special: re.Pattern) -> Counter:
    """Pre-tokens of a text with their frequencies; special strings are among them."""
    if not special.search(text):
        return Counter(_CUT.findall(text))
    found = Counter(special.findall(text))
    for part in special.split(text):
        found.update(_CUT.findall(part))
    return found


def _special(path: str) -> re.Pattern:
    return re.compile("|".join(map(re.escape, sorted(specials(path), key=len, reverse=True))) or r"(?!)")


def vocabulary_counts(texts: DataFrame, path: str) -> DataFrame:
    """piece, freq, n: every distinct pre-token of the one column, its corpus frequency and its number of tokens."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special, found = _special(path), Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["piece", "freq"])
            found.clear()
            return made

        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    found.update(pre_tokens(text.as_py(), special))
                if len(found) > GATHERED:
                    yield out()
        yield out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            for part in slices(batch, "piece", 1 << 20):
                n = [len(e) for e in t.encode_batch(part.column("piece").to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([part.column("piece"), part.column("freq"), pa.array(n, pa.int64())], ["piece", "freq", "n"])

    distinct = texts.mapInArrow(gather, "piece string, freq long").groupBy("piece").agg(F.sum("freq").alias("freq"))
    return distinct.mapInArrow(count, "piece string, freq long, n long")


def frequent(pieces: DataFrame) -> DataFrame:
    """The pieces that tasks hold."""
    share = max(1 - FREQUENT, 1 - HELD / max(1, pieces.count()))
    # Those of the border's own frequency are joined: there may be very many of them.
    border = pieces.agg(F.percentile_approx("freq", share, 1_000_000)).first()[0] or 0
    return pieces.filter((F.col("freq") > border) & (F.octet_length("piece") <= HELD_BYTES))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for every row."""
    spark = docs.sparkSession
    pieces = written(vocabulary_counts(docs.select(text_col), path))
    top = frequent(pieces).select("piece", "n").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(top["piece"].to_pylist(), top["n"].to_pylist(), strict=True)))

    def per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special, counts = _special(path), known.value
        for batch in batches:
            for part in slices(batch, "text"):
                ids, prints, sizes, firsts, rare, times = [], [], [], [], [], []
                for key, value in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    text = value or ""
                    raw = text.encode()
                    mark, total, left = xxhash.xxh3_64_intdigest(raw) >> 1, 0, []
                    for piece, freq in pre_tokens(text, special).items():
                        n = counts.get(piece)
                        if n is None:
                            left.append((piece, freq))
                        else:
                            total += n * freq
                    # A document without rare pre-tokens gets a key that meets nothing, so that such rows spread.
                    for k, (piece, freq) in enumerate(left or [(f"\x00 {mark}", 0)]):
                        ids.append(key)
                        prints.append(mark)
                        sizes.append(len(raw))
                        firsts.append(None if k else total)
                        rare.append(piece)
                        times.append(freq)
                arrays = [pa.array(ids, pa.int64()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()), pa.array(firsts, pa.int64()), pa.array(rare, pa.string()), pa.array(times, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "mark", "n_bytes", "base", "rare", "times"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(per_document, "id long, mark long, n_bytes long, base long, rare string, times long")
    joined = rows.join(pieces.select(F.col("piece").alias("rare"), "n"), "rare", "left")
    total = F.sum(F.coalesce("base", F.lit(0)) + F.col("times") * F.coalesce("n", F.lit(0)))
    summed = joined.groupBy("id", "mark").agg(F.max("n_bytes").alias("n_bytes"), F.count("base").alias("copies"), total.alias("total"))
    n_tokens = (F.col("total") / F.col("copies")).cast("long")
    return summed.select(F.col("id").alias(id_col), "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
