"""Operator 8: packing documents into sequences by cutting-stock column generation.

Every document is tokenized and ends with the end id; what exceeds the sequence
length is cut off in full pieces. The histogram of piece lengths (in classes of
``GRAIN`` tokens, so a few hundred numbers whatever the corpus) feeds a linear
program over packing patterns: its columns are priced by a knapsack dynamic
program, the pattern counts are rounded down and the few pieces left over are
packed first-fit. Pieces are then ranked within their class, and a rank says
which copy of which pattern a piece goes to; offsets are a running sum inside a
sequence.

Ranks come in two steps, over (class, cell) counts and then inside cells, so a
class may hold any share of the pieces.

Edge cases: a null or empty text is one piece that holds the end id; a null id
is a valid row; repeated rows are packed each for itself, and pieces that are alike in
all columns are interchangeable; very long texts give many full pieces; of patterns
that price alike the first is taken; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.batches import slices, specials, tokenizer, vocabulary
from lectern.llm.common import table, written

LENGTH = 4096
END_ID = 2
#: Tokens by which the linear program tells lengths apart.
GRAIN = 16
#: Simplex steps at most; any basis gives a valid packing.
MAX_STEPS = 4000
CELLS = 256
#: Distinct words whose ids a worker keeps.
CACHED = 400_000

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_LETTERS = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+")
_pools: dict = {}


class Pool:
    """Ids of the words that this worker has met, one after another in an array."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        names = self.tokenizer.get_vocab()
        self.last = np.zeros(max(names.values()) + 1, bool)
        self.last[[k for name, k in names.items() if name.endswith("</w>")]] = True
        self.names: dict[str, int] = {}
        self.flat, self.start, self.size, self.used = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def trim(self) -> None:
        """Leaves the words that came up most often, half of what fits at most."""
        least = int(np.partition(self.used, -CACHED // 2)[-CACHED // 2])
        kept = np.flatnonzero(self.used > least)
        size, new = self.size[kept], np.full(len(self.size), -1)
        new[kept] = np.arange(len(kept))
        self.names = {w: int(new[k]) for w, k in self.names.items() if new[k] >= 0}
        ends = np.cumsum(size)
        self.flat = self.flat[np.repeat(self.start[kept] - (ends - size), size) + np.arange(int(size.sum()))]
        self.start, self.size, self.used = ends - size, size, self.used[kept] // 2

    def add(self, words: list[str]) -> None:
        """Words of letters only are one pre-token, whose last piece the vocabulary marks: they are encoded as one text."""
        letters = [w for w in words if _LETTERS.fullmatch(w)]
        ids = np.array(self.tokenizer.encode(" ".join(letters), add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(letters):
            letters, ids, ends = [], ids[:0], ends[:0]
        done = set(letters)
        others = [w for w in words if w not in done]
        each = [e.ids for e in self.tokenizer.encode_batch(others, add_special_tokens=False)]
        size = np.concatenate([np.diff(ends, prepend=0), np.fromiter(map(len, each), np.int64, len(each))])
        self.names.update(zip(letters + others, range(len(self.size), len(self.size) + len(size)), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.used = np.concatenate([self.used, np.zeros(len(size), np.int32)])
        self.flat = np.concatenate([self.flat, ids, np.fromiter(chain.from_iterable(each), np.uint32, int(size[len(ends) :].sum()))])

    def places(self, words: list[str]) -> np.ndarray:
        if len(self.names) > CACHED:
            self.trim()
        missing = [w for w in words if w not in self.names]
        if missing:
            self.add(missing)
        found = np.fromiter(map(self.names.__getitem__, words), np.int64, len(words))
        self.used[found] += 1
        return found


def token_ids(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """Ids of each text.

    The vocabulary folds case and drops white space, so the words between blanks
    and line ends are independent, and a single mark after a letter is too.
    """
    if path not in _pools:
        _pools[path] = Pool(path)
    pool = _pools[path]
    texts = pc.fill_null(texts, "")
    odd = np.zeros(len(texts), bool)
    for s in specials(path):
        odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
    plain = pc.replace_substring(pc.ascii_lower(pc.if_else(pa.array(odd), "", texts)), "\n", " ")
    lists = pc.split_pattern(pc.replace_substring_regex(plain, r"([a-zÀ-ÖØ-öø-ÿ])([.,!?;:])( )", r"\1 \2\3"), " ")
    coded = lists.flatten().dictionary_encode()
    place = pool.places(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
    each = pool.size[place]
    ends = np.cumsum(each)
    out = pool.flat[np.repeat(pool.start[place] - (ends - each), each) + np.arange(int(each.sum()))]
    bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    for k in range(len(texts)):
        yield np.array(tokenizer(path).encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32) if odd[k] else out[bounds[k] : bounds[k + 1]]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: full pieces and the rest of each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], "<u4")
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                rows: list[tuple] = []
                for key, ids in zip(part.column("doc_id").to_pylist(), token_ids(part.column("text"), path), strict=True):
                    raw = memoryview(np.concatenate([ids.astype("<u4"), end]).tobytes())
                    n = len(raw) // 4
                    rows += [(key, s, min(LENGTH, n - s), zlib.crc32(raw[4 * s : 4 * (s + LENGTH)]), n) for s in range(0, n, LENGTH)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, _PIECES)


def knapsack(value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Most value of classes (class k takes k + 1 units) that fit in ``room`` units, and how many of each."""
    best, last = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for c in range(1, room + 1):
        k = min(c, len(value))
        tried = best[c - 1 :: -1][:k] + value[:k] if c - k == 0 else best[c - k : c][::-1] + value[:k]
        at = int(tried.argmax())
        best[c], last[c] = (tried[at], at + 1) if tried[at] > best[c - 1] else (best[c - 1], 0)
    counts, c = np.zeros(len(value), np.int64), room
    while c > 0:
        if last[c]:
            counts[last[c] - 1] += 1
        c -= last[c] or 1
    return float(best[room]), counts


def patterns(need: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with their whole multiplicities that hold exactly ``need`` pieces of each class."""
    used = np.flatnonzero(need)
    if not len(used):
        return []
    fit = room // (used + 1)
    columns, inverse = np.diag(fit.astype(float)), np.diag(1 / fit)
    goal = need[used].astype(float)
    level = inverse @ goal
    for _ in range(MAX_STEPS):
        value = np.zeros(room)
        value[used] = np.ones(len(used)) @ inverse
        worth, counts = knapsack(np.maximum(value, 0), room)
        if worth <= 1 + 1e-9:
            break
        step = inverse @ counts[used]
        ratio = np.where(step > 1e-12, level / np.where(step > 1e-12, step, 1), np.inf)
        out = int(ratio.argmin())
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        columns[:, out] = counts[used]
        level = np.maximum(inverse @ goal, 0)
    made, left = [], need.astype(np.int64).copy()
    for k, x in enumerate(level):
        pattern = np.zeros(room, np.int64)
        pattern[used] = np.rint(columns[:, k])
        held = pattern > 0
        if held.any() and (times := min(int(x + 1e-9), int((left[held] // pattern[held]).min()))):
            made.append((pattern, times))
            left -= pattern * times
    # Rounding leaves fewer pieces than there are patterns times pieces in one: first fit, longest first.
    bins: list[list] = []
    for k in np.flatnonzero(left)[::-1]:
        for _ in range(left[k]):
            fits = next((b for b in bins if b[0] >= k + 1), None)
            if fits is None:
                bins.append(fits := [room, np.zeros(room, np.int64)])
            fits[0] -= k + 1
            fits[1][k] += 1
    return made + [(b[1], 1) for b in bins]


def slots(need: np.ndarray, room: int) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, rank after the last, first sequence, pieces of the class in a sequence, first slot)."""
    rows, sequence, rank = [], 0, np.zeros(room, np.int64)
    for pattern, times in patterns(need, room):
        slot = 0
        for k in np.flatnonzero(pattern)[::-1]:
            n = int(pattern[k])
            rows.append((int(k) + 1, int(rank[k]), int(rank[k]) + n * times, sequence, n, slot))
            rank[k] += n * times
            slot += n
        sequence += times
    return rows


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces with their sequence and offset."""
    spark = docs.sparkSession
    kind = F.ceil(F.col("length") / GRAIN).cast("int")
    # The mark tells pieces apart that are alike, so that they spread over cells, too.
    cut = written(pieces(docs, path, id_col, text_col).withColumns({"kind": kind, "mark": F.pmod(F.monotonically_increasing_id(), F.lit(CELLS)).cast("int")}))
    need = np.zeros(LENGTH // GRAIN, np.int64)
    for k, n in cut.groupBy("kind").count().collect():
        need[k - 1] = n
    plan = spark.createDataFrame(slots(need, len(need)), "kind int, low long, high long, sequence0 long, each long, slot0 long")
    cut = cut.withColumn("cell", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "mark"), F.lit(CELLS * max(1, int(need.max()) // 5_000_000 + 1))))
    ahead = cut.groupBy("kind", "cell").count().withColumn("ahead", F.coalesce(F.sum("count").over(W.partitionBy("kind").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    inside = W.partitionBy("kind", "cell").orderBy("doc_id", "start", "ids_crc32", "doc_tokens", "mark")
    ranked = cut.join(ahead, ["kind", "cell"]).withColumn("rank", F.col("ahead") + F.row_number().over(inside) - 1)
    # The plan is bounded by the classes: at most as many rows as classes times pieces in a pattern.
    placed = ranked.join(F.broadcast(plan), (ranked["kind"] == plan["kind"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    placed = placed.withColumn("sequence_id", F.col("sequence0") + F.floor(nth / F.col("each"))).withColumn("slot", F.col("slot0") + nth % F.col("each"))
    before = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of its documents in sequences."""
    return pack(docs, vocabulary("word_bpe_49k.json"))
