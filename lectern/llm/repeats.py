"""Operator 12: repeated passages by a depth-limited radix sort of suffixes.

A passage is any string of ``width`` bytes that starts earlier too (in a smaller id, or
earlier in the same text). The suffixes that begin such strings are ordered only through
``width`` bytes, by passes over ever longer digits, and a bucket that one suffix has to
itself is never looked at again. Neighbouring suffixes travel as one row, a run, as long
as the digit that they share settles them together:

1. The digit of a run is a gram of a third of the width: the one of least hash in all
   strings of the run, so equal strings have the same gram at the same offset.
2. Runs of buckets with several contexts are cut into blocks of eight offsets. Their
   digit is all that the strings of a block have in common, ``width - 7`` bytes.
3. Blocks of such buckets are cut into single suffixes, whose digit is the whole string.

In every pass rows are range-sorted by (digit, context, place). Rows of one context (all
bytes of their strings) are copies of each other: all but the first are repeated. The
first goes on to the next pass if its bucket has other contexts, else it is the earliest
of its strings. Since the place is part of the sort key, a bucket of any size is spread
over as many partitions as it needs, and each is read as a stream; a bucket at the border
of a partition goes on, and those of the last pass are settled by comparing borders. Digits
are compared by hashes, strings by 128 bits of them. Texts are shuffled twice: to cut the
blocks, and to take out what is repeated.

Edge cases: a null text counts as empty; texts shorter than the width have no strings;
rows that repeat id and text are one document, judged once, and come back as often as they
came in; different texts of one id come in the order of 18 bits of a hash, which tell them
apart; a null id comes before all others; a text of any length (below 2 GB) is hashed in
parts of bounded size; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.batches import slices
from lectern.llm.common import discard, table, written

WIDTH = 100
#: Offsets of a block.
BLOCK = 8
#: Bytes that are hashed at a time.
PART = 1 << 21
#: Bits of the offsets of a run, and of the place of its gram.
_OFFSET, _PLACE = 7, 31
_NO_ID = -(2**63)
_ROW = "digit long, context long, id long, low long"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ (b >> np.uint64(31))))


class Hashes:
    """Hashes of all strings of some lengths (8 bytes or more) in a text, each made of two shorter ones."""

    def __init__(self, raw: np.ndarray):
        padded = np.concatenate([raw, np.zeros(8, np.uint8)])
        self.known = {8: _mixed(np.ndarray(len(raw), "<u8", padded, 0, (1,)).astype(np.uint64))}

    def of(self, length: int) -> np.ndarray:
        """At each place the hash of the ``length`` bytes there; the last ``length - 1`` mean nothing."""
        if length not in self.known:
            half = 1 << ((length - 1).bit_length() - 1)
            of_half = self.of(half)
            by = length - half
            self.known[length] = _paired(of_half, np.concatenate([of_half[by:], of_half[:by]]) if by < len(of_half) else of_half)
        return self.known[length]


def gram_of(width: int) -> int:
    if width < 16:
        raise ValueError("passages have 16 bytes at least")
    return max(8, width * 32 // 100, width - (1 << _OFFSET) + 1)


def least(x: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` neighbours."""
    done = 1
    while done < span and len(x):
        by = min(done, span - done)
        x = np.minimum(x[:-by], x[by:])
        done += by
    return x


def runs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """digit, context, text, place of the gram in it, largest and smallest offset: the runs of all texts in a buffer."""
    gram, made = gram_of(width), []
    for at in range(0, len(raw), PART):
        part = raw[at : at + PART + width - 1]
        if len(part) < width:
            break
        h = Hashes(part)
        digit, whole = h.of(gram), h.of(width)
        order = (digit & ~np.uint64((1 << 24) - 1)) | np.arange(len(part), dtype=np.uint64)
        first = least(order[: len(part) - gram + 1], width - gram + 1)
        edges = np.zeros(len(first) + 1, np.int8)
        own = ends - starts >= width
        np.add.at(edges, np.clip(starts[own] - at, 0, len(first)), 1)
        np.add.at(edges, np.clip(ends[own] - width + 1 - at, 0, len(first)), -1)
        s = np.flatnonzero(np.cumsum(edges[:-1], dtype=np.int8))
        if not len(s):
            continue
        p = (first[s] & np.uint64((1 << 24) - 1)).astype(np.int64)
        new = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        low, high, p = s[new], s[np.append(new[1:] - 1, len(s) - 1)], p[new]
        text = np.searchsorted(starts, low + at, side="right") - 1
        context = _paired(_paired(whole[low], whole[high]), ((p - low) << _OFFSET | (p - high)).astype(np.uint64))
        made.append((digit[p].view(np.int64), context.view(np.int64), text, p + at - starts[text], p - low, p - high))
    return tuple(map(np.concatenate, zip(*made, strict=True))) if made else tuple(np.zeros(0, np.int64) for _ in range(6))


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and ends."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    # Empty texts begin where the next one does; they have no places of their own.
    return raw, offsets[:-1] - offsets[0], offsets[1:] - offsets[0]


def _packed(mark: np.ndarray, place: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """One number that orders runs of an id by text and place."""
    return ((mark << _PLACE | place) << _OFFSET | high) << _OFFSET | low


def _unpacked(low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return low >> 2 * _OFFSET & (1 << _PLACE) - 1, low >> _OFFSET & (1 << _OFFSET) - 1, low & (1 << _OFFSET) - 1


def _mark(low: str | Column) -> Column:
    return F.shiftrightunsigned(low, 2 * _OFFSET + _PLACE)


def run_rows(docs: DataFrame, width: int) -> DataFrame:
    """digit, context, id, low: all runs of the texts (columns id, mark, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART):
                raw, starts, ends = _buffer(part.column("text"))
                ids, marks = (part.column(c).to_numpy() for c in ("id", "mark"))
                digit, context, text, place, high, low = runs(raw, starts, ends, width)
                yield pa.RecordBatch.from_arrays([pa.array(digit), pa.array(context), pa.array(ids[text]), pa.array(_packed(marks[text], place, high, low))], ["digit", "context", "id", "low"])

    return docs.select("id", "mark", "text").mapInArrow(cut, _ROW)


def settled(rows: DataFrame, alone: bool = False) -> DataFrame:
    """The rows of a pass that are settled as ``repeated``, or go on (not repeated).

    With ``alone`` a context is a bucket of its own, so only those at borders go on.
    """
    names = rows.columns

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # ``opened``: the row that opened the bucket at hand, until another context shows that it goes on.
        last = opened = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(4)])
            begins, last = last is None, keys[:, :1] ^ np.int64(1) if last is None else last
            same = keys == np.concatenate([last, keys[:, :-1]], axis=1)
            last = keys[:, -1:]
            same_context = same[0] & same[1]
            copies = same_context & ~(same[2] & same[3])
            parts = [(batch.take(pa.array(np.flatnonzero(copies))), True)]
            first = np.flatnonzero(~same_context)
            if len(first):
                joins = (same_context if alone else same[0])[first]
                if opened is not None and joins[0]:
                    parts.append((opened, False))
                goes_on = joins | np.append(joins[1:], False)
                goes_on[0] |= begins
                parts.append((batch.take(pa.array(first[goes_on])), False))
                opened = None if goes_on[-1] else batch.slice(int(first[-1]), 1)
            for part, repeated in parts:
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, repeated))], [*names, "repeated"])
        if opened is not None:
            yield pa.RecordBatch.from_arrays([*opened.columns, pa.array([False])], [*names, "repeated"])

    order = ["digit", "context", "id", "low"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(walk, f"{fields}, repeated boolean")


def lists(rows: DataFrame) -> DataFrame:
    """id, mark, lows: the runs of each text."""
    return rows.groupBy("id", _mark("low").alias("mark")).agg(F.collect_list("low").alias("lows"))


def _lows(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The runs of all texts of a batch, and the text of each."""
    lows = part.column("lows")
    sizes = lows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lows.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)


def block_rows(docs: DataFrame, width: int) -> DataFrame:
    """digit, context, id, low, strings: the runs of each text (column lows) in blocks, with the hashes of their strings."""
    core = width - BLOCK + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART):
                raw, starts, _ = _buffer(part.column("text"))
                ids, marks = (part.column(c).to_numpy() for c in ("id", "mark"))
                low, text = _lows(part)
                place, high, small = _unpacked(low)
                n = high // BLOCK - small // BLOCK + 1
                which = np.repeat(np.arange(len(n)), n)
                block = (small // BLOCK)[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                text, place, high, small = text[which], place[which], np.minimum(high[which], block * BLOCK + BLOCK - 1), np.maximum(small[which], block * BLOCK)
                p = place + starts[text]
                begin = p - high
                order = np.argsort(begin, kind="stable")
                for at in range(0, len(raw), PART):
                    mine = order[slice(*np.searchsorted(begin, [at, at + PART], sorter=order))]
                    if not len(mine):
                        continue
                    h = Hashes(raw[at : at + PART + 2 * width + BLOCK])
                    whole, q, hi, lo, b = h.of(width), p[mine] - at, high[mine], small[mine], block[mine] * BLOCK
                    digit = _paired(h.of(core)[q - b], b.astype(np.uint64))
                    context = _paired(_paired(whole[q - hi], whole[q - lo]), (hi << _OFFSET | lo).astype(np.uint64))
                    offset = np.clip(b[:, None] + np.arange(BLOCK), lo[:, None], hi[:, None])
                    strings = pa.Array.from_buffers(pa.binary(), len(mine), [None, pa.py_buffer(np.arange(len(mine) + 1, dtype=np.int32) * (8 * BLOCK)), pa.py_buffer(np.ascontiguousarray(whole[q[:, None] - offset]))])
                    arrays = [pa.array(digit.view(np.int64)), pa.array(context.view(np.int64)), pa.array(ids[text[mine]]), pa.array(_packed(marks[text[mine]], place[mine], hi, lo)), strings]
                    yield pa.RecordBatch.from_arrays(arrays, ["digit", "context", "id", "low", "strings"])

    return docs.select("id", "mark", "text", "lows").mapInArrow(cut, f"{_ROW}, strings binary")


def single_rows(blocks: DataFrame) -> DataFrame:
    """digit, context, id, low: each string of the blocks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            digit, ids, low = (batch.column(c).to_numpy() for c in ("digit", "id", "low"))
            strings = np.frombuffer(b"".join(batch.column("strings").to_pylist()), np.int64).reshape(-1, BLOCK)
            _, high, small = _unpacked(low)
            offset = (small // BLOCK * BLOCK)[:, None] + np.arange(BLOCK)
            row, k = np.nonzero((offset >= small[:, None]) & (offset <= high[:, None]))
            o = offset[row, k]
            packed = low[row] >> 2 * _OFFSET << 2 * _OFFSET | o << _OFFSET | o
            yield pa.RecordBatch.from_arrays([pa.array(digit[row]), pa.array(strings[row, k]), pa.array(ids[row]), pa.array(packed)], ["digit", "context", "id", "low"])

    return blocks.select("digit", "id", "low", "strings").mapInArrow(cut, _ROW)


def _later(borders: DataFrame) -> DataFrame:
    """All but the first row of each context: few rows, two of a partition at most."""
    places = F.array_sort(F.collect_set(F.struct("id", "low")))
    rest = borders.groupBy("digit", "context").agg(places.alias("places")).filter(F.size("places") > 1)
    return rest.select(F.explode(F.slice("places", 2, 2**31 - 1)).alias("p")).select("p.id", "p.low")


def spans(places: np.ndarray, width: int) -> np.ndarray:
    """The maximal runs of bytes (rows of start, end) that the strings of some runs cover."""
    place, high, low = _unpacked(places)
    order = np.argsort(place - high, kind="stable")
    start, end = (place - high)[order], np.maximum.accumulate((place - low + width)[order])
    new = np.flatnonzero(np.append(True, start[1:] > end[:-1])) if len(start) else np.zeros(0, np.int64)
    return np.stack([start[new], end[np.append(new[1:] - 1, len(end) - 1)] if len(new) else new], axis=1)


def repeated_runs(docs: DataFrame, width: int) -> tuple[DataFrame, list[DataFrame]]:
    """id, low: runs all of whose strings start earlier too; and the tables that this reads."""
    first = written(settled(run_rows(docs, width)))
    candidates = lists(first.filter("not repeated").select("id", "low"))
    blocks = written(settled(block_rows(docs.join(candidates, ["id", "mark"]), width)))
    last = written(settled(single_rows(blocks.filter("not repeated")), alone=True))
    found = [t.filter("repeated").select("id", "low") for t in (first, blocks, last)]
    return found[0].unionAll(found[1]).unionAll(found[2]).unionAll(_later(last.filter("not repeated"))), [first, blocks, last]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, spans (start, end of each removed run), kept (the bytes left) for every row."""
    gram_of(width)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("own"), text.alias("text"))
    rows = rows.select("own", F.coalesce("own", F.lit(_NO_ID)).alias("id"), F.shiftrightunsigned(F.xxhash64("text"), 46).alias("mark"), "text")
    found, tables = repeated_runs(rows, width)
    removed = written(lists(found))
    discard(*tables)

    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART):
                raw, starts, ends = _buffer(part.column("text"))
                low, text_of = _lows(part)
                at = np.searchsorted(text_of, np.arange(part.num_rows + 1))
                sizes, gone, cuts, kept = (ends - starts).tolist(), [], [], []
                for k in range(part.num_rows):
                    own = raw[starts[k] : ends[k]]
                    cut = spans(low[at[k] : at[k + 1]], width)
                    gone.append(int((cut[:, 1] - cut[:, 0]).sum()))
                    cuts.append([{"start": a, "end": b} for a, b in cut.tolist()])
                    edges = [0, *cut.ravel().tolist(), len(own)]
                    kept.append(b"".join(own[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True)))
                cut_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                arrays = [part.column("own"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(c) for c in cuts], pa.int64()), pa.array(cuts, cut_type), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["own", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    cleaned = rows.join(removed, ["id", "mark"], "left").select("own", "text", "lows").mapInArrow(take_out, "own long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary")
    return cleaned.withColumnRenamed("own", id_col)


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of what is left of each document."""
    cleaned = without_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The same in SQL: all strings by their hash (from blocks of the texts in hexadecimal), gaps and islands.
SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
q AS (SELECT r, k, substr(h, 400 * k + 1, 598) AS h FROM d, unnest(range(0, (length(h) // 2 - 100) // 200 + 1)) u(k) WHERE length(h) >= 200),
w AS MATERIALIZED (SELECT r, 200 * k + p AS p, md5_number(substr(h, 2 * p + 1, 200)) AS s FROM q, unnest(range(0, least(200, length(h) // 2 - 99))) u(p)),
m AS (SELECT s, min(r * 4294967296 + p) AS f FROM w GROUP BY s HAVING count(*) > 1),
g AS (SELECT r, p FROM w JOIN m USING (s) WHERE r * 4294967296 + p > f),
i AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS k FROM (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new FROM g)),
t AS (SELECT r, k, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY r, k),
e AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM t),
c AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM e JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN c USING (r)
"""
