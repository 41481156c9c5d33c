"""Operator 11: vector codes from product codebooks, nearest entries by VA-file filtering.

Vectors of whole numbers are cut into equal consecutive parts; each part position has a
codebook, improved in rounds: every part goes to its nearest entry, then each entry becomes
the floor of the mean of its parts. The nearest entry is found as in a vector approximation
file: each coordinate of the entries is quantised to a cell of four bits; for a part one
look-up table has the least and the most squared distance of each coordinate to each cell,
and sums over the table bound the distance to every entry from both sides. Only entries
whose lower bound does not exceed the least upper bound are refined, by distances of whole
numbers. The sums over the table are products with the one-hot cells of the entries, exact
in floats below 2**53; larger components are worked out in Python integers.

A round reads the vectors where they lie. A task adds up its parts for each entry and
passes on those sums once; the codebooks, a fixed number of entries, are all that reaches
the driver. Totals of labels are aggregated first and sent to all tasks if they are few
(``LABELS``), else joined by shuffle.

Edge cases: vectors that are null or hold null or non-finite components are dropped;
vectors of another length than that of the smallest id (and empty ones) come back with null
code and error and count nowhere; a length that the parts do not divide is an error; fewer
vectors than entries make a smaller codebook; equal distances go to the lower index; of
vectors with one id the smaller one is first in the codebook, null ids are last; repeated
rows count as often as they come; null labels are one label; errors beyond 64 bits raise;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import table, written

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Cells of a coordinate: four bits.
CELLS = 16
#: Parts that are compared with all entries at a time.
SLICE = 1024
#: Totals of labels that are sent to all tasks; more are joined by shuffle.
LABELS = 10_000


class Cells:
    """The entries of a codebook, each coordinate quantised to a cell with a least and a most value."""

    def __init__(self, entries: np.ndarray):
        self.entries, (m, d) = entries, entries.shape
        n = min(CELLS, m)
        self.low, self.high = np.empty((d, n), entries.dtype), np.empty((d, n), entries.dtype)
        self.hot = np.zeros((d * n, m))
        for j in range(d):
            order = np.argsort(entries[:, j], kind="stable")
            cell = np.arange(m) * n // m
            first = np.searchsorted(cell, np.arange(n))
            self.low[j], self.high[j] = entries[order[first], j], entries[order[np.append(first[1:], m) - 1], j]
            self.hot[j * n + cell, order] = 1

    def bounds(self, x: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """The least and the most squared distance of each part to each entry."""
        x, low, high, hot = x[:, :, None].astype(kind), self.low.astype(kind), self.high.astype(kind), self.hot.astype(int).astype(kind)
        near, far = np.maximum(np.maximum(low - x, x - high), 0), np.maximum(x - low, high - x)
        flat = (len(x), -1) if low.size else (len(x), 0)
        return (near * near).reshape(flat) @ hot, (far * far).reshape(flat) @ hot

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the nearest entry of each part, and the squared distance."""
        reach = int(max(abs(int(v)) for a in (x, self.low, self.high) for v in (a.max(initial=0), a.min(initial=0))))
        safe = (2 * reach) ** 2 * max(1, x.shape[1]) < 2**53
        index, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64 if safe else object)
        for at in range(0, len(x), SLICE):
            part = x[at : at + SLICE]
            lower, upper = self.bounds(part, float if safe else object)
            row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
            apart = (part[row] - self.entries[entry]) if safe else part[row].astype(object) - self.entries[entry].astype(object)
            exact = (apart * apart).sum(axis=1)
            begins = np.searchsorted(row, np.arange(len(part)))
            least = np.minimum.reduceat(exact, begins)
            # Candidates of a part come in the order of entries: the first at least distance has the lowest index.
            hit = np.flatnonzero(exact == least[row])
            _, first = np.unique(row[hit], return_index=True)
            index[at : at + SLICE], far[at : at + SLICE] = entry[hit[first]], least
        return index, far


def whole(x: np.ndarray) -> np.ndarray:
    """Components times the scale, all floors down, as whole numbers of any size."""
    scaled = np.floor(x.astype(float) * SCALE)
    if np.abs(scaled).max(initial=0) < 2.0**62:
        return scaled.astype(np.int64)
    return np.array([[int(v) for v in r] for r in scaled], object).reshape(scaled.shape)


def read(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with a vector without nulls and non-finite components; which of them have ``dim`` components; these as whole numbers."""
    vectors = batch.column("v")
    size = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    held = np.maximum(size, 0)
    bad = np.bincount(np.repeat(np.arange(len(size)), held)[~np.isfinite(values)], minlength=len(size))
    usable = np.flatnonzero((size >= 0) & (bad == 0))
    like = size[usable] == dim if dim else np.zeros(len(usable), bool)
    starts = (np.cumsum(held) - held)[usable[like]]
    return usable, like, whole(values[starts[:, None] + np.arange(dim)])


def _sums(rows: DataFrame, books: list[np.ndarray]) -> dict[tuple[int, int, int], int]:
    """Of each part position and entry the sums of its parts by component, and as component -1 their number."""
    dim = sum(b.shape[1] for b in books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        total, count = [np.zeros(b.shape, object) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            _, _, x = read(batch, dim)
            for p, part in enumerate(np.split(x, PARTS, axis=1)):
                index, _ = cells[p].nearest(part)
                order = np.argsort(index, kind="stable")
                used, first = np.unique(index[order], return_index=True)
                if len(used):
                    total[p][used] += np.add.reduceat(part[order], first, axis=0).astype(object)
                    count[p] += np.bincount(index, minlength=len(count[p]))
        keys, values = [], []
        for p, (t, c) in enumerate(zip(total, count, strict=True)):
            for e in np.flatnonzero(c).tolist():
                keys += [(p, e, k) for k in range(-1, t.shape[1])]
                values += [int(c[e]), *t[e].tolist()]
        part, entry, k = zip(*keys, strict=True) if keys else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(k, pa.int32()), pa.array(values, pa.int64())], ["part", "entry", "k", "value"])

    summed = rows.select("v").mapInArrow(add, "part int, entry int, k int, value long").groupBy("part", "entry", "k").agg(F.sum("value").alias("value"))
    return {(r.part, r.entry, r.k): r.value for r in summed.collect()}


def trained(rows: DataFrame) -> list[np.ndarray]:
    """The codebook of each part position (rows: id, v); none where no vector is usable."""
    x = F.col("v")
    usable = rows.select("id", "v").filter(F.size("v") > 0).filter(~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    in_order = [F.col("id").asc_nulls_last(), "v"]
    smallest = usable.orderBy(*in_order).select(F.size("v")).first()
    if smallest is None:
        return []
    if smallest[0] % PARTS:
        raise ValueError(f"vectors of {smallest[0]} components have no {PARTS} equal parts")
    seeds = usable.filter(F.size("v") == smallest[0]).orderBy(*in_order).limit(ENTRIES).select("v").collect()
    books = np.split(whole(np.array([r.v for r in seeds], float)), PARTS, axis=1)
    for _ in range(ROUNDS):
        sums = _sums(rows, books)
        made = [[[sums[p, e, k] // sums[p, e, -1] for k in range(b.shape[1])] if (p, e, -1) in sums else b[e].tolist() for e in range(len(b))] for p, b in enumerate(books)]
        books = [np.array(m, b.dtype) for m, b in zip(made, books, strict=True)]
    return books


def coded(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """id, label, code (a byte for each part), error: the nearest entries of every usable vector."""
    dim = sum(b.shape[1] for b in books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        for batch in batches:
            usable, like, x = read(batch, dim)
            found = [c.nearest(part) for c, part in zip(cells, np.split(x, PARTS, axis=1), strict=False)]
            codes, errors = np.full(len(usable), None, object), np.full(len(usable), None, object)
            if found:
                codes[like] = [bytes(c).hex() for c in np.stack([index for index, _ in found], axis=1).astype(np.uint8)]
                errors[like] = sum(far.astype(object) for _, far in found)
            kept = batch.take(pa.array(usable))
            yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select("id", "label", "v").mapInArrow(assign, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """id, code, error, label_error for every usable vector; and the codebooks."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    books = trained(rows)
    codes = written(coded(rows, books))
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    totals = totals.select(F.col("label").alias("l"), "label_error")
    few = totals.limit(LABELS + 1).count() <= LABELS
    joined = codes.join(F.broadcast(totals) if few else totals, F.col("label").eqNullSafe(F.col("l")), "left")
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error"), books


def fingerprint(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for e in b for v in e).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes(table(spark, sf_dir, "embeddings"))
    return codes.withColumn("codebooks_sha256", F.lit(fingerprint(books)))


def _sql() -> str:
    """The same in SQL: one common table expression for each step of each round."""
    distance = "list_sum(list_transform(list_zip(p.x, e.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, v) - 1 AS r, vec_id, label, list_transform(v, lambda c: floor(1024 * c)::BIGINT) AS w FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) WHERE v IS NOT NULL AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        "parts AS MATERIALIZED (SELECT r, k AS p, w[1 + k * len(w) // 4 : (k + 1) * len(w) // 4] AS x FROM kept, range(4) t(k))",
        "b0 AS MATERIALIZED (SELECT p, r AS e, x FROM parts WHERE r < 256)",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, p, s.e AS e, s.d AS d FROM (SELECT p.r, p.p, min({{'d': {distance}, 'e': e.e}}) AS s FROM parts p JOIN b{k} e ON p.p = e.p GROUP BY p.r, p.p))")
        if k < ROUNDS:
            means = f"SELECT a.p, a.e, u.i, (sum(p.x[u.i]) // count(*) - (sum(p.x[u.i]) < 0 AND sum(p.x[u.i]) % count(*) <> 0)::INT)::BIGINT AS m FROM a{k} a JOIN parts p ON a.r = p.r AND a.p = p.p, unnest(range(1, len(p.x) + 1)) u(i) GROUP BY ALL"
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS x FROM ({means}) GROUP BY p, e) m USING (p, e))")
    last = f"a{ROUNDS}"
    steps.append(f"coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM {last} GROUP BY r)")
    steps.append(f"book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM b{ROUNDS})")
    return "WITH " + ", ".join(steps) + " SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (r), book"


SQL = _sql()
