"""Operator 7: exact top-k inner products by pivot-table elimination.

Vectors become whole numbers. A table holds the Euclidean distances of each to many
pivots, measured once; by nearest pivot and distance to it the vectors are
range-partitioned into blocks. For a query and a candidate the largest difference of
their pivot distances is a lower bound of their distance, hence an upper bound of
their inner product. A query first meets its own block, which gives it a k-th score
to begin with. It then meets the other blocks: a block of queries is sent only to
blocks of candidates that some bound lets reach such a score, and there the
candidates of each query are evaluated in bound order until no bound can reach its
k-th score. The best of all blocks are merged. Pivots (a bounded number, found by
vector hash) and blocks only affect speed.

A block has about so many components (``BLOCK``), whatever the number of vectors, so
a task holds two blocks of bounded size; equal vectors are spread by id.

Edge cases: vectors that are null or hold null or non-finite components take no
part; vectors of different lengths are not compared, and those of another length than
the pivots', or with components whose products could leave 53 bits, are met without
bounds, the latter as Python integers (scores beyond 64 bits are an error); long
vectors make blocks of few rows; rows that repeat both id and vector count once, and
different vectors with one id are candidates each but never of a query with that id;
ties go to the smaller id; a query with fewer than k candidates gets all; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import table, written

K = 5
EVERY = 50
SCALE = 256
PIVOTS = 48
#: Components of a block of candidates at most (32 MB), and rows at least where there are so many.
BLOCK, LEAST_ROWS = 1 << 22, 2048
#: Blocks that the vectors are cut into before they grow, and blocks of queries.
SPREAD, QUERY_SPREAD = 32, 4
#: Rows of a block of queries at least.
LEAST_QUERIES = 512
#: Pivots whose distances bound whole blocks.
COARSE = 16
#: Candidates evaluated at first in bound order; then sixteen times as many each time.
RUN = 128
_OUT = "query_id long, vec_id long, score long"
_TABLE = "id long, v array<long>, dim int, far array<double>, cell int, near double"


def whole(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (array of long), dim: the usable vectors as whole numbers."""
    x = F.col("v")
    usable = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(usable)
    return rows.select("id", F.transform("v", lambda e: F.floor(e * SCALE)).alias("v"), F.size("v").alias("dim"))


def choose_pivots(vectors: DataFrame) -> np.ndarray | None:
    """Up to ``PIVOTS`` vectors of the commonest kind by hash, a bounded number."""
    rows = vectors.orderBy(F.xxhash64("v"), "id").limit(4 * PIVOTS).select("v").collect()
    if not rows:
        return None
    sizes = [len(r[0]) for r in rows]
    kept = [r[0] for r in rows if len(r[0]) == max(set(sizes), key=sizes.count)]
    unique = np.unique(np.array(kept, float), axis=0)
    # Farthest-first: spread pivots bound better.
    chosen, far = [0], np.linalg.norm(unique - unique[0], axis=1)
    while len(chosen) < min(PIVOTS, len(unique)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(unique - unique[chosen[-1]], axis=1))
    return unique[chosen]


def chain(pivots: np.ndarray) -> np.ndarray:
    """A number for each pivot by which near pivots are neighbours: each is followed by the nearest one left."""
    number, left, at = np.zeros(len(pivots), np.int32), set(range(1, len(pivots))), 0
    for k in range(1, len(pivots)):
        at = min(left, key=lambda p: (float(((pivots[p] - pivots[at]) ** 2).sum()), p))
        left.remove(at)
        number[at] = k
    return number


def exact(v: np.ndarray) -> np.ndarray:
    """Whether inner products of a row with any other such row are exact in floats."""
    return np.abs(v).max(axis=1, initial=0).astype(float) ** 2 * v.shape[1] < 2.0**52


def pivot_table(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The vectors with their distances to all pivots (``far``; empty where there can be none), the number of the nearest one and its distance."""
    number = chain(pivots)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            far, cell, near = [np.zeros(0)] * len(batch), np.zeros(len(batch), np.int32), np.zeros(len(batch))
            like = np.flatnonzero(batch["dim"].to_numpy() == pivots.shape[1])
            if len(like):
                v = np.stack(batch["v"].to_numpy()[like])
                like, v = like[exact(v)], v[exact(v)].astype(float)
                all_far = np.stack([np.sqrt(((v - p) ** 2).sum(axis=1)) for p in pivots], axis=1)
                cell[like], near[like] = number[all_far.argmin(axis=1)], all_far.min(axis=1)
                for k, x in zip(like, all_far, strict=True):
                    far[k] = x
            yield pd.DataFrame({"id": batch["id"], "v": batch["v"], "dim": batch["dim"], "far": far, "cell": cell, "near": near})

    return rows.mapInPandas(measure, _TABLE)


def meet(q: pd.DataFrame, c: pd.DataFrame, k: int) -> Iterator[tuple[int, int, int]]:
    """The k best candidates in this block for each query, exactly; those under a query's ``seed`` may be left out."""
    q_id, c_id, qv, cv = q["id"].to_numpy(), c["id"].to_numpy(), np.stack(q["v"]), np.stack(c["v"])
    usable = bool(len(q["far"].iloc[0])) and all(map(len, q["far"])) and all(map(len, c["far"]))
    if usable:
        # A row per pivot; in half the width, which the slack of the bounds allows for.
        to_q, to_c = np.stack(q["far"]).astype("float32"), np.stack(c["far"]).astype("float32").T.copy()
    else:
        whole_floats = exact(qv).all() and exact(cv).all()
        qv, cv = (qv, cv) if whole_floats else (qv.astype(object), cv.astype(object))
    if usable or whole_floats:
        qv, cv = qv.astype(float), cv.astype(float)
        q2, c2 = (qv**2).sum(axis=1), (cv**2).sum(axis=1)
    for i in range(len(q)):
        others = np.flatnonzero(c_id != q_id[i])
        best: list[tuple[int, int]] = []

        def evaluate(run: np.ndarray) -> None:
            if cv.dtype == object:
                score = (cv[run] * qv[i]).sum(axis=1)  # noqa: B023
            else:
                # To pick many rows costs more than to multiply them all.
                score = (cv @ qv[i])[run] if len(run) * 4 > len(cv) else cv[run] @ qv[i]  # noqa: B023
                if len(run) > 4 * k:
                    # All that are no worse than the k-th of the run, ties included.
                    some = np.flatnonzero(score >= np.partition(score, -k)[-k])
                    run, score = run[some], score[some]
            best[:] = sorted(best + [(-int(s), int(v)) for s, v in zip(score, c_id[run], strict=True)])[:k]  # noqa: B023

        if not usable:
            evaluate(others)
        else:
            low = np.zeros(len(cv), "float32")
            for p in range(len(to_c)):
                np.maximum(low, np.abs(to_c[p] - to_q[i, p]), out=low)
            # A whole inner product can't exceed this; the slack is for the rounding of the distances.
            bound = np.floor((q2[i] + c2 - low.astype(float) ** 2) / 2 + 2e-6 * (q2[i] + c2) + 1)
            seed = q["seed"].iloc[i] if "seed" in q and not pd.isna(q["seed"].iloc[i]) else -np.inf
            others = others[bound[others] >= seed]
            step = RUN
            while len(others):
                # The next ones in bound order; then only what still reaches the k-th score is left.
                if len(others) > step:
                    first = np.argpartition(-bound[others], step - 1)
                    run, others = others[first[:step]], others[first[step:]]
                else:
                    run, others = others, others[:0]
                evaluate(run)
                if len(best) == k:
                    others = others[bound[others] >= max(seed, -best[-1][0])]
                step *= 16
        yield from ((int(q_id[i]), v, -s) for s, v in best)


def top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    rows = whole(vectors, id_col, vec_col).filter(F.col("id").isNotNull()).distinct()
    chosen = choose_pivots(rows)
    pivots = np.zeros((0, 0)) if chosen is None else chosen
    measured = written(pivot_table(rows, pivots))
    total, asked, dim = measured.agg(F.count("*"), F.count(F.when(F.col("id") % every == 0, 1)), F.max("dim")).first()
    most = max(1, BLOCK // (dim or 1))
    rows_of = lambda n, least, spread: min(most, max(least, n // spread))
    n_blocks = -(-total // rows_of(total, LEAST_ROWS, SPREAD)) or 1
    c = written(measured.repartitionByRange(n_blocks, "dim", "cell", "near", F.xxhash64("id")).withColumn("block", F.spark_partition_id()))
    queries = c.filter(F.col("id") % every == 0)

    def met(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        made = list(meet(left, right, k)) if len(left) and len(right) else []
        return pd.DataFrame(made, columns=["query_id", "vec_id", "score"]).astype("int64")

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        # A query has met its own block already.
        return met(left[left["block"] != right["block"].iloc[0]], right) if len(left) and len(right) else met(left, right)

    own = written(queries.groupBy("block", "dim").cogroup(c.groupBy("block", "dim")).applyInPandas(met, _OUT))
    # The k-th score of a query in its block; of rows that share an id the lowest one holds.
    seeds = own.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select(F.col("query_id").alias("_id"), F.try_element_at("s", F.lit(k)).alias("seed"))
    single = queries.groupBy("id").agg(F.count("*").alias("n")).filter("n = 1").select(F.col("id").alias("_id"))
    seeded = queries.join(seeds.join(single, "_id"), queries["id"] == F.col("_id"), "left").drop("_id")
    # Queries of blocks that follow each other are asked together; the window sees a row per block.
    before = F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    together = queries.groupBy("block").agg(F.count("*").alias("n")).select(F.col("block").alias("_block"), F.floor(before / rows_of(asked, LEAST_QUERIES, QUERY_SPREAD)).alias("q_block"))
    q = written(seeded.join(together, F.col("block") == F.col("_block")).drop("_block"))
    pairs = reachable(q, c, min(COARSE, len(pivots)))
    left = q.join(pairs, "q_block").groupBy("q_block", "c_block", "dim")
    right = c.join(pairs.toDF("_q", "_c"), F.col("block") == F.col("_c")).groupBy("_q", "_c", "dim")
    found = own.unionByName(left.cogroup(right).applyInPandas(tile, _OUT))
    ranked = F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v"))
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(ranked)), 1, k).alias("b"))
    return best.select("query_id", F.posexplode("b").alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.v").alias("vec_id"), (-F.col("b.s")).alias("score"))


def reachable(q: DataFrame, c: DataFrame, coarse: int) -> DataFrame:
    """q_block, c_block: the blocks of candidates that may hold a result of a block of queries; rows of blocks only."""
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    extent = lambda name: [f(F.get("far", F.lit(p))).alias(f"{name}_{side}{p}") for p in range(coarse) for side, f in (("low", F.min), ("high", F.max))]
    shape = lambda df, name, key: df.withColumn("_square", square).groupBy(key).agg(F.max("_square").alias(f"{name}_square"), F.bool_or(F.size("far") == 0).alias(f"{name}_open"), *extent(name))
    asks = shape(q, "q", "q_block").join(q.groupBy("q_block").agg(F.when(F.count("seed") == F.count("*"), F.min("seed")).alias("seed")), "q_block")
    holds = written(shape(c, "c", "block"))
    last = holds.agg(F.max("block")).first()[0]
    # Every block of queries looks at the extent of every block of candidates: numbers of blocks, never vectors.
    grid = asks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last or 0)))).join(holds, "block")
    pairs = grid.filter(F.col("q_open") | F.col("c_open") | F.col("seed").isNull() | (_most(coarse) >= F.col("seed")))
    return written(pairs.select("q_block", F.col("block").alias("c_block")))


def _most(coarse: int) -> F.Column:
    """No inner product of two vectors of these blocks is greater."""
    apart = F.greatest(F.lit(0.0), *[F.greatest(F.col(f"q_low{p}") - F.col(f"c_high{p}"), F.col(f"c_low{p}") - F.col(f"q_high{p}")) for p in range(coarse)], F.lit(0.0))
    squares = F.col("q_square") + F.col("c_square")
    return (squares - apart * apart) / 2 + squares * 1e-6 + 1


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= {K}
"""
