"""Operator 3: mixing sources to target weights by weighted fair queueing.

Every source gets a target: its weighted share of the budget, at most so many
times its size, the excess reshared. Its documents, in a keyed shuffled order, pass
through a queue, a second time behind the first. A pass of a document has a virtual
finish time: the words of its source up to its end, divided by the source's target.
All passes are range-sorted by finish time over all sources and truncated at the
total budget; the pass that the budget runs out in is cut. A source is served about
its target then, because all clocks show the same time.

The sort and the sums run on rows without text, in two steps each (range cells or
slices of the shuffled order, and inside them), so that a source may hold any share
of the rows; equal documents of a source are one entry of the queue with a number of
copies. Inside a source the queue is in key order, so the truncation comes down to a
last key for every source and pass: ``mixed`` finds a text's passes by that and
shuffles no text.

Edge cases: a null text has size 0; documents of size 0 stand in no queue, have no
finish time and are not in the mix; a null source is a source of its own, sorted
last; sources without words have target 0; copies that the budget runs out in get
equally many words each, so a remainder under their number stays unused; equal finish
times of two sources are served in source order; a null id is a valid row, and rows
that share an id are told apart by text; of a very long text that is cut the words
served stay as they stand, lines included; an empty table gives an empty result;
other columns are carried by ``mixed`` whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import GAP, n_words, table, written

WEIGHTS = (5, 2, 1)
BUDGET_PERCENT = 150
MAX_PASSES = 2
#: Rows aimed at in a slice of the shuffled order.
CELL_ROWS = 50_000
MIN_CELLS = 256
SEED = "mix"


def order_key(doc_id: Column, text: Column) -> Column:
    """A place in the shuffled order; rows that share an id but not the text are spread."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{SEED}:"), F.coalesce(text, F.lit(""))))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: the shares by weight, filled up to the caps.

    A source is capped when its cap per weight is under the final level; in that
    order one running sum finds the level. The window holds one row per source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MAX_PASSES)
    filled = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("used", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("open", F.sum("weight").over(filled.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("budget", F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * F.lit(BUDGET_PERCENT) / F.lit(100))
    s = s.withColumn("level", (F.col("budget") - F.col("used")) / F.col("open"))
    # The level at the first source that its own level does not fill; all before it are full.
    s = s.withColumn("final", F.first(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level")), ignorenulls=True).over(filled.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.when(F.col("final").isNull() | (F.col("cap") <= F.col("final") * F.col("weight")), F.col("cap").cast("double")).otherwise(F.col("final") * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, source, size, key of every row, as a table."""
    text = F.col(text_col)
    return written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text).alias("size"), order_key(F.col(id_col), text).alias("key")))


def goals(slim: DataFrame) -> DataFrame:
    """source, source_size, target, as a table."""
    return written(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"))))


def queue(slim: DataFrame, goal: DataFrame) -> DataFrame:
    """A row per source, place in its shuffled order and pass: key, pass, copies, words of all copies, finish; as a table."""
    entries = slim.filter("size > 0").groupBy("source", "key", "size").agg(F.count("*").alias("copies")).withColumn("words", F.col("size") * F.col("copies"))
    most = entries.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    digits = max(len(f"{MIN_CELLS - 1:x}"), len(f"{most // CELL_ROWS:x}"))
    entries = entries.withColumn("cell", F.substring("key", 1, digits))
    sums = entries.groupBy("source", "cell").agg(F.sum("words").alias("s"))
    before = W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    ahead = sums.withColumn("ahead", F.coalesce(F.sum("s").over(before), F.lit(0)))
    lead = ahead.join(goal, ahead["source"].eqNullSafe(goal["source"])).select(ahead["source"], "cell", "ahead", "source_size", "target")
    rows = entries.alias("a").join(lead.alias("b"), (F.col("a.cell") == F.col("b.cell")) & F.col("a.source").eqNullSafe(F.col("b.source")))
    upto = F.col("ahead") + F.sum("words").over(W.partitionBy("a.cell", "a.source").orderBy("key").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.select(F.col("a.source").alias("source"), "key", "copies", "words", upto.alias("upto"), "source_size", "target")
    rows = rows.withColumn("pass", F.explode(F.array(*[F.lit(k) for k in range(MAX_PASSES)])))
    return written(rows.select("source", "key", "pass", "copies", "words", ((F.col("source_size") * F.col("pass") + F.col("upto")) / F.col("target")).alias("finish")))


def truncation(passes: DataFrame, budget: int) -> tuple[float, str | None, int] | None:
    """Finish time and source of the pass in which the budget runs out, and the words that each copy of it gets."""
    order = ["finish", F.col("source").asc_nulls_last()]
    ranged = written(passes.repartitionByRange(*order).withColumn("cell", F.spark_partition_id()))
    # A row per cell; the cell that reaches the budget is the only one looked into.
    sums = ranged.groupBy("cell").agg(F.sum("words").alias("s")).withColumn("upto", F.sum("s").over(W.orderBy("cell")))
    cell = sums.filter(F.col("upto") >= budget).orderBy("cell").first()
    if cell is None:
        return None
    inside = ranged.filter(F.col("cell") == cell["cell"]).withColumn("upto", F.sum("words").over(W.partitionBy("cell").orderBy(*order)) + (cell["upto"] - cell["s"]))
    last = inside.filter(F.col("upto") >= budget).orderBy(*order).first()
    return last["finish"], last["source"], (budget - last["upto"] + last["words"]) // last["copies"]


def ends(slim: DataFrame, passes: DataFrame, goal: DataFrame) -> DataFrame:
    """source, source_size, target and for each pass the first key that is not served whole, with the words of it that are; null where all are."""
    total = slim.agg(F.sum("size")).first()[0] or 0
    last = truncation(passes, total * min(BUDGET_PERCENT, 100 * MAX_PASSES) // 100)
    if last is None:
        rest = passes.filter("false").withColumn("part", F.lit(0).cast("long"))
    else:
        finish, source, words = last
        same = F.col("source").eqNullSafe(F.lit(source)) & (F.col("finish") == finish)
        after = F.lit(False) if source is None else F.col("source").isNull() | (F.col("source") > source)
        rest = passes.filter((F.col("finish") > finish) | same | ((F.col("finish") == finish) & after)).withColumn("part", F.when(same, F.lit(words)).otherwise(0).cast("long"))
    first = rest.groupBy("source").agg(*[F.min(F.when(F.col("pass") == k, F.struct("key", "part"))).alias(f"end{k}") for k in range(MAX_PASSES)])
    return written(goal.join(first, goal["source"].eqNullSafe(first["source"]), "left").select(goal["source"], "source_size", "target", *[f"end{k}" for k in range(MAX_PASSES)]))


def served(key: Column, size: Column, k: int) -> Column:
    """Words of a document that a pass serves, by the ends of its source."""
    end = F.col(f"end{k}")
    return F.when(end.isNull() | (key < end["key"]), size).when(key == end["key"], end["part"]).otherwise(0).cast("long")


def shares(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row per input row: id, source, size, source_size, target, the finish time of its first pass, the words taken."""
    slim = sized(docs, id_col, text_col, source_col)
    goal = goals(slim)
    passes = queue(slim, goal)
    plan = ends(slim, passes, goal)
    taken = sum((served(F.col("key"), F.col("size"), k) for k in range(1, MAX_PASSES)), served(F.col("key"), F.col("size"), 0))
    rows = slim.join(plan, slim["source"].eqNullSafe(plan["source"])).select("id", slim["source"], "key", "size", "source_size", "target", taken.alias("taken"))
    first = passes.filter("pass = 0").select(F.col("source").alias("_source"), F.col("key").alias("_key"), "finish")
    told = rows.join(first, (rows["key"] == first["_key"]) & rows["source"].eqNullSafe(first["_source"]) & (rows["size"] > 0), "left")
    return told.select("id", "source", "size", "source_size", "target", "finish", "taken")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix: a row per served pass: the input row as ``row``, pass, size, words served."""
    slim = sized(docs, id_col, text_col, source_col)
    goal = goals(slim)
    plan = ends(slim, queue(slim, goal), goal).withColumnRenamed("source", "_source")
    text = F.col(f"row.{text_col}")
    rows = docs.select(F.struct(*docs.columns).alias("row")).withColumns({"_key": order_key(F.col(f"row.{id_col}"), text), "size": n_words(text)})
    # A row per source on one side: small, or else split where a source is large.
    rows = rows.join(plan, F.col(f"row.{source_col}").eqNullSafe(F.col("_source")))
    rows = rows.select("row", "size", F.posexplode(F.array(*[served(F.col("_key"), F.col("size"), k) for k in range(MAX_PASSES)])).alias("pass", "words"))
    return rows.filter("words > 0")


def first_words(text: Column, n: Column) -> Column:
    """The text up to its ``n``-th word, as it stands."""
    # Each part is a word with what follows it; before the first one there may be a gap.
    parts = F.split(text, rf"(?<={GAP[:-1]})(?={GAP[:-1].replace('[', '[^', 1)})", -1)
    return F.regexp_replace(F.array_join(F.slice(parts, F.lit(1), n.cast("int") + text.rlike(rf"\A{GAP}").cast("int")), ""), rf"{GAP}\z", "")


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents of the mix, once for each pass; where a pass is cut, the words served.

    The queue decides what is served; the rows come in no order, for packing places them by length.
    """
    text = F.when(F.col("words") < F.col("size"), first_words(F.col("row.text"), F.col("words"))).otherwise(F.col("row.text"))
    done = mixed(docs).withColumn("_text", text)
    return done.select(*[(F.col("_text") if c == "text" else F.length("_text").cast("long") if c == "n_chars" else F.col("row")[c]).alias(c) for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shares(table(spark, sf_dir, "documents"))
    return s.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "finish", "taken")


#: The queue itself: every pass with its finish time, sorted, and the budget given out in that order.
SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}:' || coalesce(text, '')) AS key FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS weight, {MAX_PASSES} * source_size AS cap FROM t),
f AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS used, (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS open,
  (sum(source_size) OVER ())::DOUBLE * {BUDGET_PERCENT} / 100 AS budget FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
l AS (SELECT *, (budget - used) / open AS level FROM f),
v AS (SELECT min_by(level, cap / weight) AS final FROM l WHERE cap > level * weight),
g AS (SELECT source, source_size, CASE WHEN final IS NULL OR cap <= final * weight THEN cap::DOUBLE ELSE final * weight END AS target FROM l, v),
q AS (SELECT source, key, size, count(*) AS copies, size * count(*) AS words FROM d WHERE size > 0 GROUP BY source, key, size),
b AS (SELECT q.*, source_size, target, sum(words) OVER (PARTITION BY q.source ORDER BY key) AS upto FROM q JOIN g ON q.source IS NOT DISTINCT FROM g.source),
p AS (SELECT *, (source_size * k + upto)::DOUBLE / target AS finish FROM b, range({MAX_PASSES}) x(k)),
n AS (SELECT sum(size) * {BUDGET_PERCENT} // 100 AS due FROM d),
r AS (SELECT *, greatest(0, least(size, (due - (sum(words) OVER (ORDER BY finish, source NULLS LAST) - words)) // copies)) AS part FROM p, n),
s AS (SELECT source, key, size, min(finish) AS finish, sum(part)::BIGINT AS taken FROM r GROUP BY ALL)
SELECT doc_id, d.size, source_size, target, finish, coalesce(taken, 0)::BIGINT AS taken FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN s ON d.source IS NOT DISTINCT FROM s.source AND d.key = s.key AND d.size = s.size
"""
