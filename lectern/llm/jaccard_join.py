"""Operator 1: n-gram Jaccard join over size-banded tiles with bitmap signatures.

A document is the set of its distinct word shingles, as sorted 64-bit hashes;
equal sets form a class that is handled once. The join runs in three steps.

1. Candidate groups. For each level of sizes the hash range is cut into so many
   segments that two sets at or over the threshold must agree on a segment that
   is not empty: a pair of sets with at most d differing shingles touches d
   segments at most, and there are d + 1 + m of them, m being an allowance for
   empty ones. The hash of a segment's content is the join key, so no candidate is
   lost, and chance agreement of several shingles at once is rare. Sets with more
   than m empty segments also offer those. Equal keys are linked to their smallest
   set, inside the task first, and the links are closed to groups.
2. Tiles. A group is cut into tiles by size band (neighbouring bands hold all
   possible partners) and, where a band is large, by hash; each pair of tiles is
   one unit of work, and the units of a group are dealt to the tasks in turn. Units see only hashed bitmap signatures, whose bit counts
   bound the overlap of two sets from above; the pairs that the bound leaves are
   closed to narrower groups, so sets that merely share a passage part here.
3. The narrower groups are cut into tiles again, and these units get the sets:
   what the bound leaves is intersected exactly over sorted arrays. A unit emits a
   row per set (number of links and a forest edge), never pairs.
4. Forest edges are closed to components; each is named by its smallest id.

Texts with fewer words than a shingle are one shingle. Edge cases: null texts and
texts without words have an empty set and link with nothing; rows with a null id
take no part and get a null component; repeated rows are copies and link with each
other; ties cannot occur, links being exact integer comparisons; an empty table
gives an empty result; very long texts are processed whole; other columns are not
read. Hashes of 64 bits stand for shingles and sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.batches import slices
from lectern.llm.common import table, written
from lectern.llm.components import components

WIDTH, PERCENT = 4, 85
#: Ratio of the sizes of a level.
LEVEL = 1.25
#: Sets and shingles of a tile at most (a larger set is alone).
TILE_SETS, TILE_SHINGLES = 400, 1_500_000
#: Signatures of a tile at most, in small and in large groups: a group gives work to many tasks, and a large one few copies of its rows.
TILE_SIGNATURES = (400, 4096)
#: Tiles that a band of a group is cut into before they grow.
SPREAD = 7

_P, _A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers (the public splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
        return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z in lower case."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
    which = coded.indices.to_numpy(zero_copy_only=False)
    real = np.fromiter((w != "" for w in names), bool, len(names))[which] if len(names) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(real)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    h = hashes[which[real]] if len(names) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        run = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for k in range(width):
            run = run * _P + h[k : k + len(run)]
        run = mix(run)
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            if b - a >= width:
                yield np.unique(run[a : b - width + 1])
            elif b > a:
                one = np.uint64(b - a)
                for x in h[a:b]:
                    one = one * _P + x
                yield mix(np.array([one]) * _C)
            else:
                yield np.zeros(0, np.uint64)


def mark(s: np.ndarray) -> int:
    """The 64-bit name of a set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s * _C).sum(dtype=np.uint64) + np.uint64(len(s)) * _P])).view(np.int64)[0])


@cache
def bounds() -> np.ndarray:
    """First size of each level."""
    return np.unique(np.floor(LEVEL ** np.arange(140.0)).astype(np.int64))


@cache
def segments(level: int, percent: int) -> tuple[int, int]:
    """Number of segments of a level and the empty ones allowed for."""
    low, high = int(bounds()[level]), int(bounds()[level + 1]) - 1
    differing = (100 - percent) * (high + high * 100 // percent) // (100 + percent)
    if not differing:
        return 1, 0
    empty = (differing + 1) * math.exp(-low / (differing + 1))
    spare = int(empty + 3 * math.sqrt(empty))
    return differing + 1 + spare, spare


def keys(s: np.ndarray, percent: int) -> np.ndarray:
    """The join keys of a set at every level where a partner may be."""
    first, last = np.searchsorted(bounds(), [-(-len(s) * percent // 100), len(s)], side="right") - 1
    found = []
    with np.errstate(over="ignore"):
        for level in range(int(first), int(last) + 1):
            n, spare = segments(level, percent)
            at = ((s >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            place = at[starts] * _A + np.uint64(level) * _B
            found.append(mix(np.add.reduceat(s, starts) * _C + place))
            if n - len(starts) > spare:
                rest = np.setdiff1d(np.arange(n, dtype=np.uint64), at[starts])
                found.append(mix(rest * _A + np.uint64(level) * _B + _P))
    return np.concatenate(found)


def _linked(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the (key, node) rows of a slice the smallest node of each key, and the other nodes' links to it."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    start = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    hub = node[np.flatnonzero(start)][np.cumsum(start) - 1] if len(key) else node
    off = node != hub
    pairs = np.unique(np.stack([node[off], hub[off]]), axis=1)
    return key[start], node[start], pairs


def signature(s: np.ndarray) -> bytes:
    """A bit for the low end of every hash; about as many bits as there are shingles."""
    bits = np.zeros(1 << max(8, min(14, int(len(s) - 1).bit_length())), bool)
    bits[(s & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(sign: np.ndarray, words: int) -> np.ndarray:
    """Signatures (a row of 64-bit words each) at a smaller width: as if made with it."""
    return np.bitwise_or.reduce(sign.reshape(len(sign), -1, words), axis=1)


def most_shared(a: np.ndarray, b: np.ndarray, size_a: int, size_b: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlap of one set with others: each bit of one alone is a shingle of its own."""
    lone_a = np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64)
    lone_b = np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64)
    return np.minimum(size_a - lone_a, size_b - lone_b)


def classes(docs: DataFrame, width: int) -> DataFrame:
    """id, n, node, sign, h for every row: size, name and signature of its set (neither for an empty one), and the hash of its text."""

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                made = [(len(s), mark(s), signature(s)) if len(s) else (0, None, None) for s in shingle_sets(part.column("text"), width)]
                columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns, part.column("h")], ["id", "n", "node", "sign", "h"])

    return docs.withColumn("h", F.xxhash64("text")).mapInArrow(sized, "id long, n long, node long, sign binary, h long")


def candidate_links(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges a, b that connect all sets which share a key."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                seen: dict[int, np.ndarray] = {}
                for s in shingle_sets(part.column("text"), width):
                    if len(s) and (name := mark(s)) not in seen:
                        seen[name] = keys(s, percent)
                if not seen:
                    continue
                node = np.repeat(np.fromiter(seen, np.int64, len(seen)), [len(k) for k in seen.values()])
                key, first, (a, b) = _linked(np.concatenate(list(seen.values())).view(np.int64), node)
                # Links found here go on under keys of their own, evenly spread.
                own = mix(a.view(np.uint64) * _A + b.view(np.uint64)).view(np.int64)
                # By set: its name repeats from row to row and shuffles in little room.
                by_set = np.argsort(first, kind="stable")
                key, first = key[by_set], first[by_set]
                hub = pa.array(np.concatenate([first, b]), mask=np.arange(len(key) + len(a)) < len(key))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([key, own])), pa.array(np.concatenate([first, a])), hub], ["key", "node", "hub"])

    rows = docs.select("text").mapInArrow(keyed, "key long, node long, hub long")
    least = F.min("node").over(W.partitionBy("key"))
    return rows.select(F.col("node").alias("a"), F.coalesce("hub", least).alias("b")).filter("a <> b").distinct()


def tiles(nodes: DataFrame, percent: int, sets: tuple[int, int], shingles: int | None = None) -> DataFrame:
    """The columns of ``nodes`` (node, n, grp and others) and ``units``: the units of work (unit, turn, side) of each set.

    The units of a group have consecutive turns, so that dealing by turn spreads them evenly.
    """
    size = F.least(F.greatest(F.col("count") / SPREAD, F.lit(sets[0])), F.lit(sets[1]))
    parts = F.greatest(F.ceil(F.col("count") / size), F.ceil(F.col("total") / shingles) if shingles else F.lit(1)).cast("int")
    whole = nodes.groupBy("grp").agg(F.count("*").alias("count"), F.sum("n").alias("total")).withColumn("parts", parts)
    # A little wider than the threshold asks for, against rounding of the logarithm.
    band = F.floor(F.log("n") / F.lit(math.log(100 / percent * 1.0001)))
    placed = nodes.join(whole.select("grp", (F.col("parts") > 1).alias("large")), "grp").withColumn("band", F.when(F.col("large"), band).otherwise(F.lit(-1)).cast("long"))
    bands = written(placed.groupBy("grp", "band").agg(F.count("*").alias("count"), F.sum("n").alias("total")).select("grp", "band", parts.alias("parts")))
    near = lambda k, name: bands.select("grp", (F.col("band") - k).alias("band"), F.col("parts").alias(name))
    about = bands.join(near(1, "above"), ["grp", "band"], "left").join(near(-1, "below"), ["grp", "band"], "left").fillna(0, ["above", "below"])
    # Bands of small groups are all -1 and have no neighbours: 0 is a band of large groups only.
    about = about.withColumns({"above": F.when(F.col("band") < 0, 0).otherwise(F.col("above")), "below": F.when(F.col("band") <= 0, 0).otherwise(F.col("below"))})
    # How many units come before those of a band in its group: of the band itself, with the next one, and with the one before; a group has a few bands.
    own = F.col("parts") * (F.col("parts") + 1) / 2
    in_group = W.partitionBy("grp").orderBy("band")
    before = F.coalesce(F.sum(own + F.col("parts") * F.col("above")).over(in_group.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    about = about.withColumn("same_at", before.cast("long")).withColumn("up_at", (F.col("same_at") + own).cast("long")).withColumn("down_at", F.lag("up_at").over(in_group))
    rows = placed.join(about, ["grp", "band"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    count = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))

    def unit(low: Column, i: Column, j: Column, kind: str, side: Column, nth: Column) -> Column:
        turn = F.pmod(F.xxhash64("grp") + nth.cast("long"), F.lit(1 << 30)).cast("int")
        return F.struct(F.concat_ws(":", "grp", low, i, j, F.lit(kind)).alias("unit"), turn.alias("turn"), side.cast("int").alias("side"))

    p, low, high = F.col("part"), lambda j: F.least(F.col("part"), j), lambda j: F.greatest(F.col("part"), j)
    same = F.transform(count("parts"), lambda j: unit(F.col("band"), low(j), high(j), "s", F.when(j == p, 2).otherwise((p > j).cast("int")), F.col("same_at") + high(j) * (high(j) + 1) / 2 + low(j)))
    up = F.transform(count("above"), lambda j: unit(F.col("band"), p, j, "u", F.lit(0), F.col("up_at") + p * F.col("above") + j))
    down = F.transform(count("below"), lambda j: unit(F.col("band") - 1, j, p, "u", F.lit(1), F.col("down_at") + j * F.col("parts") + p))
    return rows.select(*[c for c in nodes.columns if c != "grp"], F.concat(same, up, down).alias("units"))


def by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (unit first, side and node next) in the order of units, those of one unit at a time, each node once."""
    unit, held = None, {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != unit:
                if len(held) > 1:
                    yield list(held.values())
                unit, held = row[0], {}
            held[row[2]] = row
    if len(held) > 1:
        yield list(held.values())


def dealt(rows: DataFrame) -> DataFrame:
    """The rows of each unit together and sorted, the units dealt to the tasks in turn."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionById(n, "turn").drop("turn").sortWithinPartitions("unit")


def bounded(size: np.ndarray, side: np.ndarray, signs: list[bytes], percent: int) -> np.ndarray:
    """For each set the first one of its tree, linking all pairs whose bound reaches the threshold; sizes ascend."""
    tree = np.arange(len(size))
    width = np.array([len(s) // 8 for s in signs])
    for w in np.unique(width):
        # Partners of a set are as wide as it is or wider, the sizes ascending; wider ones are folded.
        at = np.flatnonzero(width >= w)
        at = at[: np.searchsorted(size[at], size[width == w].max() * 100 // percent, side="right")]
        sign = np.concatenate([folded(np.frombuffer(signs[k], "<u8")[None], int(w)) for k in at])
        for i in range(len(at) - 1):
            a = at[i]
            if width[a] != w:
                break
            last = int(np.searchsorted(size[at], size[a] * 100 // percent, side="right"))
            b = np.arange(i + 1, last)
            if side[a] != 2:
                b = b[side[at[b]] != side[a]]
            # Pairs that are in one tree already add nothing.
            b = b[tree[at[b]] != tree[a]]
            if not len(b):
                continue
            most = most_shared(sign[i], sign[b], size[a], size[at[b]])
            joined = np.unique(tree[np.append(at[b[most * (100 + percent) >= percent * (size[a] + size[at[b]])]], a)])
            if len(joined) > 1:
                tree[np.isin(tree, joined)] = joined[0]
    return tree


def narrowed(assigned: DataFrame, percent: int) -> DataFrame:
    """Edges a, b that connect all sets of a unit whose signatures let them link; ``assigned`` has node, n, sign, units."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_unit(batches):
            rows.sort(key=lambda r: (r[3], r[2]))
            _, side, node, n, sign = zip(*rows, strict=True)
            tree = bounded(np.array(n), np.array(side), sign, percent)
            names = np.array(node, np.int64)
            off = tree != np.arange(len(tree))
            yield pa.RecordBatch.from_arrays([pa.array(names[off]), pa.array(names[tree[off]])], ["a", "b"])

    rows = assigned.select(F.explode("units").alias("u"), "node", "n", "sign").select("u.unit", "u.side", "node", "n", "sign", "u.turn")
    return dealt(rows).mapInArrow(met, "a long, b long").distinct()


def compare(sets: list[np.ndarray], side: np.ndarray, copies: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For the sets of a unit the weighted number of links of each, and the first set of its forest tree."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    flat = np.concatenate([sets[k] for k in order])
    size, side, weight = size[order], side[order], copies[order]
    ends = np.cumsum(size)
    starts = ends - size
    width = 1 << max(8, min(13, int(2 * size.max() - 1).bit_length()))
    bits = np.zeros((len(sets), width), bool)
    bits[np.repeat(np.arange(len(sets)), size), (flat & np.uint64(width - 1)).astype(np.int64)] = True
    sign = np.packbits(bits, axis=1).view(np.uint64)
    links, tree = np.zeros(len(sets), np.int64), np.arange(len(sets))
    for a in range(len(sets) - 1):
        last = int(np.searchsorted(size, size[a] * 100 // percent, side="right"))
        b = np.arange(a + 1, last)
        if side[a] != 2:
            b = b[side[b] != side[a]]
        if not len(b):
            continue
        need = percent * (size[a] + size[b])
        most = most_shared(sign[a], sign[b], size[a], size[b])
        fits = most * (100 + percent) >= need
        b, need = b[fits], need[fits]
        if not len(b):
            continue
        # The sorted array of a, and those of all its partners one after another: where each shingle would stand, it stands or not.
        own, n = flat[starts[a] : ends[a]], size[b]
        before = np.cumsum(n) - n
        theirs = flat[np.repeat(starts[b] - before, n) + np.arange(int(n.sum()))]
        place = np.searchsorted(own, theirs)
        shared = np.add.reduceat(own[np.where(place < len(own), place, 0)] == theirs, before, dtype=np.int64)
        b = b[shared * (100 + percent) >= need]
        if len(b):
            links[a] += weight[b].sum()
            links[b] += weight[a]
            joined = np.unique(tree[np.append(b, a)])
            tree[np.isin(tree, joined)] = joined[0]
    back = np.empty(len(sets), np.int64)
    back[order] = np.arange(len(sets))
    return links[back], order[tree[back]]


def links(docs: DataFrame, assigned: DataFrame, width: int, percent: int) -> DataFrame:
    """node, hub, links: a row per unit and set that has links in it."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("unit", pa.string()), ("side", pa.int32()), ("node", pa.int64()), ("copies", pa.int64()), ("s", pa.binary()), ("turn", pa.int32())])
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for k, s in enumerate(shingle_sets(part.column("text"), width)):
                    # Rows that share an id may differ in text; only the one that was assigned counts.
                    if len(s) and mark(s) == part.column("node")[k].as_py():
                        rows += [(u["unit"], u["side"], part.column("node")[k].as_py(), part.column("copies")[k].as_py(), s.tobytes(), u["turn"]) for u in part.column("units")[k].as_py()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_unit(batches):
            _, side, node, copies, sets = zip(*rows, strict=True)
            names = np.array(node, np.int64)
            n, tree = compare([np.frombuffer(s, np.uint64) for s in sets], np.array(side), np.array(copies), percent)
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(names[tree[some]]), pa.array(n[some])], ["node", "hub", "links"])

    rows = docs.join(assigned, "id").select("text", "node", "copies", "units").mapInArrow(shingled, "unit string, side int, node long, copies long, s binary, turn int")
    return dealt(rows).mapInArrow(met, "node long, hub long, links long")


def _grouped(roots: DataFrame, kinds: DataFrame) -> DataFrame:
    """``kinds`` of the nodes that are in a group, with the group as ``grp``."""
    both = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    return written(kinds.join(both.withColumnRenamed("root", "grp"), "node"))


def _joined(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """id, h, n, node, component_id, chief, n_links for every row; ``chief`` is the set of the component's smallest id (and of sets that share it the smallest)."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    slim = written(classes(own, width))
    taking = slim.filter("id IS NOT NULL AND node IS NOT NULL")
    kinds = written(taking.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.max("n").alias("n"), F.first("sign").alias("sign")))
    rough = components(candidate_links(own.filter("id IS NOT NULL"), width, percent))
    groups = components(narrowed(tiles(_grouped(rough, kinds.select("node", "n", "sign")), percent, TILE_SIGNATURES), percent))
    found = written(links(own, tiles(_grouped(groups, kinds.drop("sign")), percent, (TILE_SETS, TILE_SETS), TILE_SHINGLES), width, percent))
    trees = components(found.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    trees = trees.unionByName(trees.select(F.col("root").alias("node"), "root").distinct())
    first = written(trees.join(kinds.select("node", "id"), "node"))
    named = first.join(first.groupBy("root").agg(F.min(F.struct("id", "node")).alias("m")), "root").select("node", F.col("m.id").alias("component_id"), F.col("m.node").alias("chief"))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = kinds.join(named, "node", "left").join(counted, "node", "left")
    known = known.select("node", F.coalesce("component_id", "id").alias("component_id"), F.coalesce("chief", "node").alias("chief"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    some = taking.join(known, "node").select("id", "h", "n", "node", "component_id", "chief", "n_links")
    rest = slim.filter("id IS NULL OR node IS NULL").select("id", "h", "n", "node", F.col("id").alias("component_id"), F.col("node").alias("chief"), F.lit(0).cast("long").alias("n_links"))
    return some.unionByName(rest)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id, n_links for every row."""
    return _joined(docs, id_col, text_col, width, percent).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_links")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates (five words, 0.8) the document with the smallest id; rows without an id stay.

    Rows are told apart by id and text, so of texts that share an id those that are nobody's near copy stay.
    """
    chiefs = _joined(docs, "doc_id", "text", width=5, percent=80).filter("id = component_id AND node <=> chief")
    # Texts with one set count once; texts without a set are near copies of nothing.
    keep = chiefs.groupBy("id", "node", F.when(F.col("node").isNull(), F.col("h")).alias("other")).agg(F.min("h").alias("h")).select("id", "h")
    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.struct(*docs.columns).alias("row"))
    one = rows.join(keep, ["id", "h"], "left_semi").dropDuplicates(["id", "h"]).select("row.*")
    return one.unionByName(docs.filter("doc_id IS NULL"))
