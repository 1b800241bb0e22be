"""Shards of near equal bytes by a k-d tree over document metadata, with DataFrame expressions only.

What is placed is a group of equal texts, one point: in each metadata dimension it lies at the least value of its
rows. A node of the tree holds points and a number of shards. It is split along its widest dimension: that whose range in the
node is the largest part of its range in the whole table (ties: the first named). The cut is the weighted median,
the weight being bytes (for an odd number of shards the matching quantile), and nodes are split until each is one
shard, whose target is the table's bytes over the number of shards.

Medians are found by distributed refinement, for all nodes of a level at once: bytes are summed in at most ``BINS``
bins of the range that can hold the median (partial sums in the tasks, no row is moved), and the bin with the median
becomes the next range. Points of equal value are ordered by their text's hash, and a group's rows by their id's
hash. A group is cut only where keeping it whole would move the cut by more than ``GROUP_SLACK`` of a shard, as it
must be where one text holds a third of all rows. The driver holds a row per shard.

A cut is a comparison of a row's own values, so nothing but the groups' least values is shuffled: one partial
aggregation by text hash, and a join back whose skew Spark can split. Rows go down the tree by one broadcast join
per level, of at most as many rows as there are shards.

Defined results: a null text has no bytes and counts 1, as does an empty one, and the two are equal; a null
dimension lies below all others; a null id is hashed as such. Rows that repeat both id and text always share a
shard, as nothing tells them apart. A shard can be empty where there are fewer rows than shards; an empty table
gives an empty result. Very long texts weigh what they weigh: a shard deviates from its target by half of the row at
the cut. Other columns, whatever their names, stay in ``locate``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, saved

#: Bins of a range in one pass; a pass shuffles at most this many sums per node and task.
BINS = 4096
#: A cut is near enough if it misses its goal by this part of a shard's target.
SLACK = 1 / 2048
#: A group of equal texts stays whole if the cut then misses by at most this part.
GROUP_SLACK = 1 / 128
#: Shards at most: the driver and each broadcast hold a row per shard.
MOST_SHARDS = 1 << 16
#: Rows that are numbered together; a shard's counts of them meet in one task, a row for each.
PART = 1 << 12
#: Metadata dimensions of ``documents``.
DIMENSIONS = ("lang", "source", "n_chars")

_LEAST = -(1 << 61)


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text and one for the row itself."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def _code(df: DataFrame, name: str) -> Column:
    """A dimension as bigint: numbers keep their order, strings lie by checksum, null lies below all."""
    if dict(df.dtypes)[name] in ("tinyint", "smallint", "int", "bigint"):
        clamped = F.greatest(F.least(F.col(name).cast("bigint"), F.lit(-_LEAST)), F.lit(_LEAST))
        value = F.when(F.col(name).isNotNull(), clamped)  # these two skip nulls
    else:
        value = F.crc32(F.col(name).cast("string").cast("binary"))
    return F.coalesce(value, F.lit(_LEAST - 1))


def _short(value: Column) -> Column:
    """62 bits of a hash, so that differences fit in a bigint."""
    return F.shiftrightunsigned(F.xxhash64(value), 2)


def _text_hash(text: str) -> Column:
    return _short(F.coalesce(F.col(text), F.lit("")))


def groups(df: DataFrame, text: str = "text", dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(text_hash, codes): where each group of equal texts lies."""
    rows = df.select(_text_hash(text).alias("text_hash"), *[_code(df, d).alias(f"code_{i}") for i, d in enumerate(dimensions)])
    least = rows.groupBy("text_hash").agg(*[F.min(f"code_{i}").alias(f"code_{i}") for i in range(len(dimensions))])
    return saved(least.select("text_hash", F.array(*[f"code_{i}" for i in range(len(dimensions))]).alias("codes")))


def _placed(df: DataFrame, at: DataFrame, place: str, key: str, text: str) -> DataFrame:
    """``df`` with all that decides a row's shard: its group's codes, then hashes of text and id."""
    mark, own = fresh(df, "mark"), fresh(df, "own")
    given = df.select("*", _text_hash(text).alias(mark), _short(F.col(key)).alias(own))
    joined = given.join(at.select(F.col("text_hash").alias(mark), F.col("codes").alias(place)), mark)
    return joined.withColumn(place, F.struct(F.col(place).alias("codes"), F.col(mark).alias("text"), F.col(own).alias("id"))).drop(mark, own)


@dataclass
class Node:
    """Points that are not told apart yet, and the number of their shards."""

    shards: int
    total: int = 0
    goal: float = 0.0
    dim: int = 0
    known: list[int] = field(default_factory=list)  # values of the columns before the one that is refined
    low: int = 0
    high: int = 0
    before: int = 0  # bytes of the node below ``low``
    bound: int | None = None  # rows below it, in the refined column, go left


@dataclass
class Tree:
    """``levels``: for each level the rows of ``_CUT``."""

    levels: list[list[tuple]]
    shards: int


_CUT = "node int, dim int, depth int, code bigint, text bigint, bound bigint, left int, right int"
_RANGE = "node int, dim int, depth int, code bigint, text bigint, low bigint, high bigint"


def _value(place: Column, cut: str) -> Column:
    """The column that is refined: the code, the text's hash or the id's hash."""
    codes = F.get(place["codes"], F.col(f"{cut}.dim"))
    return F.when(F.col(f"{cut}.depth") == 0, codes).when(F.col(f"{cut}.depth") == 1, place["text"]).otherwise(place["id"])


def _descend(df: DataFrame, place: str, level: list[tuple], at: str) -> DataFrame:
    """One level down: ``at`` becomes the child's number."""
    cut = fresh(df, "cut")
    cuts = df.sparkSession.createDataFrame(level, _CUT).select(F.struct("*").alias(cut))
    joined = df.join(F.broadcast(cuts), F.col(at) == F.col(f"{cut}.node"))
    p, c = F.col(place), lambda name: F.col(f"{cut}.{name}")
    code, value = F.get(p["codes"], c("dim")), _value(p, cut)
    left = (
        F.when(c("depth") == 0, value < c("bound"))
        .when(code != c("code"), code < c("code"))
        .when((c("depth") == 2) & (p["text"] != c("text")), p["text"] < c("text"))
        .otherwise(value < c("bound"))
    )
    return joined.withColumn(at, F.when(left, c("left")).otherwise(c("right"))).drop(cut)


def _known(node: Node) -> tuple[int | None, int | None]:
    return (node.known + [None, None])[0], (node.known + [None, None])[1]


def _cut(points: DataFrame, nodes: dict[int, Node], target: float) -> None:
    """Finds the bound of every node."""
    spark, waiting = points.sparkSession, dict(nodes)
    while waiting:
        ranges = [(i, n.dim, len(n.known), *_known(n), n.low, n.high) for i, n in waiting.items()]
        asked = points.join(F.broadcast(spark.createDataFrame(ranges, _RANGE).select(F.struct("*").alias("r"))), F.col("node") == F.col("r.node"))
        place, x = F.col("place"), _value(F.col("place"), "r")
        same = ((F.col("r.depth") < 1) | (F.get(place["codes"], F.col("r.dim")) == F.col("r.code"))) & (
            (F.col("r.depth") < 2) | (place["text"] == F.col("r.text"))
        )
        inside = asked.select("node", "size", "r", x.alias("x"), same.alias("same")).where("same and x between r.low and r.high")
        bins = inside.select("node", "size", "x", F.floor((F.col("x") - F.col("r.low")) * (float(BINS) / (F.col("r.high") - F.col("r.low") + 1).cast("double"))).alias("bin"))
        sums = bins.groupBy("node", "bin").agg(F.sum("size").alias("bytes"), F.min("x").alias("low"), F.max("x").alias("high"))
        running = Window.partitionBy("node").orderBy("bin")
        goals = spark.createDataFrame([(i, n.goal - n.before) for i, n in waiting.items()], "node int, goal double")
        over = sums.withColumn("upto", F.sum("bytes").over(running)).join(F.broadcast(goals), "node").where("upto >= goal")
        for i, bytes_, upto, low, high in over.groupBy("node").agg(F.min_by(F.struct("bytes", "upto", "low", "high"), "bin").alias("b")).select("node", "b.*").collect():
            n = waiting[i]
            below, above = n.before + upto - bytes_, n.before + upto
            n.bound = low if n.goal - below < above - n.goal else high + 1
            miss, depth, whole = min(n.goal - below, above - n.goal), len(n.known), low == high
            if miss <= SLACK * target or (whole and depth == 2) or (whole and depth == 1 and miss <= GROUP_SLACK * target):
                del waiting[i]
            elif whole:
                n.known.append(low)
                n.low, n.high, n.before = 0, (1 << 62) - 1, below
            else:
                n.low, n.high, n.before = low, high, below


def fit(points: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> Tree:
    """The tree of written points (place, size) for ``shards`` shards, or for as many as ``target_bytes`` asks for."""
    points = points.select("place", "size")
    dimensions = points.select(F.max(F.size("place.codes"))).first()[0] or 1
    codes = [F.get("place.codes", F.lit(d)) for d in range(dimensions)]
    ends = [f(c) for c in codes for f in (F.min, F.max)]
    total, *root = points.agg(F.coalesce(F.sum("size"), F.lit(0)), *ends).first()
    if shards is None:
        shards = max(1, math.ceil(total / target_bytes))
    if not 1 <= shards <= MOST_SHARDS:
        raise ValueError(f"the number of shards must lie between 1 and {MOST_SHARDS}")
    width = [max(1, (hi or 0) - (lo or 0)) for lo, hi in zip(root[::2], root[1::2], strict=True)]
    points, nodes, levels = points.withColumn("node", F.lit(0)), [Node(shards)], []
    while any(n.shards > 1 for n in nodes):
        split = {i: n for i, n in enumerate(nodes) if n.shards > 1}
        for i, weight, *e in points.groupBy("node").agg(F.sum("size"), *ends).collect():
            if i in split:
                n, n.total, n.goal = split[i], weight, weight * (split[i].shards // 2) / split[i].shards
                spread = [(hi - lo) / w for lo, hi, w in zip(e[::2], e[1::2], width, strict=True)]
                n.dim = spread.index(max(spread))
                n.low, n.high = e[2 * n.dim], e[2 * n.dim + 1]
        _cut(points, {i: n for i, n in split.items() if n.total}, total / shards)
        children, level = [], []
        for i, n in enumerate(nodes):
            half = n.shards // 2
            level.append((i, n.dim, len(n.known), *_known(n), n.bound or 0, len(children), len(children) + (half > 0)))
            children += [Node(half), Node(n.shards - half)] if half else [Node(n.shards)]
        levels.append(level)
        points = _descend(points, "place", level, "node")
        nodes = children
    return Tree(levels, shards)


def _told(placed: DataFrame, place: str, tree: Tree, shard: str) -> DataFrame:
    out = placed.withColumn(shard, F.lit(0))
    for level in tree.levels:
        out = _descend(out, place, level, shard)
    return out.drop(place)


def locate(df: DataFrame, at: DataFrame, tree: Tree, key: str = "doc_id", text: str = "text", shard: str = "shard") -> DataFrame:
    """``df``, texts and all, with the shard of each row, from its ``groups`` and its tree; ready for
    ``write.partitionBy(shard)``."""
    place = fresh(df, "place")
    return _told(_placed(df, at, place, key, text), place, tree, shard)


def slots(df: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``df`` with each row's number within its shard, gapless from 0: rows are numbered within a shard's part of
    ``PART`` neighbouring rows, and a part begins where the counts of those before it end."""
    part, row = fresh(df, "part"), fresh(df, "row")
    rows = saved(df.select("*", F.monotonically_increasing_id().alias(row))).withColumn(part, F.floor(F.col(row) / PART))
    counts = rows.groupBy(shard, part).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(shard).orderBy(part)) - F.col("n")
    start = fresh(rows, "start")
    starts = counts.select(shard, part, upto.alias(start))
    numbered = rows.withColumn(slot, F.row_number().over(Window.partitionBy(shard, part).orderBy(row)) - 1)
    out = numbered.join(starts, [shard, part])
    return out.withColumn(slot, (F.col(slot) + F.col(start)).cast("bigint")).drop(part, row, start)


def shard_documents(
    df: DataFrame, shards: int | None = None, target_bytes: int | None = None, key: str = "doc_id", text: str = "text", dimensions: tuple[str, ...] = DIMENSIONS
) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row; ``locate`` gives the rows themselves. Texts are read once:
    all else works on a written table of a few numbers per row."""
    slim = saved(
        df.select(
            F.col(key).alias("key"),
            size_of(F.col(text)).alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
            _text_hash(text).alias("mark"),
            F.array(*[_code(df, d) for d in dimensions]).alias("codes"),
        )
    )
    least = slim.groupBy("mark").agg(*[F.min(F.get("codes", F.lit(d))).alias(f"c{d}") for d in range(len(dimensions))])
    at = saved(least.select("mark", F.array(*[f"c{d}" for d in range(len(dimensions))]).alias("least")))
    place = F.struct(F.col("least").alias("codes"), F.col("mark").alias("text"), _short(F.col("key")).alias("id"))
    points = saved(slim.join(at, "mark").select("key", "size", "text_crc32", place.alias("place")))
    return slots(_told(points, "place", fit(points, shards, target_bytes), "shard"))
