"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of 64 bits (the signs of a vector's values) is cut into m segments of about log2(n) bits. One index
table, shared by all queries, lists every code under each segment's value; the value's first bits name a
block, and a task holds one block. A round raises the search radius: each query that is not covered visits,
in each segment, only the blocks whose name differs from its own in at most that many bits, and probes there
the values at exactly that radius. A code is verified once, where it is met first. By the pigeonhole
principle, after radius r in all segments every code at a distance below m * (r + 1) has been seen, so a
query is covered as soon as its k-th verified distance is below that. Nothing is approximate.

A query's visits depend on the radius, not on how many codes or queries there are, so the rows that go
into the search grow with the two tables. Equal codes share one entry that carries the ``k + 1`` least ids,
which is all that any answer can need, however many copies there are.

Defined results: a null vector or null id is neither a query nor an answer; a null value or NaN inside a
vector counts as not positive; a vector of more than 64 values is an error. Ties in distance go to the
smaller id; a row is never its own answer; repeated ids are one id. Fewer than k other ids give fewer
answers. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

BITS = 64
#: Codes of an index block, on average where a block must be dealt to several tasks.
BLOCK = 1 << 18
#: Bits of a segment's value that name its block, at least.
LEAST_PREFIX = 4
#: Probes, and candidates, that a task looks at together.
PROBES = 1 << 20


def sign_code(vector: Column) -> Column:
    """bigint with bit i set where value i is above zero."""
    bits = F.transform(vector, lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(b))


def bit_masks(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits with ``radius`` bits set."""
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(width), radius)], dtype=np.uint64)


class Cuts:
    """Where codes are cut: (shift, width) of each segment, and the bits of a value that name its block."""

    def __init__(self, n_codes: int):
        m = min(8, max(3, round(BITS / math.log2(max(n_codes, 2)))))
        widths = [BITS // m + (j < BITS % m) for j in range(m)]
        self.segments = [(sum(widths[:j]), w) for j, w in enumerate(widths)]
        self.prefix = min(min(widths) - 1, max(LEAST_PREFIX, math.ceil(math.log2(max(1, n_codes / BLOCK)))))

    def blocks(self, code: Column) -> Column:
        """array<struct<segment, block>> of a code."""
        last = (1 << self.prefix) - 1
        return F.array(
            *[
                F.struct(F.lit(j).alias("segment"), F.shiftrightunsigned(code, shift + width - self.prefix).bitwiseAND(F.lit(last)).cast("int").alias("block"))
                for j, (shift, width) in enumerate(self.segments)
            ]
        )


def visits(asked: DataFrame, cuts: Cuts, radius: int) -> DataFrame:
    """(segment, block, code, bound): a row for each block that a query must look into up to this radius."""
    near = [x for x in range(1 << cuts.prefix) if x.bit_count() <= radius]
    own = asked.select("code", "bound", F.explode(cuts.blocks(F.col("code"))).alias("own"))
    every = own.select("*", F.explode(F.array(*[F.lit(x) for x in near])).alias("mask"))
    return every.select(F.col("own.segment").alias("segment"), F.col("own.block").bitwiseXOR(F.col("mask")).alias("block"), "code", "bound")


class Block:
    """The codes of one block of one segment, by their value's other bits."""

    def __init__(self, cuts: Cuts, segment: int, block: int, codes: np.ndarray, ids: pa.ListArray):
        self.cuts, self.segment, self.block, self.codes = cuts, segment, np.uint64(block), codes
        self.shift, width = cuts.segments[segment]
        self.low = width - cuts.prefix
        self.ids, offsets = ids.flatten().to_numpy(), ids.offsets.to_numpy().astype(np.int64)
        self.id_first, self.id_count = offsets[:-1] - offsets[0], np.diff(offsets)
        value = self.low_bits(codes)
        self.order = np.argsort(value, kind="stable")
        self.first = np.searchsorted(value[self.order], np.arange((1 << self.low) + 1, dtype=np.uint64))

    def low_bits(self, codes: np.ndarray) -> np.ndarray:
        return (codes >> np.uint64(self.shift)) & np.uint64((1 << self.low) - 1)

    def met_first_here(self, differing: np.ndarray, radius: int) -> np.ndarray:
        """Whether no other segment meets the pair at a smaller radius, or at this one with a smaller number."""
        m = len(self.cuts.segments)
        meets = [np.bitwise_count((differing >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) * m + j for j, (s, w) in enumerate(self.cuts.segments)]
        return np.min(meets, axis=0) == radius * m + self.segment

    def search(self, codes: np.ndarray, bounds: np.ndarray, radii: list[int], keep: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place of the query, distance, id): at most ``keep`` nearest of each query, within its bound."""
        name = (codes >> np.uint64(self.shift + self.low)) & np.uint64((1 << self.cuts.prefix) - 1)
        apart = np.bitwise_count(name ^ self.block)
        low, found = self.low_bits(codes), []
        for radius in radii:
            for h in range(max(0, radius - self.low), min(radius, self.cuts.prefix) + 1):
                masks, here = bit_masks(self.low, radius - h), np.flatnonzero(apart == h)
                step = max(1, PROBES // len(masks))
                waiting = [here[i : i + step] for i in range(0, len(here), step)]
                while waiting:
                    some = waiting.pop()
                    probes = (low[some][:, None] ^ masks[None, :]).ravel()
                    lo, size = self.first[probes], self.first[probes + np.uint64(1)] - self.first[probes]
                    if size.sum() > PROBES and len(some) > 1:
                        waiting += [some[: len(some) // 2], some[len(some) // 2 :]]
                        continue
                    before = np.cumsum(size) - size
                    place = self.order[np.repeat(lo - before, size) + np.arange(size.sum())]
                    query = np.repeat(some, len(masks)).repeat(size)
                    differing = self.codes[place] ^ codes[query]
                    distance = np.bitwise_count(differing).astype(np.int64)
                    near = np.flatnonzero(distance <= bounds[query])
                    near = near[self.met_first_here(differing[near], radius)]
                    if len(near):
                        found.append(self.nearest(query[near], distance[near], place[near], keep))
        return found

    def nearest(self, query: np.ndarray, distance: np.ndarray, place: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = self.id_count[place]
        query, distance = query.repeat(n), distance.repeat(n)
        ids = self.ids[np.repeat(self.id_first[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        order = np.lexsort((ids, distance, query))
        query, distance, ids = query[order], distance[order], ids[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        return query[rank < keep], distance[rank < keep], ids[rank < keep]


def _searched(index: DataFrame, asked: DataFrame, cuts: Cuts, radii: list[int], keep: int) -> DataFrame:
    """(code, distance, id) from sorted partitions: a block's codes come first, then its queries, in any number."""
    schema = pa.schema([("code", pa.int64()), ("distance", pa.int64()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("segment", "block", "part", "is_query")], axis=1)
            borders = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for start, end in zip(borders, borders[1:]):  # noqa: B905  (neighbours)
                if start == end:
                    continue
                *now, is_query = keys[start].tolist()
                if now != key:
                    key, held, block = now, [], None
                rows = batch.slice(start, end - start)
                codes = rows.column("code").to_numpy().view(np.uint64)
                if not is_query:
                    held.append((codes, rows.column("ids")))
                elif held:
                    if block is None:
                        block = Block(cuts, key[0], key[1], np.concatenate([c for c, _ in held]), pa.concat_arrays([i for _, i in held]))
                    for query, distance, ids in block.search(codes, rows.column("bound").to_numpy(), radii, keep):
                        yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)[query]), pa.array(distance), pa.array(ids)], schema=schema)

    coming = asked.select("segment", "block", "part", F.lit(True).alias("is_query"), "code", F.lit(None).cast("array<bigint>").alias("ids"), "bound")
    held = index.select("segment", "block", "part", F.lit(False).alias("is_query"), "code", "ids", F.lit(0).cast("bigint").alias("bound"))
    dealt = held.unionByName(coming).repartition("segment", "block", "part")
    return dealt.sortWithinPartitions("segment", "block", "part", "is_query").mapInArrow(run, "code bigint, distance bigint, id bigint")


def top_k(
    df: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query, rank, id, distance): for each row that meets ``queries`` its k nearest other rows. ``queries``
    is a condition on a column named ``id``."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    fits = F.assert_true(F.size("v") <= BITS, F.lit(f"a vector has more than {BITS} values"))
    coded = saved(rows.select("id", F.when(fits.isNull(), sign_code(F.col("v"))).alias("code")).distinct())
    keep = k + 1  # a row may meet itself
    by_code = Window.partitionBy("code").orderBy("id")
    # A hot code is cut to its least ids before the shuffle (group limit), so no task gets all its copies.
    entries = coded.withColumn("n", F.row_number().over(by_code)).where(F.col("n") <= keep)
    entries = saved(entries.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    n_codes, n_ids = entries.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    cuts = Cuts(n_codes)

    # Blocks that hold more codes than a task should are dealt to several parts.
    listed = entries.select("code", "ids", F.explode(cuts.blocks(F.col("code"))).alias("at")).select("at.*", "code", "ids")
    parts = saved(listed.groupBy("segment", "block").agg(F.ceil(F.count("*") / BLOCK).cast("bigint").alias("parts")))
    index = saved(listed.join(parts, ["segment", "block"]).withColumn("part", F.pmod(F.xxhash64("code"), F.col("parts"))).drop("parts"))

    wanted = coded.where(queries)
    codes = saved(wanted.select("code").distinct())
    asked, known, m = codes.withColumn("bound", F.lit(BITS).cast("bigint")), None, len(cuts.segments)
    widest = max(w for _, w in cuts.segments)
    for radius in range(1, widest + 1):
        going = visits(asked, cuts, radius).join(parts, ["segment", "block"])
        going = going.select("segment", "block", "code", "bound", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
        found = _searched(index, going, cuts, [0, 1] if radius == 1 else [radius], keep)
        if known is not None:
            found = found.unionByName(known)
        order = Window.partitionBy("code").orderBy("distance", "id")
        known = saved(found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep).drop("n"))
        # Covered: as many ids as can be asked for, none farther than what every segment has been searched for.
        state = known.groupBy("code").agg(F.count("*").alias("n"), F.max("distance").alias("last"))
        full = F.coalesce(F.col("n") >= keep, F.lit(False))
        covered = (full & (F.col("last") < m * (radius + 1))) | F.coalesce(F.col("n") >= n_ids, F.lit(False))
        asked = saved(codes.join(state, "code", "left").where(~covered).select("code", F.when(full, F.col("last")).otherwise(BITS).cast("bigint").alias("bound")))
        if asked.isEmpty():
            break
    answers = known.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("near"))
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query")), 1, k)
    return (
        wanted.select(F.col("id").alias("query"), "code")
        .join(answers, "code")
        .select("query", F.posexplode(others).alias("at", "x"))
        .select("query", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("id"), F.col("x.distance").alias("distance"))
    )
