"""N-gram Jaccard join with a token-group matrix.

Documents whose word shingles are equal become one class, whose representative is its least id.

Similar representatives are partitioned into groups in two steps. Every representative has ``BANDS`` keys,
each made of ``ROWS`` minhash values, and follows the least representative with which it shares a key; those
that follow the same one meet, ``GROUP`` at most together, and are linked by exact overlap counts. Who met is
a group; groups that turn out to be parts of one component are joined to one, however large: nearly all
copies of a text are in its group, and texts that share much but reach no link still stand together.

The matrix then holds for every group the union of its members' tokens that can decide a match: with every
set in one global order, two sets that reach the threshold share ``m`` tokens among their first
``n - needed + m`` (the first m of their common tokens stand there in both). So a member of one group
reaches no member of another unless the two groups meet that often in the matrix. Only groups that do are
opened, larger ones in parts, and members of one are counted exactly against the other's, but for those
already known to be of one component. Two members of the same group never become a pair again.

The global order puts tokens that are frequent in a sample last (a bounded table; any order is exact,
this one keeps passages that many documents share out of the matrix). Links and components stay in
DataFrames; the driver holds none of them. Shingles are 64-bit hashes: two different shingles of a pair
collide with a chance under 1e-12.

Defined results: null, empty and wordless text has an empty set, no links and is its own component;
with fewer than ``k`` words the whole sequence is the only shingle; repeated texts are linked; rows that
repeat an id are one node; a very long text is one set of all its shingles; ties in overlap do not matter,
as every link that reaches the threshold counts; a row without an id is linked with nothing and has no
component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, LONG, SLICE_ROWS, saved
from .components import components

#: Keys of a representative, and minhash values in each.
BANDS = 4
ROWS = 2
#: Members of a group that meet in one task, and members of another group that visit them there, on average:
#: they are dealt by a hash of their ids.
GROUP = 256
VISITORS = 512
#: Bits of the filter that keeps texts that no task needs out of the shuffle: 8 MB, broadcast.
FILTER_BITS = 1 << 26
#: Unlinked sets up to which they are counted one by one, not by the inverted matrix of all.
FEW = 16
#: How many tokens of the matrix two groups must share (fewer where sets are smaller than that).
MEETINGS = 16
#: Every so many documents one is sampled for the order; tokens found that often there come last.
SAMPLE_EVERY = 16
SAMPLE_LEAST = 4
#: Bound on the broadcast table of frequent tokens (8 bytes each).
MAX_FREQUENT = 200_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FINAL = np.uint64(0xBF58476D1CE4E5B9)


class Shingler:
    """Sorted distinct shingle hashes of a text."""

    def __init__(self, k: int):
        self.k, self.known = k, {}

    def tokens(self, text: str | None) -> np.ndarray:
        # On bytes, lower() changes A-Z only and split() parts at exactly 0x20 and 0x09 to 0x0D.
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.empty(0, dtype=np.uint64)
        if len(words) < self.k:
            return np.array([xxhash.xxh3_64_intdigest(b"\0".join(words), seed=1)], dtype=np.uint64)
        known = self.known
        codes = list(map(known.get, words))
        if None in codes:
            if len(known) > CACHE_ENTRIES:
                known.clear()
            for at, code in enumerate(codes):
                if code is None:
                    codes[at] = code = xxhash.xxh3_64_intdigest(words[at])
                    if len(words[at]) <= LONG:
                        known[words[at]] = code
        w = np.array(codes, dtype=np.uint64)
        last = len(w) - self.k + 1
        h = w[:last].copy()
        for i in range(1, self.k):
            h *= _MULTIPLIER
            h ^= h >> np.uint64(31)
            h += w[i : last + i]
        h ^= h >> np.uint64(29)
        h *= _FINAL
        h ^= h >> np.uint64(32)
        return np.unique(h)


_FACTORS = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) | np.uint64(1)


def band_keys(tokens: np.ndarray) -> list[int]:
    """Minhash values under ``BANDS * ROWS`` multipliers, joined to keys."""
    least = (tokens[None, :] * _FACTORS[:, None]).min(axis=1).reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in range(ROWS):
        keys = (keys ^ least[:, row]) * _MULTIPLIER
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64).tolist()


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of size n with any set that reaches the threshold."""
    return -(-percent * n // 100)


def _frequent_tokens(rows: DataFrame, k: int) -> np.ndarray:
    """Sorted tokens that a sample holds often; only their order among others depends on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                sets = [shingler.tokens(text) for text in batch.column("text").slice(at, SLICE_ROWS).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["token"])

    sample = rows.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLE_EVERY)) == 0)
    counts = sample.select("text").mapInArrow(run, "token bigint").groupBy("token").count().where(F.col("count") >= SAMPLE_LEAST)
    top = counts.orderBy(F.desc("count"), "token").limit(MAX_FREQUENT).select("token").toArrow().column("token")
    return np.sort(top.to_numpy().astype(np.int64).view(np.uint64))


MARKS = [f"mark{i}" for i in range(BANDS)]


def _described(rows: DataFrame, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(key, n, digest, meet, prefix, marks...) per document; ``meet`` tokens of the prefix must be shared."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)
    schema = "key bigint, n bigint, digest binary, meet int, prefix array<bigint>, " + ", ".join(f"{m} bigint" for m in MARKS)
    fields = pa.schema(
        [("key", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("meet", pa.int32()), ("prefix", pa.list_(pa.int64()))]
        + [(m, pa.int64()) for m in MARKS]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, late = Shingler(k), shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                sizes, digests, meets, prefixes, marks = [], [], [], [], []
                for text in part.column("text").to_pylist():
                    tokens = shingler.tokens(text)
                    n = len(tokens)
                    sizes.append(n)
                    digests.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                    marks.append(band_keys(tokens) if n else [None] * BANDS)
                    meets.append(min(MEETINGS, needed(n, percent)))
                    size = n - needed(n, percent) + meets[-1]
                    if len(late) and n:
                        place = np.minimum(np.searchsorted(late, tokens), len(late) - 1)
                        common = late[place] == tokens
                        tokens = np.concatenate([tokens[~common], tokens[common]])
                    prefixes.append(tokens[:size].view(np.int64))
                offsets = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes)))
                columns = [part.column("key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(meets, pa.int32()), lists]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(m, pa.int64()) for m in zip(*marks, strict=True))], schema=fields)

    return rows.mapInArrow(run, schema)


def shared_tokens(x: np.ndarray, y: np.ndarray) -> int:
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0


class Overlaps:
    """Exact overlaps of a set with some others, by their inverted matrix or one by one."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        tokens = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        order = np.argsort(tokens, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.tokens, first = np.unique(tokens[order], return_index=True)
        self.first = np.append(first, len(order))

    def linked(self, tokens: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Of the places ``among`` those whose sets reach the threshold."""
        if not len(tokens) or not len(self.tokens):
            return among[:0]
        if len(among) <= FEW:
            overlap = np.array([shared_tokens(tokens, self.sets[i]) for i in among], dtype=np.int64)
        else:
            at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
            at = at[self.tokens[at] == tokens]
            if len(at) < needed(len(tokens), self.percent):
                return among[:0]  # the bound of a query and a group's union
            lengths = self.first[at + 1] - self.first[at]
            starts = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
            overlap = np.bincount(self.owner[starts + np.arange(lengths.sum())], minlength=len(self.sets))[among]
        return among[100 * overlap >= self.percent * (len(tokens) + self.sizes[among] - overlap)]


def _place() -> Column:
    return F.pmod(F.xxhash64("rid"), F.lit(FILTER_BITS))


def _filter_bits(rids: DataFrame) -> np.ndarray:
    """A filter of ids by one hash: ``FILTER_BITS`` bits, whatever the input, made by partial aggregation."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (_place() % 64).cast("int"))
    words = rids.select(F.floor(_place() / 64).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    return bits.view(np.uint64)


def _packed(docs: DataFrame, rids: DataFrame) -> DataFrame:
    """(rid, packed): whole texts, compressed for the shuffle, of all ids among ``rids``; few others pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter_bits(rids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, bits = zstandard.ZstdCompressor(level=1).compress, shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                place = part.column("place").to_numpy().astype(np.uint64)
                part = part.filter(pa.array((bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)))
                packed = [pack((t or "").encode("utf-8", "surrogatepass")) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("rid"), pa.array(packed, pa.binary())], names=["rid", "packed"])

    rows = docs.select(F.col("key").alias("rid"), "text").where("rid is not null")
    return rows.withColumn("place", _place()).mapInArrow(run, "rid bigint, packed binary")


class Forest:
    """Joined nodes."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def _opened(tasks: DataFrame, docs: DataFrame, k: int, percent: int, inner: bool) -> DataFrame:
    """What links connect in a task, as (a, b): each node but the least of those connected, and that least one.
    ``tasks``: host, part, rid, node, member. Inside a group its members are held against each other, and only what
    follows the host is told; else visitors are held against members."""
    met = tasks.join(_packed(docs, tasks), "rid").select("host", "part", "rid", "node", "member", "packed")

    def links(table: pa.Table) -> pa.Table:
        rids, nodes = table.column("rid").to_numpy(), table.column("node").to_numpy()
        member, unpack, shingler = table.column("member").to_numpy(zero_copy_only=False), zstandard.ZstdDecompressor().decompress, Shingler(k)
        sets = [shingler.tokens(unpack(p.as_py()).decode("utf-8", "surrogatepass")) for p in table.column("packed")]
        inside, forest = np.flatnonzero(member), Forest()
        overlaps = Overlaps([sets[i] for i in inside], percent)
        of_member = nodes[inside]
        if inner:
            rest = np.ones(len(inside), dtype=bool)
            for start in np.argsort(rids[inside], kind="stable"):
                if not rest[start]:
                    continue
                rest[start], waiting = False, [start]
                while waiting and rest.any():
                    q = waiting.pop()
                    near = overlaps.linked(sets[inside[q]], np.flatnonzero(rest))
                    rest[near] = False
                    waiting += near.tolist()
                    for i in near:
                        forest.join(int(of_member[q]), int(of_member[i]))
        else:
            known = np.unique(of_member)
            for q in np.flatnonzero(~member):
                own = forest.root(int(nodes[q]))
                apart = np.array([forest.root(int(n)) != own for n in known], dtype=bool)
                among = np.flatnonzero(np.isin(of_member, known[apart]))
                near = overlaps.linked(sets[q], among) if len(among) else among
                for n in np.unique(of_member[near]):
                    forest.join(own, int(n))
        host = table.column("host")[0].as_py()
        found = [(n, root) for n in np.unique(nodes).tolist() if (root := forest.root(n)) != n and not (inner and n == host)]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return met.groupBy("host", "part").applyInArrow(links, "a bigint, b bigint")


def _parts(size: Column, of: int) -> Column:
    return F.ceil(size / of).cast("bigint")


def _dealt(parts: Column) -> Column:
    return F.pmod(F.xxhash64("rid"), parts)


def _every(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))


def followed(up: DataFrame) -> DataFrame:
    """(rid, component): who each rid follows in the end. Each rid follows one other, with a smaller id, as it meets
    others in one task alone but where it leads; so all chains are halved in each round."""
    up = saved(up)
    while True:
        beyond = up.select(F.col("rid").alias("component"), F.col("component").alias("beyond"))
        up = saved(up.join(beyond, "component", "left").select("rid", F.coalesce("beyond", "component").alias("component"), F.col("beyond").isNotNull().alias("moved")))
        if up.where("moved").isEmpty():
            return up.select("rid", "component")
        up = up.select("rid", "component")


def similar_groups(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(rid, node, grp): of each representative the least one of its component so far, and its group."""
    keys = classes.select("rid", F.explode(F.array(*MARKS)).alias("mark"))
    # What is joined is written first: both sides of the join are then shuffled, and Spark can split a hot key.
    leads = saved(keys.groupBy("mark").agg(F.min("rid").alias("lead"), F.count("*").alias("n")).where("n > 1").select("mark", "lead"))
    follows = saved(keys.join(leads, "mark").groupBy("rid").agg(F.min("lead").alias("lead")).where("rid <> lead"))
    sizes = saved(follows.groupBy("lead").agg(_parts(F.count("*"), GROUP).alias("parts")))
    met = saved(follows.join(sizes, "lead").select(F.col("lead").alias("host"), _dealt(F.col("parts")).alias("part"), "rid"))
    leading = sizes.select(F.col("lead").alias("host"), _every(F.col("parts")).alias("part"), F.col("lead").alias("rid"))
    tasks = saved(met.unionByName(leading).withColumns({"node": F.col("rid"), "member": F.lit(True)}))
    found = followed(_opened(tasks, docs, k, percent, inner=True).toDF("rid", "component"))
    known = classes.select("rid").distinct().join(found, "rid", "left").join(met, "rid", "left")
    home = F.xxhash64(F.coalesce("host", "rid"), F.coalesce("part", F.lit(0).cast("bigint")))
    placed = saved(known.select("rid", F.coalesce("component", "rid").alias("node"), home.alias("home")))
    # A group that is all of one component goes by the component.
    homes = saved(placed.groupBy("home").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("home", F.lit(True).alias("mixed")))
    return placed.join(homes, "home", "left").select(
        "rid", "node", F.when(F.col("mixed"), F.col("home")).otherwise(F.xxhash64(F.lit("component"), "node")).alias("grp")
    )


def group_links(docs: DataFrame, described: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links between nodes of different groups. ``classes``: digest, rid, node, grp, meet of the
    representatives."""
    sizes = saved(classes.groupBy("grp").agg(F.count("*").alias("size"), F.min("meet").alias("meet")))
    representatives = classes.select("digest", F.col("rid").alias("key"), "grp")
    held = saved(described.select("digest", "key", "prefix").join(representatives, ["digest", "key"]).select("grp", "prefix"))
    cells = held.select("grp", F.explode("prefix").alias("token"))
    several = saved(cells.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("token"))
    matrix = saved(cells.join(several, "token").select("token", "grp").distinct())
    met = (
        matrix.alias("x")
        .join(matrix.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.grp") < F.col("y.grp")))
        .groupBy(F.col("x.grp").alias("g1"), F.col("y.grp").alias("g2"))
        .agg(F.count("*").alias("shared"))
    )
    end = lambda i: sizes.select(F.col("grp").alias(f"g{i}"), F.col("size").alias(f"s{i}"), F.col("meet").alias(f"m{i}"))
    qualifying = saved(met).join(end(1), "g1").join(end(2), "g2").where(F.col("shared") >= F.least("m1", "m2"))
    larger = F.col("s1") >= F.col("s2")  # the larger group stays, the smaller one visits
    visits = saved(
        qualifying.select(
            *[F.when(larger, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(n) for c, n in (("g", "host"), ("s", "host_size"))],
            F.when(larger, F.col("g2")).otherwise(F.col("g1")).alias("grp"),
        )
    )
    # A host's members are dealt to rows of the task grid, its visitors to columns.
    members = classes.select("rid", "node", "grp")
    visitors = saved(visits.join(members, "grp").select("host", "host_size", "node", "rid"))
    hosts = saved(visitors.groupBy("host").agg(F.max("host_size").alias("host_size"), F.count("*").alias("n")))
    columns, height = _parts(F.col("n"), VISITORS), _parts(F.col("host_size"), GROUP)
    coming = visitors.join(hosts.select("host", "n"), "host").select(
        "host", _every(height).alias("at"), _dealt(columns).alias("column"), columns.alias("columns"), "rid", "node", F.lit(False).alias("member")
    )
    staying = members.join(hosts.withColumnRenamed("host", "grp"), "grp").select(
        F.col("grp").alias("host"), _dealt(height).alias("at"), _every(columns).alias("column"), columns.alias("columns"), "rid", "node", F.lit(True).alias("member")
    )
    tasks = coming.unionByName(staying).select("host", (F.col("at") * F.col("columns") + F.col("column")).alias("part"), "rid", "node", "member")
    return _opened(saved(tasks), docs, k, percent, inner=False)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: key, n_shingles, component_id (the least key that links reach). Two documents
    link when 100 * intersection >= percent * union of their k-word shingle sets."""
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    described = saved(_described(rows, k, percent, _frequent_tokens(rows, k)))
    per_class = described.where("n > 0 and key is not null").groupBy("digest")
    classes = saved(per_class.agg(*[F.min(c).alias(a) for c, a in (("key", "rid"), ("meet", "meet"), *zip(MARKS, MARKS, strict=True))]))
    groups = saved(similar_groups(rows, classes, k, percent))
    grouped = saved(classes.select("digest", "rid", "meet").join(groups, "rid"))
    joined = saved(components(group_links(rows, described, grouped, k, percent)))
    by_class = saved(grouped.join(joined, "node", "left").select("digest", F.coalesce("component", "node").alias("component")))
    return (
        described.select("key", "n", "digest")
        .join(by_class, "digest", "left")
        .select("key", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("key").isNotNull(), F.col("component")).otherwise(F.col("key")).alias("component_id"))
    )


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Pipeline stage: of each component the document with the least id stays; of rows that repeat that id
    the first in the order of their columns (but maps). Rows without an id stay, as nothing tells them
    apart. Columns are those of the input."""
    found = near_duplicates(docs, k=k, percent=percent).where("key = component_id").select("key").distinct()
    orderly = [n for n, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("key"), F.struct("*").alias("row"))
    order = F.struct(*[F.col("row").getField(n) for n in orderly])
    kept = rows.join(found, "key", "left_semi").groupBy("key").agg(F.min_by("row", order).alias("row"))
    return kept.unionByName(rows.where("key is null")).select(*[F.col("row").getField(n).alias(n) for n in docs.columns])
