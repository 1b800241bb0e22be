"""Ranked lexical search over impact vectors in buckets of falling length, exact.

A document's vector has a value per query term that it holds, its impact; an item's score is the weighted sum of the
impacts of its terms. Both sides carry the square root of a term's weight, so that the score is the inner product of
two vectors. All vectors are ordered by length (range partitions, sorted inside), and a bucket is a run of them:

* *Buckets.* By Cauchy-Schwarz no score in a bucket exceeds the item's length times that of the bucket's first vector.
  An item whose least kept score is higher skips the bucket; a task whose items all skip one is done, as what
  follows is shorter. The longest vectors are searched first, by themselves: the scores found there are where all
  other tasks begin, and rows too short for every item are not even sent to Python.
* *Coordinates.* Inside, an item's heaviest terms are looked up in the bucket's postings, ``FOCUS`` at a time. What
  they give, plus a bound on all other coordinates (Cauchy-Schwarz over what is left of both vectors, or the
  bucket's highest impact of each term, whichever is less), bounds each vector's score.
* *Rescoring.* Survivors are scored in 64-bit integers over all terms. The bounds are doubles with a margin far
  above their rounding, so nothing is lost, and ties keep the smaller id.

Items come in blocks of at most about ``BLOCK_BYTES`` of text and ``BLOCK_ITEMS`` items, by hash: a block's terms,
weights and least scores are what is collected and shipped, and each block is one pass over the documents. The
vectors are written once per block; they hold query terms only, so texts are neither shuffled nor kept.

Defined results: a null or empty text, or one without a term, has no vector and does not count. A null id counts
but is never an answer. Rows that repeat an id are documents of their own. Each row of items is an item of its own;
one without terms has no answers. Fewer answers than asked for are returned where fewer score above zero. Empty
tables give an empty result. Whole texts are read, however long. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_ROWS, saved

BLOCK_BYTES = 8 << 20
BLOCK_ITEMS = 2_048
#: Coordinates that an item looks up between two bounds, and the part of a bucket that is few enough to rescore.
FOCUS = 6
FEW = 1 / 16
#: Values of the vectors that a task holds as one bucket.
BUCKET_VALUES = 1 << 18
#: The longest vectors, searched first: this part of all.
FIRST_PART = 1 / 16
#: Above any rounding of the doubles in a bound.
MARGIN = 1 + 1e-9

#: Terms are runs of ASCII letters, digits and all that is not ASCII; only A-Z is lower-cased.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERMS).split()


def term_counts(df: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """(key, n, terms, counts) of documents with a term: all its terms' number, and those of the vocabulary."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part, rows = batch.slice(at, SLICE_ROWS), []
                for key, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    words = terms(text.as_py())
                    if words:
                        held = sorted((vocabulary[w], n) for w, n in Counter(words).items() if w in vocabulary)
                        rows.append((key, len(words), [t for t, _ in held], [n for _, n in held]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    given = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return given.mapInArrow(run, "key bigint, n bigint, terms array<int>, counts array<int>")


@dataclass
class Items:
    """A block's items: for each its terms, heaviest first, and their weights times their number in the item."""

    weights: np.ndarray  # by term
    terms: list[np.ndarray]
    factors: list[np.ndarray]

    @classmethod
    def weighed(cls, counts: list[Counter], weights: np.ndarray) -> Items:
        ordered = [sorted(c.items(), key=lambda x: (-int(weights[x[0]]) * x[1] ** 2, x[0])) for c in counts]
        ids = [np.array([t for t, _ in o], dtype=np.int64) for o in ordered]
        return cls(weights, ids, [weights[t] * np.array([n for _, n in o], dtype=np.int64) for t, o in zip(ids, ordered, strict=True)])

    def lengths(self) -> list[np.ndarray]:
        """Of each item's vector, and of what is left of it without its first ``FOCUS`` terms, and so on."""
        squares = [np.divide(f.astype(float) ** 2, self.weights[t], out=np.zeros(len(t)), where=self.weights[t] > 0) for t, f in zip(self.terms, self.factors, strict=True)]
        return [np.sqrt(np.array([s[at:].sum() for at in range(0, len(s) + FOCUS, FOCUS)])) * MARGIN for s in squares]


def impacts(counts: DataFrame, weights: np.ndarray, n_documents: int, n_terms: int) -> DataFrame:
    """(key, length, terms, impacts): the vectors, and the lengths that their weighted values have."""
    schema = pa.schema([("key", pa.int64()), ("length", pa.float64()), ("terms", pa.list_(pa.int32())), ("impacts", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, counted = batch.column("terms"), batch.column("counts")
            sizes = np.diff(held.offsets.to_numpy())
            ids, tf = held.flatten().to_numpy(), counted.flatten().to_numpy().astype(np.int64)
            m = 100 - 25 + (25 * batch.column("n").to_numpy() * n_documents) // n_terms
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m.repeat(sizes))
            squares = np.bincount(np.arange(len(sizes)).repeat(sizes), weights=weights[ids] * impact.astype(float) ** 2, minlength=len(sizes))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(impact.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.sqrt(squares) * MARGIN), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), values], schema=schema)

    answers = counts.where("key is not null and size(terms) > 0")
    return answers.mapInArrow(run, "key bigint, length double, terms array<int>, impacts array<int>")


class Bucket:
    """Vectors of falling length, by row and by term."""

    def __init__(self, part: pa.RecordBatch, n_terms: int):
        self.keys, self.lengths = part.column("key").to_numpy(), part.column("length").to_numpy()
        held = part.column("terms")
        self.sizes = np.diff(held.offsets.to_numpy()).astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.ids, self.impacts = held.flatten().to_numpy(), part.column("impacts").flatten().to_numpy().astype(np.int64)
        self.order = np.argsort(self.ids, kind="stable")
        self.rows = np.arange(len(self.sizes)).repeat(self.sizes)[self.order]
        self.starts = np.searchsorted(self.ids[self.order], np.arange(n_terms + 1))
        self.highest = np.zeros(n_terms, dtype=np.int64)
        np.maximum.at(self.highest, self.ids, self.impacts)

    def survivors(self, items: Items, item: int, least: int, rests: np.ndarray) -> np.ndarray:
        """Rows whose score can reach ``least``: the coordinates looked up are known, the others are bounded."""
        ids, factors = items.terms[item], items.factors[item]
        known, left, rows = np.zeros(len(self.keys)), self.lengths**2, np.arange(len(self.keys))
        # coordinate bounds: no vector gets more from the terms that follow than the bucket's highest impacts give
        highest = np.concatenate([np.cumsum((factors * self.highest[ids])[::-1])[::-1], [0]])
        for at in range(0, len(ids), FOCUS):
            for term, factor in zip(ids[at : at + FOCUS], factors[at : at + FOCUS], strict=True):
                held = slice(self.starts[term], self.starts[term + 1])
                impact = self.impacts[self.order[held]].astype(float)
                known[self.rows[held]] += factor * impact
                left[self.rows[held]] -= items.weights[term] * impact**2
            # what is left is a difference: its rounding grows with the whole length, and so does the margin
            cauchy = rests[at // FOCUS + 1] * np.sqrt(np.maximum(left[rows], 0) + self.lengths[rows] ** 2 * 1e-12)
            rows = rows[known[rows] * MARGIN + np.minimum(cauchy, highest[min(at + FOCUS, len(ids))] * MARGIN) >= least]
            if len(rows) <= FEW * len(self.keys):
                break
        return rows

    def scores(self, items: Items, item: int, rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
        """Exact scores of these rows. ``factor`` is a zeroed work array by term, and is left so."""
        factor[items.terms[item]] = items.factors[item]
        sizes = self.sizes[rows]
        at = np.arange(sizes.sum()) + np.repeat(self.first[rows] - (np.cumsum(sizes) - sizes), sizes)
        upto = np.concatenate([[0], np.cumsum(factor[self.ids[at]] * self.impacts[at])])
        factor[items.terms[item]] = 0
        ends = np.cumsum(sizes)
        return upto[ends] - upto[ends - sizes]


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the sorted vectors with a bounded number of values."""
    for batch in batches:
        upto, start = np.cumsum(np.diff(batch.column("terms").offsets.to_numpy())), 0
        while start < batch.num_rows:
            full = int(np.searchsorted(upto, (upto[start - 1] if start else 0) + BUCKET_VALUES, side="right"))
            end = max(start + 1, full)
            yield batch.slice(start, end - start)
            start = end


def search(vectors: DataFrame, items: Items, least: np.ndarray, k: int) -> DataFrame:
    """(item, key, score): of each task's vectors, sorted by falling length, the k best of each item at or above its
    ``least`` score."""
    schema = pa.schema([("item", pa.int32()), ("key", pa.int64()), ("score", pa.int64())])
    rests = items.lengths()
    whole = np.array([r[0] for r in rests])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bars, factor = least.copy(), np.zeros(len(items.weights), dtype=np.int64)
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in bars]
        for part in buckets(batches):
            going = np.flatnonzero(whole * part.column("length")[0].as_py() >= bars)
            if not len(going):
                break
            bucket = Bucket(part, len(items.weights))
            for item in going.tolist():
                rows = bucket.survivors(items, item, bars[item], rests[item])
                scores = bucket.scores(items, item, rows, factor)
                reached = scores >= bars[item]
                if reached.any():
                    keys, scores = np.concatenate([best[item][0], bucket.keys[rows[reached]]]), np.concatenate([best[item][1], scores[reached]])
                    kept = np.lexsort((keys, -scores))[:k]
                    best[item] = keys[kept], scores[kept]
                    if len(kept) == k:
                        bars[item] = scores[kept[-1]]
        found = [(np.full(len(keys), i, np.int32), keys, scores) for i, (keys, scores) in enumerate(best) if len(keys)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=schema)

    return vectors.mapInArrow(run, "item int, key bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(df: DataFrame, texts: list[str | None], k: int, key: str, text: str) -> DataFrame:
    """(item, rank, key, score), items by their place in ``texts``."""
    counts = [Counter(terms(t)) for t in texts]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
    counts = [Counter({vocabulary[t]: n for t, n in c.items()}) for c in counts]
    counted = saved(term_counts(df, vocabulary, key, text))
    n_documents, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    for term, holding in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        weights[term] = math.floor(1000 * math.log((2 * n_documents + 2) / (2 * holding + 1)))
    items = Items.weighed(counts, weights)

    # Ties in length are dealt by id, so that copies do not meet in one task.
    falling = [F.col("length").desc(), F.xxhash64("key")]
    made = impacts(counted, weights, n_documents, max(n_terms, 1))
    vectors = saved(made.repartitionByRange(*falling).sortWithinPartitions(*falling))
    longest = vectors.agg(F.percentile_approx("length", 1 - FIRST_PART)).first()[0] or 0.0
    bars = np.ones(len(texts), dtype=np.int64)
    first = saved(_ranked(search(vectors.where(F.col("length") >= longest), items, bars, k), k))
    for item, score in first.where(F.col("rank") == k).select("item", "score").collect():
        bars[item] = score
    whole = np.array([r[0] for r in items.lengths()])
    needed = float(np.min(np.divide(bars, whole, out=np.full(len(bars), np.inf), where=whole > 0), initial=np.inf))
    others = vectors.where((F.col("length") < longest) & (F.col("length") >= needed))
    return _ranked(search(others, items, bars, k).unionByName(first.drop("rank")), k)


def top_k(df: DataFrame, asked: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, key, score): for each row of ``asked`` its ``k`` best documents."""
    spark = df.sparkSession
    given = asked.select(F.col(item).alias("item"), F.col(item_text).alias("text"))
    rows, size = given.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(rows / BLOCK_ITEMS), math.ceil(size / BLOCK_BYTES))
    dealt, found = given.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))), None
    for at in range(blocks):
        here = dealt.where(F.col("block") == at).drop("block").orderBy("item", "text").collect()
        if not here and at < blocks - 1:
            continue
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(here)], f"at int, item {dict(given.dtypes)['item']}")
        told = _block(df, [r["text"] for r in here], k, key, text).withColumnRenamed("item", "at")
        told = told.join(F.broadcast(names), "at").select("item", "rank", "key", "score")
        found = told if found is None else found.unionByName(told)
    return found
