"""Language identification by word-first backoff.

A word that the model knows scores its log frequency in each language. A word it does not know backs
off to its character n-grams, longest first: the n-grams of the longest order of which any is known
give their mean score; else the next shorter order is tried.

The model is fitted on a bounded sample of labelled rows (``docs_per_language``, drawn by a hash of the
id) and holds every word and n-gram of that sample, seen once or often, and nothing else: the bound on the
sample bounds what the driver gets and what is broadcast. Counting runs in Spark; prediction reads every
whole text and never sees the label, the source or the id.

Defined results: null text, the empty text and text without a letter give ``und`` with score 0; so does
every text when nothing could be learned. Equal scores go to the language first in name order. Rows
with a null label or null text are not learned from. Repeated rows stay repeated and an empty table
gives an empty result; a very long text is counted word by word as a whole; columns other than those
named are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, LONG, SLICE_ROWS, count_rows, fresh, map_rows

UNDETERMINED = "und"
#: Orders of the character n-grams, longest first; a word is padded with one blank on each side.
ORDERS = (4, 3, 2, 1)
LETTERS = re.compile(r"[^\W\d_]+").findall
SCHEMA = "key bigint, lang_pred string, score double"


def grams(word: str, order: int) -> list[str]:
    padded = f" {word} " if order > 1 else word
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


class Model:
    """Log frequencies by language, as matrix rows: known words, and n-grams of all orders."""

    def __init__(self, languages: list[str], words: list[str], word_scores: np.ndarray, grams: list[str], gram_scores: np.ndarray):
        self.languages, self.words, self.word_scores, self.grams, self.gram_scores = languages, words, word_scores, grams, gram_scores
        self.gram_rows = {g: i for i, g in enumerate(grams)}  # an n-gram's length is its order
        self.clear()

    def tables(self) -> tuple:
        """What makes an equal model."""
        return self.languages, self.words, self.word_scores, self.grams, self.gram_scores

    def clear(self) -> None:
        self.rows = {w: i for i, w in enumerate(self.words)}
        self.used = len(self.words)
        self.scores = np.vstack([self.word_scores, np.zeros((1024, self.word_scores.shape[1]))])

    def backoff(self, word: str) -> list[int]:
        """Rows of the known n-grams of the longest order that has any."""
        rows = self.gram_rows
        for order in ORDERS:
            found = [rows[g] for g in grams(word, order) if g in rows]
            if found:
                return found
        return []

    def learn(self, words: list[str]) -> None:
        """Score words that were not seen before, all at once."""
        first = self.used
        self.used += len(words)
        while first + len(words) > len(self.scores):
            self.scores = np.vstack([self.scores, np.zeros_like(self.scores)])
        flat, at, own = [], [], []
        for i, word in enumerate(words):
            self.rows[word] = first + i
            if found := self.backoff(word):
                at.append(len(flat))
                own.append(first + i)
                flat += found
        self.scores[first : first + len(words)] = 0
        if flat:
            sizes = np.diff([*at, len(flat)])
            self.scores[own] = np.add.reduceat(self.gram_scores[flat], at, axis=0) / sizes[:, None]

    def predict(self, text: str | None) -> tuple[str, float]:
        words = LETTERS(text.lower()) if text else []
        if not self.languages or not any(c.isalpha() for w in words for c in w):
            return UNDETERMINED, 0.0
        counts = Counter(words)
        if len(self.rows) > len(self.words) + CACHE_ENTRIES:
            self.clear()
        new = [w for w in counts if w not in self.rows]
        self.learn(new)
        at = list(map(self.rows.__getitem__, counts))
        for word in new:
            if len(word) > LONG:
                del self.rows[word]
        total = np.fromiter(counts.values(), float, len(counts)) @ self.scores[at]
        best = int(total.argmax())
        # Divided by the root of the length, the score stays comparable between short and long texts.
        share = np.exp((total - total[best]) / math.sqrt(len(words)))
        return self.languages[best], float(1 / share.sum())


def log_frequencies(counts: np.ndarray, smoothing: float) -> np.ndarray:
    """Of each item (row) in each language (column), centred over the languages."""
    logs = np.log((counts + smoothing) / (counts.sum(axis=0) + smoothing * len(counts)))
    return logs - logs.mean(axis=1, keepdims=True)


def fit(
    labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_language: int = 400, smoothing: float = 0.5
) -> Model:
    """Learn from rows with a text and a label. The driver gets the distinct words and n-grams of about
    ``docs_per_language`` documents per label, with a count for each label."""
    rows = labelled.select(
        F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")
    ).where("text is not null and lang is not null")
    # Labels alone decide the sampling rate; only the small columns are read here.
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], [], np.zeros((0, 1)), [], np.zeros((0, 1)))
    rate = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, docs_per_language / n)))])
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.where(draw < F.element_at(rate, F.col("lang"))).select("text", "lang")

    def words_of(r: dict):
        return (((r["lang"], word), n) for word, n in Counter(LETTERS(r["text"].lower())).items())

    def grams_of(r: dict):
        return (((r["lang"], order, gram), r["n"]) for order in ORDERS for gram in grams(r["word"], order))

    fields = [pa.field("lang", pa.string()), pa.field("word", pa.string()), pa.field("n", pa.int64())]
    words = count_rows(sample, words_of, "lang string, word string, n bigint", fields).groupBy("word", "lang").agg(F.sum("n").alias("n"))
    gram_fields = [pa.field("lang", pa.string()), pa.field("size", pa.int32()), pa.field("item", pa.string()), pa.field("n", pa.int64())]
    items = count_rows(words, grams_of, "lang string, size int, item string, n bigint", gram_fields).unionByName(
        words.select("lang", F.lit(0).alias("size"), F.col("word").alias("item"), "n")
    )
    place = F.create_map(*[x for at, k in enumerate(languages) for x in (F.lit(k), F.lit(at))])
    by_item = (
        items.groupBy("size", "item", "lang")
        .agg(F.sum("n").alias("n"))
        .groupBy("size", "item")
        .agg(F.collect_list(F.struct(F.element_at(place, F.col("lang")).alias("at"), "n")).alias("by_lang"))  # a row per label at most
        .orderBy("size", "item")
        .toArrow()
        .combine_chunks()
    )
    sizes_of, found = by_item["size"].to_numpy(), by_item["by_lang"].combine_chunks()
    counts = np.zeros((len(by_item), len(languages)))
    owner = np.repeat(np.arange(len(by_item)), np.diff(found.offsets.to_numpy()))
    cells = found.flatten()
    counts[owner, cells.field("at").to_numpy()] = cells.field("n").to_numpy()
    named = by_item["item"].to_pylist()
    logs = np.vstack([log_frequencies(counts[sizes_of == size], smoothing) for size in range(max(ORDERS) + 1)])  # rows are sorted by size
    n_words = int((sizes_of == 0).sum())
    return Model(languages, named[:n_words], logs[:n_words], named[n_words:], logs[n_words:])


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, lang_pred, score (0 to 1; the share of the best language)."""
    shared = df.sparkSession.sparkContext.broadcast(model.tables())

    def make():
        own = Model(*shared.value)

        def row(r: dict):
            yield r["key"], *own.predict(r["text"])

        return row

    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    fields = [pa.field("key", pa.int64()), pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())]
    return map_rows(rows, make, SCHEMA, fields)


def filter_documents(docs: DataFrame, min_score: float = 0.5, **fit_options) -> DataFrame:
    """Pipeline stage: learns from the labels of ``docs`` and drops documents whose language cannot be
    told (``und``) or whose best language has a share under ``min_score``. Clean prose stays. Columns
    are those of the input; ``lang`` keeps the given label and takes the prediction where it was null.
    When nothing could be learned, only documents without a letter go and nulls become ``und``."""
    model = fit(docs, **fit_options)
    if not model.grams:
        lettered = docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
        return lettered.withColumn("lang", F.coalesce("lang", F.lit(UNDETERMINED))).select(*docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(model.tables())
    names, mark = docs.columns, fresh(docs, "told")

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(*shared.value)  # for this task alone
        for texts in batches:
            found: list[tuple[str, float]] = []
            for at in range(0, len(texts), SLICE_ROWS):
                found += [own.predict(t) for t in texts.slice(at, SLICE_ROWS).to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], ["lang_pred", "score"])

    told = told.asNondeterministic()  # else the filter and the projection would each run it
    marked = docs.withColumn(mark, told(F.col("text").cast("string")))
    kept = marked.where((F.col(mark)["lang_pred"] != UNDETERMINED) & (F.col(mark)["score"] >= min_score))
    return kept.withColumn("lang", F.coalesce("lang", F.col(mark)["lang_pred"])).select(*names)
