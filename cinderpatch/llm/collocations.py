"""Phrase collocation mining with a HAT-trie of word ids, exact, per language.

A *window* is a word and up to ``LONGEST - 1`` words that follow it in its piece; each word begins one, and a
phrase's count is the summed count of the windows that begin with it. Tasks count windows in a trie: under each first
word lies a hash container of the windows' other words, which bursts into a container per second word when it grows.
Beyond ``ENTRIES`` windows whole subtrees, the largest first, are spilled as sorted runs and the trie goes on. A run
is dealt to buckets by a hash of the first two words, so each prefix meets in one bucket; there the runs are merged,
and only what is frequent (or may be, with other buckets) leaves. Prefixes that hold more than a quarter of a
bucket's share in a bounded sample of texts are dealt by their next word too, and their parts are summed afterwards:
the sample decides where windows meet, never what is counted.

What is frequent goes on as a plain table: a phrase is joined with its parts for the score, with the longer
candidates that hold it, and ranked within its language.

The shuffle carries a row per run and bucket: its words, once, and windows as numbers into them. Copies of texts are
one window in a task. Buckets number the texts' bytes over ``BUCKET_BYTES``; a bucket is held by one task at a time.
Where there are more than ``WAYS`` buckets (above some 30 GB of text), a spill would have but a few windows for
each, so runs are merged by groups of buckets first, and again until a group is one bucket.

Defined results: a null or empty text has no words; a null language is ``und`` and one with any that is named so;
repeated rows count each; ties are broken by the phrase's bytes. A text longer than ``CHUNK`` is read in parts that
overlap by three words, so all its windows are counted. Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_ROWS, saved

LONGEST = 4
#: Bits of a word's number within a trie; a trie that knows ``WORDS`` words is spilled whole and begun anew.
BITS = 20
WORDS = 120_000
#: Windows that a task holds, of about 120 bytes, and those of a container before it bursts.
ENTRIES = 3 << 17
BURST = 1 << 12
#: Bytes of text that are read before they are counted, that are looked at together at most, that make a bucket, and
#: that tell hot prefixes.
HELD_BYTES = 2 << 20
CHUNK = 1 << 20
BUCKET_BYTES = 8 << 20
SAMPLE_BYTES = 32 << 20
#: Ways into which a run is dealt at once, and windows that are gathered into a longer run.
WAYS = 4_096
GATHERED = 1 << 20
#: A hot prefix holds at least one of so many parts of a bucket's share of the sample, and has this count there at
#: least: both bound their number.
HOT_PARTS = 4
HOT_COUNT = 16

#: A-Z in lower case, ends of pieces as line feeds, tabs as blanks.
_LETTERS = bytes(10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_GAP, _NEXT_WORDS = re.compile(rb"[ \n]"), re.compile(rb"(?: +[^ \n]+){0,%d}" % (LONGEST - 1))


class Words(dict):
    """Word -> its number in a trie, from 1; ``sums`` are checksums of the words, 0 for none."""

    def __init__(self):
        self.names, self.sums = [b""], [0]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.names)
        self.names.append(word)
        self.sums.append(zlib.crc32(word) + 1)
        return n


def chunks(data: bytes) -> Iterator[tuple[bytes, int]]:
    """Parts of translated text, and how many words at a part's end begin no window in it."""
    start = 0
    while start < len(data):
        gap = _GAP.search(data, start + CHUNK)
        end = gap.start() if gap else len(data)
        tail = _NEXT_WORDS.match(data, end).group()
        yield data[start:end] + tail, len(tail.split())
        start = end


def windows(chunk: bytes, tail: int, words: Words) -> np.ndarray:
    """A column for each word that begins a window: the words' numbers from 1, 0 beyond the end of the piece."""
    text = np.frombuffer(chunk, dtype=np.uint8)
    gap = (text == 10) | (text == 32)
    starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    piece = np.cumsum(text == 10, dtype=np.int32)[starts]
    ids = np.fromiter(map(words.__getitem__, chunk.split()), dtype=np.int64, count=len(starts))
    out = np.zeros((LONGEST, len(ids)), dtype=np.int64)
    out[0] = ids
    for d in range(1, min(LONGEST, len(ids))):
        out[d, :-d] = np.where(piece[d:] == piece[:-d], ids[d:], 0)
    return out[:, : len(ids) - tail]


class Trie:
    """Counts of windows: first word -> hash container, or second word -> hash container once that has burst."""

    def __init__(self):
        self.words, self.roots, self.entries = Words(), {}, 0
        self.single = np.zeros(0, dtype=np.int64)

    def add(self, w: np.ndarray) -> None:
        single = np.bincount(w[0], minlength=len(self.words.names))
        single[: len(self.single)] += self.single
        self.single = single
        w = w[:, w[1] > 0]
        pair = (w[0] << BITS) | w[1]
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        rest = ((w[1] << (2 * BITS)) | (w[2] << BITS) | w[3])[order].tolist()
        # borders of equal pairs, and among these the first of each first word
        borders = np.flatnonzero(np.diff(pair, prepend=-1, append=-1))
        words = pair[borders[:-1]] >> BITS
        heads = np.flatnonzero(np.diff(words, prepend=-1, append=-1))
        seconds, borders = (pair[borders[:-1]] & ((1 << BITS) - 1)).tolist(), borders.tolist()
        for word, head, end in zip(words[heads[:-1]].tolist(), heads[:-1].tolist(), heads[1:].tolist(), strict=True):
            container = self.roots.get(word)
            if container is None:
                container = self.roots[word] = defaultdict(int)
            if type(container) is dict:
                for second, s, e in zip(seconds[head:end], borders[head:end], borders[head + 1 : end + 1], strict=True):
                    below = container.get(second)
                    if below is None:
                        below = container[second] = defaultdict(int)
                    self.count(below, rest[s:e])
            else:
                self.count(container, rest[borders[head] : borders[end]])
                if len(container) > BURST:
                    node: dict[int, defaultdict[int, int]] = {}
                    for key, count in container.items():
                        node.setdefault(key >> (2 * BITS), defaultdict(int))[key] = count
                    self.roots[word] = node

    def count(self, container: defaultdict[int, int], keys: list[int]) -> None:
        self.entries -= len(container)
        for key in keys:
            container[key] += 1
        self.entries += len(container)

    def spill(self, left: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows and counts of whole subtrees, the largest first, until at most ``left`` entries stay."""
        parts = lambda c: c.values() if type(c) is dict else [c]
        sizes = sorted([(sum(map(len, c.values())) if type(c) is dict else len(c), w) for w, c in self.roots.items()], reverse=True)
        first, size, keys, counts = [], [], [], []
        for n, word in sizes:
            if self.entries <= left:
                break
            for part in parts(self.roots.pop(word)):
                keys += part.keys()
                counts += part.values()
            first.append(word)
            size.append(n)
            self.entries -= n
        key, mask = np.array(keys, dtype=np.int64), (1 << BITS) - 1
        first = np.array(first, dtype=np.int64).repeat(np.array(size, dtype=np.int64))
        return np.stack([first, key >> (2 * BITS), (key >> BITS) & mask, key & mask]), np.array(counts, dtype=np.int64)

    def singles(self) -> tuple[np.ndarray, np.ndarray]:
        """Each word as a window of its own, with its count."""
        held = np.flatnonzero(self.single)
        w = np.zeros((LONGEST, len(held)), dtype=np.int64)
        w[0] = held
        return w, self.single[held]


def _mixed(columns: Iterable[np.ndarray | int], n: int) -> np.ndarray:
    x = np.full(n, 0x9E3779B97F4A7C15, dtype=np.uint64)
    for c in columns:
        x = (x ^ (np.uint64(c) if isinstance(c, int) else c)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    return x


def prefix_hashes(lang: str, w: np.ndarray, sums: np.ndarray) -> list[np.ndarray]:
    """Hashes of the first two, three and four words of each window, alike in every task."""
    words = [sums[c] for c in w]
    return [_mixed([zlib.crc32(lang.encode()), *words[:d]], w.shape[1]) for d in (2, 3, 4)]


def _bucket(hashes: list[np.ndarray], hot: np.ndarray, buckets: int) -> np.ndarray:
    place = np.where(np.isin(hashes[0], hot), np.where(np.isin(hashes[1], hot), hashes[2], hashes[1]), hashes[0])
    return ((place >> np.uint64(8)) % np.uint64(buckets)).astype(np.int32)


_RUN = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("size", pa.int32()), ("words", pa.binary()), ("windows", pa.binary()), ("counts", pa.binary())])
_RUN_COLUMNS = "lang string, bucket int, size int, words binary, windows binary, counts binary"


def _least_bytes(x: np.ndarray) -> bytes:
    """Little-endian numbers of as many bytes as the largest needs; a row's ``size`` tells how many."""
    return x.astype(np.min_scalar_type(x.max()).newbyteorder("<")).tobytes()


def _numbers(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{len(data) // size}").astype(np.int64)


def _run_rows(lang: str, w: np.ndarray, counts: np.ndarray, words: Words, hot: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A trie's spilled windows as a sorted run."""
    return _dealt(lang, w, counts, _bucket(prefix_hashes(lang, w, np.array(words.sums, dtype=np.uint64)), hot, buckets), words.names)


def _dealt(lang: str, w: np.ndarray, counts: np.ndarray, bucket: np.ndarray, names: list[bytes]) -> pa.RecordBatch:
    """A sorted run: a row for each bucket, with its words and its windows as places among them; equal windows are
    summed."""
    order = np.lexsort(((w[2] << 32) | w[3], (w[0] << 32) | w[1], bucket))
    w, counts, bucket = w[:, order], counts[order], bucket[order]
    new = np.flatnonzero(np.concatenate(([True], (w[:, 1:] != w[:, :-1]).any(axis=0) | (bucket[1:] != bucket[:-1]))))
    w, counts, bucket = w[:, new], np.add.reduceat(counts, new), bucket[new]
    rows, borders = [], [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    for s, e in zip(borders, borders[1:]):  # noqa: B905  (neighbours)
        part = w[:, s:e]
        held = np.unique(part)
        held = held[held > 0]
        places = np.where(part > 0, np.searchsorted(held, part) + 1, 0)
        rows.append((lang, int(bucket[s]), e - s, b"\n".join(map(names.__getitem__, held.tolist())), _least_bytes(places), _least_bytes(counts[s:e])))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _RUN, strict=True)], schema=_RUN)


def _joined(runs: list[tuple[int, int, bytes, bytes, bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Rows of several runs as (names, windows, counts) under one numbering of words."""
    lists = [words.split(b"\n") for _, _, words, _, _ in runs]
    names = [b"", *set().union(*lists)]
    number = dict(zip(names, range(len(names)), strict=True))
    columns = []
    for words, (_, size, _, places, _) in zip(lists, runs, strict=True):
        own = np.array([0, *map(number.__getitem__, words)], dtype=np.int64)
        columns.append(own[_numbers(places, LONGEST * size).reshape(LONGEST, size)])
    return names, np.concatenate(columns, axis=1), np.concatenate([_numbers(c, size) for _, size, _, _, c in runs])


def _by_key(batches: Iterator[pa.RecordBatch], most: int, part: int) -> Iterator[tuple[str, list[tuple[int, int, bytes, bytes, bytes]]]]:
    """(language, rows) of sorted partitions: the rows of ``part`` neighbouring buckets together, ``most`` windows at a time."""
    key, held, windows_held = None, [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            for lang, bucket, size, *rest in zip(*(c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns), strict=True):
                if held and ((bucket // part, lang) != key or windows_held + size > most):
                    yield key[1], held
                    held, windows_held = [], 0
                key = bucket // part, lang
                held.append((bucket, size, *rest))
                windows_held += size
    if held:
        yield key[1], held


def _gathered(runs: DataFrame, buckets: int) -> DataFrame:
    """Short rows become long ones where there are more than ``WAYS`` buckets: rows are dealt by groups of buckets first,
    and neighbours in a group are merged into longer runs, which hold more windows of each bucket."""
    part = math.ceil(buckets / WAYS)
    if part == 1:
        return runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, held in _by_key(batches, GATHERED, part):
            names, w, counts = _joined(held)
            bucket = np.array([b for b, *_ in held], dtype=np.int32).repeat([size for _, size, *_ in held])
            yield _dealt(lang, w, counts, bucket, names)

    group = F.floor(F.col("bucket") / part)
    return _gathered(runs.repartition(group).sortWithinPartitions(group, "lang").mapInArrow(run, _RUN_COLUMNS), part)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, int]]:
    """(language, chunk, tail) of the rows' texts; those of a language go together, some ``HELD_BYTES`` at a time."""
    texts, held = defaultdict(list), 0

    def looked_at() -> Iterator[tuple[str, bytes, int]]:
        for lang in sorted(texts):
            for chunk, tail in chunks(b"\n".join(texts.pop(lang))):
                if not chunk.isspace():
                    yield lang, chunk, tail

    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            for lang, text in zip(*(c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns), strict=True):
                if text:
                    texts[lang].append(text.encode().translate(_LETTERS))
                    held += len(texts[lang][-1])
            if held >= HELD_BYTES:
                yield from looked_at()
                held = 0
    yield from looked_at()


def _hot(given: DataFrame, size: int, buckets: int) -> np.ndarray:
    """Hashes of the prefixes that are hot in a sample: at most ``HOT_PARTS * buckets`` pairs and as many triples, and no
    more than the sample's words over ``HOT_COUNT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, chunk, tail in _texts(batches):
            words = Words()
            w = windows(chunk, tail, words)
            for d, hashes in zip((2, 3), prefix_hashes(lang, w, np.array(words.sums, dtype=np.uint64)), strict=False):
                keys, counts = np.unique(hashes[w[d - 1] > 0], return_counts=True)
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["prefix", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([w.shape[1]], pa.int64())], names=["prefix", "n"])

    sample = given.sample(min(1.0, SAMPLE_BYTES / size), seed=1) if size > SAMPLE_BYTES else given
    counted = saved(sample.mapInArrow(run, "prefix bigint, n bigint").groupBy("prefix").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_COUNT))
    total = counted.where("prefix is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = counted.where(F.col("prefix").isNotNull() & (F.col("n") * HOT_PARTS * buckets > total)).select("prefix").collect()
    return np.array(sorted(r[0] for r in hot), dtype=np.int64).view(np.uint64)


def _runs(given: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, Trie] = {}

        def spilled(lang: str, left: int) -> Iterator[pa.RecordBatch]:
            w, counts = tries[lang].spill(left)
            if len(counts):
                yield _run_rows(lang, w, counts, tries[lang].words, hot, buckets)

        def ended(lang: str) -> Iterator[pa.RecordBatch]:
            yield from spilled(lang, 0)
            trie = tries.pop(lang)
            yield _run_rows(lang, *trie.singles(), trie.words, hot, buckets)

        for lang, chunk, tail in _texts(batches):
            trie = tries.setdefault(lang, Trie())
            trie.add(windows(chunk, tail, trie.words))
            while sum(t.entries for t in tries.values()) > ENTRIES:
                largest = max(tries, key=lambda x: tries[x].entries)
                yield from spilled(largest, tries[largest].entries // 2)
            while sum(len(t.words) for t in tries.values()) > WORDS:
                yield from ended(max(tries, key=lambda x: len(tries[x].words)))
        for lang in list(tries):
            yield from ended(lang)

    return given.mapInArrow(run, _RUN_COLUMNS)


_PHRASE = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])


def _merged(lang: str, runs: list[tuple[int, int, bytes, bytes, bytes]], hot: np.ndarray, least: int) -> pa.RecordBatch:
    """The frequent phrases of a bucket, and the words of its language that it counted (k = 0)."""
    names, w, counts = _joined(runs)
    checks = np.array([0, *(zlib.crc32(x) + 1 for x in names[1:])] if len(hot) else [], dtype=np.uint64)
    order = np.lexsort(((w[2] << 32) | w[3], (w[0] << 32) | w[1]))
    w, counts = w[:, order], counts[order]
    rows = [(lang, 0, "", int(counts[w[1] == 0].sum()))]
    changed = np.zeros(w.shape[1], dtype=bool)
    changed[:1] = True
    for d in range(1, LONGEST + 1):
        changed[1:] |= w[d - 1, 1:] != w[d - 1, :-1]
        if d == 1:  # words are counted as windows of their own
            starts = np.flatnonzero(w[1] == 0)
            starts = starts[changed[starts]]
            sums = np.add.reduceat(np.where(w[1] == 0, counts, 0), starts) if len(starts) else starts
        else:
            starts = np.flatnonzero(changed)
            sums = np.add.reduceat(counts, starts)
        kept = (w[d - 1, starts] > 0) & (sums >= least)
        if d in (2, 3) and len(hot):
            kept |= (w[d - 1, starts] > 0) & np.isin(prefix_hashes(lang, w[:, starts], checks)[d - 2], hot)
        for at, n in zip(starts[kept].tolist(), sums[kept].tolist(), strict=True):
            rows.append((lang, d, b" ".join(map(names.__getitem__, w[:d, at].tolist())).decode(), n))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _PHRASE, strict=True)], schema=_PHRASE)


def frequent_phrases(df: DataFrame, least: int = 30, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, k, phrase, n): phrases of up to four words with a count of at least ``least``, and with k = 0 the number
    of all words of the language."""
    given = df.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    size = given.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(math.ceil(size / BUCKET_BYTES), 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = _hot(given, size, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, held in _by_key(batches, 1 << 62, 1):
            yield _merged(lang, held, hot, least)

    dealt = _gathered(_runs(given, hot, buckets), buckets).repartition("bucket").sortWithinPartitions("bucket", "lang")
    counted = dealt.mapInArrow(run, "lang string, k int, phrase string, n bigint")
    return counted.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("k") == 0))


def mine(df: DataFrame, least: int = 30, top: int = 2_000, held_percent: int = 80, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to four words."""
    counts = saved(frequent_phrases(df, least, text, lang))
    phrases = counts.where("k > 0")
    found = phrases.where("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    part = lambda words, start, n: F.array_join(F.slice(words, start, n), " ")
    cuts = found.select("lang", "phrase", "k", "a", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = saved(cuts.select("lang", "phrase", "a", "cut", part(F.col("words"), F.lit(1), F.col("cut")).alias("first"), part(F.col("words"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest")))
    known = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cut = cuts.join(known("first", "l"), ["lang", "first"]).join(known("rest", "r"), ["lang", "rest"])
    wide = lambda c: f"cast({c} as decimal(20, 0))"
    cut = cut.withColumn("score", F.expr(f"2000000 * {wide('a')} div ({wide('l')} + {wide('r')})"))
    best = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.*")

    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("k") - 1),
            lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda start: part(F.col("words"), start, n)),
        )
    )
    inside = found.where("k > 2").select("lang", F.explode(spans).alias("phrase"), "a")
    longer = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = best.join(longer, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {held_percent} * a")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counts.where("k = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
