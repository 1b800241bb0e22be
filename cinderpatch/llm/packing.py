"""Vector bin packing of token sequences.

Each example is a vector: tokens, segments (one) and loss-bearing tokens. A sequence is a bin with a
limit on each. The open bin takes, among a pool of examples that fit, the one whose vector has the
largest dot product with what the bin has left (each part as a share of its limit); when none fits, or
the last segment is due, an example is cut so that the bin is filled. Cutting is free: the rest goes
back to the pool.

Packing runs inside each partition with a bounded pool, so nothing is shuffled and no group grows; the
partition number makes the sequence ids unique. A bin that cannot be filled (a partition's last one)
is laid out as sequences whose lengths are powers of two, which need no padding.

A prompt's tokens bear no loss, so for instruction data the three limits differ.

Defined results: null text counts as the empty text, whose only token is the end mark; repeated rows
are examples of their own; of examples with equal dot products the one that has waited longest is taken;
a very long text is tokenized in blocks cut at white space and fills as many sequences as it needs; an
empty table gives an empty result; other columns are ignored. A null key stays null.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, give_back

#: Characters that normalization leaves as they are but for lower case, each by itself: Latin and Cyrillic
#: letters and what lies between them, without combining marks and the capital I with a dot.
SIMPLE = regex.compile(r"[\x20-\x7e\u00a1-\u012f\u0131-\u024f\u0400-\u0482\u048a-\u052f]*").fullmatch
#: Normalizers and pre-tokenizers for which words can be parted here; all else goes to the library.
KNOWN_PARTS = ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]
BORDER = b"\xff\xff\xff\xff"  # no id
NOTHING = np.empty(0, dtype="<u4")
CUT = re.compile(r"[ \t\n\r]").search
#: Bytes of text whose chunks are told apart together, and rows that are looked at together.
BLOCK = 1 << 23
BLOCK_ROWS = 4096
#: A bin is filled once the pool holds this many bins' tokens and more examples than a bin's segments.
POOL_BINS = 2
#: Words whose ids a task remembers from block to block, about 200 bytes each: 60 MB.
WORD_CACHE = 300_000
#: A bin with at most this many free tokens is padded as it is.
LITTLE = 16
SCHEMA = (
    "key bigint, start bigint, length bigint, loss_tokens bigint, token_bytes binary, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)
FIELDS = pa.schema(
    [
        ("key", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("loss_tokens", pa.int64()),
        ("token_bytes", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)


class ChunkTokenizer:
    """Ids of texts. The distinct chunks (between ASCII white space) of a block of texts are tokenized once, and
    the words in them once for many blocks. Where the file's own pattern parts words of simple characters, they
    go straight to the library's model, one call for each new word; any other chunk goes through the whole library."""

    def __init__(self, data: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data)
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {" ": BORDER}
        spec = json.loads(data)
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        steps = [*(spec.get("normalizer") or {}).get("normalizers", ()), *(spec.get("pre_tokenizer") or {}).get("pretokenizers", ())]
        self.parted = None
        if [step["type"] for step in steps] == KNOWN_PARTS:
            self.parted = regex.compile(f"\\x20|{steps[3]['pattern']['Regex']}").findall

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text. Texts are taken together up to ``BLOCK`` bytes; a longer one is cut at white space."""
        texts = pc.fill_null(texts, "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), BLOCK, side="right")) + at)
            if to > at + 1 or sizes[at] <= BLOCK:
                yield from self.encode_block(texts[at:to])
            else:
                pieces = cut_at_space(texts[at].as_py())
                yield np.concatenate([ids for piece in pieces for ids in self.encode_block(pa.array([piece]))])
            at = to

    def encode_block(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Chunks are told apart once for the whole block; the ids of each text are gathered from those of its chunks."""
        chunked = pc.ascii_split_whitespace(texts)
        coded = chunked.flatten().dictionary_encode()
        ids = self.ids_of(coded.dictionary.to_pylist())
        flat, sizes = np.frombuffer(b"".join(ids), dtype="<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        firsts = np.cumsum(sizes) - sizes
        chunk_at = coded.indices.to_numpy(zero_copy_only=False)
        borders = chunked.offsets.to_numpy() - chunked.offsets[0].as_py()
        for row in range(0, len(texts), SLICE_ROWS):  # a bound on what stands beside the texts
            ends = borders[row : row + SLICE_ROWS + 1]
            at = chunk_at[ends[0] : ends[-1]]
            after = np.concatenate([[0], np.cumsum(sizes[at])])
            found = flat[np.repeat(firsts[at] - after[:-1], sizes[at]) + np.arange(after[-1])]
            to = after[ends - ends[0]].tolist()
            for start, end in zip(to, to[1:]):  # noqa: B905  (neighbours)
                yield found[start:end]

    def ids_of(self, chunks: list[str]) -> list[bytes]:
        """Of each distinct chunk; an empty one has none."""
        if not chunks:
            return []
        text = " ".join(chunks)
        if self.simple(text):
            return self.by_words(chunks, text)
        simple = [self.simple(c) for c in chunks]
        plain, odd = [c for c, s in zip(chunks, simple, strict=True) if s], [c for c, s in zip(chunks, simple, strict=True) if not s]
        of_plain, of_odd = iter(self.by_words(plain, " ".join(plain)) if plain else []), iter(self.encode_chunks(odd))
        return [next(of_plain if s else of_odd) for s in simple]

    def simple(self, text: str) -> bool:
        return self.parted is not None and SIMPLE(text) is not None and not any(s in text for s in self.special)

    def by_words(self, chunks: list[str], text: str) -> list[bytes]:
        words = self.parted(text.lower())
        new = list(set(words).difference(self.words))
        if len(self.words) + len(new) > WORD_CACHE:
            self.words = {" ": BORDER}
            new = list(set(words).difference(self.words))
        self.words.update(zip(new, self.encode_words(new), strict=True))
        return b"".join(map(self.words.__getitem__, words)).split(BORDER)

    def encode_words(self, words: list[str]) -> list[bytes]:
        tokenize, ids, ends = self.model.tokenize, [], [0]
        for word in words:
            ids += [t.id for t in tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LEVEL))]
            ends.append(len(ids))
        data = np.array(ids, dtype="<u4").tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(ends, ends[1:])]

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """One call for all chunks; a token belongs to the chunk in which it starts."""
        encoding = self.tokenizer.encode(" ".join(chunks), add_special_tokens=False)
        ids = np.array(encoding.ids, dtype="<u4").tobytes()
        starts = np.cumsum([0, *(len(c) + 1 for c in chunks)])[1:]
        tokens = np.fromiter(map(itemgetter(0), encoding.offsets), dtype=np.int64)
        ends = np.searchsorted(tokens, starts, side="left")
        return [ids[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def byte_level() -> dict[int, int]:
    """Bytes that byte-level vocabularies write as another character: those that do not print, from U+0100 on."""
    printing = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 0x100 + n for n, b in enumerate(b for b in range(256) if b not in printing)}


BYTE_LEVEL = byte_level()


def cut_at_space(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > BLOCK and (m := CUT(text, at + BLOCK)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


@dataclass
class Piece:
    key: int | None
    start: int
    ids: np.ndarray
    loss: np.ndarray | None  # per token 0 or 1; None: every token bears loss
    doc_tokens: int

    @property
    def loss_tokens(self) -> int:
        return len(self.ids) if self.loss is None else int(self.loss.sum())

    def head_within(self, tokens: int, loss: int) -> int:
        """How many tokens from the front keep both limits."""
        if self.loss is None:
            return min(len(self.ids), tokens, loss)
        n = min(len(self.ids), tokens)
        return int(np.searchsorted(np.cumsum(self.loss[:n]), loss, side="right"))

    def cut(self, n: int) -> tuple[Piece, Piece]:
        first = None if self.loss is None else self.loss[:n]
        rest = None if self.loss is None else self.loss[n:]
        return (
            Piece(self.key, self.start, self.ids[:n], first, self.doc_tokens),
            Piece(self.key, self.start + n, self.ids[n:], rest, self.doc_tokens),
        )


class Packer:
    """Fills one bin after another from a bounded pool; yields lists of pieces, a list per sequence."""

    def __init__(self, tokens: int, segments: int, loss: int):
        if min(tokens, segments, loss) < 1:
            raise ValueError("limits must be 1 or more")
        self.limits = np.array([tokens, segments, loss], dtype=float)
        self.pool: list[Piece] = []
        self.need = np.empty((0, 3))  # the pool's vectors, with spare rows
        self.tokens = 0  # in the pool

    def put(self, piece: Piece) -> None:
        if len(self.pool) == len(self.need):
            self.need = np.concatenate([self.need, np.empty((len(self.need) + 64, 3))])
        self.need[len(self.pool)] = len(piece.ids), 1, piece.loss_tokens
        self.pool.append(piece)
        self.tokens += len(piece.ids)

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        tokens, segments, loss = map(int, self.limits)
        while len(piece.ids) >= tokens or piece.loss_tokens >= loss:
            n = piece.head_within(tokens, loss)
            head, piece = piece.cut(n)
            yield from self.laid_out([head])
        if not len(piece.ids):
            return
        self.put(piece)
        while len(self.pool) > segments and self.tokens >= POOL_BINS * tokens:
            yield from self.laid_out(self.fill())

    def finish(self) -> Iterator[list[Piece]]:
        while self.pool:
            yield from self.laid_out(self.fill())

    def fill(self) -> list[Piece]:
        need = self.need[: len(self.pool)]
        shares = need / self.limits
        free = np.ones(len(self.pool), dtype=bool)
        left, chosen = self.limits.copy(), []
        back: list[Piece] = []
        while left.min() > 0 and free.any():
            fits = free & (need <= left).all(axis=1)
            last = left[1] == 1 and (need[free, 0] > left[0]).any()
            if fits.any() and not last:
                at = int(np.where(fits, shares @ (left / self.limits), -1.0).argmax())
                piece = self.pool[at]
            else:
                at = int(np.where(free, need[:, 0], -1.0).argmax())
                n = self.pool[at].head_within(int(left[0]), int(left[2]))
                if not n:
                    break
                piece, rest = self.pool[at].cut(n)
                if len(rest.ids):
                    back.append(rest)
            free[at] = False
            chosen.append(piece)
            left -= (len(piece.ids), 1, piece.loss_tokens)
        self.pool = [p for p, f in zip(self.pool, free.tolist(), strict=True) if f]
        self.need[: len(self.pool)] = need[free]
        self.tokens = int(self.need[: len(self.pool), 0].sum())
        for rest in back:
            self.put(rest)
        return chosen

    def laid_out(self, pieces: list[Piece]) -> Iterator[list[Piece]]:
        total, whole = sum(len(p.ids) for p in pieces), int(self.limits[0])
        pieces = pieces[::-1]
        while total:
            size = total if whole - total <= LITTLE else 1 << total.bit_length() - 1
            total -= size
            row: list[Piece] = []
            while size:
                piece = pieces.pop()
                if len(piece.ids) > size:
                    piece, rest = piece.cut(size)
                    pieces.append(rest)
                row.append(piece)
                size -= len(piece.ids)
            yield row


def _packed(df: DataFrame, examples, tokens: int, segments: int, loss: int) -> DataFrame:
    """``examples`` is called once per task and gives a function from a batch of rows to their pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        first = TaskContext.get().partitionId() << 40
        packer, of_rows, rows, n = Packer(tokens, segments, loss), examples(), [], 0

        def take(sequences) -> None:
            nonlocal n
            for pieces in sequences:
                offset = 0
                for p in pieces:
                    rows.append((p.key, p.start, len(p.ids), p.loss_tokens, p.ids.tobytes(), p.doc_tokens, first + n, offset))
                    offset += len(p.ids)
                n += 1

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), FIELDS, strict=True)], schema=FIELDS
            )
            rows.clear()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                for piece in of_rows(batch.slice(at, BLOCK_ROWS)):
                    take(packer.add(piece))
                    if len(rows) >= SLICE_ROWS:
                        yield out()
        take(packer.finish())
        if rows:
            yield out()

    return df.mapInArrow(run, SCHEMA)


def pack_tokens(
    df: DataFrame,
    key: str = "key",
    token_bytes: str = "token_bytes",
    loss_mask: str | None = None,
    tokens: int = 4096,
    segments: int = 256,
    loss: int = 4096,
) -> DataFrame:
    """Pack ready ids (little-endian unsigned 32-bit) under the three limits; ``loss_mask`` names a binary
    column with a byte 0 or 1 per token (null or none: every token bears loss)."""

    def examples():
        def of_row(r: dict) -> Piece:
            ids = np.frombuffer(r["ids"] or b"", dtype="<u4")
            mask = None if r["mask"] is None else np.frombuffer(r["mask"], dtype="u1")
            if mask is not None and len(mask) != len(ids):
                raise ValueError("a loss mask has another length than its ids")
            return Piece(r["key"], 0, ids, mask, len(ids))

        return lambda rows: map(of_row, rows.to_pylist())

    mask = F.lit(None).cast("binary") if loss_mask is None else F.col(loss_mask)
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(token_bytes).alias("ids"), mask.alias("mask"))
    return _packed(rows, examples, tokens, segments, loss)


def digests(packed: DataFrame) -> DataFrame:
    """Adds ids_crc32 of each piece's ids."""
    return packed.withColumn("ids_crc32", F.crc32("token_bytes"))


def pack_documents(
    docs: DataFrame,
    path: str,
    end_id: int = 2,
    key: str = "doc_id",
    text: str = "text",
    prompt: str | None = None,
    tokens: int = 4096,
    segments: int = 256,
    loss: int = 4096,
) -> DataFrame:
    """Tokenize whole texts, end each with ``end_id`` and pack them. ``prompt`` names a column whose ids come
    before the text's: they bear no loss (null: empty), while the text's ids and the end bear it. Without a
    prompt every token bears loss."""
    with open(path, encoding="utf-8") as f:  # fixed size; executors need not have the file
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def examples():
        tokenizer, end = ChunkTokenizer(data.value), np.array([end_id], dtype="<u4")  # for this task alone

        def of_rows(rows: pa.RecordBatch) -> Iterator[Piece]:
            said = tokenizer.encode_all(rows.column("text"))
            asked = tokenizer.encode_all(rows.column("prompt")) if prompt is not None else repeat(NOTHING)
            for own, text_ids, before in zip(rows.column("key").to_pylist(), said, asked):  # noqa: B905  (repeat has no end)
                ids = np.concatenate([before, text_ids, end])
                mask = (np.arange(len(ids)) >= len(before)).astype("u1") if len(before) else None
                yield Piece(own, 0, ids, mask, len(ids))

        return of_rows

    before = F.lit(None) if prompt is None else F.col(prompt)
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"), before.cast("string").alias("prompt"))
    return _packed(rows, examples, tokens, segments, loss)
