"""Byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 characters so that an Aho-Corasick automaton over the whole vocabulary
finds, in one pass, the longest token that starts at each byte. Encoding walks from longest matches
and steps back when two neighbouring tokens could not have been left side by side by the merge
rules; that pair test is memoised. The result equals applying the merges in rank order, in time
linear in the piece.

Defined results: null text is the empty text; the empty text has no ids; repeated rows stay repeated;
equal texts get equal ids; a very long text costs time and memory in proportion, whatever its pieces; an
empty table gives an empty result; columns other than the named id and text are ignored.
"""

from __future__ import annotations

import base64
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONG, map_rows

#: Pieces, and as many pairs of tokens, that a task remembers: about 100 MB. They go with the task.
CACHE_ENTRIES = 400_000

ENCODED = "key bigint, n_tokens bigint, token_bytes binary"
DECODED = "key bigint, n_tokens bigint, token_bytes binary, decoded binary"


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class BytePairCoder:
    """Encoder and decoder for the content of one rank file; an id is the rank of its merge."""

    def __init__(self, data: bytes, pattern: str):
        self.ranks = read_ranks(data)
        self.tokens = token_table(self.ranks)
        self.length = [len(token) for token in self.tokens]
        self.pieces = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token) - 1))
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.prefix = [self._shorter(token) for token in self.tokens]
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        if token not in self.halves:
            data = self.tokens[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                rank, at = min(
                    (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)
                )
                if rank >= token:
                    raise ValueError(f"token {token} cannot be reached by merges of lower rank")
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = tuple(self.ranks[p] for p in parts) if len(parts) == 2 else None
        return self.halves[token]

    def _shorter(self, token: bytes) -> int:
        """The longest token that is a proper prefix of ``token``; -1 if there is none."""
        return next((r for n in range(len(token) - 1, 0, -1) if (r := self.ranks.get(token[:n])) is not None), -1)

    def compatible(self, left: int, right: int) -> bool:
        """Would the merges leave ``left`` and ``right`` side by side? Undo the later merge of the two,
        again and again; a merge across the border that comes before the one undone rules the pair out."""
        key = left << 32 | right
        before = 1 << 60  # merges across the border below this rank come first
        answer = True
        while True:
            across = self.ranks.get(self.tokens[left] + self.tokens[right])
            if across is not None and across < before:
                answer = False
                break
            left_parts, right_parts = self.split(left), self.split(right)
            if left_parts is None and right_parts is None:
                break
            # Of equal ranks the leftmost merge comes first: a tie across the border beats the right one.
            if right_parts is None or left_parts is not None and left > right:
                before, left = left, left_parts[1]
            else:
                before, right = right + 1, right_parts[0]
        if len(self.fits) > CACHE_ENTRIES:
            self.fits.clear()
        self.fits[key] = answer
        return answer

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        longest = [-1] * (len(data) + 1) if len(data) < 1 << 16 else array("i", [-1]) * (len(data) + 1)
        for end, (token, back) in self.automaton.iter(data.decode("latin-1")):
            longest[end - back] = token  # later ends are longer
        length, prefix, fits = self.length, self.prefix, self.fits
        usable = bytearray(b"\x01") * (len(data) + 1)  # a border from which the rest can still be encoded
        out: list[int] = []
        at, last, size, token = 0, -1, len(data), longest[0]
        while at < size:
            end = at + length[token]
            if usable[end]:
                fit = last < 0 or fits.get(last << 32 | token)
                if fit is None:
                    fit = self.compatible(last, token)
                if fit:
                    out.append(token)
                    at, last, token = end, token, longest[end]
                    continue
            token = prefix[token]
            if token < 0:
                usable[at] = 0
                if not out:
                    raise ValueError("the vocabulary lacks a single byte")
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known = self.known
        pieces = self.pieces(text)
        parts = list(map(known.get, pieces))
        if None in parts:
            if len(known) > CACHE_ENTRIES:
                known.clear()
            for at, ids in enumerate(parts):
                if ids is None:
                    p = pieces[at]
                    parts[at] = ids = known.get(p) or _little(self.encode_piece(p.encode("utf-8", "surrogatepass")))
                    if len(p) <= LONG:
                        known[p] = ids
        return b"".join(parts)


def _little(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def token_table(ranks: dict[bytes, int]) -> list[bytes]:
    """Bytes by id."""
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def decode_ids(tokens: list[bytes], ids: bytes) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _shared(df: DataFrame, path: str) -> Broadcast:
    """The driver reads the rank file (its size is fixed); each task builds its own tables from it."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_tokens, token_bytes (ids as little-endian unsigned 32-bit integers)."""
    data = _shared(df, path)

    def make():
        coder = BytePairCoder(data.value, pattern)

        def row(r: dict):
            ids = coder.encode(r["text"] or "")
            yield r["key"], len(ids) // 4, ids

        return row

    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    fields = [pa.field("key", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("token_bytes", pa.binary())]
    return map_rows(rows, make, ENCODED, fields)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``: the bytes that the ids stand for. Unknown ids are an error."""
    data = _shared(encoded, path)

    def make():
        tokens = token_table(read_ranks(data.value))

        def row(r: dict):
            yield r["key"], r["n_tokens"], r["token_bytes"], decode_ids(tokens, r["token_bytes"] or b"")

        return row

    fields = [
        pa.field("key", pa.int64()),
        pa.field("n_tokens", pa.int64()),
        pa.field("token_bytes", pa.binary()),
        pa.field("decoded", pa.binary()),
    ]
    return map_rows(encoded.select("key", "n_tokens", "token_bytes"), make, DECODED, fields)
