"""The public formats of record files: frames with checksums, and examples inside them."""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import types as T

#: Bytes that are inflated or read at once.
PIECE = 1 << 20
#: Parts of a long payload whose checksums are taken side by side.
LANES = 2_048


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)  # the Castagnoli polynomial, reflected
        table.append(n)
    return table


_CRC = _crc_table()
_CRC_ARRAY = np.array(_CRC, dtype=np.uint32)


def _applied(operator: list[int], value: int) -> int:
    out = 0
    for image in operator:
        out ^= image * (value & 1)
        value >>= 1
    return out


@functools.lru_cache(maxsize=64)
def _over_zeros(n: int) -> list[int]:
    """What ``n`` zero bytes make of each bit of a checksum: a checksum is linear in its bits."""
    if n == 1:
        return [_CRC[(1 << b) & 255] ^ (1 << b) >> 8 for b in range(32)]
    half = _over_zeros(n // 2)
    twice = [_applied(half, image) for image in half]
    return [_applied(_over_zeros(1), image) for image in twice] if n % 2 else twice


def _crc(data: bytes) -> int:
    """CRC-32C. A long payload is cut into lanes whose bytes are taken in array steps, then put together."""
    crc, steps = 0xFFFFFFFF, len(data) // LANES
    if steps > 8:
        lanes = np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8, count=steps * LANES).reshape(LANES, steps).T)
        each = np.zeros(LANES, dtype=np.uint32)
        each[0] = crc
        for column in lanes:
            each = _CRC_ARRAY[(each ^ column) & 255] ^ (each >> 8)
        over = _over_zeros(steps)
        crc = 0
        for lane in each.tolist():
            crc = _applied(over, crc) ^ lane
        data = data[steps * LANES :]
    for byte in data:
        crc = _CRC[(crc ^ byte) & 255] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def masked_crc(data: bytes) -> int:
    crc = _crc(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def inflated(data: Iterator[bytes]) -> Iterator[bytes]:
    """Pieces of all members of a gzip file, none longer than ``PIECE``. Zero bytes between members are padding; a
    truncated member is an error."""
    member, out = None, b""
    for left in data:
        while left or len(out) == PIECE:
            if member is None:
                left = left.lstrip(b"\0")
                if not left:
                    out = b""
                    break
                member = zlib.decompressobj(31)
            out = member.decompress(left, PIECE)
            left = member.unconsumed_tail
            if member.eof:
                left, member = member.unused_data, None
            if out:
                yield out
            if member is None:
                out = b""
    if member is not None:
        raise ValueError("truncated gzip data")


def frames(data: Iterator[bytes], check_data: bool = False) -> Iterator[bytes]:
    """Payloads of length-prefixed records. Lengths are always checked, payloads on demand."""
    held = bytearray()

    def has(n: int) -> bool:
        while len(held) < n:
            if (piece := next(data, None)) is None:
                return False
            held.extend(piece)
        return True

    while has(1):
        if not has(12) or masked_crc(bytes(held[:8])) != struct.unpack("<I", held[8:12])[0]:
            raise ValueError("corrupt or truncated record length")
        (size,) = struct.unpack("<Q", held[:8])
        if not has(16 + size):
            raise ValueError("truncated record")
        body = bytes(held[12 : 12 + size])
        if check_data and masked_crc(body) != struct.unpack("<I", held[12 + size : 16 + size])[0]:
            raise ValueError("corrupt record")
        del held[: 16 + size]
        yield body


def _varint(view: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = view[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(view: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of a message: an integer for varints, bytes for the rest."""
    at = 0
    while at < len(view):
        tag, at = _varint(view, at)
        wire = tag & 7
        if wire == 0:
            value, at = _varint(view, at)
        else:
            if wire == 2:
                size, at = _varint(view, at)
            elif wire in (1, 5):
                size = 8 if wire == 1 else 4
            else:
                raise ValueError(f"unknown wire type {wire}")
            if at + size > len(view):
                raise ValueError("truncated message")
            value = view[at : at + size]
            at += size
        yield tag >> 3, value


def _values(feature: memoryview) -> list | np.ndarray:
    """Values of one feature: byte strings, floats or integers; packed or one by one."""
    for kind, body in _fields(feature):
        parts = [v for n, v in _fields(body) if n == 1]
        if kind == 1:
            return [bytes(p) for p in parts]
        if kind == 2:
            return np.frombuffer(b"".join(parts), dtype="<f4")
        numbers: list[int] = []
        for p in parts:
            if isinstance(p, int):
                numbers.append(p)
                continue
            at = 0
            while at < len(p):
                n, at = _varint(p, at)
                numbers.append(n)
        return [n - (1 << 64) if n >> 63 else n for n in numbers]
    return []


def decode(record: bytes, wanted: T.StructType, size: int) -> list:
    """Values in the order of ``wanted``. A missing feature or a wrong number of values is an error."""
    found = {}
    names = set(wanted.fieldNames())
    for number, features in _fields(memoryview(record)):
        if number != 1:
            continue
        for _, entry in _fields(features):
            parts = dict(_fields(entry))
            if (name := bytes(parts[1]).decode()) in names:
                found[name] = _values(parts[2])
    row = []
    for field in wanted:
        values = found.get(field.name)
        is_band = isinstance(field.dataType, T.ArrayType)
        if values is None or len(values) != (size * size if is_band else 1):
            raise ValueError(f"feature {field.name}: {'missing' if values is None else f'{len(values)} values'}")
        if is_band:
            row.append(np.asarray(values, dtype="f4"))
        elif isinstance(field.dataType, T.StringType):
            row.append(bytes(values[0]).decode())
        else:
            row.append(int(values[0]) if isinstance(field.dataType, T.LongType) else float(values[0]))
    return row
