"""Writes record files for tests: a plain encoder of the public framing and message formats."""

import gzip
import struct

import numpy as np

from cinderpatch.sources.records import masked_crc


def varint(n):
    out = b""
    while True:
        n, low = n >> 7, n & 127
        if not n:
            return out + bytes([low])
        out += bytes([low | 128])


def chunk(number, data):
    return varint(number << 3 | 2) + varint(len(data)) + data


def feature(value, packed=True):
    if isinstance(value, str):
        return chunk(1, chunk(1, value.encode()))
    if isinstance(value, int):
        return chunk(3, chunk(1, varint(value & (1 << 64) - 1)))
    floats = np.asarray(value, dtype="<f4").reshape(-1)
    if packed:
        return chunk(2, chunk(1, floats.tobytes()))
    return chunk(2, b"".join(varint(1 << 3 | 5) + f.tobytes() for f in floats))


def example(values, packed=True):
    entries = b"".join(chunk(1, chunk(1, name.encode()) + chunk(2, feature(v, packed))) for name, v in values.items())
    return chunk(1, entries)


def framed(payload):
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked_crc(head)) + payload + struct.pack("<I", masked_crc(payload))


def write(path, rows, compress=True, packed=True):
    data = b"".join(framed(example(r, packed)) for r in rows)
    path.write_bytes(gzip.compress(data) if compress else data)


def write_schema(directory, features):
    blocks = "\n".join(f'feature {{\n  name: "{n}"\n  type: {t}\n  presence {{ min_fraction: 1.0 }}\n}}' for n, t in features)
    (directory / "schema.pbtxt").write_text(blocks)
