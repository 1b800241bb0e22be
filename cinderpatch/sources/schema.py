"""Schema sidecars: which features a record has, and the frame they become."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import types as T

SIDECAR = "schema.pbtxt"
SCALARS = ("lon", "lat", "id")
_BLOCK = re.compile(r"\bfeature\s*:?\s*\{")
_NAME = re.compile(r"""\bname\s*:\s*(?:"([^"]*)"|'([^']*)')""")
_TYPE = re.compile(r"\btype\s*:\s*(\w+)")


def parse_schema(text: str) -> list[tuple[str, str]]:
    """(name, type) of each top-level feature, in order. Only these two fields are read; nested blocks are skipped."""
    found = []
    at = 0
    while m := _BLOCK.search(text, at):
        depth, end = 1, m.end()
        own = []
        while depth and end < len(text):
            c = text[end]
            depth += (c == "{") - (c == "}")
            if depth == 1 and c != "}":
                own.append(c)
            end += 1
        body = "".join(own)
        if name := _NAME.search(body):
            kind = _TYPE.search(body)
            found.append((name[1] or name[2] or "", kind[1] if kind else "TYPE_UNKNOWN"))
        at = end
    return found


def read_schema(spark: SparkSession, directory: str) -> list[tuple[str, str]]:
    """Features of the sidecar in ``directory``; Spark reads it, so any store will do. Missing: an error."""
    lines = spark.read.text(f"{directory.rstrip('/')}/{SIDECAR}", wholetext=True).head(1)
    return parse_schema(lines[0][0] if lines else "")


def patch_struct(features: list[tuple[str, str]], scalars: tuple[str, ...] = SCALARS) -> T.StructType:
    """Bytes become strings, integers longs, floats arrays unless their name is a scalar's; anything else a float."""
    kinds = {"BYTES": T.StringType(), "INT": T.LongType()}
    return T.StructType(
        [
            T.StructField(name, kinds.get(kind) or (T.ArrayType(T.FloatType()) if kind == "FLOAT" and name not in scalars else T.FloatType()), False)
            for name, kind in features
        ]
    )


def write_schema(spark: SparkSession, directory: str, features: list[tuple[str, str]]) -> None:
    """The sidecar of (name, type) pairs, written by Spark as a folder of one file."""
    text = "\n".join(f'feature {{ name: "{name}" type: {kind} }}' for name, kind in features)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{directory.rstrip('/')}/{SIDECAR}")
