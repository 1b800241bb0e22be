"""Secret scans with a randomness test battery, in DataFrame expressions only.

Base kinds (``assign``, ``access``, ``hex``) are found by pattern. Beside them every long token that
mixes letters and digits is a candidate of kind ``random``: its encoding is inferred from its
characters (hexadecimal, base 32, base 64), and three tests ask whether it could be uniform random
text of that encoding: chi-squared over the alphabet, runs above and below the middle of the alphabet,
and lag-one serial correlation. Fisher's method joins the three p-values.

Which p-value makes a secret is decided over the whole table, for each encoding and class of lengths, as
tests of short tokens are weak: a bounded histogram of p-values is counted, random tokens are estimated
from its upper half (they spread evenly, ordinary ones crowd at zero), and the cut-off is the least at
which no more than ``FALSE_SHARE`` of what is reported is estimated to be ordinary.

Positions come from ``split`` and ``regexp_extract_all`` with the same pattern: the gaps and the matches
of one left-to-right scan. Only the histogram is shuffled; texts are read once, and what was found in
them is written before the cut-offs are known.

Defined results: null text counts as the empty text and has no spans; repeated rows stay repeated and count
each time; spans with equal starts stand in the order of ``KINDS``; a very long text is scanned whole, in time
linear in it and in its matches; an empty table gives an empty result; columns other than the named ones are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running, saved

# The patterns, kinds in order, and least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a shorter match ends with its run of characters, so no other could start in it
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{14,}"  # 80 bits of base 64
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}

#: Least p-value of a secret: so many random tokens may be missed.
ALPHA = 0.01
#: Share of the reported random tokens that may be ordinary, as estimated.
FALSE_SHARE = 0.1
#: Cells of the histogram in each group, and classes of lengths (two to each doubling).
BINS = 100
LENGTHS = 9
#: Least information in a token, in bits: length times bits per character.
LEAST_BITS = 80


def matches(text: Column, pattern: str, least: int = 0, group: int = 0) -> Column:
    """array<struct<start, end, token>>: matches of a left-to-right scan whose group has ``least`` characters."""

    def placed(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        walk = running(
            F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit")),
            lambda x: F.length(x["gap"]) + F.length(x["hit"]),
            lambda at, x: let(
                at + F.length(x["gap"]),
                lambda start: F.struct(start.alias("start"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("token")),
            ),
            "struct<start:int,end:int,token:string>",
        )
        if not group:
            return F.filter(walk, lambda m: F.length(m["token"]) >= least)
        return F.filter(walk, lambda m: F.length(F.regexp_extract(m["token"], pattern, group)) >= least)

    none = F.array().cast("array<struct<start:int,end:int,token:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda f: F.when(F.size(f) > 0, placed(f)).otherwise(none))


def normal_tail(z: Column) -> Column:
    """P(Z >= z) for z >= 0: the Abramowitz-Stegun polynomial 26.2.17."""
    return let(
        1 / (1 + 0.2316419 * z),
        lambda t: F.exp(-z * z / 2)
        / math.sqrt(2 * math.pi)
        * t
        * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))),
    )


def upper_tail(z: Column) -> Column:
    return let(z, lambda v: F.when(v >= 0, normal_tail(v)).otherwise(1 - normal_tail(-v)))


def two_sided(z: Column) -> Column:
    return 2 * normal_tail(F.abs(z))


def encoding(token: Column) -> Column:
    return (
        F.when(token.rlike("^[0-9a-f]+$") | token.rlike("^[0-9A-F]+$"), "hex")
        .when(token.rlike("^[A-Z2-7]+=*$"), "base32")
        .otherwise("base64")
    )


def randomness(token: Column) -> Column:
    """p-value that a token is uniform random text of its inferred encoding, by Fisher's method over three tests."""

    def tests(kind: str) -> Column:
        alphabet, size = ALPHABETS[kind], len(ALPHABETS[kind])
        plain = F.translate(token, "=", "") if kind != "base64" else F.translate(F.translate(token, "=", ""), "-_", "+/")
        plain = F.lower(plain) if kind == "hex" else plain

        def of_codes(x: Column) -> Column:
            n = F.size(x).cast("double")
            squares = F.aggregate(
                F.sequence(F.lit(1), F.lit(size)),
                F.lit(0.0),
                lambda acc, c: let(F.size(F.filter(x, lambda v: v == c)).cast("double"), lambda k: acc + k * k),
            )
            free = size - 1
            uniform = upper_tail(
                (F.cbrt((size * squares / n - n) / free) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
            )
            high = F.transform(x, lambda v: v > size / 2)
            n_high = F.size(F.filter(high, lambda v: v)).cast("double")
            n_low = n - n_high
            changes = F.size(F.filter(F.sequence(F.lit(1), F.size(x) - 1), lambda i: F.get(high, i) != F.get(high, i - 1))) + 1.0
            expected = 2 * n_high * n_low / n + 1
            spread = (expected - 1) * (expected - 2) / (n - 1)
            runs = F.when(spread > 0, two_sided((changes - expected) / F.sqrt(F.greatest(spread, F.lit(1e-9))))).otherwise(1e-12)
            mean = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v) / n
            serial = let(
                mean,
                lambda m: let(
                    F.aggregate(x, F.lit(0.0), lambda acc, v: acc + (v - m) * (v - m)),
                    lambda var: F.when(
                        var > 0,
                        two_sided(
                            (
                                F.aggregate(
                                    F.sequence(F.lit(1), F.size(x) - 1),
                                    F.lit(0.0),
                                    lambda acc, i: acc + (F.get(x, i) - m) * (F.get(x, i - 1) - m),
                                )
                                / F.greatest(var, F.lit(1e-9))
                                + 1 / n
                            )
                            * F.sqrt(n)
                        ),
                    ).otherwise(1e-12),
                ),
            )
            return let(
                -2 * (F.log(F.greatest(uniform, F.lit(1e-12))) + F.log(F.greatest(runs, F.lit(1e-12))) + F.log(F.greatest(serial, F.lit(1e-12)))) / 2,
                lambda h: F.exp(-h) * (1 + h + h * h / 2),  # chi-squared with six degrees of freedom
            )

        codes = let(
            plain,
            lambda p: F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(p), F.lit(1))), lambda i: F.instr(F.lit(alphabet), F.substring(p, i, F.lit(1))).cast("double")
            ),
        )
        return let(codes, of_codes)

    kind = encoding(token)
    return F.when(kind == "hex", tests("hex")).when(kind == "base32", tests("base32")).otherwise(tests("base64"))


def candidates(text: Column) -> Column:
    """array<struct<start, end, group, p>>: tokens that mix letters and digits; the group is the encoding's and
    the length's."""

    def judged(found: Column) -> Column:
        encoded = F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["token"].alias("token"), encoding(m["token"]).alias("encoding")))
        usable = F.filter(
            encoded,
            lambda m: m["token"].rlike("[0-9]")
            & m["token"].rlike("[A-Za-z]")
            & (F.length(m["token"]) * F.when(m["encoding"] == "hex", 4).when(m["encoding"] == "base32", 5).otherwise(6) >= LEAST_BITS),
        )
        return F.transform(
            usable,
            lambda m: F.struct(
                m["start"].alias("start"), m["end"].alias("end"), group(m["encoding"], F.length(m["token"])).alias("group"), randomness(m["token"]).alias("p")
            ),
        )

    return let(matches(text, TOKEN), judged)


def group(kind: Column, length: Column) -> Column:
    return F.concat(kind, F.least(F.floor(2 * F.log2(length / 14)), F.lit(LENGTHS - 1)).cast("string"))


def cut_offs(found: DataFrame) -> DataFrame:
    """(group, least_p) from rows with group and p: bounded in number, whatever the input."""
    cells = found.groupBy("group", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    counts = cells.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("n"))  # BINS at most
    above = lambda first: F.aggregate(
        F.sequence(first, F.lit(BINS - 1)), F.lit(0).cast("bigint"), lambda acc, i: acc + F.coalesce(F.try_element_at("n", i), F.lit(0))
    )
    # Of random tokens half have a p-value above one half; one more is counted, so that a few are believed.
    random = counts.withColumn("random", 2.0 * (1 + above(F.lit(BINS // 2))))
    fits = F.filter(
        F.sequence(F.lit(int(ALPHA * BINS)), F.lit(BINS - 1)),
        lambda i: let(above(i), lambda seen: (seen > 0) & (seen - F.col("random") * (1 - i / F.lit(BINS)) <= FALSE_SHARE * seen)),
    )
    return random.select("group", F.coalesce(F.array_min(fits) / F.lit(float(BINS)), F.lit(2.0)).alias("least_p"))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, and spans array<struct<start, kind, end>> in code points, end exclusive,
    by start and then by kind in the order of ``KINDS`` (kind is its place there)."""
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    t = F.col("text")

    def of_kind(found: Column, kind: str) -> Column:
        return F.transform(
            found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"))
        )

    base = F.concat(of_kind(matches(t, ASSIGN, ASSIGN_LEAST, 2), "assign"), of_kind(matches(t, ACCESS), "access"), of_kind(matches(t, HEX), "hex"))
    found = saved(rows.select("key", base.alias("base"), candidates(t).alias("candidates")))
    least = {r["group"]: r["least_p"] for r in cut_offs(found.select(F.inline("candidates"))).collect()}  # encodings times classes
    table = F.create_map(*[x for name, p in sorted(least.items()) for x in (F.lit(name), F.lit(p))]).cast("map<string,double>")
    random = F.filter("candidates", lambda m: m["p"] >= F.try_element_at(table, m["group"]))
    return found.select("key", F.sort_array(F.concat("base", of_kind(random, "random"))).alias("spans"))


def written(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
