"""Line-first quality rules, in DataFrame expressions only.

Every line of a text is judged on its own: navigation rows, lines of symbols or shouting, stubs without
an end mark, boilerplate, and repeats of an earlier line fail and are removed. A document is then
rejected if it fails a base rule (too few words, or too many words in repeated three-word windows) or
lost too much of its text. No shuffle: all work stays in the row.

Defined results: null text counts as the empty text, has no words and is rejected; repeated rows stay
repeated; of equal lines the first is judged and the others go; a very long text is judged whole, in
time n log n in its words; an empty table gives an empty result; columns other than the named ones are
ignored by ``assess``, and kept as they are by ``filter_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let

# White space, symbols, marks and phrases that the rules look for.
WHITE_SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SYMBOL_CLASS = r"[#*$%&|<>]"
SHOUT = "!!"
END_MARK = r"[.!?:;,\"'”»)\]。！？…][\x20\x09-\x0D]*$"
NAVIGATION = r"(^|[\x20\x09])([|»›>•·/]|::)([\x20\x09]|$)"
BOILERPLATE = [
    "all rights reserved",
    "licensed under",
    "privacy policy",
    "terms of use",
    "terms of service",
    "use of cookies",
    "uses cookies",
    "cookie policy",
    "subscribe to our newsletter",
    "sign up for",
    "log in to",
    "javascript is disabled",
    "javascript is required",
    "enable javascript",
    "click here",
    "read more",
    "share this",
    "powered by",
    "skip to content",
    "skip to main content",
]
LICENSE = ("released under the ", r"released under the [a-z0-9 .-]+ licen[sc]e")

#: Production parameters.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS_PER_WORD = 0.3
SHOUTS_PER_WORD = 0.3
NAVIGATION_PER_WORD = 0.2
UPPER_PER_LETTER = 0.6
STUB_WORDS = 4
MIN_LEFT = 0.6


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def removed_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def boilerplate(line: Column) -> Column:
    """Whether one of the phrases occurs, A to Z in either case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def found(low: Column) -> Column:
        hit = F.contains(low, F.lit(LICENSE[0])) & low.rlike(LICENSE[1])
        for phrase in BOILERPLATE:
            hit = hit | F.contains(low, F.lit(phrase))
        return hit

    return let(F.translate(line, upper, upper.lower()), found)


def line_passes(line: Column) -> Column:
    def judged(words: Column) -> Column:
        # Few lines have so many capitals that their letters must be counted at all.
        shouted = let(
            F.regexp_count(line, F.lit(r"\p{Lu}")),
            lambda upper: (upper > UPPER_PER_LETTER * 20)
            & let(
                F.length(line) - F.length(F.regexp_replace(line, r"\p{L}+", "")), lambda n: (n >= 20) & (upper > UPPER_PER_LETTER * n)
            ),
        )
        shouts = (F.length(line) - F.length(F.replace(line, F.lit(SHOUT), F.lit("")))) / len(SHOUT)
        return (
            (words > 0)
            & (removed_chars(line, SYMBOLS) <= SYMBOLS_PER_WORD * words)
            & (shouts <= SHOUTS_PER_WORD * words)
            & (F.regexp_count(line, F.lit(NAVIGATION)) <= NAVIGATION_PER_WORD * words)
            & ~shouted
            & ((words > STUB_WORDS) | line.rlike(END_MARK))
            & ~((words <= 20) & boilerplate(line))
        )

    return let(word_count(line), judged)


def _covered_by_repeats(w: Column) -> Column:
    """Sorting the windows puts equal ones side by side, so a row costs n log n and no window leaves it."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i")),
    )

    def marked(s: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            return F.coalesce((x["b"] == y["b"]) & (x["a"] == y["a"]) & (x["c"] == y["c"]), F.lit(False))

        hits = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda k: same(F.get(s, k), F.get(s, k + 1)) | same(F.get(s, k), F.get(s, k - 1)),
        )
        places = F.flatten(F.transform(hits, lambda k: let(F.get(s, k)["i"], lambda i: F.array(i, i + 1, i + 2))))
        return F.size(F.array_distinct(places))

    return let(F.sort_array(windows), marked)


def repeated_window_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more; ``words`` is bound already. Windows whose hashes all differ
    all differ; only other texts are sorted."""

    def counted(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        all_differ = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
        return F.when(all_differ, F.lit(0)).otherwise(_covered_by_repeats(w))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(counted(words)).cast("bigint")


def assess(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    clean_text (lines that pass, joined by a line feed), left_share (of the word characters), kept."""
    t = F.col("text")
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    with_word = F.filter(F.split(t, "\n"), lambda line: line.rlike(WORD))
    counted = rows.select(
        "key",
        F.length(F.translate(t, WHITE_SPACE, "")).cast("bigint").alias("word_chars"),
        removed_chars(t, SYMBOLS).cast("bigint").alias("n_symbols"),
        let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeated_window_words(w).alias("repeated"))).alias("words"),
        let(
            with_word,
            lambda lines: let(
                F.array_distinct(lines),
                lambda once: F.struct(
                    (F.size(lines) - F.size(once)).cast("bigint").alias("dup"),
                    F.array_join(F.filter(once, line_passes), "\n").alias("text"),
                ),
            ),
        ).alias("clean"),
    )
    counted = counted.select("*", F.col("words.n").alias("n_words"), F.col("words.repeated").alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.length(F.translate(F.col("clean.text"), WHITE_SPACE, "")) / F.greatest(F.col("word_chars"), F.lit(1))
    return counted.select(
        "key",
        "n_words",
        "word_chars",
        "n_symbols",
        F.col("clean.dup").alias("n_dup_lines"),
        "n_repeat_words",
        failed.alias("base_failed"),
        F.col("clean.text").alias("clean_text"),
        left.alias("left_share"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("left_share") >= MIN_LEFT))


def filter_documents(docs: DataFrame) -> DataFrame:
    """Pipeline stage: rejected documents go; of the others the failing lines go, and n_chars follows.
    Columns are those of the input."""
    judged = assess(docs.select(F.struct("*").alias("row"), F.col("text").alias("text")), key="row").where("kept")

    def column(name: str) -> Column:
        if name == "text":
            return F.col("clean_text")
        if name == "n_chars":
            return F.length("clean_text").cast(docs.schema["n_chars"].dataType)
        return F.col("key").getField(name)

    return judged.select(*[column(name).alias(name) for name in docs.columns])
