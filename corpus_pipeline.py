"""The training-data pipeline: five stages over ``documents``, each working on all that the one before kept. An
empty table passes through all of them; other columns of ``documents``, whatever their names, stay until ``pack``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cinderpatch.llm import jaccard_join, language_id, packing, pii, quality_rules
from cinderpatch.llm.common import read_table, saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, then documents that fail a base rule or lost too much of their text. Null, empty and
    wordless texts go; repeated rows are judged one by one; ``n_chars`` follows the text."""
    return quality_rules.filter_documents(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that can be told, with a share of 0.5 at least, go; where no label lets
    one be learned, only those without a letter. Null and empty texts go; a null ``lang`` takes the prediction;
    repeated rows get equal answers."""
    return language_id.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words at a Jaccard similarity of 0.8 one stays, that with the least
    id. Null and empty texts are linked with nothing and stay; of rows that repeat an id one stays; rows without
    an id stay."""
    return jaccard_join.keep_one(docs, k=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes marks. No row goes; a null text stays null; ``n_chars`` follows the text."""
    return pii.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences for training: a row per piece, with its ids. A null or empty text is its end mark alone;
    repeated rows are packed each; a null id stays null."""
    packed = packing.digests(packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")))
    return packed.selectExpr(
        "key as doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "token_bytes"
    )


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("pack", pack),
]

#: Language models, links and packing have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if at == 0 else saved(docs), sf_dir)
    return docs
