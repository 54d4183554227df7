"""A training-data pipeline of five stages: quality rules, near-dedup, secret scan, mixing, byte-level BPE.

Defined results of all stages: null and empty texts fail the quality rules and go there; documents with a null id link to
no other and stay in the near-dedup; null languages and sources are the name '' in the mixing; repeated rows of one id stay or
go together, and each is mixed as a row of its own; extra columns of any name are carried to the last stage, which has columns
of its own; an empty table, or one of which nothing is left, gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import bpe, mixing, near_copies, quality_rules, queries, secrets, store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return quality_rules.keep_good(docs, quality_rules.fit_on(docs, queries.table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of near copies (five-word shingles, similarity 0.8): that of the smallest id."""
    return near_copies.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the spans that look live in the texts; all documents stay."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the target weights ask for."""
    return mixing.select(docs, domain=queries.mix_domain(), weights=queries.WEIGHTS, share=queries.SHARE, max_epochs=queries.MAX_EPOCHS, seed=queries.SEED)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: doc_id, n_tokens, digests, ids (packed little-endian unsigned 32-bit integers)."""
    import public_tokenizers

    return bpe.encode_documents(docs, queries.tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mixing", mix),
    ("byte_bpe", tokenize),
]
#: No stage but the secret scan and the mixing can be said in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each is written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = spark.read.parquet(store.written(stage(spark, docs, sf_dir), name))
    return docs
