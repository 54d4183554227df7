"""The thin queries of the ten operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, licenses, middle, mixing, nearest, ngram_join, quality_fm, quality_rules, secrets, simhash, spelling, substring, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The mixture's tree and weights. The tables have no domain, so it is derived from the source's number.
DOMAIN = "case when cast(regexp_extract(source, '([0-9]+)', 1) as int) < 7 then 'web' when cast(regexp_extract(source, '([0-9]+)', 1) as int) < 14 then 'books' else 'code' end"
WEIGHTS = {"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 4}, "source": {"src0": 3}}
SHARE, MAX_EPOCHS, SEED = 0.8, 4, 17


def mix_domain() -> Column:
    return F.expr(DOMAIN.replace("cast(", "try_cast("))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), limit=2048)


def op4_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, exact=True)


def op6_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))  # a null id has no label, either
    machine = quality_fm.train(docs, labels.where(~held_out))
    return quality_fm.score(docs, machine, 0.7).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.rate(docs, quality_rules.fit_on(docs, table(spark, sf_dir, "labels")))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), domain=mix_domain(), weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS, seed=SEED)


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


def op12_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.fill_in_middle_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_secret_scan, op3_token_counts, op4_simhash_neardup, op5_nearest, op6_quality_fm, op7_license_scan, op8_quality_rules, op9_byte_bpe, op10_mixing, op11_ngram_join, op12_spellings, op13_fill_in_middle)
}
ORACLES: dict[str, str] = {"op2_secret_scan": secrets.ORACLE_SQL, "op10_mixing": mixing.oracle_sql(DOMAIN.replace("cast(", "try_cast("), WEIGHTS, SHARE, MAX_EPOCHS, SEED), "op11_ngram_join": ngram_join.ORACLE_SQL, "op12_spellings": spelling.ORACLE_SQL, "op13_fill_in_middle": middle.ORACLE_SQL}
