"""Registered queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import scratch_path, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import read_tokens, write_tokens

    path = scratch_path(spark)
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"), shards=8)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similarity_classes

    return similarity_classes(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secretscan import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lmscore import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("clauses")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_token_files": op2_token_files,
    "op3_sharding": op3_sharding,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_secret_scan": op5_secret_scan,
    "op6_fingerprint": op6_fingerprint,
    "op7_language_id": op7_language_id,
    "op8_decontamination": op8_decontamination,
    "op9_lm_score": op9_lm_score,
    "op10_toxicity": op10_toxicity,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {}
