"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadcurve.llm import ann, bpe, embedding_dedup, licenses, line_dedup, lm_scoring, merkle, minhash, packing, periodic, quality, substring_dedup, warc


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.digests(_table(spark, folder, "documents"))


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(_table(spark, folder, "pages"))


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.verdicts(_table(spark, folder, "documents"))


def op4_attention_lm(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return lm_scoring.scored(_table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.verdicts(_table(spark, folder, "documents"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.batches_of(_table(spark, folder, "documents"))


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(_table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


def op8_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents"))


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    out = licenses.scanned(_table(spark, folder, "documents"))
    return out.withColumns({c: F.array_join(c, ",") for c in ("licenses", "embedded")})


def op10_multi_index_hashing(spark: SparkSession, folder: str) -> DataFrame:
    return ann.self_neighbours(_table(spark, folder, "embeddings"))


def op11_flat_graph(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, folder, "embeddings"))


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.tamper_checks(_table(spark, folder, "documents"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.digests(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_warc": op2_warc,
    "op3_quality_rules": op3_quality_rules,
    "op4_attention_lm": op4_attention_lm,
    "op5_line_dedup": op5_line_dedup,
    "op6_packing": op6_packing,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_minhash": op8_minhash,
    "op9_license_scan": op9_license_scan,
    "op10_multi_index_hashing": op10_multi_index_hashing,
    "op11_flat_graph": op11_flat_graph,
    "op12_merkle": op12_merkle,
    "op13_periodic_runs": op13_periodic_runs,
}
