"""The operators' queries: each reads its whole tables and returns its whole result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from . import ann, clustering, filter_audit, language_crf, minhash, mixing, packing, quality_nbsvm, secret_scan, substring_dedup, token_files, vector_dedup, wordpiece_counts


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_files(spark, sf_dir):
    return token_files.op_query(spark, _docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 2)


def op2_packing(spark, sf_dir):
    return packing.op_query(spark, _docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op3_language(spark, sf_dir):
    return language_crf.op_query(spark, _docs(spark, sf_dir))


def op5_mixing(spark, sf_dir):
    return mixing.op_query(spark, _docs(spark, sf_dir))


def op7_quality(spark, sf_dir):
    return quality_nbsvm.op_query(spark, _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_minhash(spark, sf_dir):
    return minhash.op_query(spark, _docs(spark, sf_dir))


def op4_vector_dedup(spark, sf_dir):
    return vector_dedup.op_query(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_ann(spark, sf_dir):
    return ann.op_query(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_substrings(spark, sf_dir):
    return substring_dedup.op_query(spark, _docs(spark, sf_dir))


def op9_token_counts(spark, sf_dir):
    return wordpiece_counts.op_query(spark, _docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op11_clustering(spark, sf_dir):
    return clustering.op_query(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_secrets(spark, sf_dir):
    return secret_scan.op_query(spark, _docs(spark, sf_dir))


def op13_filter_audit(spark, sf_dir):
    return filter_audit.op_query(spark, _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_packing, op3_language, op4_vector_dedup, op5_mixing, op6_substrings, op7_quality, op8_minhash, op9_token_counts, op10_ann, op11_clustering, op12_secrets, op13_filter_audit)}
ORACLE = {"op5_mixing": mixing.SQL, "op11_clustering": clustering.SQL, "op12_secrets": secret_scan.SQL, "op13_filter_audit": filter_audit.SQL}
