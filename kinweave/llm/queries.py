"""Registered queries of the operators: whole tables in, the agreed columns out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import (
    hyperplane_dedup, laesa_codes, lang_crf, lemp_search, license_scan, mixing, multi_index, pfor, piece_spans, pii_bootstrap,
    simhash_popcount, vector_packing, warc,
)
from kinweave.llm.common import read

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_crf.identify(read(spark, sf_dir, "documents"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(read(spark, sf_dir, "embeddings"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperplane_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_spans.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_popcount.components(read(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.report(read(spark, sf_dir, "documents"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.encode_corpus(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lemp_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laesa_codes.encode(read(spark, sf_dir, "embeddings"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_licenses": op2_licenses,
    "op3_language": op3_language,
    "op4_nearest": op4_nearest,
    "op5_near_vectors": op5_near_vectors,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_packing": op7_packing,
    "op8_simhash": op8_simhash,
    "op9_pii": op9_pii,
    "op10_token_ids": op10_token_ids,
    "op11_lexical": op11_lexical,
    "op12_vector_codes": op12_vector_codes,
    "op13_mixing": op13_mixing,
}
