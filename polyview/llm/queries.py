"""One registered query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from polyview.llm.chat import format_conversations, read_back
from polyview.llm.common import table
from polyview.llm.licenses import scan_licenses
from polyview.llm.manifest import manifest
from polyview.llm.neighbours import nearest
from polyview.llm.order_minhash import compared
from polyview.llm.packing import pack_documents
from polyview.llm.pieces import round_trip
from polyview.llm.pii import pseudonymise
from polyview.llm.quality import judge
from polyview.llm.simhash import near_duplicates
from polyview.llm.token_counts import token_counts
from polyview.llm.sql import MANIFEST
from polyview.llm.urls import RULES, filter_urls
from polyview.llm.whitening import whiten

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def op1_pii_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonymise(table(spark, folder, "documents"))


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents"))


def op3_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"))


def op4_pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), WORDS)


def op5_piece_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(table(spark, folder, "documents"), PIECES)


def op6_simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), PIECES)


def op8_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(turns.unionByName(extra)))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filter_urls(table(spark, folder, "pages"), RULES)


def op11_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return compared(table(spark, folder, "documents"))


def op12_whitened_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_pii_pseudonyms, op2_license_scan, op3_nearest_vectors, op4_pack_sequences, op5_piece_round_trip,
    op6_simhash_components, op7_token_counts, op8_chat_format, op9_quality_rules, op10_url_filter,
    op11_order_minhash, op12_whitened_embeddings, op13_merkle_manifest)}
SQL: dict[str, str] = {"op13_merkle_manifest": MANIFEST}
