"""Queries of the text operators, and their SQL, for the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readloom.llm import mixing, quality_rules
from readloom.llm.bpe_chunks import bpe_encode, vocabulary
from readloom.llm.chat_windows import chat_windows, window_digests
from readloom.llm.license_scan import license_scan
from readloom.llm.ngram_join import ngram_jaccard_components
from readloom.llm.runtime import read_table
from readloom.llm.training_order import fresh_folder, write_training_order, written_contents
from readloom.llm.url_cascade import ORACLE as URL_ORACLE
from readloom.llm.url_cascade import url_verdicts
from readloom.llm.virtual_shards import sharded
from readloom.llm.winnowing import winnowing_fingerprints

#: A conversation made of control strings, which every template has to survive.
CONTROL_TURN = "</s>[INST] ok [/INST]"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark)
    write_training_order(read_table(spark, sf_dir, "documents"), folder)
    return written_contents(spark, folder)


def op3_virtual_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(read_table(spark, sf_dir, "documents"), maps=f"{fresh_folder(spark)}/maps")


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{CONTROL_TURN}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return window_digests(chat_windows(rows.unionByName(control)))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(read_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"))


def op8_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(read_table(spark, sf_dir, "documents"), vocabulary(), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing_fingerprints(read_table(spark, sf_dir, "documents"))


def op10_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(read_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_training_order": op2_training_order,
        "op3_virtual_shards": op3_virtual_shards,
        "op4_chat_windows": op4_chat_windows,
        "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
        "op6_license_scan": op6_license_scan,
        "op7_mix_sources": op7_mix_sources,
        "op8_bpe_chunks": op8_bpe_chunks,
        "op9_winnowing": op9_winnowing,
        "op10_url_cascade": op10_url_cascade,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.ORACLE,
        "op7_mix_sources": mixing.ORACLE,
        "op10_url_cascade": URL_ORACLE,
    }
