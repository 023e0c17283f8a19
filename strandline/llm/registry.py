"""Queries of the training-data operators: one per operator, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.common import table
from strandline.llm.packing import pack
from strandline.llm import bitpack, chat, decontaminate, minhash, pii, projections, repair, substrings, tries, warc
from strandline.llm.quality import quality_report
from strandline.llm.toxicity import toxicity_report


def op10_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pack_local_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op8_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op6_decontaminate_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_minhash_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_substring_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op1_embedding_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_toxicity_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pii_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_report(table(spark, sf_dir, "conversations"))


def op11_token_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.token_round_trip(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.trie_report(table(spark, sf_dir, "conversations"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op11_token_bits": op11_token_bits,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_structure_repair": op13_structure_repair,
    "op9_preference_format": op9_preference_format,
    "op5_pii_field": op5_pii_field,
    "op3_toxicity_channel": op3_toxicity_channel,
    "op1_embedding_projections": op1_embedding_projections,
    "op7_substring_automata": op7_substring_automata,
    "op2_minhash_chosen_path": op2_minhash_chosen_path,
    "op6_decontaminate_prefix": op6_decontaminate_prefix,
    "op8_warc_normalise": op8_warc_normalise,
    "op4_pack_local_search": op4_pack_local_search,
    "op10_quality_compression": op10_quality_compression,
}

ORACLES: dict[str, str] = {
    "op12_prefix_trie": tries.ORACLE,
    "op13_structure_repair": repair.ORACLE,
    "op9_preference_format": chat.ORACLE,
    "op1_embedding_projections": projections.ORACLE,
    "op7_substring_automata": substrings.ORACLE,
    "op2_minhash_chosen_path": minhash.ORACLE,
    "op6_decontaminate_prefix": decontaminate.ORACLE,
    "op8_warc_normalise": warc.ORACLE,
}
