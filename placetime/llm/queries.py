"""Queries of the corpus operators over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bitplanes, boilerplate, collocations, contextual_pii, crf_secrets, decontaminate, divergence, group_join, main_text, merkle, packing, quotes, url_model
from .common import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_quotation_linking")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_order(load(spark, sf_dir, "conversations"))


@query("op2_distribution_divergence")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = divergence.judge(load(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.select("doc_id", *divergence.STATS, "base_failed", "kept", "char_distance", "word_distance")


@query("op3_simhash_windows")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), ["doc_id"])


@query("op4_site_line_frequency", boilerplate.SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = boilerplate.drop_lines(load(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return cleaned.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "n_lines", "n_dropped", "text")


@query("op5_bit_planes")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.round_trip(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op6_least_squares_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_conditional_random_field")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_secrets.scan(load(spark, sf_dir, "documents"))


@query("op8_contextual_extraction")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contextual_pii.scan(load(spark, sf_dir, "documents"))


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query("op9_character_model_ratio")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_model.judge(load(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


@query("op10_grouped_prefix_join")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_join.classes(load(spark, sf_dir, "documents"))


@query("op11_son_collocations", collocations.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.best_phrases(load(spark, sf_dir, "documents").select("text", "lang"))


@query("op12_nested_intervals", merkle.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(load(spark, sf_dir, "documents"))


@query("op13_block_field")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_texts(load(spark, sf_dir, "pages"))
