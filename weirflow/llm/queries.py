"""One query per operator, over whole tables with production parameters, and the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from weirflow.llm import (
    chat_repair,
    collocations,
    decontaminate,
    embedding_hnsw,
    html_crf,
    language_gru,
    packing,
    pii_crf,
    quality_ri,
    rank_bpe,
    repeats,
    simhash_pivots,
    turn_align,
)
from weirflow.llm.common import table, tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@query
def op1_embedding_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op2_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair(table(spark, sf_dir, "conversations"))


@query
def op3_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pivots.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"))


@query
def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ri.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.find(table(spark, sf_dir, "documents"))


@query
def op5_language_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_gru.identify(table(spark, sf_dir, "documents"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(packing.TOKENIZER))


@query
def op11_turn_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_align.damaged_audits(table(spark, sf_dir, "conversations"))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query
def op13_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = rank_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(rank_bpe.TOKENIZER))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                       F.sha2("text", 256).alias("decoded_sha256"))


ORACLES["op12_collocations"] = collocations.ORACLE_SQL
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
