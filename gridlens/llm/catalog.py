"""The queries opN_<name> over the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from gridlens.llm import bpe, caps, decontam, html, jaccard, lexical, licenses, linededup, packing, pii, quality, shards, trie

SHARDS = 24


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by the byte-level ranks, and the bytes decoded from them, as digests."""
    return bpe.digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by key."""
    return shards.assign(_read(spark, sf_dir, "documents"), SHARDS)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in all documents."""
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packing.pack(packing.pieces(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals and verdict for all documents."""
    return quality.digests(_read(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html.extract(_read(spark, sf_dir, "pages"))


def op7_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings, cosine 0.95 and more."""
    return caps.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.digests(_read(spark, sf_dir, "documents"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by five-word shingles, 0.75 and more."""
    return jaccard.near_duplicates(_read(spark, sf_dir, "documents"))


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without lines that stood before."""
    return linededup.dedup_lines(_read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that stand in ten words of a benchmark item."""
    return decontam.digests(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prefixes of all conversations, rebuilt on shared beginnings, as nodes of a trie."""
    return trie.build_rebuilt(_read(spark, sf_dir, "conversations"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all documents for each benchmark item."""
    return lexical.rank_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_shards, op3_licenses, op4_packing, op5_quality, op6_html, op7_caps, op8_pii, op9_jaccard, op10_linededup, op11_decontamination, op12_trie, op13_search)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {"op10_linededup": linededup.ORACLE_SQL, "op11_decontamination": decontam.ORACLE_SQL, "op12_trie": trie.ORACLE_SQL, "op13_search": lexical.ORACLE_SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: sql for name, sql in found.items() if sql}
