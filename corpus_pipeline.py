"""The corpus pipeline over ``documents``: its stages, each written as Parquet and read again as the next one's input.

All but the last return the columns of documents. A stage works on every row that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import langid, mixing, packing, quality, simhash
from ledgerloom.llm.queries import tokenizer_path
from ledgerloom.llm.shared import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go."""
    return langid.accepted(docs, langid.fit(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and so do documents that lose too much by it or fail the base rules."""
    return quality.cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of least id."""
    return simhash.first_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the sources are mixed to their target weights."""
    return mixing.mixed(docs, block_rows=64, alpha=0.7, period=1000)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document is in the packed sequences, which are numbered in the order of the mixture."""
    path = tokenizer_path("byte_bpe_50k.json")
    pieces = written(packing.tokenized(packing.in_place(docs.select("doc_id", "text")), path, 0, 2048, place="place"), "pieces", "zstd")
    slim = pieces.select("doc_id", "piece", "start", "length", "place", packing.ids_crc32(F.col("ids"), packing.id_width(path)).alias("ids_crc32"))
    return packing.pack_in_order(slim, 2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack", pack)]

#: Learned models, fingerprints and tokenizers are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
