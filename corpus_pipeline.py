"""The corpus pipeline: quality classifier, exact dedup, SimHash near-dedup, mixing to target weights, best-fit packing.

Each stage works on all rows that the one before it kept, written as Parquet and read again.

Defined results: a null or empty text, or one without words, is rejected by the first stage; a null id has no label, is
larger than all others where the smallest stays, and is packed like others; of repeated rows one stays after exact dedup;
a null language or source is one of its own; texts of any length are handled whole; columns of any name are kept by all
stages but the last; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textlattice.llm import exact_dedup, kneser_ney, mixing, packing, simhash
from textlattice.llm.common import materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kneser_ney.survivors(spark, docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.survivors(docs, exact_dedup.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.survivors(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SimHash fingerprints are XXH64 sums, which DuckDB doesn't have.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
