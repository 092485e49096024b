"""A training corpus from documents: known languages, no copies, no near copies, mixed by source, packed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns
of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillrake.llm.exact_dedup import exact_dedup
from quillrake.llm.language_id import language_filter
from quillrake.llm.mixing import mixed_order, mixed_places
from quillrake.llm.packing import pack_documents
from quillrake.llm.shared import cut, remove
from quillrake.llm.simhash_dedup import simhash_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts that no learned language claims with a score of 0.3."""
    return language_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays."""
    return exact_dedup(docs, keep="smallest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (sets of five-word shingles, similarity 0.8, every link verified) the smallest id stays."""
    return simhash_dedup(docs, similarity=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order in which blocks of the sources are due; weights follow the root of the sources' sizes."""
    return mixed_order(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, numbered along the mixture.

    A table read again has no order, so the places in the mixture are taken from its rows, which have the same places as
    before. The stages share their workers, so each remembers less than alone.
    """
    return pack_documents(docs, cache=150_000, order=mixed_places(docs))


STAGES: list[tuple[str, Stage]] = [("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("packed", packed)]

#: The stages' models, sketches and packings are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again, and goes when the next is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
