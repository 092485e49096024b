"""Mixing sources to target weights by Pfair scheduling.

Block j of a source with weight w is released at floor(j / w) and due at ceil((j + 1) / w); in every slot the
released block with the earliest deadline runs. For weights that sum to one this schedule is Pfair on one
processor: after t slots a source has had its w * t blocks to within less than one block.

The whole schedule is computed from the exact rational weights, so the bound holds however long it is and however small a
weight is. A schedule has no shorter description in general, so one task makes it, from the counts of the sources alone: it
carries a block of each source from slot to slot and writes ``period`` blocks at a time. That takes a row for each block of
documents and memory in proportion to the sources. A source that runs out leaves its later slots to others, whose blocks
still run between release and deadline; slots that nobody may take stay empty; nothing is dropped.
Ties in deadline go to the earlier release, then to the source that sorts first. Block numbers come from counts
of (source, bucket) of bounded size, so no task ever holds a whole source.

Null sources are one source of their own, which sorts first, and apart from the source ''. Weights name it None. An empty table
gives an empty result. Rows that repeat an id are separate documents. Extra columns of any name pass through ``mixed_order``.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut


def _ordinal(source: str | None) -> tuple[bool, str]:
    return source is not None, source or ""


def pfair_blocks(weights: dict[str | None, float], blocks: dict[str | None, int]) -> Iterator[tuple[str | None, int, int, int, int]]:
    """(source, j, release, deadline, slot) of the first ``blocks`` of each source, in order of slots."""
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    total = sum(Fraction(w) for w in weights.values())
    names = sorted((s for s, n in blocks.items() if n > 0), key=_ordinal)
    shares = [Fraction(weights[s]) / total for s in names]
    parts = [(x.numerator, x.denominator, blocks[s]) for x, s in zip(shares, names, strict=True)]
    coming = [(0, k, 0) for k in range(len(names))]
    ready: list[tuple[int, int, int, int]] = []
    slot = 0
    while coming or ready:
        if not ready:
            slot = max(slot, coming[0][0])
        while coming and coming[0][0] <= slot:
            release, k, j = heapq.heappop(coming)
            num, den, n = parts[k]
            heapq.heappush(ready, (-(-(j + 1) * den // num), release, k, j))
            if j + 1 < n:
                heapq.heappush(coming, ((j + 1) * den // num, k, j + 1))
        deadline, release, k, j = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError(f"block {j} of {names[k]} misses its deadline")
        yield names[k], j, release, deadline, slot
        slot += 1


def _plan_rows(weights: dict[str | None, float], blocks: dict[str | None, int], chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            rows, turn = pfair_blocks(weights, blocks), 0
            while held := list(itertools.islice(rows, chunk)):
                source, *numbers = zip(*held, strict=True)
                numbers.append(range(turn, turn := turn + len(held)))
                yield pa.RecordBatch.from_arrays([pa.array(source, pa.string()), *(pa.array(x, pa.int64()) for x in numbers)], ["__source", "block", "release", "deadline", "slot", "turn"])

    return run


def source_counts(docs: DataFrame, source_col: str = "source") -> dict[str | None, int]:
    """Documents of each source. One row per source reaches the driver."""
    rows = docs.groupBy(F.col(source_col).alias("s")).agg(F.count("*").alias("n")).collect()
    return {r["s"]: r["n"] for r in rows}


def temperature_weights(docs: DataFrame, source_col: str = "source", power: float = 0.5) -> dict[str | None, float]:
    """Weights in proportion to a power of each source's documents."""
    return {s: float(n) ** power for s, n in source_counts(docs, source_col).items()}


def pfair_schedule(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_docs: int = 16, period: int = 4096) -> DataFrame:
    """One row per document: id, source, block, slot, release, deadline, place (in the block), turn (of the block: slots without gaps).

    Sources that ``weights`` does not name raise an error. Without weights: ``temperature_weights``. ``period`` blocks are
    planned at a time; it changes no results.
    """
    spark = docs.sparkSession
    counts = source_counts(docs, source_col)
    weights = {s: float(n) ** 0.5 for s, n in counts.items()} if weights is None else weights
    if missing := sorted(set(counts) - set(weights), key=_ordinal):
        raise ValueError(f"no weight for source {missing[0]}")
    blocks = {s: -(-n // block_docs) for s, n in counts.items()}
    # a null source has a key of its own: joins and windows are by (__none, __source)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(source_col).isNull().alias("__none"), F.coalesce(F.col(source_col), F.lit("")).alias("__source"))
    rows = rows.withColumn("__n", _numbers(rows))
    plan = spark.range(0, 1, 1, 1).mapInArrow(_plan_rows(weights, blocks, period), "__source string, block long, release long, deadline long, slot long, turn long")
    plan, _ = cut(plan.withColumn("__none", F.col("__source").isNull()).withColumn("__source", F.coalesce("__source", F.lit(""))), "slots")
    rows = _numbered(rows).withColumn("block", F.floor(F.col("__rank") / F.lit(block_docs)).cast("long"))
    out = rows.join(plan, [*_KEY, "block"])
    source = F.when(~F.col("__none"), F.col("__source"))
    return out.select(F.col("__id").alias(id_col), source.alias(source_col), "block", "slot", "release", "deadline", F.expr(f"__rank % {int(block_docs)}").alias("place"), "turn")


BUCKET_DOCS = 2048
_KEY = ("__none", "__source")


def _numbers(rows: DataFrame):
    buckets = max(1, -(-rows.count() // BUCKET_DOCS))
    return F.pmod(F.xxhash64("__id"), F.lit(buckets))


def _numbered(rows: DataFrame) -> DataFrame:
    """``__rank`` from 0 within each source, in order of (bucket, id): ranks inside buckets plus the buckets before."""
    counts = rows.groupBy(*_KEY, "__n").agg(F.count("*").alias("__in"))
    before = Window.partitionBy(*_KEY).orderBy("__n").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*_KEY, "__n", F.coalesce(F.sum("__in").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*_KEY, "__n").orderBy("__id")
    local = rows.withColumn("__local", F.row_number().over(inside) - 1)
    return local.join(counts, [*_KEY, "__n"]).withColumn("__rank", F.col("__local") + F.col("__before")).drop("__local", "__before", "__n")


def mixed_places(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_docs: int = 16, period: int = 4096) -> DataFrame:
    """(__id, __at) of each id once: its first place in the order of the schedule, without gaps between blocks.

    The same rows have the same places in any order.
    """
    at = F.col("turn") * F.lit(block_docs) + F.col("place")
    rows = pfair_schedule(docs, weights, id_col, source_col, block_docs, period).select(F.col(id_col).alias("__id"), at.alias("__at"))
    order, _ = cut(rows.groupBy("__id").agg(F.min("__at").alias("__at")), "mix")
    return order


#: Places of a written part of the mixture.
PART_DOCS = 1 << 13


def mixed_order(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_docs: int = 16, period: int = 4096) -> DataFrame:
    """The rows of ``docs`` in the order of the schedule: partitioned by ranges of places and sorted, columns unchanged.

    Places have no gaps, so the ranges are known without reading a text.
    """
    order = mixed_places(docs, weights, id_col, source_col, block_docs, period)
    parts = (order.agg(F.max("__at")).first()[0] or 0) // PART_DOCS + 1
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)  # names of ours never meet the caller's
    own = names[docs.columns.index(id_col)]
    out = rows.join(order, F.col(own).eqNullSafe(F.col("__id")))
    out = out.repartitionById(parts, F.expr(f"int(__at div {PART_DOCS})")).sortWithinPartitions("__at", own)
    return out.select(*names).toDF(*docs.columns)
