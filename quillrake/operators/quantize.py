"""Quantised vectors: scalar (SQ8), binary and product (PQ) codes, and searches that score codes first and rows second.

Ranges and code books are fitted on a bounded sample (``SAMPLE_ROWS``); every row is encoded. Codes only choose candidates:
``refine`` times k rows are scored exactly, so codes change recall and never a distance.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrake.functions.vector import METRICS, binary_quantize, packed_hamming

SAMPLE_ROWS = 20_000


def _sample(df: DataFrame, vector: str) -> np.ndarray:
    """A sample by hash of the vector, so that it does not depend on the order of rows; of distinct vectors, so that it is bounded."""
    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    n = rows.count()
    if n > SAMPLE_ROWS:
        rows = rows.where(F.pmod(F.xxhash64("v"), F.lit(n)) < SAMPLE_ROWS).distinct().orderBy(F.xxhash64("v"), "v").limit(2 * SAMPLE_ROWS)
    return np.array([r["v"] for r in rows.collect()], float)


class ScalarQuantizer:
    """A byte per element between the sample's least and largest values of that element."""

    def __init__(self, low: Sequence[float], high: Sequence[float]) -> None:
        self.low = [float(x) for x in low]
        self.step = [max(float(b) - float(a), 1e-12) / 255 for a, b in zip(low, high, strict=True)]

    @classmethod
    def fit(cls, df: DataFrame, vector: str) -> ScalarQuantizer:
        x = _sample(df, vector)
        return cls(x.min(0), x.max(0))

    def encode(self, vector: Column | str) -> Column:
        v = F.col(vector) if isinstance(vector, str) else vector
        low, step = (F.array(*[F.lit(x) for x in side]) for side in (self.low, self.step))
        parts = F.arrays_zip(v.cast("array<double>").alias("x"), low.alias("l"), step.alias("s"))
        return F.transform(parts, lambda p: F.least(F.lit(255), F.greatest(F.lit(0), F.round((p["x"] - p["l"]) / p["s"]))).cast("smallint"))

    def decode(self, code: Column | str) -> Column:
        c = F.col(code) if isinstance(code, str) else code
        low, step = (F.array(*[F.lit(x) for x in side]) for side in (self.low, self.step))
        return F.transform(F.arrays_zip(c.alias("c"), low.alias("l"), step.alias("s")), lambda p: p["c"] * p["s"] + p["l"])


class ProductQuantizer:
    """``parts`` sub-vectors of equal length, each named by the nearest of ``codes`` centres."""

    def __init__(self, books: np.ndarray) -> None:
        self.books = books  # (parts, codes, length)

    @classmethod
    def fit(cls, df: DataFrame, vector: str, parts: int = 8, codes: int = 64, rounds: int = 12, seed: int = 1) -> ProductQuantizer:
        x = _sample(df, vector)
        if not len(x) or x.shape[1] % parts:
            raise ValueError("the dimension must be a multiple of the parts, and there must be vectors")
        rng, books = np.random.default_rng(seed), []
        for sub in np.split(x, parts, axis=1):
            k = min(codes, len(sub))
            centres = sub[rng.choice(len(sub), k, replace=False)]
            for _ in range(rounds):
                near = ((sub[:, None, :] - centres[None]) ** 2).sum(2).argmin(1) if len(sub) * k < 4_000_000 else np.concatenate([((s[:, None, :] - centres[None]) ** 2).sum(2).argmin(1) for s in np.array_split(sub, 64)])
                total = np.zeros_like(centres)
                np.add.at(total, near, sub)
                n = np.bincount(near, minlength=k)
                centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
            books.append(centres)
        return cls(np.array(books))

    def encode(self, df: DataFrame, vector: str, code: str = "pq_code") -> DataFrame:
        """``df`` with one number per part; null vectors have null codes."""
        books = self.books
        at = df.columns.index(vector)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list = [None] * b.num_rows
                rows = [(i, v) for i, v in enumerate(b.column(at).to_pylist()) if v is not None]
                if rows:
                    x = np.array([v for _, v in rows], float)
                    codes = np.stack([((s[:, None, :] - c[None]) ** 2).sum(2).argmin(1) for s, c in zip(np.split(x, len(books), axis=1), books, strict=True)], 1)
                    for (i, _), c in zip(rows, codes.tolist(), strict=True):
                        out[i] = c
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int16()))], [*b.schema.names, code])

        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(code, T.ArrayType(T.ShortType()))]))

    def distance(self, code: Column | str, query: Sequence[float]) -> Column:
        """Squared distance of the query to the coded vector: one table lookup per part, on the JVM."""
        c = F.col(code) if isinstance(code, str) else code
        tables = [((np.asarray(q) - b) ** 2).sum(1) for q, b in zip(np.split(np.asarray(query, float), len(self.books)), self.books, strict=True)]
        total = F.lit(0.0)
        for i, t in enumerate(tables):
            total = total + F.get(F.array(*[F.lit(float(x)) for x in t]), F.get(c, F.lit(i)).cast("int"))
        return total


def refined(df: DataFrame, rough: Column, vector: str, query: Sequence[float], k: int, id_col: str, metric: str = "l2", refine: int = 4) -> DataFrame:
    """The best k by exact distance among the ``refine`` * k best by the rough one."""
    first = df.withColumn("__rough", rough).where("__rough IS NOT NULL").orderBy("__rough", id_col).limit(k * refine).drop("__rough")
    return first.withColumn("distance", METRICS[metric](vector, list(query))).orderBy("distance", id_col).limit(k)


def binary_search(df: DataFrame, vector: str, query: Sequence[float], k: int, id_col: str, metric: str = "cosine", refine: int = 8) -> DataFrame:
    """Candidates by differing signs, then exact."""
    return refined(df, packed_hamming(binary_quantize(vector), binary_quantize(list(map(float, query)))), vector, query, k, id_col, metric, refine)
