"""Element-wise aggregates of vectors by group.

Vectors of up to ``WIDE`` elements become one partial aggregate for each element: no row is multiplied and a hot group
costs each task one row. Wider ones, and medians, are exploded to (position, value). Null vectors and null elements are
skipped; a group without vectors has null; vectors of different lengths in a group raise an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGGS = {
    "vector_sum": F.sum,
    "vector_avg": F.avg,
    "centroid": F.avg,
    "vector_min": F.min,
    "vector_max": F.max,
    "vector_stddev": F.stddev_pop,
    "vector_median": lambda x: F.percentile(x, F.lit(0.5)),
}
WIDE = 256
_FAIL = "vectors of a group have different dimensions"


def vector_aggregate(df: DataFrame, vector: str, keys: list[str] | None = None, aggs: tuple[str, ...] = ("vector_sum",), dim: int | None = None) -> DataFrame:
    """One row per group: the keys and one array column for each aggregate, named by it.

    ``dim`` is the greatest length of a vector; without it a pass over the column finds it.
    """
    keys = keys or []
    rows = df.select(*keys, F.col(vector).cast("array<double>").alias("__v"))
    dim = dim or rows.agg(F.max(F.size("__v"))).first()[0] or 0
    if 0 < dim <= WIDE and "vector_median" not in aggs:
        return _by_element(rows, keys, aggs, dim)
    return _exploded(rows, keys, aggs)


def _by_element(rows: DataFrame, keys: list[str], aggs: tuple[str, ...], dim: int) -> DataFrame:
    cols = [AGGS[a](F.get("__v", F.lit(i))).alias(f"__{k}_{i}") for k, a in enumerate(aggs) for i in range(dim)]
    size = F.when(F.col("__v").isNotNull(), F.size("__v"))
    out = rows.groupBy(*keys).agg(F.min(size).alias("__lo"), F.max(size).alias("__hi"), *cols)
    bad = F.col("__hi") != F.col("__lo")  # groups may differ from each other, so each cuts its arrays
    arrays = [F.when(F.col("__hi").isNull(), F.lit(None)).when(bad, F.raise_error(F.lit(_FAIL))).otherwise(F.slice(F.array(*[f"__{k}_{i}" for i in range(dim)]), F.lit(1), F.col("__hi"))).alias(a) for k, a in enumerate(aggs)]
    return out.select(*keys, *arrays)


def _exploded(rows: DataFrame, keys: list[str], aggs: tuple[str, ...]) -> DataFrame:
    some = rows.where("__v IS NOT NULL")
    by_place = some.select(*keys, F.posexplode("__v").alias("__pos", "__x")).groupBy(*keys, "__pos").agg(*[AGGS[a]("__x").alias(a) for a in aggs])
    gathered = by_place.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__pos", *aggs))).alias("__all"))
    fields = [F.col(f"__all.{a}").alias(a) for a in aggs]
    whole = some.groupBy(*keys).agg(F.min(F.size("__v")).alias("__lo"), F.max(F.size("__v")).alias("__hi"))
    if not keys:
        out = gathered.crossJoin(whole)  # one row each
    else:
        out = rows.select(*keys).distinct()
        for side in (gathered, whole):
            named = side.toDF(*[f"__k{i}" for i in range(len(keys))], *side.columns[len(keys) :])
            on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
            out = out.join(named, on, "left").drop(*[f"__k{i}" for i in range(len(keys))])
    bad = F.col("__lo") != F.col("__hi")
    return out.withColumn("__all", F.when(bad, F.raise_error(F.lit(_FAIL))).otherwise(F.col("__all"))).select(*keys, *fields)
