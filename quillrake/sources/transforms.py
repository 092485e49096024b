"""Partition transforms and space-filling curves as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrake.functions.text import let

TRANSFORMS = ("identity", "year", "month", "day", "hour", "void", "bucket[n]", "truncate[w]")


def partition_value(column: Column | str, transform: str, kind: str = "") -> Column:
    """The partition that a value belongs to. Months and so on are timestamps cut to the unit; buckets are numbers."""
    c = F.col(column) if isinstance(column, str) else column
    if transform == "identity":
        return c
    if transform in ("year", "month", "day", "hour"):
        pattern = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd-HH"}[transform]
        return F.date_format(c, pattern)
    if transform == "void":
        return F.lit(None).cast("string")
    if m := re.fullmatch(r"bucket\[(\d+)\]", transform):
        return F.pmod(F.xxhash64(c), F.lit(int(m[1]))).cast("int")
    if m := re.fullmatch(r"truncate\[(\d+)\]", transform):
        w = int(m[1])
        return F.substring(c, 1, w) if kind in ("string", "") else c - F.pmod(c, F.lit(w))
    raise ValueError(f"unknown partition transform {transform!r}; known are {TRANSFORMS}")


def _below(edges: Column):
    return lambda v: F.when(v.isNull(), F.lit(0)).otherwise(F.size(F.filter(edges, lambda e: e < v))).cast("long")


def _scaled(df: DataFrame, columns: list[str], bits: int) -> list[Column]:
    """Each column as a rank of ``bits`` bits between its quantiles; nulls come first.

    Quantiles, not minimum and maximum, so that skewed values still spread.
    """
    steps = 1 << min(bits, 8)
    out = []
    for c in columns:
        kind = dict(df.dtypes)[c]
        x = F.xxhash64(c).cast("double") if kind in ("string", "binary", "boolean") else F.col(c).cast("double") if not kind.startswith(("timestamp", "date")) else F.unix_micros(F.col(c).cast("timestamp")).cast("double")
        cuts = df.agg(F.percentile_approx(x, [i / steps for i in range(1, steps)], 10_000)).first()[0] or []
        cuts = sorted(set(cuts))
        edges = F.array(*[F.lit(v) for v in cuts]) if cuts else F.array().cast("array<double>")
        out.append(let(x, _below(edges)))
    return out


def z_order(df: DataFrame, columns: list[str], bits: int = 8) -> Column:
    """Interleaved bits of the columns' ranks. A fold over the bits keeps the expression small."""
    ranks, n = _scaled(df, columns, bits), len(columns)

    def merge(acc: Column, b: Column) -> Column:
        v = acc["v"]
        for k in range(n):
            bit = _shift("shiftright", F.get(acc["r"], F.lit(k)), b).bitwiseAND(F.lit(1).cast("long"))
            v = v.bitwiseOR(_shift("shiftleft", bit, b * n + k))
        return F.struct(v.alias("v"), acc["r"].alias("r"))

    start = F.struct(F.lit(0).cast("long").alias("v"), F.array(*ranks).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), start, merge, lambda acc: acc["v"])


def _shift(how: str, value: Column, by: Column) -> Column:
    return F.call_function(how, value, by)


def hilbert(df: DataFrame, columns: list[str], bits: int = 8) -> Column:
    """Place along a Hilbert curve of two columns: quadrant by quadrant, turning as the curve does."""
    if len(columns) != 2:
        raise ValueError("a Hilbert curve here takes two columns; use z_order for more")
    one = F.lit(1).cast("long")

    def merge(acc: Column, b: Column) -> Column:
        x, y, side = acc["x"], acc["y"], _shift("shiftleft", one, b)
        right, up = _shift("shiftright", x, b).bitwiseAND(one), _shift("shiftright", y, b).bitwiseAND(one)
        low_x, low_y = x.bitwiseAND(side - 1), y.bitwiseAND(side - 1)
        flip = lambda v: F.when(right == 1, side - 1 - v).otherwise(v)
        nx, ny = F.when(up == 0, flip(low_y)).otherwise(low_x), F.when(up == 0, flip(low_x)).otherwise(low_y)
        return F.struct((acc["d"] + side * side * (3 * right).bitwiseXOR(up)).alias("d"), nx.alias("x"), ny.alias("y"))

    x, y = _scaled(df, columns, bits)
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), F.struct(F.lit(0).cast("long").alias("d"), x.alias("x"), y.alias("y")), merge, lambda acc: acc["d"])
