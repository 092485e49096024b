"""Vector functions as Column expressions; they stay on the JVM.

A vector is an array of numbers or a text like ``'[1, 2.5]'``. Distances are computed in double precision. Null vectors
and null elements give null; vectors of different lengths raise an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

Vector = Column | str | list | tuple


def vec(v: Vector) -> Column:
    """A vector argument as a Column: names, literals as lists, texts in brackets."""
    if isinstance(v, list | tuple):
        return F.array(*[F.lit(float(x)) for x in v]).cast("array<double>")
    if isinstance(v, str):
        return parse_dense(v) if v.lstrip().startswith("[") else F.col(v).cast("array<double>")
    return v.cast("array<double>")


def parse_dense(text: str) -> Column:
    body = text.strip()
    if not (body.startswith("[") and body.endswith("]")):
        raise ValueError(f"not a vector literal: {text!r}")
    inner = body[1:-1].strip()
    return F.array(*[F.lit(float(x)) for x in inner.split(",")]).cast("array<double>") if inner else F.array().cast("array<double>")


def _same(a: Column, b: Column, out: Column) -> Column:
    differ = F.concat(F.lit("vectors have different dimensions: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(F.size(a) != F.size(b), F.raise_error(differ)).otherwise(out)


def _total(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def _dot(a: Column, b: Column) -> Column:
    return _total(a, b, lambda x, y: x * y)


def _squares(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def dist_l2(a: Vector, b: Vector) -> Column:
    a, b = vec(a), vec(b)
    return _same(a, b, F.sqrt(_total(a, b, lambda x, y: (x - y) * (x - y))))


def dist_cosine(a: Vector, b: Vector) -> Column:
    """1 - cosine, not below 0; 1 if a vector is zero."""
    a, b = vec(a), vec(b)
    norm, away = F.sqrt(_squares(a)) * F.sqrt(_squares(b)), 1 - _dot(a, b) / (F.sqrt(_squares(a)) * F.sqrt(_squares(b)))
    # greatest() would take 0 for a null, that is, call a vector with a null element identical
    return _same(a, b, F.when(norm == 0, F.lit(1.0)).when(away < 0, F.lit(0.0)).otherwise(away))


def inner_product(a: Vector, b: Vector) -> Column:
    a, b = vec(a), vec(b)
    return _same(a, b, _dot(a, b))


def dist_ip(a: Vector, b: Vector) -> Column:
    """Negative inner product, so that less is nearer."""
    return -inner_product(a, b)


def dist_l1(a: Vector, b: Vector) -> Column:
    a, b = vec(a), vec(b)
    return _same(a, b, _total(a, b, lambda x, y: F.abs(x - y)))


def dist_hamming(a: Vector, b: Vector) -> Column:
    a, b = vec(a), vec(b)
    return _same(a, b, _total(a, b, lambda x, y: F.when(x.isNull() | y.isNull(), F.lit(None)).otherwise((x != y).cast("double"))))


def dist_jaccard(a: Vector, b: Vector) -> Column:
    """1 - intersection / union of positive places; a place is shared if its positive values are equal."""
    a, b = vec(a), vec(b)
    union = _total(a, b, lambda x, y: ((x > 0) | (y > 0)).cast("double"))
    inter = _total(a, b, lambda x, y: ((x > 0) & (x == y)).cast("double"))
    return _same(a, b, F.when(union == 0, F.lit(0.0)).otherwise(1 - inter / union))


def _bytes(v: Vector) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<int>")


def packed_hamming(a: Vector, b: Vector) -> Column:
    """Bits that differ between packed binary vectors."""
    a, b = _bytes(a), _bytes(b)
    return _same(a, b, F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x))


def packed_jaccard(a: Vector, b: Vector) -> Column:
    a, b = _bytes(a), _bytes(b)
    bits = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0).cast("long"), lambda s, x: s + F.bit_count(x).cast("long"))
    union, inter = bits(lambda x, y: x.bitwiseOR(y)), bits(lambda x, y: x.bitwiseAND(y))
    return _same(a, b, F.when(union == 0, F.lit(0.0)).otherwise(1 - inter / union))


def vector_add(a: Vector, b: Vector) -> Column:
    a, b = vec(a), vec(b)
    return _same(a, b, F.zip_with(a, b, lambda x, y: x + y))


def vector_sub(a: Vector, b: Vector) -> Column:
    a, b = vec(a), vec(b)
    return _same(a, b, F.zip_with(a, b, lambda x, y: x - y))


def vector_mul(a: Vector, b: Vector) -> Column:
    a, b = vec(a), vec(b)
    return _same(a, b, F.zip_with(a, b, lambda x, y: x * y))


def vector_concat(a: Vector, b: Vector) -> Column:
    return F.concat(vec(a), vec(b))


def vector_dims(v: Vector) -> Column:
    v = vec(v)
    return F.when(v.isNotNull(), F.size(v))


def vector_norm(v: Vector) -> Column:
    return F.sqrt(_squares(vec(v)))


def l2_normalize(v: Vector) -> Column:
    """Length one; a zero vector stays as it is."""
    v = vec(v)
    return let(F.sqrt(_squares(v)), lambda norm: F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm)))


def subvector(v: Vector, start: Column | int, count: Column | int) -> Column:
    """``count`` elements from the 0-based ``start``; what lies beyond the ends is left out."""
    v = vec(v)
    start = F.lit(start) if isinstance(start, int) else start
    count = F.lit(count) if isinstance(count, int) else count
    return F.when(start >= F.size(v), F.array().cast("array<double>")).otherwise(F.slice(v, F.greatest(start, F.lit(0)) + 1, F.greatest(count, F.lit(0))))


def _pack(v: Column, on) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(8))
    byte = lambda s: F.aggregate(F.transform(F.slice(v, s + 1, 8), lambda x, i: F.when(on(x), F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2.0), i)).otherwise(0).cast("int")), F.lit(0), lambda t, x: t + x).cast("smallint")
    return F.when(v.isNull(), F.lit(None)).when(F.size(v) == 0, F.array().cast("array<smallint>")).otherwise(F.transform(starts, byte))


def binary_quantize(v: Vector) -> Column:
    """Bit j is set where element j is above 0; eight bits to a number, the least significant first."""
    return _pack(vec(v), lambda x: x > 0)


def vector_to_binary(v: Vector) -> Column:
    """Like ``binary_quantize``, but 0 sets the bit too."""
    return _pack(vec(v), lambda x: x >= 0)


def vector_to_sparse(v: Vector) -> Column:
    """struct(indices, values, dim) of the elements that are not 0."""
    v = vec(v)
    kept = F.filter(F.transform(v, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: e["x"] != 0)
    return F.when(v.isNotNull(), F.struct(F.transform(kept, lambda e: e["i"]).alias("indices"), F.transform(kept, lambda e: e["x"]).alias("values"), F.size(v).alias("dim")))


def _sparse(v: Column | str) -> Column:
    return F.col(v) if isinstance(v, str) else v


def sparse_to_vector(v: Column | str) -> Column:
    v = _sparse(v)
    places = F.sequence(F.lit(0), v["dim"] - 1)
    dense = F.map_values(F.map_zip_with(F.map_from_arrays(places, places), _as_map(v), lambda k, place, x: F.coalesce(x, F.lit(0.0)).cast("double")))  # in order of places
    return F.when(v.isNull(), F.lit(None)).when(v["dim"] == 0, F.array().cast("array<double>")).otherwise(dense)


def sparse_dims(v: Column | str) -> Column:
    return _sparse(v)["dim"]


def sparse_nnz(v: Column | str) -> Column:
    v = _sparse(v)
    return F.when(v.isNotNull(), F.size(v["indices"]))


def _as_map(v: Column) -> Column:
    return F.map_from_arrays(v["indices"], v["values"])


def _sparse_terms(a: Column, b: Column, f) -> Column:
    at = lambda x: F.coalesce(x, F.lit(0.0)).cast("double")
    both = F.map_zip_with(_as_map(a), _as_map(b), lambda k, x, y: f(at(x), at(y)))
    return F.aggregate(F.map_values(both), F.lit(0.0), lambda s, x: s + x)


def sparse_inner_product(a: Column | str, b: Column | str) -> Column:
    return _sparse_terms(_sparse(a), _sparse(b), lambda x, y: x * y)


def sparse_l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(_sparse_terms(_sparse(a), _sparse(b), lambda x, y: (x - y) * (x - y)))


def sparse_cosine(a: Column | str, b: Column | str) -> Column:
    a, b = _sparse(a), _sparse(b)
    norm = F.sqrt(_squares(a["values"].cast("array<double>"))) * F.sqrt(_squares(b["values"].cast("array<double>")))
    away = 1 - sparse_inner_product(a, b) / norm
    return F.when(norm == 0, F.lit(1.0)).when(away < 0, F.lit(0.0)).otherwise(away)


def hybrid_score(dense: Column, sparse: Column, alpha: float) -> Column:
    return F.lit(alpha) * dense + F.lit(1 - alpha) * sparse


def reciprocal_rank_fusion(ranks: Column, k: float = 60) -> Column:
    """Sum of 1 / (k + rank) over an array of ranks; null ranks add nothing."""
    return F.aggregate(F.transform(ranks, lambda r: F.coalesce(1.0 / (F.lit(float(k)) + r), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


METRICS = {"l2": dist_l2, "cosine": dist_cosine, "ip": dist_ip, "l1": dist_l1, "hamming": dist_hamming, "jaccard": dist_jaccard}
