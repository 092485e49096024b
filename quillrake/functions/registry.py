"""All functions under their SQL names. Most are SQL functions, which Catalyst inlines; JSON paths are Arrow UDFs."""

from __future__ import annotations


import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .jsonfn import _MISSING, _step, contains, dump, find, load, parse_path

_V = "ARRAY<DOUBLE>"
_SAME = "CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN size(a) <> size(b) THEN raise_error(concat('vectors have different dimensions: ', size(a), ' and ', size(b))) ELSE {} END"


def _total(f: str) -> str:
    return f"aggregate(zip_with(a, b, (__x, __y) -> {f}), 0D, (__s, __x) -> __s + __x)"


_DOT, _NORM_A, _NORM_B = _total("__x * __y"), "sqrt(aggregate(a, 0D, (__s, __x) -> __s + __x * __x))", "sqrt(aggregate(b, 0D, (__s, __x) -> __s + __x * __x))"
_UNION, _SHARED = _total("CASE WHEN __x > 0 OR __y > 0 THEN 1D ELSE 0D END"), _total("CASE WHEN __x > 0 AND __x = __y THEN 1D ELSE 0D END")

#: name and aliases: (arguments, result, body)
_TWO = f"a {_V}, b {_V}"
_PACK = "CASE WHEN size(v) = 0 THEN array() ELSE transform(sequence(0, size(v) - 1, 8), __b -> cast(aggregate(transform(slice(v, __b + 1, 8), (__x, __i) -> CASE WHEN __x {} 0 THEN shiftleft(1, __i) ELSE 0 END), 0, (__s, __x) -> __s + __x) AS SMALLINT)) END"
_WORDS = r"filter(transform(split(lower({}), '\\s+'), __w -> regexp_replace(__w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '')), __w -> __w <> '')"
_TF = "cast(size(filter(__ws, __w -> __w = __u)) AS DOUBLE)"
_SPARSE = "STRUCT<indices: ARRAY<INT>, values: ARRAY<DOUBLE>, dim: INT>"
SQL_FUNCTIONS: dict[tuple[str, ...], tuple[str, str, str]] = {
    ("dist_l2", "l2_distance", "vector_distance"): (_TWO, "DOUBLE", _SAME.format(f"sqrt({_total('(__x - __y) * (__x - __y)')})")),
    ("dist_cosine", "cosine_distance", "vector_cosine_distance"): (_TWO, "DOUBLE", _SAME.format(f"CASE WHEN {_NORM_A} * {_NORM_B} = 0 THEN 1D WHEN 1 - {_DOT} / ({_NORM_A} * {_NORM_B}) < 0 THEN 0D ELSE 1 - {_DOT} / ({_NORM_A} * {_NORM_B}) END")),
    ("dist_ip", "vector_inner_product"): (_TWO, "DOUBLE", _SAME.format(f"-{_DOT}")),
    ("inner_product", "dot_product"): (_TWO, "DOUBLE", _SAME.format(_DOT)),
    ("dist_l1", "l1_distance", "vector_l1_distance"): (_TWO, "DOUBLE", _SAME.format(_total("abs(__x - __y)"))),
    ("dist_hamming", "hamming_distance", "vector_hamming_distance"): (_TWO, "DOUBLE", _SAME.format(_total("CASE WHEN __x IS NULL OR __y IS NULL THEN NULL WHEN __x <> __y THEN 1D ELSE 0D END"))),
    ("dist_jaccard", "jaccard_distance", "vector_jaccard_distance"): (_TWO, "DOUBLE", _SAME.format(f"CASE WHEN {_UNION} = 0 THEN 0D ELSE 1 - {_SHARED} / {_UNION} END")),
    ("vector_add",): (_TWO, _V, _SAME.format("zip_with(a, b, (__x, __y) -> __x + __y)")),
    ("vector_sub",): (_TWO, _V, _SAME.format("zip_with(a, b, (__x, __y) -> __x - __y)")),
    ("vector_mul",): (_TWO, _V, _SAME.format("zip_with(a, b, (__x, __y) -> __x * __y)")),
    ("vector_concat",): (_TWO, _V, "concat(a, b)"),
    ("vector_dims",): (f"v {_V}", "INT", "CASE WHEN v IS NOT NULL THEN size(v) END"),
    ("vector_norm",): (f"v {_V}", "DOUBLE", "sqrt(aggregate(v, 0D, (__s, __x) -> __s + __x * __x))"),
    ("l2_normalize",): (f"v {_V}", _V, "get(transform(array(sqrt(aggregate(v, 0D, (__s, __x) -> __s + __x * __x))), __n -> CASE WHEN __n = 0 THEN v ELSE transform(v, __y -> __y / __n) END), 0)"),
    ("subvector",): (f"v {_V}, start INT, n INT", _V, "CASE WHEN start >= size(v) THEN array() ELSE slice(v, greatest(start, 0) + 1, greatest(n, 0)) END"),
    ("binary_quantize",): (f"v {_V}", "ARRAY<SMALLINT>", _PACK.format(">")),
    ("vector_to_binary",): (f"v {_V}", "ARRAY<SMALLINT>", _PACK.format(">=")),
    ("vector_to_sparse",): (f"v {_V}", _SPARSE, "CASE WHEN v IS NOT NULL THEN named_struct('indices', transform(filter(transform(v, (__x, __i) -> named_struct('i', __i, 'x', __x)), __e -> __e.x <> 0), __e -> __e.i), 'values', filter(v, __x -> __x <> 0), 'dim', size(v)) END"),
    ("sparse_to_vector",): (f"v {_SPARSE}", _V, "CASE WHEN v.dim = 0 THEN array() ELSE map_values(map_zip_with(map_from_arrays(sequence(0, v.dim - 1), sequence(0, v.dim - 1)), map_from_arrays(v.indices, v.values), (__k, __p, __x) -> coalesce(__x, 0D))) END"),
    ("sparse_dot_product",): (f"a {_SPARSE}, b {_SPARSE}", "DOUBLE", "aggregate(map_values(map_zip_with(map_from_arrays(a.indices, a.values), map_from_arrays(b.indices, b.values), (__k, __x, __y) -> coalesce(__x, 0D) * coalesce(__y, 0D))), 0D, (__s, __x) -> __s + __x)"),
    ("hybrid_score",): ("dense DOUBLE, sparse DOUBLE, alpha DOUBLE", "DOUBLE", "alpha * dense + (1 - alpha) * sparse"),
    ("reciprocal_rank_fusion",): ("ranks ARRAY<DOUBLE>, k DOUBLE DEFAULT 60", "DOUBLE", "aggregate(transform(ranks, __r -> coalesce(1 / (k + __r), 0D)), 0D, (__s, __x) -> __s + __x)"),
    ("bm25_score",): ("t STRING, q STRING", "DOUBLE", f"CASE WHEN t IS NOT NULL AND q IS NOT NULL THEN get(transform(array({_WORDS.format('t')}), __ws -> aggregate(transform({_WORDS.format('q')}, __u -> {_TF} * 2.2D / ({_TF} + 1.2D)), 0D, (__s, __x) -> __s + __x)), 0) END"),
    ("tf_idf",): ("t STRING", "ARRAY<DOUBLE>", f"get(transform(array({_WORDS.format('t')}), __ws -> transform(array_distinct(__ws), __u -> {_TF} / size(__ws))), 0)"),
    ("json_typeof",): ("j STRING", "STRING", "CASE WHEN schema_of_variant(try_parse_json(j)) IS NULL THEN NULL WHEN schema_of_variant(try_parse_json(j)) = 'VOID' THEN 'null' WHEN schema_of_variant(try_parse_json(j)) = 'BOOLEAN' THEN 'boolean' WHEN schema_of_variant(try_parse_json(j)) = 'STRING' THEN 'string' WHEN schema_of_variant(try_parse_json(j)) LIKE 'ARRAY%' THEN 'array' WHEN schema_of_variant(try_parse_json(j)) LIKE 'OBJECT%' THEN 'object' ELSE 'number' END"),
}


def _rows(kind: str, f):
    """A pandas UDF over any number of text columns; null where one is null."""

    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None for x in row) else f(*row) for row in zip(*cols, strict=True)], dtype=object)

    return F.pandas_udf(run, kind)


def _walk(as_text: bool):
    def one(text: str, *keys: str) -> str | None:
        d = load(text)
        for k in keys:
            d = _step(d, k) if d is not _MISSING else d
        if d is _MISSING or (as_text and d is None):
            return None
        return d if as_text and isinstance(d, str) else dump(d)

    return one


def _json_functions() -> dict:
    def steps(p: str):
        return parse_path(p)

    def key_in(j: str, k: str) -> bool:
        d = load(j)
        return k in d if isinstance(d, dict) else any(isinstance(x, str) and x == k for x in d) if isinstance(d, list) else False

    return {
        "json_extract_path": _rows("string", _walk(False)),
        "json_extract_path_text": _rows("string", _walk(True)),
        "json_contains": _rows("boolean", lambda j, c: (d := load(j)) is not _MISSING and (x := load(c)) is not _MISSING and contains(d, x)),
        "json_exists": _rows("boolean", key_in),
        "json_path_exists": _rows("boolean", lambda j, p: (d := load(j)) is not _MISSING and (s := steps(p)) is not None and bool(find(d, s))),
        "json_path_query": _rows("array<string>", lambda j, p: [] if (d := load(j)) is _MISSING or (s := steps(p)) is None else [dump(x) for x in find(d, s)]),
    }


def macros() -> dict[str, tuple[list[tuple[str, str, str | None]], str]]:
    """name: (arguments as (name, type, default), body), for the SQL dialect, which writes bodies in place of calls.

    Spark takes SQL functions in projections and filters only; in place they work in sorts and aggregates too.
    """
    out = {}
    for aliases, (args, _, body) in SQL_FUNCTIONS.items():
        parts = []
        for a in re.split(r", (?=\w+ [A-Z])", args):
            name, kind = a.split(" ", 1)
            kind, _, default = kind.partition(" DEFAULT ")
            parts.append((name, kind, default or None))
        out |= dict.fromkeys(aliases, (parts, body))
    return out


def register_functions(spark: SparkSession) -> list[str]:
    """Register every function for SQL of this session; returns the names."""
    names = []
    for aliases, (args, result, body) in SQL_FUNCTIONS.items():
        for name in aliases:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
            names.append(name)
    for name, f in _json_functions().items():
        spark.udf.register(name, f)
        names.append(name)
    return names


__all__ = ["SQL_FUNCTIONS", "macros", "register_functions"]
