"""JSON functions over texts.

Types come from Spark's VARIANT; paths, wildcards and containment run on Arrow batches, since the built-in functions write
numbers and keys in other forms. Objects are written with sorted keys.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



class _MISSING:
    """No value. A class, since workers get functions by value and must still find the same one."""



@functools.lru_cache(4096)
def parse_path(path: str) -> tuple | None:
    """Steps of ``$.a."b c"[0][*].*``: keys, indexes and None for a wildcard. None for a malformed path."""
    if not path.startswith("$"):
        return None
    steps, at = [], 1
    step = re.compile(r'\.(?:"((?:[^"\\]|\\.)*)"|(\*)|([^.\[\]"]+))|\[(?:(\d+)|(\*)|"((?:[^"\\]|\\.)*)"|\'([^\']*)\')\]')
    while at < len(path):
        m = step.match(path, at)
        if not m:
            return None
        quoted, star, key, index, star2, q2, q3 = m.groups()
        if star or star2:
            steps.append(None)
        elif index is not None:
            steps.append(int(index))
        else:
            raw = quoted if quoted is not None else q2
            steps.append(json.loads(f'"{raw}"') if raw is not None else key if key is not None else q3)
        at = m.end()
    return tuple(steps)


def find(doc, steps: tuple) -> list:
    """All values at a path; an object wildcard goes through its keys in order."""
    now = [doc]
    for s in steps:
        got = []
        for x in now:
            if s is None:
                got += x if isinstance(x, list) else [x[k] for k in sorted(x)] if isinstance(x, dict) else []
            elif isinstance(s, int):
                if isinstance(x, list) and s < len(x):
                    got.append(x[s])
            elif isinstance(x, dict) and s in x:
                got.append(x[s])
        now = got
    return now


def contains(a, b) -> bool:
    """Whether ``a`` contains ``b``: objects by key, arrays by element, an array also a scalar."""
    if isinstance(a, dict):
        return isinstance(b, dict) and all(k in a and contains(a[k], v) for k, v in b.items())
    if isinstance(a, list):
        if isinstance(b, list):
            return all(any(contains(x, y) for x in a) for y in b)
        return any(same(x, b) for x in a) if not isinstance(b, dict) else False
    return same(a, b)


def same(a, b) -> bool:
    return type(a) is type(b) and a == b or (isinstance(a, int | float) and isinstance(b, int | float) and not isinstance(a, bool) and not isinstance(b, bool) and a == b)


def load(text: str):
    try:
        return json.loads(text, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
    except (ValueError, RecursionError):
        return _MISSING


def dump(x) -> str:
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _query(d, path: str) -> list[str]:
    steps = parse_path(path)
    return [] if d is _MISSING or steps is None else [dump(x) for x in find(d, steps)]


def _exists_path(d, path: str) -> bool:
    steps = parse_path(path)
    return d is not _MISSING and steps is not None and bool(find(d, steps))


def _contains(d, candidate: str) -> bool:
    c = load(candidate)
    return d is not _MISSING and c is not _MISSING and contains(d, c)


def _exists_key(d, key: str) -> bool:
    return key in d if isinstance(d, dict) else any(isinstance(x, str) and x == key for x in d) if isinstance(d, list) else False


_TWO = {"query": ("array<string>", _query), "exists_path": ("boolean", _exists_path), "contains": ("boolean", _contains), "exists_key": ("boolean", _exists_key)}


@functools.cache
def _udf(name: str):
    """A pandas UDF of two text columns, made on the driver at first use; null if either is null."""
    kind, f = _TWO[name]

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(load(x), y) for x, y in zip(a, b, strict=True)], dtype=object)

    return F.pandas_udf(run, kind)


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _literal(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def _step(d, k: str):
    if isinstance(d, dict):
        return d.get(k, _MISSING)
    if isinstance(d, list) and re.fullmatch(r"\d+", k) and int(k) < len(d):
        return d[int(k)]
    return _MISSING


def _walk(text: str, keys: str):
    d = load(text)
    for k in json.loads(keys):
        d = _step(d, k) if d is not _MISSING else d
    return d


@functools.cache
def _extract(as_text: bool):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, keys in zip(a, b, strict=True):
            d = _MISSING if x is None or keys is None else _walk(x, keys)
            out.append(None if d is _MISSING or (as_text and d is None) else d if as_text and isinstance(d, str) else dump(d))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")


def _keys(keys: tuple) -> Column:
    cols = [_literal(k).cast("string") if not isinstance(k, int) else F.lit(str(k)) for k in keys]
    any_null = functools.reduce(lambda a, b: a | b, [c.isNull() for c in cols])
    return F.when(~any_null, F.to_json(F.array(*cols)))


def json_extract_path(doc: Column | str, *keys: Column | str | int) -> Column:
    """The value at the keys as JSON text; null if it is missing, the text is not JSON or a key is null."""
    return _extract(False)(_column(doc), _keys(keys) if keys else F.lit("[]"))


def json_extract_path_text(doc: Column | str, *keys: Column | str | int) -> Column:
    """Like ``json_extract_path``, but texts are bare and JSON null is null."""
    return _extract(True)(_column(doc), _keys(keys) if keys else F.lit("[]"))


def json_contains(doc: Column | str, candidate: Column | str) -> Column:
    """Whether the document contains the candidate; text that is not JSON contains nothing."""
    return _udf("contains")(_column(doc), _literal(candidate))


def json_exists(doc: Column | str, key: Column | str) -> Column:
    """Whether an object has the key, or an array the text, at the top."""
    return _udf("exists_key")(_column(doc), _literal(key))


def json_typeof(doc: Column | str) -> Column:
    """null, boolean, number, string, array or object; null if the text is not JSON."""
    kind = F.schema_of_variant(F.try_parse_json(_column(doc)))
    return F.when(kind.isNull(), F.lit(None)).when(kind == "VOID", "null").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("number")


def json_path_exists(doc: Column | str, path: Column | str) -> Column:
    return _udf("exists_path")(_column(doc), _literal(path))


def json_path_query(doc: Column | str, path: Column | str) -> Column:
    """Every match as JSON text; empty if nothing matches."""
    return _udf("query")(_column(doc), _literal(path))


def _flat(x, path: str = "$") -> Iterator[tuple[str, str]]:
    yield path, dump(x)
    if isinstance(x, dict):
        for k, v in x.items():
            yield from _flat(v, f"{path}.{k}" if re.fullmatch(r"[^.\[\]\"*]+", k) else f"{path}.{json.dumps(k, ensure_ascii=False)}")
    elif isinstance(x, list):
        for i, v in enumerate(x):
            yield from _flat(v, f"{path}[{i}]")


def json_entries(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, path, value) of every value of every document, as JSON text; texts that are not JSON have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, p, v) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t is not None and (d := load(t)) is not _MISSING for p, v in _flat(d)]
            ids, paths, values = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(paths, pa.string()), pa.array(values, pa.string())], ["id", "path", "value"])

    return df.select(id_col, json_col).mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, path string, value string")
