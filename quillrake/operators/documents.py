"""Documents and points over versioned tables: bulk changes, changes by query, filters and searches over points with payloads."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrake.sources.table import Table

from . import dsl
from .retrieval import discover, knn, recommend

# Documents.


def parse_bulk(body: str) -> list[tuple[str, Any, dict]]:
    """(operation, id, fields) of lines of JSON: an action line (index, create, update or delete) and, but for delete, a line of fields."""
    lines = [x for x in body.splitlines() if x.strip()]
    out, i = [], 0
    while i < len(lines):
        op, head = next(iter(json.loads(lines[i]).items()))
        i += 1
        if op not in ("index", "create", "update", "delete"):
            raise dsl.DslError(f"bulk: unknown operation {op!r}")
        fields: dict = {}
        if op != "delete":
            fields = json.loads(lines[i])
            fields = fields.get("doc", fields) if op == "update" else fields
            i += 1
        out.append((op, head.get("_id"), fields))
    return out


def bulk(table: Table, body: str | Sequence[tuple[str, Any, dict]]) -> dict[str, int]:
    """Apply a request's operations as one MERGE; of several for one id the last counts, updates add to earlier ones.

    A request is what one client sends: it is bounded by memory. Updates of ids that are not there do nothing.
    """
    key = table.state["primary_key"][0]
    final: dict[Any, tuple[str, dict]] = {}
    for op, i, fields in parse_bulk(body) if isinstance(body, str) else body:
        before = final.get(i)
        if op == "update" and before and before[0] != "delete":
            final[i] = (before[0], before[1] | fields)
        elif op == "update" and before:
            continue
        else:
            final[i] = (op, dict(fields))
    kinds = {f.name: f.dataType for f in table.schema.fields}
    unknown = {c for _, fields in final.values() for c in fields} - set(kinds)
    if unknown:
        raise ValueError(f"unknown columns {sorted(unknown)}")
    rows = [(op, json.dumps(fields | {key: i}), sorted({*fields, key})) for i, (op, fields) in final.items()]
    if not rows:
        return {"updated": 0, "deleted": 0, "inserted": 0}
    parsed = table.spark.createDataFrame(rows, "__op string, __doc string, __set array<string>").select("__op", "__set", F.from_json("__doc", table.schema).alias("d")).select("__op", "__set", "d.*")
    values = {c: F.when((F.col("s.__op") == "update") & ~F.array_contains("s.__set", c), F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")) for c in table.columns}
    return table.merge(parsed, {key: key}, matched=[("s.__op = 'delete'", "delete", None), (None, "update", values)], not_matched=[("s.__op IN ('index', 'create')", {c: F.col(f"s.{c}") for c in table.columns})])


def delete_by_query(table: Table, query: Mapping) -> int:
    key = (table.state["primary_key"] or [None])[0]
    return table.delete(dsl.to_filter(query, key))


def update_by_query(table: Table, query: Mapping, values: Mapping[str, Any]) -> int:
    key = (table.state["primary_key"] or [None])[0]
    return table.update({c: v if isinstance(v, Column) else F.lit(v) for c, v in values.items()}, dsl.to_filter(query, key))


def reindex(source: Table, target: Table, query: Mapping | None = None) -> int:
    """Copy the rows of a query into another table, replacing equal keys; returns the target's version."""
    key = (source.state["primary_key"] or [None])[0]
    rows = source.df().where(dsl.to_filter(query or {}, key)).select(*[c for c in source.columns if c in target.columns])
    if target.state["primary_key"]:
        target.upsert(rows)
        return target.version
    return target.append(rows)


# Points.


def point_filter(spec: Mapping | None, id_col: str) -> Column:
    """must, should and must_not of conditions: {key, match: {value | any | except | text}}, {key, range}, {has_id}, {is_null}, {is_empty}, or filters again."""
    if not spec:
        return F.lit(True)

    def condition(c: Mapping) -> Column:
        if set(c) & {"must", "should", "must_not"}:
            return point_filter(c, id_col)
        if "has_id" in c:
            return dsl.to_filter({"ids": {"values": list(c["has_id"])}}, id_col)
        if "is_null" in c:
            return dsl._col(c["is_null"]["key"]).isNull()
        if "is_empty" in c:
            col = dsl._col(c["is_empty"]["key"])
            return col.isNull() | (F.length(col.cast("string")) == 0)
        parts = []
        if "match" in c:
            m = c["match"]
            col = dsl._col(c["key"])
            parts.append(col == F.lit(m["value"]) if "value" in m else col.isin(*m["any"]) if "any" in m else ~col.isin(*m["except"]) if "except" in m else F.lower(col).contains(str(m["text"]).lower()))
        if "range" in c:
            parts.append(dsl.to_filter({"range": {c["key"]: {k: v for k, v in c["range"].items() if v is not None}}}))
        if not parts:
            raise dsl.DslError(f"a condition needs match or range: {dict(c)}")
        return dsl._all(parts)

    listed = lambda k: [condition(c) for c in (spec.get(k) if isinstance(spec.get(k), list) else [spec[k]] if spec.get(k) else [])]
    parts = listed("must")
    if should := listed("should"):
        parts.append(dsl._any(should))
    return dsl._all(parts + [~F.coalesce(c, F.lit(False)) for c in listed("must_not")])


class Points:
    """Vectors with payload columns in a versioned table whose key is the point's id."""

    def __init__(self, table: Table, vector: str = "vector", metric: str = "cosine") -> None:
        self.table, self.vector, self.metric = table, vector, metric
        self.id = table.state["primary_key"][0]

    def _rows(self, where: Mapping | None) -> DataFrame:
        return self.table.df().where(point_filter(where, self.id))

    def upsert(self, rows: DataFrame) -> dict[str, int]:
        return self.table.upsert(rows)

    def delete(self, where: Mapping) -> int:
        return self.table.delete(point_filter(where, self.id))

    def search(self, query: Sequence[float], k: int = 10, where: Mapping | None = None, offset: int = 0, threshold: float | None = None) -> DataFrame:
        """Best first with ``score``: similarity for cosine and inner product, distance else."""
        out = knn(self._rows(where), self.vector, list(query), k, self.id, self.metric, offset=offset, score="score")
        if self.metric in ("cosine", "ip"):
            out = out.withColumn("score", (1 - F.col("score")) if self.metric == "cosine" else -F.col("score"))
            return out.where(F.col("score") >= threshold) if threshold is not None else out
        return out.where(F.col("score") <= threshold) if threshold is not None else out

    def retrieve(self, ids: Sequence[Any]) -> DataFrame:
        return self._rows({"must": [{"has_id": list(ids)}]})

    def count(self, where: Mapping | None = None) -> int:
        return self._rows(where).count()

    def scroll(self, size: int = 10, after: Any = None, where: Mapping | None = None) -> DataFrame:
        """A page in the order of ids; pass the last id to get the next one."""
        rows = self._rows(where)
        return (rows.where(F.col(self.id) > F.lit(after)) if after is not None else rows).orderBy(self.id).limit(size)

    def _vectors(self, examples: Sequence[Any]) -> list[list[float]]:
        """Examples are vectors or ids of points."""
        ids = [x for x in examples if not isinstance(x, list | tuple)]
        known = {r[0]: r[1] for r in self.retrieve(ids).select(self.id, self.vector).collect()} if ids else {}
        return [list(x) if isinstance(x, list | tuple) else list(known[x]) for x in examples]

    def recommend(self, positive: Sequence[Any], negative: Sequence[Any] = (), k: int = 10, where: Mapping | None = None, strategy: str = "average_vector") -> DataFrame:
        """Points like the positive and unlike the negative examples, without the examples."""
        ids = [x for x in (*positive, *negative) if not isinstance(x, list | tuple)]
        rows = self._rows(where)
        rows = rows.where(~F.col(self.id).isin(*ids)) if ids else rows
        return recommend(rows, self.vector, self.id, self._vectors(positive), self._vectors(negative), k, strategy)

    def discover(self, target: Any, context: Sequence[tuple[Any, Any]], k: int = 10, where: Mapping | None = None) -> DataFrame:
        pairs = [tuple(self._vectors(p)) for p in context]
        return discover(self._rows(where), self.vector, self.id, self._vectors([target])[0], pairs, k)

    def set_payload(self, values: Mapping[str, Any], where: Mapping) -> int:
        return self.table.update({c: F.lit(v) for c, v in values.items()}, point_filter(where, self.id))

    def overwrite_payload(self, values: Mapping[str, Any], where: Mapping) -> int:
        rest = [c for c in self.table.columns if c not in (self.id, self.vector)]
        return self.set_payload({c: values.get(c) for c in rest}, where)

    def delete_payload(self, keys: Sequence[str], where: Mapping) -> int:
        return self.set_payload(dict.fromkeys(keys), where)

    def clear_payload(self, where: Mapping) -> int:
        return self.overwrite_payload({}, where)
