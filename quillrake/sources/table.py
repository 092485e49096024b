"""Versioned tables: immutable Parquet files and a log of snapshots.

A snapshot names its files with row counts and the least and largest values of some columns, and carries schema,
partitioning, key and properties. Commits publish the next number of the log, which only one writer can; appends
that lose are tried again on top, other changes fail with ``Conflict``. Readers hold one snapshot. Changes rewrite only files
with rows that change. Columns keep their physical name for life, so renames and moves rewrite nothing.
"""

from __future__ import annotations

import datetime
import functools
import json
import re
import time
import uuid
from collections.abc import Mapping, Sequence
from typing import Any
from urllib.parse import unquote, urlparse

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrake.functions.jsonfn import json_entries, json_path_query
from quillrake.operators.fulltext import bm25, bm25_of_postings, corpus_statistics, documents_of_terms, phrase_search, postings
from quillrake.operators.retrieval import IvfIndex, knn

from . import transforms
from .storage import AlreadyThere, Storage

STATS_COLUMNS = 8
TARGET_FILE_BYTES = 512 << 20
#: Rows that one task sorts for a file.
SORTED_ROWS = 1_000_000
#: Types a column can be changed to without rewriting files; fixed values.
WIDER = {"tinyint": ("smallint", "int", "bigint", "double"), "smallint": ("int", "bigint", "double"), "int": ("bigint", "double"), "float": ("double",), "date": ("timestamp_ntz",)}
_ORDERED = ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz", "string")


class Conflict(Exception):
    """Another writer changed the table meanwhile."""


class ConstraintError(ValueError):
    """Rows break the table's key, a not-null column or a vector's dimension."""


def _plain(x: Any) -> Any:
    return x.isoformat() if isinstance(x, datetime.date | datetime.datetime) else x


class Table:
    def __init__(self, spark: SparkSession, path: str, ref: str | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.storage = Storage(spark, self.path)
        self.ref = ref
        self.state = self._load(self._latest())

    # log

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType | str, partition_by: Sequence[str | tuple[str, str]] = (), primary_key: Sequence[str] = (), properties: Mapping[str, Any] | None = None) -> Table:
        """A new empty table; an error if there is one. ``partition_by``: names or (name, transform)."""
        schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        columns = [{"id": i + 1, "name": f.name, "physical": f.name, "type": json.loads(f.dataType.json()), "nullable": f.nullable, "added": 0, "default": None} for i, f in enumerate(schema.fields)]
        state = {"version": 0, "parent": None, "operation": "create", "time": time.time(), "columns": columns, "next_id": len(columns) + 1, "partition_by": [], "primary_key": list(primary_key), "sort_order": [], "properties": dict(properties or {}), "indexes": {}, "deletes": [], "files": []}
        storage = Storage(spark, path.rstrip("/"))
        for p in partition_by:
            name, how = (p, "identity") if isinstance(p, str) else p
            transforms.partition_value(F.lit(None), how)
            state["partition_by"].append([name, how])
        try:
            storage.publish("_log/00000000000000000000.json", state)
        except AlreadyThere:
            raise ValueError(f"there is a table at {path}") from None
        return cls(spark, path)

    @classmethod
    def exists(cls, spark: SparkSession, path: str) -> bool:
        return Storage(spark, path.rstrip("/")).exists("_log/00000000000000000000.json")

    @classmethod
    def from_dataframe(cls, df: DataFrame, path: str, **options: Any) -> Table:
        table = cls.create(df.sparkSession, path, df.schema, **options)
        table.append(df)
        return table

    @classmethod
    def mount(cls, spark: SparkSession, files: str, path: str) -> Table:
        """A table over Parquet files that stay where they are; ``sync`` takes up what has come or gone since."""
        t = cls.create(spark, path, spark.read.parquet(files).schema, properties={"mounted": files})
        t.sync()
        return t

    def sync(self) -> int:
        """Follow the files of a mounted table. Nothing is copied; the files are not this table's to delete."""
        source = Storage(self.spark, self.state["properties"]["mounted"])
        there = {source.full(n): b for n, b in source.files("").items() if n.endswith(".parquet") and not n.split("/")[-1].startswith(("_", "."))}
        known = {f["path"]: f for f in self.state["files"]}
        if {p: f["bytes"] for p, f in known.items()} == there:
            return self.version
        counts = {}
        if fresh := [p for p in there if p not in known or known[p]["bytes"] != there[p]]:
            rows = self.spark.read.schema(self.schema).parquet(*fresh).groupBy(F.col("_metadata.file_path").alias("p")).agg(F.count("*").alias("n"))
            counts = {unquote(urlparse(r["p"]).path): r["n"] for r in rows.collect()}
        new = [known[p] if p in known and known[p]["bytes"] == there[p] else {"path": p, "rows": counts.get(unquote(urlparse(p).path), 0), "bytes": there[p], "version": self.version + 1, "stats": {}} for p in sorted(there)]
        return self._commit("sync", lambda s: s | {"files": new})

    def branches(self) -> dict[str, int]:
        """Branches and the versions that they started from."""
        return {n.removesuffix(".json"): self.storage.read(f"_refs/{n}")["version"] for n in self.storage.names("_refs") if n.endswith(".json")}

    def versions(self) -> list[int]:
        return [int(n[:20]) for n in self.storage.names("_log") if re.fullmatch(r"\d{20}\.json", n)]

    def _latest(self, ref: str | None = "") -> int:
        """The last version of a branch (main for None). A version names its branch, so the newest of its own is the head."""
        ref, versions = self.ref if ref == "" else ref, self.versions()
        if not versions:
            raise ValueError(f"no table at {self.path}")
        branches = self.branches()
        if ref is not None and ref not in branches:
            raise ValueError(f"no branch {ref!r}")
        if not branches:
            return versions[-1]
        start = branches.get(ref) if ref is not None else None
        return next((v for v in reversed(versions) if (start is None or v > start) and self._load(v).get("branch") == ref), start if start is not None else versions[-1])

    def _load(self, version: int) -> dict:
        return self.storage.read(f"_log/{version:020d}.json")

    def refresh(self) -> Table:
        self.state = self._load(self._latest())
        return self

    @property
    def version(self) -> int:
        return self.state["version"]

    def _commit(self, operation: str, change, retry: bool = False) -> int:
        """Publish ``change(state)`` as the next version. Only ``retry`` ones may be applied to a newer state."""
        for _ in range(20):
            base = self.state
            new = change(json.loads(json.dumps(base)))
            new |= {"version": self.versions()[-1] + 1, "parent": base["version"], "operation": operation, "time": time.time(), "branch": self.ref}
            if self._latest() == base["version"]:
                try:
                    self.storage.publish(f"_log/{new['version']:020d}.json", new)
                    self.state = new
                    return new["version"]
                except AlreadyThere:
                    pass
            if not retry:
                raise Conflict(f"{operation}: version {base['version']} is not the latest any more")
            self.refresh()
        raise Conflict(f"{operation}: gave up after 20 attempts")

    # schema

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c["name"], self._type(c), True) for c in self.state["columns"]])

    @property
    def columns(self) -> list[str]:
        return [c["name"] for c in self.state["columns"]]

    @staticmethod
    def _type(column: Mapping) -> T.DataType:
        return T._parse_datatype_json_string(json.dumps(column["type"]))

    def _column(self, state: Mapping, name: str) -> dict:
        for c in state["columns"]:
            if c["name"] == name:
                return c
        raise ValueError(f"no column {name!r}")

    def add_column(self, name: str, kind: T.DataType | str, default: Any = None, after: str | None = None, first: bool = False) -> int:
        kind = T._parse_datatype_string(kind) if isinstance(kind, str) else kind

        def change(s: dict) -> dict:
            if any(c["name"] == name for c in s["columns"]):
                raise ValueError(f"there is a column {name!r}")
            new = {"id": s["next_id"], "name": name, "physical": f"{name}__{s['next_id']}", "type": json.loads(kind.json()), "nullable": True, "added": s["version"] + 1, "default": _plain(default)}
            s["next_id"] += 1
            s["columns"].append(new)
            return self._moved(s, name, after, first) if after or first else s

        return self._commit("add column", change)

    def drop_column(self, name: str) -> int:
        def change(s: dict) -> dict:
            self._column(s, name)
            if name in s["primary_key"] or any(p[0] == name for p in s["partition_by"]):
                raise ValueError(f"{name!r} is part of the key or the partitioning")
            s["columns"] = [c for c in s["columns"] if c["name"] != name]
            return s

        return self._commit("drop column", change)

    def rename_column(self, old: str, new: str) -> int:
        def change(s: dict) -> dict:
            if any(c["name"] == new for c in s["columns"]):
                raise ValueError(f"there is a column {new!r}")
            self._column(s, old)["name"] = new
            s["primary_key"] = [new if k == old else k for k in s["primary_key"]]
            s["partition_by"] = [[new if n == old else n, t] for n, t in s["partition_by"]]
            return s

        return self._commit("rename column", change)

    def change_type(self, name: str, kind: str) -> int:
        """Only to types that hold every old value, which readers widen as they read."""

        def change(s: dict) -> dict:
            c = self._column(s, name)
            old, new = self._type(c).simpleString(), T._parse_datatype_string(kind)
            if new.simpleString() not in (old, *WIDER.get(old, ())):
                raise ValueError(f"{name}: {old} does not widen to {kind}")
            c["type"] = json.loads(new.json())
            return s

        return self._commit("change type", change)

    def _moved(self, s: dict, name: str, after: str | None, first: bool) -> dict:
        c = self._column(s, name)
        rest = [x for x in s["columns"] if x is not c]
        at = 0 if first else next(i for i, x in enumerate(rest) if x["name"] == after) + 1
        s["columns"] = [*rest[:at], c, *rest[at:]]
        return s

    def move_column(self, name: str, after: str | None = None, first: bool = False) -> int:
        return self._commit("move column", lambda s: self._moved(s, name, after, first))

    def set_not_null(self, name: str, required: bool = True) -> int:
        if required and self.df().where(F.col(name).isNull()).limit(1).count():
            raise ConstraintError(f"{name} has nulls")

        def change(s: dict) -> dict:
            self._column(s, name)["nullable"] = not required
            return s

        return self._commit("set not null", change)

    def set_partitioning(self, partition_by: Sequence[str | tuple[str, str]]) -> int:
        """For files written from now on; older ones stay as they are."""
        spec = [[p, "identity"] if isinstance(p, str) else list(p) for p in partition_by]
        for name, how in spec:
            self._column(self.state, name)
            transforms.partition_value(F.lit(None), how)
        return self._commit("set partitioning", lambda s: s | {"partition_by": spec})

    def set_sort_order(self, columns: Sequence[str]) -> int:
        return self._commit("set sort order", lambda s: s | {"sort_order": list(columns)})

    def set_properties(self, properties: Mapping[str, Any]) -> int:
        return self._commit("set properties", lambda s: s | {"properties": {k: v for k, v in (s["properties"] | dict(properties)).items() if v is not None}})

    def set_primary_key(self, columns: Sequence[str]) -> int:
        """Checked against the rows there are, and before each append."""
        for c in columns:
            self._column(self.state, c)
        if columns:
            self._unique(self.df(), list(columns))
        return self._commit("set primary key", lambda s: s | {"primary_key": list(columns)})

    # reading

    def at(self, version: int | None = None, timestamp: float | None = None) -> dict:
        if version is None and timestamp is None:
            return self.state
        if version is None:
            past = [v for v in self.versions() if self._load(v)["time"] <= timestamp]
            if not past:
                raise ValueError("no version is that old")
            version = past[-1]
        return self._load(version)

    def _read(self, state: dict, files: list[dict], extra: Sequence[Column] = ()) -> DataFrame:
        """Rows of some files in the columns of ``state``; columns that are younger than a file have their default.

        Rows that a delete file names (by file and row, or by key) are left out with anti-joins.
        """
        groups: dict[tuple, list[str]] = {}
        for f in files:
            young = tuple(c["id"] for c in state["columns"] if c["default"] is not None and f["version"] < c["added"])
            gone = tuple(i for i, d in enumerate(state["deletes"]) if f["version"] < d["version"])
            groups.setdefault((young, gone), []).append(self.storage.full(f["path"]))
        physical = T.StructType([T.StructField(c["physical"], self._type(c), True) for c in state["columns"]])
        parts = []
        for (young, gone), paths in groups.items() or [(((), ()), [])]:
            rows = self.spark.read.schema(physical).parquet(*paths) if paths else self.spark.createDataFrame([], physical)
            if gone:
                rows = self._without(rows.withColumns({"__name": self._file_name(), "__row": F.col("_metadata.row_index"), "__path": F.col("_metadata.file_path")}), [state["deletes"][i] for i in gone])
                extra_here = [F.col("__path").alias("__file")] if extra else []
            else:
                extra_here = list(extra)
            given = lambda c: F.lit(c["default"]).cast(self._type(c)) if c["id"] in young else F.col(f"`{c['physical']}`")  # noqa: B023, E731
            parts.append(rows.select(*[given(c).alias(c["name"]) for c in state["columns"]], *(extra_here if paths else [F.lit(None).cast("string").alias("__file")] if extra else [])))
        return functools.reduce(DataFrame.unionByName, parts)

    @staticmethod
    def _file_name() -> Column:
        """A file's name within the table, as delete files hold it."""
        return F.regexp_extract("_metadata.file_path", r"data/[0-9a-f]{32}/.*$", 0)

    def _without(self, rows: DataFrame, deletes: list[dict]) -> DataFrame:
        for d in deletes:
            gone = self.spark.read.parquet(self.storage.full(d["path"]))
            if d["kind"] == "position":
                rows = rows.join(gone.withColumnsRenamed({"name": "__name", "row": "__row"}), ["__name", "__row"], "left_anti")
            else:
                named = gone.toDF(*[f"__d{i}" for i in range(len(d["columns"]))])
                rows = rows.join(named, functools.reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"__d{i}")) for i, c in enumerate(d["columns"])]), "left_anti")
        return rows

    def df(self, version: int | None = None, timestamp: float | None = None, where: Column | str | None = None, ranges: Mapping[str, tuple[Any, Any]] | None = None) -> DataFrame:
        """Rows of a snapshot. ``where`` is pushed into the scan; ``ranges`` (column: (least, largest)) first leave out files by their statistics."""
        state = self.at(version, timestamp)
        files = [f for f in state["files"] if self._may_hold(f, ranges or {})]
        rows = self._read(state, files)
        for c, (lo, hi) in (ranges or {}).items():
            rows = rows.where(F.lit(True) & (F.col(c) >= F.lit(lo) if lo is not None else F.lit(True)) & (F.col(c) <= F.lit(hi) if hi is not None else F.lit(True)))
        return rows.where(where) if where is not None else rows

    def _may_hold(self, f: dict, ranges: Mapping[str, tuple[Any, Any]]) -> bool:
        for c, (lo, hi) in ranges.items():
            known = f["stats"].get(self._column(self.state, c)["physical"])
            if known and ((lo is not None and known[1] is not None and known[1] < _plain(lo)) or (hi is not None and known[0] is not None and known[0] > _plain(hi))):
                return False
        return True

    def explain_pruning(self, ranges: Mapping[str, tuple[Any, Any]]) -> dict[str, int]:
        kept = sum(self._may_hold(f, ranges) for f in self.state["files"])
        return {"files": len(self.state["files"]), "kept": kept, "pruned": len(self.state["files"]) - kept}

    def lookup(self, *keys: Any) -> DataFrame:
        """The row of a primary key; files are left out by statistics."""
        names = self.state["primary_key"]
        if len(keys) != len(names) or not names:
            raise ValueError(f"the key is {names}")
        return self.df(ranges={n: (k, k) for n, k in zip(names, keys, strict=True)})

    def splits(self, most_bytes: int = 128 << 20, ranges: Mapping[str, tuple[Any, Any]] | None = None) -> list[list[str]]:
        """Names of files in groups of about ``most_bytes``, for readers that share out the work; ``read_split`` takes one."""
        out: list[list[str]] = []
        size = most_bytes
        for f in self.state["files"]:
            if not self._may_hold(f, ranges or {}):
                continue
            if size + f["bytes"] > most_bytes:
                out.append([])
                size = 0
            out[-1].append(f["path"])
            size += f["bytes"]
        return out

    def read_split(self, split: Sequence[str]) -> DataFrame:
        return self._read(self.state, [f for f in self.state["files"] if f["path"] in set(split)])

    # writing

    def _shaped(self, df: DataFrame) -> DataFrame:
        unknown = set(df.columns) - set(self.columns)
        if unknown:
            raise ValueError(f"unknown columns {sorted(unknown)}")
        return df.select(*[(F.col(f"`{c['name']}`") if c["name"] in df.columns else F.lit(c["default"])).cast(self._type(c)).alias(c["name"]) for c in self.state["columns"]])

    def _checked(self, df: DataFrame) -> DataFrame:
        rows = self._shaped(df)
        bad = [(F.col(c["name"]).isNull(), f"{c['name']} is null") for c in self.state["columns"] if not c["nullable"]]
        for name, dim in self.state["properties"].get("vector_dimensions", {}).items():
            bad.append((F.col(name).isNotNull() & (F.size(name) != int(dim)), f"{name} does not have {dim} dimensions"))
        for test, why in bad:  # checked as rows are written, in the same pass
            first = self.columns[0]
            rows = rows.withColumn(first, F.when(test, F.raise_error(F.lit(f"constraint: {why}")).cast(rows.schema[first].dataType)).otherwise(F.col(first)))
        return rows

    def _unique(self, rows: DataFrame, keys: list[str]) -> None:
        if rows.where(functools.reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])).limit(1).count():
            raise ConstraintError(f"the key {keys} has nulls")
        if rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            raise ConstraintError(f"the key {keys} is not unique")

    def _write(self, rows: DataFrame) -> list[dict]:
        """Files of the rows, partitioned and sorted as the table asks, with their statistics. Not yet part of the table."""
        state, folder = self.state, f"data/{uuid.uuid4().hex}"
        named = rows.select(*[F.col(f"`{c['name']}`").alias(c["physical"]) for c in state["columns"]])
        physical = {c["name"]: c["physical"] for c in state["columns"]}
        kinds = dict(named.dtypes)
        parts = []
        for name, how in state["partition_by"]:
            part = f"__p_{name}_{how.split('[')[0]}"
            named = named.withColumn(part, transforms.partition_value(F.col(f"`{physical[name]}`"), how, kinds[physical[name]]))
            parts.append(part)
        if parts:
            # Rows of a partition go to tasks of a bounded size, as many as it needs: adaptive execution splits the large ones.
            named = named.hint("rebalance", *parts) if state["properties"].get("cluster_partitions", True) else named
        order = [*parts, *[physical[c] for c in state["sort_order"] if c in physical]]
        if order:
            named = named.sortWithinPartitions(*[F.col(f"`{c}`") for c in order])
        try:
            writer = named.write.partitionBy(*parts) if parts else named.write
            for entry in state["indexes"].values():
                if entry["kind"] in ("bloom", "inverted") and entry["column"] in physical:
                    writer = writer.option(f"parquet.bloom.filter.enabled#{physical[entry['column']]}", "true")
            writer.parquet(self.storage.full(folder))
        except Exception as e:
            self.storage.delete(folder)
            if m := re.search(r"constraint: ([^\n\"]+)", str(e)):
                raise ConstraintError(m[1].strip()) from None
            raise
        return self._described(folder)

    def _described(self, folder: str) -> list[dict]:
        sizes = {n: b for n, b in self.storage.files(folder).items() if n.endswith(".parquet")}
        wanted = [c for c in self.state["columns"] if self._type(c).simpleString() in _ORDERED][:STATS_COLUMNS]
        schema = T.StructType([T.StructField(c["physical"], self._type(c), True) for c in wanted])
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(self.storage.full(folder)) if sizes else None
        out = []
        if rows is not None:
            ends = [x for c in wanted for x in (F.min(f"`{c['physical']}`"), F.max(f"`{c['physical']}`"))]
            for r in rows.groupBy(F.col("_metadata.file_path").alias("__file")).agg(F.count("*"), *ends).toLocalIterator():  # a row for each file
                name = self._known(r[0])
                stats = {c["physical"]: [_plain(r[2 + 2 * i]), _plain(r[3 + 2 * i])] for i, c in enumerate(wanted)}
                out.append({"path": name, "rows": r[1], "bytes": sizes[name], "version": self.version + 1, "stats": stats})
        return sorted(out, key=lambda f: f["path"])

    def append(self, df: DataFrame, properties: Mapping[str, Any] | None = None) -> int:
        """Add rows; ``properties`` are set in the same commit."""
        rows, key = self._checked(df), self.state["primary_key"]
        if key:
            keys = self._shaped(df).select(*key)
            self._unique(keys, key)
            if self.df().join(keys, key, "left_semi").limit(1).count():
                raise ConstraintError(f"a key {key} is in the table already")
        files = self._write(rows)
        return self._commit("append", lambda s: s | {"files": s["files"] + [f | {"version": s["version"] + 1} for f in files], "properties": s["properties"] | dict(properties or {})}, retry=not key)

    def overwrite(self, df: DataFrame) -> int:
        rows = self._checked(df)
        if self.state["primary_key"]:
            self._unique(self._shaped(df), self.state["primary_key"])
        files = self._write(rows)
        return self._commit("overwrite", lambda s: s | {"files": files, "deletes": []})

    def truncate(self) -> int:
        return self._commit("truncate", lambda s: s | {"files": [], "deletes": []})

    def _with_files(self, files: list[dict] | None = None) -> DataFrame:
        return self._read(self.state, self.state["files"] if files is None else files, [F.col("_metadata.file_path").alias("__file")])

    def _touched(self, rows: DataFrame) -> list[dict]:
        """Files that hold one of the rows; the driver gets their names only."""
        names = {self._known(r[0]) for r in rows.select("__file").where("__file IS NOT NULL").distinct().collect()}
        return [f for f in self.state["files"] if self._known(f["path"]) in names]

    @staticmethod
    def _known(uri: str) -> str:
        """A file's name as the log has it: within the table, or a path where files are mounted."""
        path = unquote(urlparse(uri).path)
        inside = re.search(r"data/[0-9a-f]{32}/.*$", path)
        return inside[0] if inside else path

    def _rewritten(self, operation: str, touched: list[dict], rows: DataFrame) -> int:
        gone = {f["path"] for f in touched}
        new = self._write(rows)

        def change(s: dict) -> dict:
            kept = [f for f in s["files"] if f["path"] not in gone]
            oldest = min((f["version"] for f in kept), default=s["version"] + 1)
            return s | {"files": kept + new, "deletes": [d for d in s["deletes"] if oldest < d["version"]]}

        return self._commit(operation, change)

    def delete(self, where: Column | str | None = None) -> int:
        """Remove the rows for which ``where`` is true; those for which it is null stay. Returns rows removed."""
        if where is None:
            n = self.row_count()
            self.truncate()
            return n
        hit = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
        touched = self._touched(self._with_files().where(hit))
        if not touched:
            return 0
        before = self.row_count()
        self._rewritten("delete", touched, self._read(self.state, touched).where(~hit))
        return before - self.row_count()

    def delete_on_read(self, where: Column | str | None = None, keys: DataFrame | None = None) -> int:
        """Write a small delete file instead of rewriting data: rows by position (``where``) or by equal columns (``keys``).

        Readers leave the rows out; ``compact`` or any rewrite applies them. Returns the version.
        """
        folder = f"deletes/{uuid.uuid4().hex}"
        if keys is not None:
            physical = [self._column(self.state, c)["physical"] for c in keys.columns]
            keys.distinct().toDF(*physical).write.parquet(self.storage.full(folder))
            entry = {"path": folder, "kind": "equality", "columns": physical}
        else:
            hit = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
            physical = T.StructType([T.StructField(c["physical"], self._type(c), True) for c in self.state["columns"]])
            paths = [self.storage.full(f["path"]) for f in self.state["files"]]
            if not paths:
                return self.version
            rows = self.spark.read.schema(physical).parquet(*paths).withColumns({"__name": self._file_name(), "__row": F.col("_metadata.row_index")})
            named = rows.select("__name", "__row", *[F.col(f"`{c['physical']}`").alias(c["name"]) for c in self.state["columns"]])
            named.where(hit).select(F.col("__name").alias("name"), F.col("__row").alias("row")).write.parquet(self.storage.full(folder))
            entry = {"path": folder, "kind": "position", "columns": []}
        return self._commit("delete on read", lambda s: s | {"deletes": s["deletes"] + [entry | {"version": s["version"] + 1}]})

    def update(self, values: Mapping[str, Column | str | Any], where: Column | str | None = None) -> int:
        """Set columns of the rows for which ``where`` is true; texts are expressions. Returns rows changed."""
        hit = F.lit(True) if where is None else F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
        found = self._with_files().where(hit)
        touched, n = self._touched(found), found.count()
        if touched:
            rows = self._read(self.state, touched)
            new = {c: F.expr(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v) for c, v in values.items()}
            for c in new:
                self._column(self.state, c)
            rows = rows.select(*[(F.when(hit, new[c]).otherwise(F.col(c)) if c in new else F.col(c)).alias(c) for c in self.columns])
            self._rewritten("update", touched, self._checked(rows))
        return n

    def upsert(self, df: DataFrame, keys: Sequence[str] | None = None) -> dict[str, int]:
        """Replace rows of equal keys, add the others."""
        keys = list(keys or self.state["primary_key"])
        return self.merge(df, {k: k for k in keys}, matched=[(None, "update", None)], not_matched=[(None, None)])

    def merge(self, source: DataFrame, on: Mapping[str, str], matched: Sequence[tuple] = (), not_matched: Sequence[tuple] = (), not_matched_by_source: Sequence[tuple] = ()) -> dict[str, int]:
        """MERGE by equal columns (``on``: target column to source column). In each list the first clause that holds counts.

        matched, not_matched_by_source: (condition, "update" | "delete", {column: expression} or None for all of the source).
        not_matched: (condition, {column: expression} or None for all). Expressions name the sides t and s. A target row that
        several source rows match is an error; null keys match nothing. Returns counts of updated, deleted and inserted.
        """
        if not on:
            raise ValueError("a merge needs columns to match on")
        if source.where(functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on.values()])).groupBy(*on.values()).agg(F.count("*").alias("n")).where("n > 1").select(*on.values()).join(self.df().select(*[F.col(t).alias(s) for t, s in on.items()]), list(on.values()), "left_semi").limit(1).count():
            raise ConstraintError("several source rows match one target row")
        t = self._with_files(None if not_matched_by_source else self._overlapping(source, on)).withColumn("__t", F.lit(True)).alias("t")
        s = source.withColumn("__s", F.lit(True)).alias("s")
        joined = t.join(s, functools.reduce(lambda a, b: a & b, [F.col(f"t.{a}") == F.col(f"s.{b}") for a, b in on.items()]), "full" if not_matched else "left")
        both, only_t, only_s = F.col("__t").isNotNull() & F.col("__s").isNotNull(), F.col("__s").isNull(), F.col("__t").isNull()
        clauses: list[tuple[Column, str, Mapping | None]] = []
        for side, group in ((both, matched), (only_t, not_matched_by_source)):
            for cond, kind, values in group:
                clauses.append((side & (F.lit(True) if cond is None else F.coalesce(F.expr(cond) if isinstance(cond, str) else cond, F.lit(False))), kind, values))
        for cond, values in not_matched:
            clauses.append((only_s & (F.lit(True) if cond is None else F.coalesce(F.expr(cond) if isinstance(cond, str) else cond, F.lit(False))), "insert", values))
        action = functools.reduce(lambda acc, i: F.when(clauses[i][0], i).otherwise(acc), reversed(range(len(clauses))), F.when(F.col("__t").isNotNull(), F.lit(-1)))
        decided = joined.withColumn("__a", action).where("__a IS NOT NULL")
        counted = {r["__a"]: r["n"] for r in decided.groupBy("__a").agg(F.count("*").alias("n")).collect()}
        sums = dict.fromkeys(("update", "delete", "insert"), 0)
        for i, (_, kind, _) in enumerate(clauses):
            sums[kind] += counted.get(i, 0)
        if any(sums.values()):
            touched = self._touched(decided.where("__a >= 0"))
            gone = [i for i, c in enumerate(clauses) if c[1] == "delete"]
            rows = decided.where(~F.col("__a").isin(*gone)) if gone else decided
            names = [f["path"] for f in touched]
            hit = functools.reduce(lambda a, n: a | F.col("__file").endswith(n), names, F.lit(False)) if len(names) <= 50 else F.col("__file").isin(*[r[0] for r in decided.where("__a >= 0").select("__file").distinct().collect()])
            rows = rows.where(F.col("__t").isNull() | hit)
            value = lambda x: F.expr(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)
            out = []
            for c in self.columns:
                new = F.col(f"t.{c}")
                for i, (_, kind, values) in enumerate(clauses):
                    if kind == "delete":
                        continue
                    if values is None:
                        v = F.col(f"s.{c}") if c in source.columns else (F.col(f"t.{c}") if kind == "update" else F.lit(self._column(self.state, c)["default"]))
                    else:
                        v = value(values[c]) if c in values else (F.col(f"t.{c}") if kind == "update" else F.lit(self._column(self.state, c)["default"]))
                    new = F.when(F.col("__a") == i, v).otherwise(new)
                out.append(new.cast(self._type(self._column(self.state, c))).alias(c))
            result = rows.select(*out)
            if key := self.state["primary_key"]:
                self._unique(result.select(*key), key)
                kept = {f["path"] for f in touched}
                rest = [f for f in self.state["files"] if f["path"] not in kept]
                moved = set(on) != set(key) or any(kind == "update" and values is not None and set(values) & set(key) for _, kind, values in clauses)
                if moved and rest and self._read(self.state, rest).join(result.select(*key), key, "left_semi").limit(1).count():
                    raise ConstraintError(f"the key {key} is not unique")
            self._rewritten("merge", touched, self._checked(result))
        return {"updated": sums["update"], "deleted": sums["delete"], "inserted": sums["insert"]}

    def _overlapping(self, source: DataFrame, on: Mapping[str, str]) -> list[dict]:
        """Files whose statistics allow a row that a source row matches: no other file is read by a merge."""
        ends = source.agg(*[f(F.col(s)).alias(f"{n}{i}") for i, s in enumerate(on.values()) for n, f in (("lo", F.min), ("hi", F.max))]).first()
        ranges = {t: (ends[f"lo{i}"], ends[f"hi{i}"]) for i, t in enumerate(on)}
        return [f for f in self.state["files"] if self._may_hold(f, ranges)]

    # history

    def history(self) -> list[dict]:
        keys = ("version", "parent", "operation", "time")
        return [{k: s[k] for k in keys} | {"files": len(s["files"]), "rows": sum(f["rows"] for f in s["files"])} for s in map(self._load, self.versions())]

    def rollback(self, version: int) -> int:
        """The table is again as it was at a version; a commit of its own."""
        old = self._load(version)
        return self._commit(f"rollback to {version}", lambda s: json.loads(json.dumps(old)))

    def create_branch(self, name: str, version: int | None = None) -> Table:
        """A named line of versions; writing to it leaves main alone."""
        if not re.fullmatch(r"[\w-]+", name) or name == "main":
            raise ValueError(f"not a name for a branch: {name!r}")
        try:
            self.storage.publish(f"_refs/{name}.json", {"version": self.version if version is None else version})
        except AlreadyThere:
            raise ValueError(f"there is a branch {name!r}") from None
        return Table(self.spark, self.path, name)

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """Rows added and removed between two versions: _change (insert or delete) and the columns.

        Only files that one of the versions lacks are read; rows in both cancel out, copies counted.
        """
        a, b = self._load(since), self._load(self.version if until is None else until)
        before, after = {f["path"] for f in a["files"]}, {f["path"] for f in b["files"]}
        marked = a["deletes"] != b["deletes"]  # then files in both may hold rows in one only
        old = self._read(a | {"columns": b["columns"]}, [f for f in a["files"] if marked or f["path"] not in after])
        new = self._read(b, [f for f in b["files"] if marked or f["path"] not in before])
        added, removed = (new, old) if not marked and not (before - after) else (new.exceptAll(old), old.exceptAll(new))
        return added.withColumn("_change", F.lit("insert")).unionByName(removed.withColumn("_change", F.lit("delete"))).select("_change", *[c["name"] for c in b["columns"]])

    # maintenance

    def row_count(self) -> int:
        return self.df().count() if self.state["deletes"] else sum(f["rows"] for f in self.state["files"])

    def statistics(self) -> dict[str, Any]:
        files = self.state["files"]
        return {"version": self.version, "files": len(files), "rows": self.row_count(), "bytes": sum(f["bytes"] for f in files)}

    def compact(self, target_bytes: int = TARGET_FILE_BYTES) -> int:
        """Rewrite files smaller than half the target together; large ones stay."""
        stale = min((d["version"] for d in self.state["deletes"]), default=0)
        small = [f for f in self.state["files"] if f["bytes"] < target_bytes // 2 or any(f["version"] < d["version"] for d in self.state["deletes"])]
        if len(small) < 2 and not (small and stale):
            return self.version
        n = max(1, -(-sum(f["bytes"] for f in small) // target_bytes))
        return self._rewritten("compact", small, self._read(self.state, small).repartition(n))

    def cluster(self, columns: Sequence[str], curve: str = "z-order", files: int | None = None) -> int:
        """Rewrite all rows along a curve (z-order, hilbert, linear), so that statistics leave out more files.

        There are ``files`` of them, or more where one would hold over ``SORTED_ROWS`` rows, which one task has to sort.
        """
        rows = self.df()
        n = files or max(1, -(-sum(f["bytes"] for f in self.state["files"]) // TARGET_FILE_BYTES))
        n = max(n, -(-sum(f["rows"] for f in self.state["files"]) // SORTED_ROWS))
        if curve == "linear":
            laid = rows.repartitionByRange(n, *columns).sortWithinPartitions(*columns)
        else:
            place = {"z-order": transforms.z_order, "hilbert": transforms.hilbert}[curve](rows, list(columns))
            laid = rows.withColumn("__place", place).repartitionByRange(n, "__place").sortWithinPartitions("__place").drop("__place")
        return self._rewritten(f"cluster by {curve}", self.state["files"], laid)

    def expire(self, keep: int = 1) -> list[int]:
        """Forget all but the last ``keep`` versions and those that branches name; ``vacuum`` then frees their files."""
        held = set(self.versions()[-max(1, keep) :]) | set(self.branches().values()) | {self._latest(b) for b in [None, *self.branches()]} | {self.version}
        gone = [v for v in self.versions() if v not in held]
        for v in gone:
            self.storage.delete(f"_log/{v:020d}.json")
        return gone

    def vacuum(self, older_than_seconds: float = 7 * 86400.0) -> list[str]:
        """Delete data files that no version names and that are old enough not to be part of a running write."""
        named = {f["path"] for v in self.versions() for f in self._load(v)["files"]}
        limit = time.time() - older_than_seconds
        marks = tuple(d["path"] + "/" for v in self.versions() for d in self._load(v)["deletes"])
        gone = [n for n in self.storage.files("data") if n not in named and self.storage.modified(n) <= limit]
        gone += [n for n in self.storage.files("deletes") if not n.startswith(marks or ("\0",)) and self.storage.modified(n) <= limit]
        for n in gone:
            self.storage.delete(n)
        return gone

    def verify(self) -> list[str]:
        """What is wrong with the current version: missing files, sizes or row counts that differ."""
        there = self.storage.files("data")
        wrong = [f"{f['path']} is missing" for f in self.state["files"] if f["path"] not in there]
        wrong += [f"{f['path']} has {there[f['path']]} bytes, not {f['bytes']}" for f in self.state["files"] if there.get(f["path"], f["bytes"]) != f["bytes"]]
        if not wrong and self.df().count() != self.row_count():
            wrong.append("row counts differ")
        return wrong

    # derived structures

    def create_index(self, name: str, kind: str, column: str, **options: Any) -> int:
        """Register a derived structure: bm25 (postings), ivf (vector cells), json (paths and values), graph (sorted distinct edges).

        The scalar kinds (bitmap, composite, bloom, inverted) rest on Parquet: files written from then on have Bloom filters for
        bloom and inverted, and all have statistics. Structures are built for the current version and used only while the
        files are the same, so they never change an answer.
        """
        path = f"index/{name}-{uuid.uuid4().hex[:8]}"
        where = self.storage.full(path)
        key = options.pop("id_col", None) or (self.state["primary_key"] or [self.columns[0]])[0]
        for c in column.split(","):
            self._column(self.state, c)
        if kind == "bm25":
            analyzer = options.get("analyzer", "standard")
            postings(self.df(), key, column, analyzer).hint("rebalance", "term").sortWithinPartitions("term").write.parquet(where)
            options = {"analyzer": analyzer} | corpus_statistics(self.df(), column, analyzer)
        elif kind == "ivf":
            index = IvfIndex.build(self.df(), column, key, where, **options)
            options = {"centroids": index.centroids.tolist()}
        elif kind == "json":
            json_entries(self.df(), key, column).repartition("path").sortWithinPartitions("path", "value").write.parquet(where)
        elif kind == "graph":
            source, target = column.split(",") if "," in column else (column, options["target"])
            self.df().select(F.col(source).cast("long").alias("source"), F.col(target).cast("long").alias("target")).dropna().distinct().repartition("source").sortWithinPartitions("source", "target").write.parquet(where)
        elif kind not in ("bitmap", "bloom", "inverted", "composite"):
            raise ValueError(f"unknown index kind {kind!r}")
        entry = {"kind": kind, "column": column, "id_col": key, "path": path, "options": options}
        return self._commit("create index", lambda s: s | {"indexes": s["indexes"] | {name: entry | {"version": s["version"] + 1}}})

    def _postings(self, column: str, index: str | None, id_col: str, analyzer: str) -> tuple[DataFrame, dict] | None:
        """Postings and corpus statistics of a fresh bm25 index over a column: the one named, or any that fits."""
        for name in [index] if index else list(self.state["indexes"]):
            e = self.index(name)
            if e and e["kind"] == "bm25" and e["column"] == column and e["id_col"] == id_col and e["options"].get("analyzer") == analyzer and "docs" in e["options"]:
                return self.spark.read.parquet(self.storage.full(e["path"])), e["options"]
        return None

    def bm25(self, column: str, query: str, index: str | None = None, id_col: str | None = None, analyzer: str = "standard") -> DataFrame:
        """(id, score): from the postings of the query's terms where an index is fresh, else by a scan; the scores are the same."""
        key = id_col or (self.state["primary_key"] or [self.columns[0]])[0]
        if found := self._postings(column, index, key, analyzer):
            return bm25_of_postings(found[0], found[1], key, query, analyzer)
        return bm25(self.df(), key, column, query, analyzer)

    def keyword_search(self, column: str, query: str, k: int, index: str | None = None, id_col: str | None = None, analyzer: str = "standard") -> DataFrame:
        scores = self.bm25(column, query, index, id_col, analyzer)
        return scores.orderBy(F.col("score").desc(), scores.columns[0]).limit(k)

    def phrase_search(self, column: str, phrase: str, slop: int = 0, index: str | None = None, id_col: str | None = None, analyzer: str = "standard") -> DataFrame:
        """(id, freq): only documents that hold all terms by the index are read again to place them."""
        key = id_col or (self.state["primary_key"] or [self.columns[0]])[0]
        rows = self.df()
        if found := self._postings(column, index, key, analyzer):
            rows = rows.join(documents_of_terms(found[0], key, phrase, analyzer), key, "left_semi")
        return phrase_search(rows, key, column, phrase, slop, analyzer)

    def json_lookup(self, column: str, path: str, value: str, index: str | None = None) -> DataFrame:
        """Rows whose JSON has the value (as JSON text) at a path without wildcards, by a fresh json index or by a scan."""
        entry = self.index(index) if index else None
        if entry and entry["kind"] == "json" and entry["column"] == column:
            ids = self.spark.read.parquet(self.storage.full(entry["path"])).where((F.col("path") == path) & (F.col("value") == value)).select(F.col("id").alias(entry["id_col"])).distinct()
            return self.df().join(ids, entry["id_col"], "left_semi")
        return self.df().where(F.array_contains(json_path_query(F.col(column), path), value))

    def edges(self, index: str | None = None, source: str = "source", target: str = "target") -> DataFrame:
        """(source, target) of an edge table, from a fresh graph index where one is named."""
        entry = self.index(index) if index else None
        if entry and entry["kind"] == "graph":
            return self.spark.read.parquet(self.storage.full(entry["path"]))
        return self.df().select(F.col(source).cast("long").alias("source"), F.col(target).cast("long").alias("target")).dropna()

    def drop_index(self, name: str) -> int:
        if name not in self.state["indexes"]:
            raise ValueError(f"no index {name!r}")
        return self._commit("drop index", lambda s: s | {"indexes": {k: v for k, v in s["indexes"].items() if k != name}})

    def index(self, name: str) -> dict | None:
        """The index if it was built for the rows there are now, else None: then scan."""
        entry = self.state["indexes"].get(name)
        if entry is None:
            return None
        built = self._load(entry["version"]) if entry["version"] in self.versions() else None
        fresh = built is not None and {f["path"] for f in built["files"]} == {f["path"] for f in self.state["files"]}
        return entry if fresh else None

    def vector_search(self, column: str, query: Sequence[float], k: int, index: str | None = None, probes: int = 8, **options: Any) -> DataFrame:
        """Exact unless a fresh ivf index is named."""
        entry = self.index(index) if index else None
        key = (self.state["primary_key"] or [self.columns[0]])[0]
        if entry and entry["kind"] == "ivf":
            ivf = IvfIndex(self.storage.full(entry["path"]), np.array(entry["options"]["centroids"]), column, entry["id_col"])
            return ivf.search(self.spark, list(query), k, probes, **options)
        return knn(self.df(), column, list(query), k, options.pop("id_col", key), **options)
