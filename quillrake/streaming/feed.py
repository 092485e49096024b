"""Change feeds of versioned tables: bounded polls, and Structured Streaming over the log."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillrake.sources.table import Table


def poll_events(table: Table, where: str | None = None, max_events: int = 100, timeout_ms: int = 1000, since: int | None = None) -> DataFrame:
    """(version, event_type, rows): what happened after ``since``, by default now; waits up to the timeout for a first event."""
    start = table.refresh().version if since is None else since
    ends = time.monotonic() + timeout_ms / 1000
    while True:
        fresh = [v for v in table.versions() if v > start][:max_events]
        if fresh or time.monotonic() >= ends:
            break
        time.sleep(min(0.05, timeout_ms / 1000))
    rows = []
    for v in fresh:
        state = table._load(v)
        if where:
            n = table.changes(state["parent"], v).where(where).count()
        else:
            n = abs(sum(f["rows"] for f in state["files"]) - sum(f["rows"] for f in table._load(state["parent"])["files"]))
        if n or not where:
            rows.append((v, "batch" if state["operation"] == "append" else "commit", n))
    return table.spark.createDataFrame(rows, "version long, event_type string, rows long")


def subscribe(table: Table, since: int | None = None, where: Column | str | None = None) -> Iterator[tuple[int, DataFrame]]:
    """(version, its changes) of every version after ``since`` there is now; call again for later ones."""
    at = table.refresh().version if since is None else since
    for v in [v for v in table.versions() if v > at]:
        rows = table.changes(at, v)
        yield v, rows.where(where) if where is not None else rows
        at = v


_LOG = "version long, parent long, operation string, branch string, files array<struct<path: string, version: long>>"


def stream_appends(table: Table) -> DataFrame:
    """A stream of the rows that commits append to a table's branch, from its first version on.

    The stream follows the log: each version file, which appears whole, names the files that its commit added. So files of a write
    that was never committed are not read, and rows that compaction, clustering, updates or deletes write again do not come again.
    """
    state, spark = table.state, table.spark
    kinds = T.StructType([T.StructField(c["name"], table._type(c), True) for c in state["columns"]])
    names = [(c["physical"], c["name"]) for c in state["columns"]]
    log = spark.readStream.schema(_LOG).option("pathGlobFilter", "*.json").json(table.storage.full("_log"))
    log = log.where((F.col("operation") == "append") & F.col("branch").eqNullSafe(F.lit(table.ref)))
    added = log.select(F.explode(F.filter("files", lambda f: f.version > F.col("parent"))).alias("f")).select("f.path")
    return added.mapInArrow(_rows_of(table.storage.root, names, to_arrow_schema(kinds)), kinds)


def _rows_of(root: str, names: list[tuple[str, str]], schema: pa.Schema):
    """Reads the Parquet files that rows name, a batch at a time; columns that a file lacks are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            for path in batch.column("path").to_pylist():
                uri = path if "://" in path or path.startswith("/") else f"{root}/{path}"
                system, inside = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
                with system.open_input_file(inside) as source:
                    for part in pq.ParquetFile(source, coerce_int96_timestamp_unit="us").iter_batches(columns=[p for p, _ in names]):
                        there = set(part.schema.names)
                        columns = [part.column(p).cast(schema.field(n).type) if p in there else pa.nulls(part.num_rows, schema.field(n).type) for p, n in names]
                        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def sink(table: Table, checkpoint: str, stream: DataFrame, keys: list[str] | None = None, name: str = "sink", transform: Callable[[DataFrame], DataFrame] | None = None):
    """Write a stream into a table, every batch once: the last batch written is a property in the commit that holds it.

    With ``keys`` batches are merged, else appended. Returns the query's writer, ready to start.
    """
    mark = f"stream.{name}"

    def write(batch: DataFrame, number: int) -> None:
        if int(table.refresh().state["properties"].get(mark, -1)) >= number:
            return
        rows = transform(batch) if transform else batch
        commit = table._commit

        def marked(operation: str, change, retry: bool = False) -> int:
            def with_mark(s: dict) -> dict:
                s = change(s)
                return s | {"properties": s["properties"] | {mark: number}}

            return commit(operation, with_mark, retry)

        table._commit = marked
        try:
            table.upsert(rows, keys) if keys else table.append(rows)
        finally:
            table._commit = commit

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
