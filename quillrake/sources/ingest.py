"""Files into tables and tables into files: Parquet, CSV, JSON, ORC and Arrow IPC."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyarrow import ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from .table import Table

FORMATS = ("parquet", "csv", "json", "orc", "ipc")
INFER_ROWS = 100


def _ipc_schema(data: bytes) -> T.StructType:
    return from_arrow_schema(_opened(data).schema)


def _opened(data: bytes):
    source = pa.BufferReader(data)
    return ipc.open_file(source) if data[:6] == b"ARROW1" else ipc.open_stream(source)


def read_files(spark: SparkSession, path: str, format: str, schema: T.StructType | str | None = None, **options: Any) -> DataFrame:
    """Rows of files. Without a schema, CSV and JSON types are inferred from a sample of the first file.

    Arrow IPC files are read whole, one file to a task.
    """
    if format not in FORMATS:
        raise ValueError(f"format is one of {FORMATS}")
    if format == "ipc":
        files = spark.read.format("binaryFile").load(path)
        if schema is None:
            first = files.select("content").first()
            if first is None:
                raise ValueError(f"no files at {path}")
            schema = _ipc_schema(bytes(first[0]))

        def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for data in part.column("content"):
                    reader = _opened(data.as_py())
                    yield from (reader.get_batch(i) for i in range(reader.num_record_batches)) if hasattr(reader, "num_record_batches") else reader

        return files.select("content").repartition(max(1, files.count())).mapInArrow(batches, schema)
    reader = spark.read.options(**options)
    if format == "csv":
        reader = reader.option("header", options.get("header", True))
    if schema is not None:
        return reader.schema(schema).format(format).load(path)
    if format == "csv":
        sample = reader.option("inferSchema", False).csv(path).limit(INFER_ROWS)
        rows = ["\t".join("" if v is None else v.replace("\t", " ").replace("\n", " ") for v in r) for r in sample.collect()]
        names = sample.columns
        inferred = spark.read.option("sep", "\t").option("inferSchema", True).csv(spark.sparkContext.parallelize(rows)).schema if rows else T.StructType([T.StructField(c, T.StringType()) for c in names])
        schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, inferred.fields, strict=True)])
        return reader.schema(schema).csv(path)
    if format == "json":
        lines = spark.read.text(path).limit(INFER_ROWS)
        schema = spark.read.json(lines.rdd.map(lambda r: r[0])).schema
        return reader.schema(schema).json(path)
    return reader.format(format).load(path)


def ingest(table: Table, path: str, format: str, schema: T.StructType | str | None = None, resume: str | None = None, **options: Any) -> int:
    """Append files to a table; returns the version. With ``resume`` (a name) files taken before under that name are left out.

    What has been taken is a property of the table, published in the commit that adds the rows.
    """
    rows = read_files(table.spark, path, format, schema, **options)
    if resume is None:
        return table.append(rows)
    done = set(table.state["properties"].get(f"ingested.{resume}", []))
    files = [f for f in rows.inputFiles() if f not in done] if format != "ipc" else [f for f in table.spark.read.format("binaryFile").load(path).inputFiles() if f not in done]
    if not files:
        return table.version
    for f in files:
        done.add(f)
        table.append(read_files(table.spark, f, format, schema or rows.schema, **options), properties={f"ingested.{resume}": sorted(done)})
    return table.version


def export(df: DataFrame, path: str, format: str = "parquet", mode: str = "error", **options: Any) -> None:
    """Write rows as files; one file for each task."""
    if format == "ipc":
        raise ValueError("Arrow IPC is written with to_arrow() and pyarrow; files at scale are Parquet")
    writer = df.write.mode(mode).options(**options)
    (writer.option("header", options.get("header", True)) if format == "csv" else writer).format(format).save(path)


def to_arrow(df: DataFrame) -> pa.Table:
    return df.toArrow()


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    return spark.createDataFrame(table)


def to_arrow_batches(df: DataFrame) -> Iterator[pa.RecordBatch]:
    """Batches one partition at a time, so that the driver holds one partition and not the result."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sink = pa.BufferOutputStream()
            with ipc.new_stream(sink, b.schema) as out:
                out.write_batch(b)
            yield pa.RecordBatch.from_pydict({"ipc": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    for row in df.mapInArrow(packed, "ipc binary").toLocalIterator():
        yield from ipc.open_stream(bytes(row["ipc"]))
