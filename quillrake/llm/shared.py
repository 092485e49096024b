"""Helpers of the training-data operators: durable cuts of a plan and distributed connected components."""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _own_folder() -> str:
    """Used only where the session names no shared folder, as in tests on one machine."""
    path = tempfile.mkdtemp(prefix="quillrake-")
    atexit.register(shutil.rmtree, path, True)
    return f"file://{path}"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or _own_folder()).rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/quillrake/{tag}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it again.

    It cuts the lineage, survives the loss of any executor, and forgets the partitioning, so a later join
    shuffles both sides and adaptive execution can split its hot keys.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def ship_modules(spark: SparkSession, folder: str) -> None:
    """Let Python workers of this session import the package from ``folder``."""
    env = spark.sparkContext.environment
    if folder not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH"), folder) if x)


def release() -> None:
    """Give memory back to the system that this worker has freed, or that the encoder of another stage holds; stages share workers, which keep it otherwise."""
    if tokens := sys.modules.get(f"{__package__}.tokens"):
        tokens.encoder.cache_clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``most`` bytes of text, one row at least."""
    for batch in batches:
        at, size = 0, 0
        lengths = pc.binary_length(batch.column(column)).to_pylist()
        for i, n in enumerate(lengths):
            size += n or 0
            if size >= most:
                yield batch.slice(at, i + 1 - at)
                at, size = i + 1, 0
        if at < len(lengths):
            yield batch.slice(at)


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, self.find(x)) for x in list(self.parent) if self.find(x) != x]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as stars, which keep its components with fewer edges."""
    forest = Forest()
    for b in batches:
        for hi, lo in zip(b.column("hi").to_pylist(), b.column("lo").to_pylist(), strict=True):
            forest.join(hi, lo)
    edges = forest.edges()
    yield pa.RecordBatch.from_pydict({"hi": pa.array([e[0] for e in edges], pa.int64()), "lo": pa.array([e[1] for e in edges], pa.int64())})


def _joined_min(edges: DataFrame, key: str, salts: int = 8) -> DataFrame:
    """Each edge with ``low``, the least other end among the edges of ``key``; a hub's edges spread over salts."""
    other = "lo" if key == "hi" else "m"
    mins = edges.groupBy(key).agg(F.min(other).alias("low")).withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return edges.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(salts)).cast("int")).join(mins, [key, "salt"])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node on an edge whose root, the smallest node it reaches, is not itself.

    Alternating large-star and small-star rounds (Kiveris et al. 2014), each written to the shared folder, until
    nothing changes. Nothing is gathered on the driver but two sums a round. Null ends and loops are ignored.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).cast("long").alias("hi"), F.least(a, b).cast("long").alias("lo"))
    e = e.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") != F.col("lo")))
    e, path = cut(e.mapInArrow(_contract, "hi long, lo long"), "stars")
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == state:
            break
        state = now
        both = e.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(e.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        large = _joined_min(both, "n").where("m > n").select(F.col("m").alias("hi"), F.least("n", "low").alias("lo")).distinct()
        large, mid = cut(large, "stars")
        small = _joined_min(large, "hi").select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("low").alias("lo")), F.struct("hi", F.col("low").alias("lo")))).alias("x"))
        small = small.select("x.hi", "x.lo").where("hi > lo").distinct()
        old = (path, mid)
        e, path = cut(small, "stars")
        for p in old:
            remove(spark, p)
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
