"""A log-structured index of fingerprints: immutable sorted runs, dealt out by bucket, merged as they are written.

A run is a folder with a file for each bucket: its distinct fingerprints, ascending, eight bytes each. Every run of a log
has the same buckets, so a batch crosses the network once, to its buckets; the task of a bucket merge-joins it with the
same bucket of all older runs while it writes the new one. No run is ever shuffled or sorted again. Files are read and
written in blocks, so memory does not grow with a bucket.

Runs have levels: when ``FAN_IN`` of one level have gathered, each bucket's files are merged into one run of the next level.

What a log holds is named by its last manifest, a small file published by rename under the next number. Runs and batches that no
manifest names (a writer died) are ignored; a second writer that publishes the same number fails. Files of merged runs are
removed only after the manifest that leaves them out.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import opened
from .shared import cut, new_path, remove

FAN_IN = 3
#: Fingerprints of a bucket of a log's first call; and the most buckets.
BUCKET_PRINTS, BUCKETS = 1 << 18, 1 << 14
_BLOCK = 1 << 16


class RunReader:
    """One bucket's file of a run, read forward."""

    def __init__(self, run: str, bucket: int) -> None:
        system, path = opened(f"{run}/bucket-{bucket:05d}")
        try:
            self.stream = system.open_input_stream(path, compression=None)
        except FileNotFoundError:  # a bucket to which nothing was dealt
            self.stream = None
        self.held = np.zeros(0, np.int64)

    def fill(self) -> bool:
        """Read a block if nothing is held; false at the end."""
        if not len(self.held) and self.stream is not None:
            data = self.stream.read(8 * _BLOCK)
            while len(data) % 8 and (more := self.stream.read(8 - len(data) % 8)):  # a store may give less than it is asked for
                data += more
            self.held = np.frombuffer(data, np.int64)
            if not len(self.held):
                self.stream.close()
                self.stream = None
        return len(self.held) > 0

    def among(self, x: np.ndarray) -> np.ndarray:
        """Which of ``x`` (ascending, above all asked before) the run has."""
        found = np.zeros(len(x), bool)
        while self.fill():
            at = np.minimum(np.searchsorted(self.held, x), len(self.held) - 1)
            found |= self.held[at] == x
            if self.held[-1] >= x[-1]:
                self.held = self.held[np.searchsorted(self.held, x[-1], "right") :]
                break
            self.held = self.held[:0]
        return found


class _RunWriter:
    """A bucket's file; published under its name when whole, whichever attempt of the task wrote it."""

    def __init__(self, run: str, bucket: int) -> None:
        self.system, self.folder = opened(run)
        self.system.create_dir(self.folder, recursive=True)
        self.name = f"bucket-{bucket:05d}"
        self.trial = f"{self.folder}/.{self.name}-{TaskContext.get().taskAttemptId()}"
        self.out = self.system.open_output_stream(self.trial, compression=None)

    def close(self) -> None:
        self.out.close()
        self.system.move(self.trial, f"{self.folder}/{self.name}")


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of many documents, each once with 1 or 2 for how often: a frequent one sends a row or so per task."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> pa.RecordBatch:
        prints, times = (np.concatenate(x) for x in zip(*held, strict=True))
        distinct, at = np.unique(prints, return_inverse=True)
        n = np.minimum(np.bincount(at, weights=times, minlength=len(distinct)), 2).astype(np.int8)
        return pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(n)], ["fingerprint", "n"])

    for batch in batches:
        anchors, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("anchors", "times"))
        held.append((anchors.astype(np.int64), times.astype(np.int64)))
        size += len(anchors)
        if size >= 1 << 20:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def _merged(run: str, old: list[str]):
    """Writes a bucket of a run from its sorted rows, and yields those that repeat or that an older run has."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = TaskContext.get().partitionId()
        writer, readers = _RunWriter(run, bucket), [RunReader(r, bucket) for r in old]
        last, last_n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def done(x: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            again = n > 1
            for reader in readers:
                again |= reader.among(x) if len(x) else again
            writer.out.write(x.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(x[again])], ["fingerprint"])

        for batch in batches:
            prints, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("fingerprint", "n"))
            prints, n = np.concatenate([last, prints]), np.concatenate([last_n, n])
            distinct, first = np.unique(prints, return_index=True)
            if len(distinct):
                n = np.add.reduceat(n, first)
                yield done(distinct[:-1], n[:-1])  # the last may go on in the next batch
                last, last_n = distinct[-1:], n[-1:]
        yield done(last, last_n)
        writer.close()

    return merge


def _compacted(run: str, old: list[str]):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket in batch.column("id").to_pylist():
                writer, readers = _RunWriter(run, bucket), [RunReader(r, bucket) for r in old]
                while live := [r for r in readers if r.fill()]:
                    limit = min(r.held[-1] for r in live)
                    parts = []
                    for r in live:
                        k = np.searchsorted(r.held, limit, "right")
                        parts.append(r.held[:k])
                        r.held = r.held[k:]
                    writer.out.write(np.unique(np.concatenate(parts)).tobytes())
                writer.close()
            yield pa.RecordBatch.from_arrays([batch.column("id")], ["id"])

    return merge


class FingerprintLog:
    """Runs of fingerprints and the batches of documents that they are of, in a folder of the shared file system."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fan_in: int = FAN_IN) -> None:
        self.spark, self.folder, self.fan_in = spark, (folder or new_path(spark, "log")).rstrip("/"), fan_in
        self.number, self.buckets = 0, None
        self.runs: list[dict] = []
        self.batches: list[dict] = []
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._system = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self._system.exists(self._path(self.folder)):
            names = [x.getPath().getName() for x in self._system.listStatus(self._path(self.folder))]
            if known := sorted(x for x in names if x.startswith("manifest-")):
                self._read(known[-1])

    def _read(self, name: str) -> None:
        stream = self._system.open(self._path(f"{self.folder}/{name}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        held = json.loads(text)
        self.number, self.buckets, self.runs, self.batches = int(name.rsplit("-", 1)[1]), held["buckets"], held["runs"], held["batches"]

    def _publish(self) -> None:
        trial, name = (self._path(f"{self.folder}/{x}") for x in (f".trial-{uuid.uuid4().hex}", f"manifest-{self.number + 1:08d}"))
        out = self._system.create(trial, False)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "runs": self.runs, "batches": self.batches}).encode()))
        out.close()
        if self._system.exists(name) or not self._system.rename(trial, name):
            raise RuntimeError(f"another writer has published to the log {self.folder}")
        self.number += 1

    def new_batch(self) -> str:
        return f"{self.folder}/batch-{uuid.uuid4().hex}"

    def publish(self, name: str, path: str) -> None:
        """From now on the documents in ``path`` are history; a name that the log has keeps its first documents."""
        if name not in {b["name"] for b in self.batches}:
            self.batches.append({"name": name, "path": path})
            self._publish()

    def size_for(self, prints: DataFrame) -> None:
        """Settle the number of buckets by the first documents (anchors) that the log gets."""
        if self.buckets is None:
            n = prints.agg(F.sum(F.size("anchors"))).first()[0] or 0
            self.buckets = max(8, min(BUCKETS, -(-n // BUCKET_PRINTS)))

    def append(self, prints: DataFrame) -> DataFrame:
        """Add the fingerprints of documents (anchors, times) as a run; returns those that occur again, in them or in history."""
        self.size_for(prints)
        run = f"{self.folder}/run-{uuid.uuid4().hex}"
        rows = prints.select("anchors", "times").mapInArrow(_tallied, "fingerprint long, n byte")
        dealt = rows.repartitionById(self.buckets, F.pmod(F.hash("fingerprint"), F.lit(self.buckets))).sortWithinPartitions("fingerprint")
        again, _ = cut(dealt.mapInArrow(_merged(run, [r["path"] for r in self.runs]), "fingerprint long"), "again")
        self.runs.append({"path": run, "level": 0})
        self._publish()
        self._compact()
        return again

    def _compact(self) -> None:
        level = 0
        while len(old := [r for r in self.runs if r["level"] == level]) >= self.fan_in:
            run = f"{self.folder}/run-{uuid.uuid4().hex}"
            paths = [r["path"] for r in old]
            self.spark.range(0, self.buckets, 1, self.buckets).mapInArrow(_compacted(run, paths), "id long").write.format("noop").mode("overwrite").save()
            self.runs = [r for r in self.runs if r["level"] != level] + [{"path": run, "level": level + 1}]
            self._publish()
            for p in paths:
                remove(self.spark, p)
            level += 1
