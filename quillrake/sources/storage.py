"""Small files of metadata on any file system that Spark reaches."""

from __future__ import annotations

import json
import os
import uuid
from typing import Any

from pyspark.sql import SparkSession


class AlreadyThere(Exception):
    """Another writer published the same version first."""


class Storage:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        path = self._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.local = self._fs.getUri().getScheme() == "file"

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def full(self, name: str) -> str:
        return name if "://" in name or name.startswith("/") else f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return bool(self._fs.exists(self._path(name)))

    def names(self, folder: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(folder))) if self.exists(folder) else []

    def files(self, folder: str) -> dict[str, int]:
        """Name under the root to bytes, of all files below a folder."""
        out: dict[str, int] = {}
        if not self.exists(folder):
            return out
        base = self._fs.makeQualified(self._path("")).toUri().getPath().rstrip("/") + "/"
        found = self._fs.listFiles(self._path(folder), True)
        while found.hasNext():
            f = found.next()
            out[f.getPath().toUri().getPath().removeprefix(base)] = f.getLen()
        return out

    def modified(self, name: str) -> float:
        return self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def read(self, name: str) -> Any:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def publish(self, name: str, content: Any) -> None:
        """Write a file that must not exist yet; of two writers one gets ``AlreadyThere``."""
        data = json.dumps(content).encode()
        if self.local:  # a link is made or fails as a whole; Hadoop's local create looks first and then writes
            to = self._path(name).toUri().getPath()
            os.makedirs(os.path.dirname(to), exist_ok=True)
            trial = f"{to}.{uuid.uuid4().hex}"
            with open(trial, "wb") as f:
                f.write(data)
            try:
                os.link(trial, to)
            except FileExistsError:
                raise AlreadyThere(name) from None
            finally:
                os.unlink(trial)
            return
        if self.exists(name):
            raise AlreadyThere(name)
        trial = f"{name}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(trial), False)
        stream.write(bytearray(data))
        stream.close()
        if not self._fs.rename(self._path(trial), self._path(name)):  # fails if the name is taken
            self._fs.delete(self._path(trial), False)
            raise AlreadyThere(name)

    def replace(self, name: str, content: Any) -> None:
        stream = self._fs.create(self._path(name), True)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
