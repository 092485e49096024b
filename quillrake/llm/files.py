"""Files that tasks write and read themselves, in the shared folder, on any file system that Arrow opens."""

from __future__ import annotations

from collections.abc import Callable

from pyarrow import fs
from pyspark import TaskContext


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def write_part(folder: str, suffix: str, write: Callable) -> str:
    """Call ``write`` with a stream and publish what it wrote as part-<partition><suffix>; returns the file's URI.

    Each attempt has a file of its own, moved in place when whole: a task that runs again, after an executor is lost
    or beside a slow copy, replaces the file by an equal one.
    """
    task = TaskContext.get()
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    name = f"part-{task.partitionId():06d}"
    trial = f"{path}/.{name}-{task.taskAttemptId()}"
    with system.open_output_stream(trial, compression=None) as out:
        write(out)
    system.move(trial, f"{path}/{name}{suffix}")
    return f"{folder}/{name}{suffix}"
