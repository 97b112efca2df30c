"""Files of our own formats in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (local, HDFS, S3, GCS) and the path in it."""
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> str:
    system, path = open_folder(uri)
    system.create_dir(path, recursive=True)
    return uri.rstrip("/")


def task_file(prefix: str) -> str:
    """A name no other attempt of this task uses: a file counts only once a manifest, which
    Spark commits with the task, has its name; what lost or repeated attempts left is never read."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"{prefix}-{context.partitionId() if context else 0:06d}-{uuid.uuid4().hex}"
