"""Files wherever they lie: by Hadoop's file systems on the driver, by Arrow's (or plainly, for local paths) in tasks."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import SparkSession

#: Schemes that Arrow knows under another name.
_ALIASES = {"s3a": "s3", "s3n": "s3"}


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _hadoop(spark, path)
    return system.exists(at)


def file_state(spark: SparkSession, path: str) -> tuple[str, int, int]:
    """A file's full path, size and time of change."""
    system, at = _hadoop(spark, path)
    status = system.getFileStatus(at)
    return status.getPath().toString(), status.getLen(), status.getModificationTime()


def scheme(path: str) -> str:
    """A path's scheme, file if it has none."""
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]+):", path)
    return found[1].lower() if found else "file"


def absolute(path: str) -> str:
    """A path that means the same in every process: local ones without a scheme, others as they are."""
    return os.path.abspath(re.sub(r"^file:(//(?=/))?", "", path)) if scheme(path) == "file" else path


def open_binary(path: str) -> BinaryIO:
    """A seekable stream. Local paths must be open to every executor; others need a scheme that Arrow has a file system for."""
    if scheme(path) == "file":
        return open(absolute(path), "rb")
    system, at = arrow_system(path)
    return system.open_input_file(at)


def arrow_system(path: str):
    """Arrow's file system of a path with a scheme, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(_ALIASES.get(scheme(path), scheme(path)) + path[path.index(":") :])


def shared_folder(spark: SparkSession, label: str) -> str:
    """A path for a new file or folder where driver and executors see it: in spark.checkpoint.dir, or on one machine in a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="allelia-")
    path = f"{absolute(str(found).rstrip('/'))}/allelia-{label}-{uuid.uuid4().hex}"
    atexit.register(forget, spark, path)
    return path


def forget(spark: SparkSession, path: str) -> None:
    """Deletes what shared_folder named, and files whose names begin so, while the session lives."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    system, at = _hadoop(spark, f"{path}*")
    for status in system.globStatus(at) or ():
        system.delete(status.getPath(), True)


@contextlib.contextmanager
def replacing(path: str) -> Iterator[BinaryIO]:
    """A stream to a hidden name beside path, which takes its place at the end; after an error nothing is left."""
    folder, _, name = absolute(path).rpartition("/")
    part = f"{folder}/.{name}.{uuid.uuid4().hex}.partial"
    if scheme(path) == "file":
        os.makedirs(folder or "/", exist_ok=True)
        try:
            with open(part, "wb") as out:
                yield out
            os.replace(part, absolute(path))
        finally:
            with contextlib.suppress(FileNotFoundError):
                os.remove(part)
        return
    system, at = arrow_system(part)
    with system.open_output_stream(at) as out:
        yield out
    system.move(at, f"{at.rpartition('/')[0]}/{name}")
