"""Small driver-side files on any path that Spark's file systems know."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession

from driftwell.operators.checks import require


def place(spark: SparkSession, path: str):
    """The file system of a path, and the path in its terms."""
    require(bool(path), "a path must not be empty")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = place(spark, path)
    return fs.exists(where)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, where = place(spark, path)
    return fs.exists(where) and fs.getFileStatus(where).isFile()


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """Write one file that its owner alone may read; missing folders are made."""
    fs, where = place(spark, path)
    if where.getParent() is not None:
        fs.mkdirs(where.getParent())
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.setPermission(where, spark.sparkContext._jvm.org.apache.hadoop.fs.permission.FsPermission("600"))
    return path


def write_json(spark: SparkSession, path: str, value) -> str:
    return write_text(spark, path, json.dumps(value, indent=2, ensure_ascii=False) + "\n")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: below spark.checkpoint.dir, or on this machine where all tasks run here."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        require(spark.sparkContext.master.startswith("local"), "set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/driftwell-{uuid.uuid4().hex}"


class MemoryStore:
    """Named bytes in the driver's memory, for tests."""

    def __init__(self):
        self._held: dict[str, bytes] = {}

    def put(self, path: str, data: bytes) -> None:
        require(bool(path), "a path must not be empty")
        self._held[path] = bytes(data)

    def get(self, path: str) -> bytes:
        require(bool(path), "a path must not be empty")
        if path not in self._held:
            raise KeyError(f"nothing is stored under {path!r}")
        return self._held[path]

    def exists(self, path: str) -> bool:
        require(bool(path), "a path must not be empty")
        return path in self._held
