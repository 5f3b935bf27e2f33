"""Intermediate tables in the folder that all executors and the driver share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on one machine (tests) a temporary one where the session has none."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors and the driver share")
        sc.setCheckpointDir(at := tempfile.mkdtemp(prefix="quantweft-"))
    return at


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder; what is there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: read as often as needed, computed once."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete() -> None:
    for path in _written:
        # a store that Arrow does not know, or a folder that is gone: left to whoever clears the shared folder
        with suppress(OSError, pa.ArrowException):
            fs, at = FileSystem.from_uri(path)
            fs.delete_dir(at)


atexit.register(_delete)
