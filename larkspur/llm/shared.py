"""The folder that driver and executors share, and what is written there."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from larkspur.scratch import scratch_dir as shared_dir

__all__ = ["discard", "get_bytes", "map_array", "materialize", "prepare", "put_arrays", "put_bytes", "release", "shared_dir", "ship"]


def materialize(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def discard(spark: SparkSession, uri: str) -> None:
    """Removes a table that nothing needs any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished phases."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _split(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path. Hadoop's names of S3 stand for the one that Arrow knows."""
    if uri.startswith(("file:", "/")):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    scheme, _, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")


def put_bytes(uri: str, data: bytes) -> None:
    """Writes under another name, then renames: a task that runs twice leaves one whole file."""
    store, path = _split(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, path)


def get_bytes(uri: str) -> bytes:
    store, path = _split(uri)
    with store.open_input_stream(path) as f:
        return f.read()


def put_arrays(uri: str, **arrays: np.ndarray) -> None:
    for name, x in arrays.items():
        put_bytes(f"{uri}.{name}", np.ascontiguousarray(x).tobytes())


def map_array(uri: str, dtype: type) -> np.ndarray:
    """Memory-mapped. A file in a store that cannot be mapped is read through an unlinked local copy: a cache of this process,
    which nobody else is to find."""
    store, path = _split(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    with tempfile.TemporaryFile() as local, store.open_input_stream(path) as f:
        while piece := f.read(1 << 24):
            local.write(piece)
        local.flush()
        return np.memmap(local, dtype, "r") if local.tell() else np.zeros(0, dtype)


def prepare(spark: SparkSession) -> None:
    """Session settings of these operators: Arrow batches of few rows and bytes, as texts may be long. For the session's later
    queries, too, these are only smaller batches."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors where their Python would not find it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sc = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == root or getattr(sc, "_larkspur_shipped", False):
        return
    with tempfile.TemporaryDirectory() as d:
        sc.addPyFile(shutil.make_archive(os.path.join(d, "larkspur_package"), "zip", root, "larkspur"))
        sc._larkspur_shipped = True
