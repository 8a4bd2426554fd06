"""What several operators share: the shared folder, lineage cuts, file access by URI and free column names."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's; a temporary one where neither is set (local mode)."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and base is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(base or f"file://{tempfile.mkdtemp(prefix='lamella-')}")
    return (base or sc.getCheckpointDir()).rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    """The URI of a new folder under the shared one."""
    base = shared_dir(spark)
    uri = f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/lamella-{what}-{uuid.uuid4().hex[:12]}"
    fs, path = opened(uri)
    fs.create_dir(path, recursive=True)
    _made.append(uri)
    return uri


_made: list[str] = []


def _forget() -> None:
    for uri in _made:
        with contextlib.suppress(OSError):
            fs, path = opened(uri)
            fs.delete_dir(path)


atexit.register(_forget)


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and kept as Parquet in the shared folder until the driver ends; its lineage ends there, so a lost executor costs nothing made before it."""
    uri = fresh_dir(df.sparkSession, "table")
    df.write.mode("overwrite").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def forget(df: DataFrame) -> None:
    """Delete the files of a table from stored() that nothing will read again."""
    for uri in [u for u in _made if any(f"/{u.rsplit('/', 1)[1]}/" in f for f in df.inputFiles()[:1])]:
        _made.remove(uri)
        with contextlib.suppress(OSError):
            fs, path = opened(uri)
            fs.delete_dir(path)


def opened(uri: str):
    """(file system, path) of a URI; works for every store that pyarrow knows."""
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
