"""Folders of files that tasks write by themselves."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame


def opened(path: str):
    """(file system, path) of a URI or a plain path."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def write_parts(df: DataFrame, path: str, suffix: str, write: Callable[[Iterator[pa.RecordBatch], object], int]) -> int:
    """A new folder with a file a partition of df, each by write(batches, stream), which returns its records; returns their number.

    Names follow the order of partitions. A task that is tried again writes another file, and only files of tasks that ended well are moved into the folder.
    """
    fs, target = opened(path.rstrip("/"))
    if fs.get_file_info(target).type != pafs.FileType.NotFound:
        raise FileExistsError(path)
    aside = f"_part-{uuid.uuid4().hex}"
    fs.create_dir(f"{target}/{aside}", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}{suffix}"
        own, folder = opened(path.rstrip("/"))
        with own.open_output_stream(f"{folder}/{aside}/{name}") as out:
            n = write(batches, out)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["name", "n"])

    made = df.mapInArrow(run, "name string, n long").collect()  # a line per file
    for r in made:
        fs.move(f"{target}/{aside}/{r['name']}", f"{target}/{r['name']}")
    fs.delete_dir(f"{target}/{aside}")
    return sum(r["n"] for r in made)
