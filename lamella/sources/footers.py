"""File metadata as DataFrames: one row per file, row group or column chunk, read from footers in parallel on the executors."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHUNKS = "file string, row_group int, rg_rows long, rg_bytes long, column_id int, path string, physical_type string, logical_type string, codec string, encodings string, n_values long, null_count long, min_value string, max_value string, has_dictionary boolean, compressed long, uncompressed long, first_row long, has_bloom boolean"
FILES = "file string, n_rows long, n_row_groups int, n_columns int, created_by string, version string, footer_bytes long, file_bytes long, key_values string, columns string"


def open_file(uri: str):
    """A random-access file behind any URI that pyarrow can open, and its size."""
    if uri.startswith("file:/"):
        fs, path = pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    elif "://" in uri:
        fs, path = pafs.FileSystem.from_uri(uri)
    else:
        fs, path = pafs.LocalFileSystem(), uri
    return fs.open_input_file(path)


def list_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """file and file_bytes of the data files under a path; names that start with _ or . are hidden. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("file_bytes"))


def _per_file(spark: SparkSession, path: str, rows, schema: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split()[0] for c in schema.split(",")]
        for frame in frames:
            for uri, size in zip(frame["file"], frame["file_bytes"], strict=True):
                with open_file(uri) as f:
                    yield pd.DataFrame(rows(uri, size, pq.ParquetFile(f)), columns=names)

    return list_files(spark, path, recursive=True).mapInPandas(run, schema)


def each_file(spark: SparkSession, path: str, rows, schema: str) -> DataFrame:
    """What rows(uri, file, parquet file) yields for each file under a path, read in parallel on the executors."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uri in frame["file"]:
                with open_file(uri) as f:
                    yield pd.DataFrame(list(rows(uri, f, pq.ParquetFile(f))), columns=names, dtype=object)

    return list_files(spark, path, True).mapInPandas(run, schema)


def _text(v) -> str | None:
    return None if v is None else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v).lower() if isinstance(v, bool) else str(v)


def _chunks(uri: str, size: int, f: pq.ParquetFile):
    meta, before = f.metadata, 0
    for g in range(meta.num_row_groups):
        rg = meta.row_group(g)
        for k in range(rg.num_columns):
            c = rg.column(k)
            s = c.statistics if c.is_stats_set else None
            bounds = (s.min, s.max) if s is not None and s.has_min_max else (None, None)
            logical = str(f.schema.column(k).logical_type)
            nulls = s.null_count if s is not None and s.has_null_count else None
            yield (uri, g, rg.num_rows, rg.total_byte_size, k, c.path_in_schema, c.physical_type, logical, c.compression, ",".join(sorted(c.encodings)), c.num_values, nulls, _text(bounds[0]), _text(bounds[1]), c.has_dictionary_page, c.total_compressed_size, c.total_uncompressed_size, before, getattr(c, "bloom_filter_offset", None) is not None)
        before += rg.num_rows


def _files(uri: str, size: int, f: pq.ParquetFile):
    m = f.metadata
    pairs = {k.decode(): v.decode("utf-8", "replace") for k, v in (m.metadata or {}).items()}
    columns = [{"path": f.schema.column(k).path, "type": f.schema.column(k).physical_type, "logical": str(f.schema.column(k).logical_type), "d": f.schema.column(k).max_definition_level, "r": f.schema.column(k).max_repetition_level} for k in range(m.num_columns)]
    yield (uri, m.num_rows, m.num_row_groups, m.num_columns, m.created_by, m.format_version, m.serialized_size, size, json.dumps(pairs, sort_keys=True), json.dumps(columns))


def chunk_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A row per column chunk of every file under path; see CHUNKS. Bounds are text; null where the footer has none."""
    return _per_file(spark, path, lambda *a: list(_chunks(*a)), CHUNKS)


def file_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A row per file; see FILES. key_values and columns are JSON."""
    return _per_file(spark, path, lambda *a: list(_files(*a)), FILES)


def row_groups(spark: SparkSession, path: str, *, start: int | None = None, end: int | None = None, ordinals: list[int] | None = None) -> DataFrame:
    """file, row_group, first_row, rg_rows, rg_bytes, middle. With start and end only groups whose middle byte falls in the range; with ordinals only those."""

    def rows(uri: str, size: int, f: pq.ParquetFile):
        before = 0
        for g in range(f.metadata.num_row_groups):
            rg = f.metadata.row_group(g)
            first = min((c.dictionary_page_offset if c.has_dictionary_page else c.data_page_offset) for c in map(rg.column, range(rg.num_columns)))
            packed = sum(rg.column(k).total_compressed_size for k in range(rg.num_columns))
            yield (uri, g, before, rg.num_rows, rg.total_byte_size, first + packed // 2)
            before += rg.num_rows

    out = _per_file(spark, path, lambda *a: list(rows(*a)), "file string, row_group int, first_row long, rg_rows long, rg_bytes long, middle long")
    if start is not None:
        out = out.where(F.col("middle") >= start)
    if end is not None:
        out = out.where(F.col("middle") < end)
    return out if ordinals is None else out.where(F.col("row_group").isin(ordinals))


def starts(groups: DataFrame) -> DataFrame:
    """file, groups_before and rows_before from the row groups of a table (file, row_group, rg_rows): what the files before it in order of path hold."""
    sizes = groups.groupBy("file").agg(F.countDistinct("row_group").alias("g"), F.sum("rg_rows").alias("n"))
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)  # a row per file
    return sizes.select("file", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(name) for c, name in (("g", "groups_before"), ("n", "rows_before"))))


def through_files(groups: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """groups (file, row_group and others; first_row if there is one) with ordinals and first rows that count on through the table's files in order of path;
    number is the ordinal, row_group stays that in the file. every has all row groups of the table where groups has not."""
    d = groups.join(F.broadcast(starts(groups if every is None else every)), "file").withColumn("number", (F.col("groups_before") + F.col("row_group")).cast("int"))
    if "first_row" in groups.columns:
        d = d.withColumn("table_row", F.col("rows_before") + F.col("first_row"))
    return d.drop("groups_before", "rows_before")


def metadata_count(spark: SparkSession, path: str) -> DataFrame:
    """file and n_rows from footers alone."""
    return file_catalog(spark, path).select("file", "n_rows")


SUMMARY = "file string, row_group int, first_row long, rg_rows long, path string, kind string, n_values long, null_count long, low binary, high binary"


def summary(spark: SparkSession, path: str) -> DataFrame:
    """A row per column chunk with what planning needs: place, type and statistics; bounds as the plain bytes of the footer."""
    from .chunks import row_group_chunks

    def rows(uri: str, f, meta):
        before = 0
        for g, chunks in enumerate(row_group_chunks(f, meta, None)):
            n = meta.metadata.row_group(g).num_rows
            for name, c in chunks.items():
                yield uri, g, before, n, name, c.kind.to_json(), c.bounds.n, c.bounds.nulls, c.low, c.high
            before += n

    return each_file(spark, path, rows, SUMMARY)


def save_summary(catalog: DataFrame, to: str) -> None:
    """Keep a catalog or summary, so that later plans prune without opening files: the summary of a folder."""
    catalog.write.mode("overwrite").parquet(to)


def merge_summaries(*parts: DataFrame) -> DataFrame:
    """The summary of several folders; one that has a file already may be given again."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["file", "row_group", "path"])


#: Rows of a batch that a row group is read in.
BATCH = 65_536

#: Rows of the row groups that a task opens a file for; one of more rows is read alone.
RUN = 1 << 19


def read_row_groups(spark: SparkSession, path: str | tuple[str, ...], chosen: DataFrame, *, names: list[str] | None = None, ordinal: str | None = None, number: str = "row_group") -> DataFrame:
    """The rows of chosen row groups (file, row_group) of the tables at path: tasks open these alone and read the columns asked for.

    Columns that a file lacks are null. With ordinal a column of that name tells each row's row group, by the column number of chosen. Row groups
    of a file are read in runs of up to RUN rows where chosen has first_row, so that a footer is read once a run; else each by itself.
    """
    paths = (path,) if isinstance(path, str) else path
    schema = spark.read.parquet(*paths).schema
    if names is not None:
        schema = T.StructType([schema[n] for n in names])
    out = T.StructType([*schema.fields, T.StructField(ordinal, T.IntegerType())]) if ordinal else schema
    arrow = to_arrow_schema(schema)
    tasks = spark.sparkContext.defaultParallelism * 4
    place = F.floor(F.col("first_row") / RUN) if "first_row" in chosen.columns else F.col("row_group")
    runs = chosen.select("file", "row_group", F.col(number).cast("int").alias("number"), place.alias("run"))

    def read(uri: str, groups: list[int], numbers: list[int]) -> Iterator[pa.RecordBatch]:
        with open_file(uri) as f:
            p = pq.ParquetFile(f)
            there = set(p.schema_arrow.names)
            sizes = [p.metadata.row_group(g).num_rows for g in groups]
            told, at = np.repeat(np.array(numbers, np.int32), sizes), 0
            for part in p.iter_batches(BATCH, row_groups=groups, columns=[n for n in arrow.names if n in there]):
                columns = [fitted(part.column(n), arrow.field(n).type) if n in there else pa.nulls(part.num_rows, arrow.field(n).type) for n in arrow.names]
                if ordinal:
                    columns.append(pa.array(told[at : at + part.num_rows]))
                at += part.num_rows
                yield pa.RecordBatch.from_arrays(columns, [*arrow.names, *([ordinal] if ordinal else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, groups, numbers = None, [], []
        for b in batches:
            for uri, g, number, r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last is not None and last != (uri, r):
                    yield from read(last[0], groups, numbers)
                    groups, numbers = [], []
                last = (uri, r)
                groups.append(g)
                numbers.append(number)
        if last is not None:
            yield from read(last[0], groups, numbers)

    return runs.repartition(tasks, "file", "run").sortWithinPartitions("file", "run", "row_group").mapInArrow(run, out)


def fitted(column: pa.Array, kind: pa.DataType) -> pa.Array:
    """A column as read from a file, in the type that the session has for it; instants that the file leaves without a zone are UTC."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if pa.types.is_timestamp(column.type) and pa.types.is_timestamp(kind) and column.type.tz is None and kind.tz is not None:
        column = column.cast(pa.timestamp(column.type.unit, "UTC"), safe=False)
    return column.cast(kind, safe=False)


def rows_between(uri: str, first: int, n: int, names: list[str]) -> list[pa.ChunkedArray]:
    """Columns of n rows of a file from one on; only the row groups that hold them are read."""
    with open_file(uri) as f:
        p = pq.ParquetFile(f)
        start, groups, skip = 0, [], 0
        for g in range(p.metadata.num_row_groups):
            size = p.metadata.row_group(g).num_rows
            if start < first + n and start + size > first:
                skip = skip if groups else first - start
                groups.append(g)
            start += size
        t = p.read_row_groups(groups, columns=names)
        return [t.column(c).slice(skip, n) for c in names]


def read_row_group(spark: SparkSession, path: str, ordinals: list[int]) -> DataFrame:
    """The rows of the row groups with these ordinals in their files; other groups are not read."""
    return read_row_groups(spark, path, row_groups(spark, path, ordinals=ordinals))


def with_row_group(spark: SparkSession, path: str, name: str = "row_group", *, through: bool = False) -> DataFrame:
    """The rows of a table with the ordinal of each one's row group in its file, or with through in the table, its files in order of path."""
    groups = row_groups(spark, path)
    if through:
        return read_row_groups(spark, path, through_files(groups), ordinal=name, number="number")
    return read_row_groups(spark, path, groups, ordinal=name)


def sniff(spark: SparkSession, path: str) -> DataFrame:
    """file and format (PARQUET, AVRO or TEXT) by the first bytes of each file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kinds = []
            for uri in frame["file"]:
                with open_file(uri) as f:
                    head = f.read(4)
                kinds.append("PARQUET" if head == b"PAR1" else "AVRO" if head == b"Obj\x01" else "TEXT")
            yield pd.DataFrame({"file": frame["file"], "format": kinds})

    return list_files(spark, path, recursive=True).mapInPandas(run, "file string, format string")
