"""Readers and writers with the format's own options, built step by step."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.predicates import Predicate, PredicateError, apply_filter, columns, compile_predicate, type_of
from ..operators.projection import project, select_globs, select_paths, with_missing
from ..operators.rewrite import with_position
from .avro import read_avro
from .footers import file_catalog, fitted, list_files, read_row_groups, row_groups, rows_between

#: Levels of filtering and the session setting of each; the record level is the Spark filter itself.
LEVELS = {"statistics": "parquet.filter.stats.enabled", "dictionary": "parquet.filter.dictionary.enabled", "bloom": "parquet.filter.bloom.enabled", "column_index": "parquet.filter.columnindex.enabled"}


@dataclass(frozen=True)
class Reader:
    """A scan: ``Reader(spark, path).where(p).paths("a.b").read()``. Each step gives a new reader."""

    spark: SparkSession
    path: str | tuple[str, ...]
    predicate: Predicate | None = None
    schema: T.StructType | None = None
    wanted_paths: tuple[str, ...] = ()
    wanted_globs: tuple[str, ...] = ()
    byte_range: tuple[int, int] | None = None
    record_filter: bool = True
    row_index: bool = False
    recursive: bool = False
    options: dict[str, str] = field(default_factory=dict)
    hooks: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    rule: Callable[[DataFrame], Column] | None = None

    def where_columns(self, rule: Callable[[DataFrame], Column]) -> Reader:
        """Filter by column functions (see predicates.column_filter), the older style; a scan takes one style or the other."""
        if self.predicate is not None or self.rule is not None:
            raise PredicateError("a scan takes one filter: a predicate or column functions")
        return replace(self, rule=rule)

    def where(self, p: Predicate | None) -> Reader:
        """Filter by a predicate, besides those given before; None filters nothing."""
        if p is None:
            return self
        if self.rule is not None:
            raise PredicateError("a scan takes one filter: a predicate or column functions")
        return replace(self, predicate=p if self.predicate is None else self.predicate & p)

    def with_schema(self, schema: T.StructType) -> Reader:
        """Project to a schema; fields that files lack read as null."""
        return replace(self, schema=schema)

    def paths(self, *paths: str) -> Reader:
        return replace(self, wanted_paths=paths)

    def globs(self, *globs: str) -> Reader:
        return replace(self, wanted_globs=globs)

    def between(self, start: int, end: int) -> Reader:
        """Only row groups whose middle byte lies in [start, end)."""
        return replace(self, byte_range=(start, end))

    def option(self, key: str, value: str) -> Reader:
        return replace(self, options={**self.options, key: str(value)})

    def via(self, hook: Callable[[DataFrame], DataFrame]) -> Reader:
        """Pass what is read through a function, after filters and projections: it sees the schema and decides on records."""
        return replace(self, hooks=(*self.hooks, hook))

    def use(self, level: str, on: bool) -> Reader:
        """Turn a level of filtering on or off; results stay the same unless the record level goes."""
        if level == "record":
            return replace(self, record_filter=on)
        return self.option(LEVELS[level], str(on).lower())

    def read(self) -> DataFrame:
        paths = (self.path,) if isinstance(self.path, str) else self.path
        df = self.spark.read.options(**self.options).option("recursiveFileLookup", str(self.recursive).lower()).parquet(*paths)
        if self.byte_range:
            chosen = reduce(DataFrame.unionAll, (row_groups(self.spark, p, start=self.byte_range[0], end=self.byte_range[1]).select("file", "row_group", "first_row") for p in paths))
            df = read_row_groups(self.spark, paths, chosen)
        elif self.row_index:
            df = df.select("*", F.col("_metadata.row_index").alias("row_index"))
        if self.predicate is not None and self.record_filter:
            df = apply_filter(df, self.predicate)
        if self.rule is not None and self.record_filter:
            df = df.where(self.rule(df))
        if self.schema is not None:
            df = with_missing(df, self.schema) if set(self.schema.names) - set(df.columns) else project(df, self.schema)
        if self.wanted_paths:
            df = select_paths(df, *self.wanted_paths)
        df = select_globs(df, *self.wanted_globs) if self.wanted_globs else df
        return reduce(lambda d, hook: hook(d), self.hooks, df)


def missing_columns(df: DataFrame, p: Predicate) -> list[str]:
    """Columns of a predicate that a table lacks; they read as null."""
    return [c for c in columns(p) if type_of(df.schema, c) is None]


#: Writer options by plain name; a pair (column, value) applies to one column.
WRITER = {
    "row_group_bytes": "parquet.block.size", "row_group_rows": "parquet.block.row.count.limit", "page_bytes": "parquet.page.size", "page_rows": "parquet.page.row.count.limit", "dictionary_page_bytes": "parquet.dictionary.page.size", "dictionary": "parquet.enable.dictionary",
    "version": "parquet.writer.version", "bloom": "parquet.bloom.filter.enabled", "bloom_ndv": "parquet.bloom.filter.expected.ndv", "bloom_fpp": "parquet.bloom.filter.fpp", "bloom_adaptive": "parquet.bloom.filter.adaptive.enabled", "bloom_max_bytes": "parquet.bloom.filter.max.bytes",
    "checksums": "parquet.page.write-checksum.enabled", "max_padding": "parquet.writer.max-padding", "statistics": "parquet.column.statistics.enabled", "index_truncate": "parquet.columnindex.truncate.length", "statistics_truncate": "parquet.statistics.truncate.length", "codec": "compression",
}


@dataclass(frozen=True)
class Writer:
    """A sink: ``Writer(df).set("row_group_rows", 1000).set("bloom", True, "l_orderkey").write(path)``."""

    df: DataFrame
    options: dict[str, str] = field(default_factory=dict)
    schema: T.StructType | None = None
    hooks: tuple[Callable[[DataFrame], DataFrame], ...] = ()

    def via(self, hook: Callable[[DataFrame], DataFrame]) -> Writer:
        """Pass what is written through a function first."""
        return replace(self, hooks=(*self.hooks, hook))

    def set(self, name: str, value, column: str | None = None) -> Writer:
        key = WRITER[name] + (f"#{column}" if column else "")
        return replace(self, options={**self.options, key: str(value).lower() if isinstance(value, bool) else str(value)})

    def validated(self, schema: T.StructType) -> Writer:
        """Rows have to fit this schema: types equal, no null in required columns."""
        return replace(self, schema=schema)

    def write(self, path: str, *, overwrite: bool = False, partition_by: tuple[str, ...] = ()) -> None:
        df = reduce(lambda d, hook: hook(d), self.hooks, self.df)
        if self.schema is not None:
            for f in self.schema.fields:
                if f.name not in df.columns or df.schema[f.name].dataType != f.dataType:
                    raise TypeError(f"{f.name} is not {f.dataType.simpleString()}")
                if not f.nullable:
                    c = F.col(f"`{f.name}`")
                    df = df.withColumn(f.name, F.when(c.isNull(), F.raise_error(F.lit(f"null in required column {f.name}"))).otherwise(c))
        df.write.mode("overwrite" if overwrite else "error").options(**self.options).partitionBy(*partition_by).parquet(path)


#: Rows of a file of an ordered table: a multiple of the usual row groups and pages, few enough for short footers and even tasks.
FILE_ROWS = 500_000


def ranged(df: DataFrame, *keys: str, file_rows: int | None = None) -> DataFrame:
    """df in order of its keys, in partitions of some file_rows rows that follow each other."""
    return df.repartitionByRange(max(1, -(-df.count() // (file_rows or FILE_ROWS))), *keys).sortWithinPartitions(*keys)


def in_order(df: DataFrame, staged: str, *keys: str) -> Callable[..., DataFrame]:
    """A function (file_rows) -> df in order of its keys, a partition for each file_rows rows (the last: what is left), so that writing it gives files
    of so many rows whose names follow the order. Rows are ranged and written to a new folder, staged, once; their places there tell each one's file."""
    n = df.count()
    ranged(df, *keys).write.parquet(staged)
    spark, place = df.sparkSession, "__pos"

    def cut(file_rows: int | None = None) -> DataFrame:
        file_rows = file_rows or FILE_ROWS
        d = with_position(spark.read.parquet(staged), place)
        return d.repartitionById(max(1, -(-n // file_rows)), F.floor(F.col(place) / file_rows).cast("int")).sortWithinPartitions(place).drop(place)

    return cut


def append_files(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def tolerant(spark: SparkSession, path: str, schema: T.StructType, form: str, threshold: float) -> DataFrame:
    """Rows of a JSON or CSV table without the unreadable ones; an error if these are more than a share of all."""
    bad = "_corrupt_record"
    d = spark.read.schema(T.StructType([*schema.fields, T.StructField(bad, T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).format(form).load(path)
    # a corrupt-record column alone cannot be counted on the raw scan, so another column's state is counted with it
    rest = F.struct(*(F.col(f"`{f.name}`") for f in schema.fields))
    row = d.select(F.col(bad).isNotNull().alias("bad"), F.hash(rest).alias("rest")).agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), F.bit_xor("rest").alias("rest")).first()
    if row["n"] and row["bad"] / row["n"] > threshold:
        raise ValueError(f"{row['bad']} of {row['n']} records cannot be read")
    return d.where(F.col(bad).isNull() & (F.hash(rest) <= F.lit(2**31 - 1))).drop(bad)  # always true; keeps the other columns in the scan, whatever is asked of it


def avro(spark: SparkSession, path: str) -> DataFrame:
    """The records of Avro containers."""
    return read_avro(spark, path)


def files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    return list_files(spark, path, recursive)


def splits(spark: SparkSession, path: str, split_bytes: int) -> DataFrame:
    """file, start, length of the splits of a size that a scan makes."""
    f = list_files(spark, path, True)
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("file_bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    return f.select("file", "file_bytes", F.explode(starts).alias("start")).select("file", "start", F.least(F.lit(split_bytes).cast("long"), F.col("file_bytes") - F.col("start")).alias("length"))


def filter_column(df: DataFrame, p: Predicate, name: str = "matches") -> DataFrame:
    """df with whether each row satisfies p: true or false, never null."""
    return df.withColumn(name, F.coalesce(compile_predicate(p, df.schema), F.lit(False)))


def page(spark: SparkSession, path: str, start: int, n: int, *names: str) -> DataFrame:
    """Rows start to start + n - 1 of a table, counted from 1 in the order of its files: found by the footers' row counts, so other row groups are not read and nothing is sorted."""
    if start < 1 or n < 0:
        raise ValueError("rows are counted from 1")
    parts, before = [], 0
    for r in sorted(file_catalog(spark, path).select("file", "n_rows").collect()):  # a line per file
        a, b = max(start - 1, before), min(start - 1 + n, before + r["n_rows"])
        if a < b:
            parts.append((len(parts), r["file"], a - before, b - a))
        before += r["n_rows"]
    schema = spark.read.parquet(path).schema
    schema = T.StructType([schema[c] for c in names]) if names else schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, first, size in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                columns = [fitted(c.combine_chunks(), f.type) for c, f in zip(rows_between(uri, first, size, arrow.names), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, arrow.names)

    return spark.createDataFrame(parts, "k int, file string, first long, n long").repartition(max(1, len(parts)), "k").mapInArrow(run, schema)


def read_metrics(df: DataFrame) -> dict[str, int]:
    """What scanning df took, after running it once for its number of rows: files, bytes and rows of the scans, by Spark's own counts."""
    plan = df._jdf.queryExecution().executedPlan()
    rows = df._jdf.queryExecution().toRdd().count()
    out = {"rows_out": int(rows), "files": 0, "bytes": 0, "rows_scanned": 0}
    names = {"numFiles": "files", "filesSize": "bytes", "numOutputRows": "rows_scanned"}

    def walk(node) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind == "FileSourceScanExec":
            for theirs, ours in names.items():
                found = node.metrics().get(theirs)
                out[ours] += int(found.get().value()) if found.isDefined() else 0
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    walk(plan)
    return out
