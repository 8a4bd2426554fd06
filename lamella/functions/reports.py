"""The inspection commands as functions that return DataFrames, and the few that write."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import bloom, rewrite, statistics
from ..operators.projection import select_paths
from ..sources import pages as page_source
from ..sources.avro import write_avro
from ..sources.footers import chunk_catalog, file_catalog
from ..sources.tables import avro
from . import geo, infer, schema_text

VERSION = "0.1"


def meta(spark: SparkSession, path: str) -> DataFrame:
    """A row per column chunk: where it is, how it is stored, its statistics."""
    return chunk_catalog(spark, path).select("file", "row_group", "rg_rows", "path", "physical_type", "logical_type", "codec", "encodings", "n_values", "compressed", "null_count", "min_value", "max_value")


def pages(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    return page_source.page_headers(spark, path, columns)


def dictionary(spark: SparkSession, path: str, column: str) -> DataFrame:
    return page_source.dictionaries(spark, path, column)


def column_index(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    return page_source.column_indexes(spark, path, columns)


def schema(spark: SparkSession, path: str, *, message: bool = True) -> str:
    """The schema of a table as a message, or as JSON."""
    s = spark.read.parquet(path).schema
    return schema_text.render(schema_text.from_struct(s)) if message else json.dumps(json.loads(s.json()), indent=2)


def schema_table(spark: SparkSession, path: str) -> DataFrame:
    """A row per leaf column: path, physical_type, logical_type, definition and repetition level, as the footers say."""
    kind = "array<struct<path:string,type:string,logical:string,d:int,r:int>>"
    c = file_catalog(spark, path).select(F.explode(F.from_json("columns", kind)).alias("c"))
    return c.select("c.path", F.col("c.type").alias("physical_type"), F.col("c.logical").alias("logical_type"), F.col("c.d").alias("definition_level"), F.col("c.r").alias("repetition_level")).distinct()


def csv_schema(spark: SparkSession, path: str, form: infer.CsvFormat | None = None) -> str:
    return schema_text.render(schema_text.from_struct(infer.infer_csv(spark, path, form), "csv"))


def convert_csv(spark: SparkSession, source: str, output: str, form: infer.CsvFormat | None = None, codec: str = "gzip") -> None:
    infer.read_csv(spark, source, None, form).write.option("compression", codec).parquet(output)


def convert(spark: SparkSession, source: str, output: str, *, form: str = "json", columns: list[str] | None = None, codec: str = "gzip") -> None:
    """JSON lines, Avro or the format itself to the format; columns are paths."""
    if form == "json":
        df = spark.read.schema(infer.infer_json(spark, source)).json(source)
    elif form == "avro":
        df = avro(spark, source)
    else:
        df = spark.read.parquet(source)
    (select_paths(df, *columns) if columns else df).write.option("compression", codec).parquet(output)


def to_avro(df: DataFrame, output: str, *, codec: str = "deflate") -> int:
    """df as Avro containers in a new folder; the number of records."""
    return write_avro(df, output, codec=codec)


def head(df: DataFrame, n: int = 10, *columns: str) -> DataFrame:
    """The first n rows of a scan."""
    return (select_paths(df, *columns) if columns else df).limit(n)


def cat(df: DataFrame, *columns: str) -> DataFrame:
    return select_paths(df, *columns) if columns else df


def column_size(spark: SparkSession, path: str, *prefixes: str) -> DataFrame:
    """path, compressed bytes and ratio of the whole, largest first; prefixes keep columns at or below them, ratios stay those of all."""
    s = chunk_catalog(spark, path).groupBy("path").agg(F.sum("compressed").alias("bytes"))
    s = s.withColumn("ratio", F.col("bytes") / F.sum("bytes").over(W.partitionBy()))  # a row per column
    if prefixes:
        s = s.where(" OR ".join(f"path = '{p}' OR startswith(path, '{p}.')" for p in prefixes))
    return s.orderBy(F.desc("bytes"), "path")


def footer(spark: SparkSession, path: str) -> DataFrame:
    """file and its footer as JSON: file facts, then row groups with their chunks."""
    c = chunk_catalog(spark, path)
    groups = c.groupBy("file", "row_group", "rg_rows", "rg_bytes").agg(F.sort_array(F.collect_list(F.struct("column_id", "path", "physical_type", "codec", "encodings", "n_values", "null_count", "min_value", "max_value", "compressed", "uncompressed"))).alias("columns"))
    blocks = groups.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("row_group", "rg_rows", "rg_bytes", "columns"))).alias("blocks"))
    return file_catalog(spark, path).join(blocks, "file", "left").select("file", F.to_json(F.struct("n_rows", "created_by", "version", "key_values", "blocks")).alias("footer"))


def scan_counts(df: DataFrame) -> DataFrame:
    """file_name and n_rows of each file of a scan."""
    return df.groupBy(F.col("_metadata.file_name").alias("file_name")).agg(F.count("*").alias("n_rows"))


def check_stats(spark: SparkSession, path: str) -> DataFrame:
    """Columns whose footer statistics differ from the data: column_name, what, stated and found. Numbers are compared as numbers."""
    df = spark.read.parquet(path)
    found = statistics.column_statistics(df)
    c = chunk_catalog(spark, path)
    number = F.col("physical_type").isin("INT32", "INT64", "FLOAT", "DOUBLE") & F.col("logical_type").isin("None")
    stated = c.where(number).groupBy("path").agg(F.sum("null_count").alias("nulls"), F.min(F.col("min_value").cast("double")).alias("low"), F.max(F.col("max_value").cast("double")).alias("high"))
    j = stated.join(found, F.col("path") == F.col("column_name"))
    test = lambda what, a, b: F.when(~a.eqNullSafe(b), F.struct(F.lit(what).alias("what"), a.cast("string").alias("stated"), b.cast("string").alias("found")))
    bad = F.array_compact(F.array(test("null_count", F.col("nulls"), F.col("null_count")), test("min", F.col("low"), F.col("min_value").cast("double")), test("max", F.col("high"), F.col("max_value").cast("double"))))
    return j.select("column_name", F.explode(bad).alias("b")).select("column_name", "b.*")


def bloom_filter(df: DataFrame, column: str, values: list, *, ndv: int, fpp: float = 0.01) -> DataFrame:
    """value and may_contain for each value, from a filter built over the column."""
    b = bloom.build(df, column, ndv=ndv, fpp=fpp)
    kind = df.schema[column]
    rows = df.sparkSession.createDataFrame([(v,) for v in values], f"value {kind.dataType.simpleString()}")
    return bloom.probe(rows, "value", b)


def size_stats(df: DataFrame, *paths: str) -> DataFrame:
    out = [statistics.size_statistics(df, p).select(F.lit(p).alias("path"), "level_kind", "level", "n") for p in paths]
    result = out[0]
    for o in out[1:]:
        result = result.unionAll(o)
    return result


def geospatial_stats(df: DataFrame, column: str) -> DataFrame:
    return geo.bounding_box(df, column)


def prune(spark: SparkSession, source: str, output: str, *columns: str) -> None:
    rewrite.rewrite(spark, rewrite.RewriteOptions([source], output, prune=list(columns)))


def masking(spark: SparkSession, source: str, output: str, mode: str, *columns: str) -> None:
    rewrite.rewrite(spark, rewrite.RewriteOptions([source], output, mask=dict.fromkeys(columns, mode)))


def trans_compression(spark: SparkSession, source: str, output: str, codec: str) -> None:
    rewrite.recompress(spark, source, output, codec)


def version() -> str:
    return VERSION


COMMANDS = (
    "meta", "pages", "dictionary", "check_stats", "schema", "csv_schema", "convert_csv", "convert", "to_avro", "cat", "head", "column_index", "column_size", "prune", "trans_compression", "masking", "footer", "bloom_filter", "scan_counts", "size_stats", "geospatial_stats", "version", "help",
)


def help() -> dict[str, str]:  # noqa: A001
    """Each command and its first line of documentation."""
    return {n: (globals()[n].__doc__ or "").strip().split("\n")[0] for n in COMMANDS}
