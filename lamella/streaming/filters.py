"""Predicates, projections and statistics over unbounded tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.predicates import Predicate, apply_filter
from ..operators.projection import select_paths


def stream_files(spark: SparkSession, folder: str, *, per_trigger: int = 100) -> DataFrame:
    """New files of a folder as they come, under the schema of those that are there."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def filtered(stream: DataFrame, p: Predicate | None, *paths: str) -> DataFrame:
    """The same filter and projection as a scan's, row by row, without state."""
    out = apply_filter(stream, p)
    return select_paths(out, *paths) if paths else out


def windowed_statistics(stream: DataFrame, time: str, value: str, width: str, late: str) -> DataFrame:
    """n, null_count, min and max of a column per window of event time; windows close when the watermark passes them."""
    t = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return t.groupBy(F.window("__t", width).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("null_count"), F.min(value).alias("min_value"), F.max(value).alias("max_value")).select("w.start", "w.end", "n", "null_count", "min_value", "max_value")
