"""Connected components of an edge table by hooking to the least neighbour and contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(v, c) for each vertex of edges (a, b): c is the least vertex it reaches.

    Each round maps every label to the least of its own and its neighbours', twice over, and drops edges within a label,
    so chains shrink by powers. Minima are partly made before the shuffle: a hub costs no more than its edges.
    """
    e = stored(edges.select("a", "b").where("a <> b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct())
    labels = e.select(F.col("a").alias("v")).distinct().withColumn("c", F.col("v"))
    labels = stored(labels)
    while not e.isEmpty():
        hook = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("l"), F.least("a", "m").alias("m"))
        hook = stored(hook)
        up = hook.select(F.col("l").alias("l2"), F.col("m").alias("m2"))
        jump = stored(hook.join(up, F.col("m") == F.col("l2")).select("l", F.col("m2").alias("m")))
        labels = stored(labels.join(jump, F.col("c") == F.col("l"), "left").select("v", F.coalesce("m", "c").alias("c")))
        to = jump.select(F.col("l").alias("lb"), F.col("m").alias("mb"))
        e = stored(e.join(jump, F.col("a") == F.col("l")).select(F.col("m").alias("a"), "b").join(to, F.col("b") == F.col("lb")).select("a", F.col("mb").alias("b")).where("a <> b").distinct())
    return labels
