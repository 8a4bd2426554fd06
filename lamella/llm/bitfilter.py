"""A bit filter of fixed size that goes to the workers: it drops most rows before an exact join, and only saves work.

When the input outgrows it, more rows pass to the join; results stay the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits, a power of two: 4 MB on each worker, and at most a row per 64 bits to the driver.
BITS = 1 << 25


def place(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITS)).cast("long")


def build(keys: DataFrame, at: Column | None = None):
    """A broadcast array of words with the bits of all rows of keys; at tells them where place() does not."""
    at = keys.select((place(*(F.col(c) for c in keys.columns)) if at is None else at).alias("p"))
    words = at.select(F.shiftright("p", 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    got, mask = words.toPandas(), np.zeros(BITS // 64, np.int64)
    mask[got["w"].to_numpy(np.int64)] = got["m"].to_numpy(np.int64)
    return keys.sparkSession.sparkContext.broadcast(mask.view(np.uint64))


def hits(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (words[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1) == 1
