"""Operator 3: token counts by a map-side two-tier lookup. Texts and their pre-tokens are not shuffled: one narrow pass, after a look at a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import bpe


def count_tokens(docs: DataFrame, tokenizer_path: str, *, text: str = "text", keys: tuple[str, ...] = ("doc_id",), limit: int = 1024) -> DataFrame:
    """Per row: the keys, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit), in the input's partitions.

    Tier one is a broadcast table of the lengths of frequent pre-tokens (see bpe.frequent for its bounds); tier two a bounded
    cache in each worker. Null texts count as empty: 0 bytes, 0 tokens. Repeated rows each give a row; other columns
    are not read. An empty table gives an empty result.
    """
    shared = bpe.Shared(docs, text, tokenizer_path)
    n = len(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared.encoder("lengths", len)
        for b in batches:
            texts = b.column(n)
            sizes = pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0)
            counts = pa.array([sum(enc.values_of(x)) if x else 0 for x in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], sizes, counts, pc.greater(counts, limit)], names)

    schema = T.StructType([*docs.select(*keys).schema, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    names = schema.names
    return docs.select(*keys, text).mapInArrow(count, schema)
