"""File transformations: prune, mask, rename, recompress, encrypt cells, merge, and columns glued by row position."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.footers import file_catalog, fitted, rows_between
from .projection import leaf_paths, prune_schema

CODECS = {"UNCOMPRESSED": "none", "SNAPPY": "snappy", "GZIP": "gzip", "ZSTD": "zstd", "LZ4": "lz4", "LZ4_RAW": "lz4_raw"}


class RewriteError(ValueError):
    """Options that contradict each other or the schema."""


def prune(df: DataFrame, *paths: str) -> DataFrame:
    """df without the columns at these dotted paths; a struct that loses all fields goes. Unknown names only warn."""
    leaves = leaf_paths(df.schema)
    gone = {p for p in leaves if any(p == x or p.startswith(f"{x}.") for x in paths)}
    for x in paths:
        if not any(p == x or p.startswith(f"{x}.") for p in leaves):
            warnings.warn(f"no column {x} to prune", stacklevel=2)
    from .projection import project

    return project(df, prune_schema(df.schema, [p for p in leaves if p not in gone]))


def _walk(df: DataFrame, path: str, change) -> DataFrame:
    """df with the value at a dotted path changed; structs on the way stay, null ones stay null."""
    head, *rest = path.split(".")

    def go(c: Column, kind: T.DataType, steps: list[str]) -> Column:
        if not steps:
            return change(c, kind)
        return F.when(c.isNotNull(), c.withField(steps[0], go(c[steps[0]], kind[steps[0]].dataType, steps[1:])))

    return df.withColumn(head, go(F.col(f"`{head}`"), df.schema[head].dataType, rest))


def _field(schema: T.StructType, path: str) -> T.StructField:
    here, f = schema, None
    for step in path.split("."):
        if not isinstance(here, T.StructType) or step not in here.names:
            raise RewriteError(f"no column {path}")
        f = here[step]
        here = f.dataType
    return f


def nullify(df: DataFrame, *paths: str) -> DataFrame:
    """df with nulls at these paths, lists as a whole; a required column cannot be masked."""
    for p in paths:
        if not _field(df.schema, p).nullable:
            raise RewriteError(f"{p} is required and cannot hold nulls")
        df = _walk(df, p, lambda c, kind: F.lit(None).cast(kind))
    return df


def mask(df: DataFrame, mode: str, *paths: str) -> DataFrame:
    """nullify() for mode nullify; hash and redact are names without a meaning yet."""
    if mode.lower() in ("hash", "redact"):
        raise RewriteError(f"mask mode {mode} is not supported")
    if mode.lower() != "nullify":
        raise RewriteError(f"unknown mask mode {mode}")
    return nullify(df, *paths)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """df with top-level columns renamed; types stay. Sources have to exist, targets not; no dots."""
    for old, new in names.items():
        if "." in old or "." in new:
            raise RewriteError("only top-level columns are renamed")
        if old not in df.columns:
            raise RewriteError(f"no column {old} to rename")
        if new in df.columns and new not in names:
            raise RewriteError(f"there is a column {new} already")
    if len(set(names.values())) < len(names):
        raise RewriteError("two columns would get one name")
    return df.withColumnsRenamed(names)


def merge(frames: list[DataFrame]) -> DataFrame:
    """Rows of frames with equal schemas, in their order of files."""
    for f in frames[1:]:
        if f.schema.simpleString() != frames[0].schema.simpleString():
            raise RewriteError("files to merge have different schemas")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out


def encrypt_cells(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """df with the columns of keys as AES-GCM ciphertext (binary) under the hex key of each; cells, not file pages."""
    for name, key in keys.items():
        if _field(df.schema, name).metadata.get("encrypted"):
            raise RewriteError(f"{name} is encrypted already")
        c = F.aes_encrypt(F.col(f"`{name}`").cast("string"), F.unhex(F.lit(key)))
        df = df.withColumn(name, c.alias(name, metadata={"encrypted": True, "type": df.schema[name].dataType.simpleString()}))
    return df


def decrypt_cells(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    for name, key in keys.items():
        kind = df.schema[name].metadata.get("type", "string")
        df = df.withColumn(name, F.aes_decrypt(F.col(f"`{name}`"), F.unhex(F.lit(key))).cast("string").cast(kind))
    return df


def with_position(df: DataFrame, name: str = "__pos") -> DataFrame:
    """Rows numbered from 0 in the order of file path and row in the file. Offsets of files come from a count per file; no global sort."""
    d = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    sizes = d.groupBy("__file").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per file
    starts = sizes.select("__file", before.alias("__start"))
    return d.join(F.broadcast(starts), "__file").withColumn(name, F.col("__start") + F.col("__row")).drop("__file", "__row", "__start")


def positional_join(left: DataFrame, right: DataFrame, *, overwrite: bool = False) -> DataFrame:
    """Columns of two scans side by side, by row position. On a clash of names the left side's stays, or with overwrite the right side's, in the left one's place.

    Both need the same number of rows.
    """
    n, m = left.count(), right.count()
    if n != m:
        raise RewriteError(f"{n} rows on the left, {m} on the right")
    k = max(1, -(-n // STRETCH))  # tasks of some STRETCH rows, however many the session has
    a, b = (with_position(d, "__pos").repartition(k, "__pos").alias(x) for d, x in ((left, "a"), (right, "b")))
    both = set(left.columns) & set(right.columns)
    take = [F.col(f"{'b' if overwrite and c in both else 'a'}.`{c}`").alias(c) for c in left.columns]
    take += [F.col(f"b.`{c}`") for c in right.columns if c not in both]
    return a.join(b, F.col("a.__pos") == F.col("b.__pos")).select(*take)


def segments(left: list[tuple[str, int]], right: list[tuple[str, int]]) -> list[tuple[int, str, int, str, int, int]]:
    """(number, left file, its first row, right file, its first row, rows) of the stretches that two lists of (file, rows) have in common."""
    if sum(n for _, n in left) != sum(n for _, n in right):
        raise RewriteError(f"{sum(n for _, n in left)} rows on the left, {sum(n for _, n in right)} on the right")
    out, i, j, a, b = [], 0, 0, 0, 0
    while i < len(left) and j < len(right):
        n = min(left[i][1] - a, right[j][1] - b)
        if n:
            out.append((len(out), left[i][0], a, right[j][0], b, n))
        a, b = a + n, b + n
        if a == left[i][1]:
            i, a = i + 1, 0
        if j < len(right) and b == right[j][1]:
            j, b = j + 1, 0
    return out


#: Rows of a task of a positional join; longer files are taken in stretches of so many.
STRETCH = 1 << 20


def positional_join_files(spark: SparkSession, left: str | list[str], right: str | list[str], *, overwrite: bool = False) -> DataFrame:
    """positional_join() of the tables at paths, in the order of their files, without a shuffle of rows: each task reads the same
    stretch of rows of either side and lays the columns side by side. Row groups outside its stretch are not read."""
    left, right = ([p] if isinstance(p, str) else list(p) for p in (left, right))
    sizes = [[(r["file"], r["n_rows"]) for p in paths for r in sorted(file_catalog(spark, p).select("file", "n_rows").collect())] for paths in (left, right)]  # a line per file
    parts = [(k, lf, a + at, rf, b + at, min(STRETCH, n - at)) for k, lf, a, rf, b, n in segments(*sizes) for at in range(0, n, STRETCH)]
    ls, rs = spark.read.parquet(*left).schema, spark.read.parquet(*right).schema
    both = set(ls.names) & set(rs.names)
    schema = T.StructType([(rs if overwrite and f.name in both else ls)[f.name] for f in ls.fields] + [f for f in rs.fields if f.name not in both])
    arrow = to_arrow_schema(schema)
    from_right = [n in rs.names and (n not in ls.names or overwrite) for n in schema.names]
    names = [[n for n, r in zip(schema.names, from_right, strict=True) if r == side] for side in (False, True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, lf, at, rf, bt, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                one, two = rows_between(lf, at, n, names[0]), rows_between(rf, bt, n, names[1])
                columns = {**dict(zip(names[0], one, strict=True)), **dict(zip(names[1], two, strict=True))}
                for lo in range(0, n, 65_536):
                    yield pa.RecordBatch.from_arrays([fitted(columns[f.name].slice(lo, min(65_536, n - lo)).combine_chunks(), f.type) for f in arrow], schema.names)

    frame = spark.createDataFrame(parts, "k long, lf string, a long, rf string, b long, n long")
    return frame.repartition(max(1, len(parts)), "k", "a").mapInArrow(run, schema)


def merge_metadata(parts: list[dict[str, str]], *, strict: bool = False, joiner: str | None = None) -> dict[str, str]:
    """Key-value metadata of several files: last wins; with strict a conflict is an error; with joiner different values are joined."""
    out: dict[str, str] = {}
    for p in parts:
        for k, v in p.items():
            if k in out and out[k] != v:
                if strict:
                    raise RewriteError(f"conflicting values for {k}: {out[k]!r} and {v!r}")
                v = f"{out[k]}{joiner}{v}" if joiner is not None else v
            out[k] = v
    return out


def provenance(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The merged key-value metadata of files and, under original.created.by, their distinct writers."""
    files = [r for p in paths for r in file_catalog(spark, p).select("file", "created_by", "key_values").collect()]
    files.sort(key=lambda r: r["file"])
    out = merge_metadata([json.loads(r["key_values"]) for r in files])
    out["original.created.by"] = "\n".join(dict.fromkeys(r["created_by"] for r in files if r["created_by"]))
    return out


@dataclass
class RewriteOptions:
    """What a rewrite does, in this order: merge, join, prune, mask, rename, encrypt; codec None keeps the session's."""

    inputs: list[str]
    output: str
    join: str | None = None
    overwrite_joined: bool = False
    prune: list[str] = field(default_factory=list)
    mask: dict[str, str] = field(default_factory=dict)
    rename: dict[str, str] = field(default_factory=dict)
    encrypt: dict[str, str] = field(default_factory=dict)
    codec: str | None = None
    overwrite: bool = False
    options: dict[str, str] = field(default_factory=dict)

    def check(self) -> None:
        if not self.inputs:
            raise RewriteError("no input")
        below = lambda a, b: a == b or a.startswith(f"{b}.") or b.startswith(f"{a}.")
        for x in self.prune:
            for what, others in (("mask", self.mask), ("encrypt", self.encrypt)):
                if any(below(x, y) for y in others):
                    raise RewriteError(f"cannot both prune and {what} {x}")
        if set(self.mask) & set(self.rename):
            raise RewriteError("cannot both mask and rename a column")
        for name, key in self.encrypt.items():
            if not key:
                raise RewriteError(f"no key to encrypt {name} with")
        if self.codec is not None and self.codec.upper() not in CODECS:
            raise RewriteError(f"codec {self.codec} cannot be written here; known: {', '.join(CODECS)}")


def rewritten(spark: SparkSession, o: RewriteOptions) -> DataFrame:
    """The rows that a rewrite would write."""
    o.check()
    df = merge([spark.read.parquet(p) for p in o.inputs]) if o.join is None else positional_join_files(spark, o.inputs, o.join, overwrite=o.overwrite_joined)
    df = prune(df, *o.prune) if o.prune else df
    for path, mode in o.mask.items():
        df = mask(df, mode, path)
    df = rename(df, o.rename) if o.rename else df
    return encrypt_cells(df, o.encrypt) if o.encrypt else df


def rewrite(spark: SparkSession, o: RewriteOptions) -> None:
    """Read, change and write in one pass."""
    w = rewritten(spark, o).write.mode("overwrite" if o.overwrite else "error").options(**o.options)
    (w if o.codec is None else w.option("compression", CODECS[o.codec.upper()])).parquet(o.output)


def recompress(spark: SparkSession, source: str, output: str, codec: str) -> None:
    rewrite(spark, RewriteOptions([source], output, codec=codec))


#: Metadata that describes a file's own schema: wrong for what is made of it.
OWN = ("org.apache.spark.sql.parquet.row.metadata", "org.apache.spark.version", "ARROW:schema", "pandas")


def rewrite_with_metadata(spark: SparkSession, o: RewriteOptions) -> int:
    """rewrite() that carries the key-value metadata of inputs and joined files, and their writers, into the new footers; through Arrow, as Spark's writer takes none. The number of rows."""
    from ..sources.arrow_files import FileOptions, write_files

    kept = {k: v for k, v in provenance(spark, [*o.inputs, *([o.join] if o.join else [])]).items() if k not in OWN}
    codec = {None: "snappy", "UNCOMPRESSED": "none", "LZ4_RAW": "lz4"}.get(o.codec and o.codec.upper(), (o.codec or "").lower())
    return write_files(rewritten(spark, o), o.output, FileOptions(codec=codec, metadata=kept))
