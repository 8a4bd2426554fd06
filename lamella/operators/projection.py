"""Projection by path, by glob and by sub-schema."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ProjectionError(ValueError):
    """A projection that the schema does not allow."""


_STEP = re.compile(r"\.?([^.\[\]]+)|\[([^\]]*)\]")


def path_column(schema: T.StructType, path: str) -> Column:
    """The value at a path: ``a.b`` for fields, ``a[0]`` for elements of a list, ``m[key]`` for entries of a map; null beyond the end."""
    here: T.DataType = schema
    out: Column | None = None
    at = 0
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ProjectionError(f"cannot read {path!r} from place {at}")
        at = m.end()
        if m[1] is not None:
            if not isinstance(here, T.StructType) or m[1] not in here.names:
                raise ProjectionError(f"{path!r}: no field {m[1]!r}")
            out = F.col(f"`{m[1]}`") if out is None else out[m[1]]
            here = here[m[1]].dataType
        elif isinstance(here, T.ArrayType):
            if not m[2].isdigit():
                raise ProjectionError(f"{path!r}: a list takes a whole number, not {m[2]!r}")
            out, here = F.get(out, int(m[2])), here.elementType
        elif isinstance(here, T.MapType):
            key = F.lit(m[2].strip("\"'")).cast(here.keyType)
            out, here = F.try_element_at(out, key), here.valueType
        else:
            raise ProjectionError(f"{path!r}: [{m[2]}] follows neither a list nor a map")
    if out is None:
        raise ProjectionError("the path is empty")
    return out


def select_paths(df: DataFrame, *paths: str) -> DataFrame:
    """A column per path, named like it with dots and brackets turned to underscores."""
    return df.select(*(path_column(df.schema, p).alias(re.sub(r"\W+", "_", p).strip("_")) for p in paths))


def expand_braces(pattern: str) -> list[str]:
    """The patterns that {a,b} alternation stands for; braces may nest."""
    start = pattern.find("{")
    if start < 0:
        if "}" in pattern:
            raise ProjectionError(f"{pattern!r}: a brace closes that is not open")
        return [pattern]
    depth, pieces, last = 0, [], start + 1
    for i in range(start, len(pattern)):
        c = pattern[i]
        depth += (c == "{") - (c == "}")
        if depth == 0 or (depth == 1 and c == ","):
            pieces.append(pattern[last:i])
            last = i + 1
        if depth == 0:
            return [x for piece in pieces for inner in expand_braces(piece) for x in expand_braces(pattern[:start] + inner + pattern[i + 1 :])]
    raise ProjectionError(f"{pattern!r}: a brace is not closed")


def leaf_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Dotted paths of all primitive columns below structs; lists and maps count as one."""
    if not isinstance(schema, T.StructType):
        return [prefix]
    return [p for f in schema.fields for p in leaf_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]


def glob_paths(schema: T.StructType, *globs: str) -> list[str]:
    """Leaf paths that a glob names, or that lie below what it names, in schema order. ``*`` stands for any characters; a glob without a match is an error."""
    found, paths = set(), leaf_paths(schema)
    for glob in (g for pattern in globs for g in pattern.split(";")):
        for one in expand_braces(glob):
            rule = re.compile(".*".join(map(re.escape, one.split("*"))) + r"(\..*)?")
            hits = {p for p in paths if rule.fullmatch(p)}
            if not hits:
                raise ProjectionError(f"{one!r} matches no column")
            found |= hits
    return [p for p in paths if p in found]


def prune_schema(schema: T.StructType, keep: list[str]) -> T.StructType:
    """The schema with the leaf paths kept; structs that lose all fields go."""

    def walk(s: T.StructType, prefix: str) -> T.StructType:
        out = []
        for f in s.fields:
            path = f"{prefix}{f.name}"
            if isinstance(f.dataType, T.StructType):
                inner = walk(f.dataType, f"{path}.")
                if inner.fields:
                    out.append(T.StructField(f.name, inner, f.nullable, f.metadata))
            elif path in keep:
                out.append(f)
        return T.StructType(out)

    return walk(schema, "")


def _shaped(c: Column, kind: T.DataType) -> Column:
    if not isinstance(kind, T.StructType):
        return c
    return F.when(c.isNotNull(), F.struct(*(_shaped(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))


def project(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df under a sub-schema: fields by name, nested ones too. Every field has to exist with that type (see check_projection). No field at all leaves empty rows, as many as before."""
    check_projection(df.schema, schema)
    return df.select(*(_shaped(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in schema.fields))


def select_globs(df: DataFrame, *globs: str) -> DataFrame:
    return project(df, prune_schema(df.schema, glob_paths(df.schema, *globs)))


def check_projection(have: T.StructType, want: T.StructType, prefix: str = "") -> None:
    """Raise where a requested field is missing, has another type, or is required while the file's is optional."""
    for f in want.fields:
        path = f"{prefix}{f.name}"
        if f.name not in have.names:
            raise ProjectionError(f"no column {path}")
        own = have[f.name]
        if own.nullable and not f.nullable:
            raise ProjectionError(f"{path} is optional in the file and required in the request")
        if isinstance(f.dataType, T.StructType) and isinstance(own.dataType, T.StructType):
            check_projection(own.dataType, f.dataType, f"{path}.")
        elif f.dataType != own.dataType:
            raise ProjectionError(f"{path} is {own.dataType.simpleString()}, not {f.dataType.simpleString()}")


def with_missing(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df under a schema that may have further fields: these read as null."""
    return df.select(*((F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields))


def first_primitive(schema: T.StructType) -> str:
    """The path of the first primitive column: what is read when only rows count."""
    return leaf_paths(schema)[0]


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """The row's number in its file, from the scan itself."""
    return df.select("*", F.col("_metadata.row_index").alias(name))


def with_file(df: DataFrame, name: str = "file") -> DataFrame:
    return df.select("*", F.col("_metadata.file_name").alias(name))


def union_columns(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames, columns by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
