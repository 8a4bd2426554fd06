"""Schemas from text: CSV by its first rows, JSON by its values."""

from __future__ import annotations

import csv
import io
import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that decide a CSV schema.
SAMPLE = 25
_LONG, _DOUBLE, _FLOAT = re.compile(r"\d+"), re.compile(r"\d*\.\d*"), re.compile(r"\d*\.\d*[fF]")


class InferenceError(ValueError):
    """Text from which no schema follows."""


@dataclass(frozen=True)
class CsvFormat:
    delimiter: str = ","
    quote: str = '"'
    escape: str = "\\"
    header: bool = True
    skip: int = 0
    charset: str = "UTF-8"

    def options(self) -> dict[str, str]:
        return {"sep": self.delimiter, "quote": self.quote, "escape": self.escape, "header": str(self.header).lower(), "encoding": self.charset, "emptyValue": "", "nullValue": "\u0000"}


def _kind(value: str) -> T.DataType:
    """Digits alone are a long; digits around a point a double, with f a float; a sign makes text."""
    if _LONG.fullmatch(value):
        return T.LongType()
    if _FLOAT.fullmatch(value):
        return T.FloatType()
    return T.DoubleType() if _DOUBLE.fullmatch(value) and value != "." else T.StringType()


def csv_schema(lines: list[str], form: CsvFormat | None = None, required: tuple[str, ...] = ()) -> T.StructType:
    """From the first rows of a file: a column has the type of its first value that is not empty, text if there is none; nullable unless required."""
    form = form or CsvFormat()
    rows = list(csv.reader(io.StringIO("\n".join(lines[form.skip :])), delimiter=form.delimiter, quotechar=form.quote, escapechar=form.escape))
    rows = [r for r in rows if r]
    if not rows:
        raise InferenceError("no row to infer from")
    names = rows.pop(0) if form.header else [f"field_{k}" for k in range(len(rows[0]))]
    if bad := [n for n in names if not re.fullmatch(r"[A-Za-z_]\w*", n.strip())]:
        raise InferenceError(f"no valid column name: {bad[0]!r}")
    kinds: dict[str, T.DataType] = {}
    for r in rows[:SAMPLE]:
        for n, v in zip(names, r, strict=False):
            if v and n not in kinds:
                kinds[n] = _kind(v)
    return T.StructType([T.StructField(n.strip(), kinds.get(n, T.StringType()), n not in required) for n in names])


def infer_csv(spark: SparkSession, path: str, form: CsvFormat | None = None, required: tuple[str, ...] = ()) -> T.StructType:
    """csv_schema() of the first rows under a path; only these reach the driver."""
    form = form or CsvFormat()
    lines = [r["value"] for r in spark.read.text(path).limit(SAMPLE + 1 + form.skip).collect()]
    return csv_schema(lines, form, required)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, form: CsvFormat | None = None) -> DataFrame:
    """Rows under an inferred or given schema. Empty values are null in all but text columns; a value that does not fit is an error when read."""
    form = form or CsvFormat()
    schema = schema or infer_csv(spark, path, form)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.read.options(**form.options(), mode="FAILFAST").schema(text).csv(path)

    def cell(f: T.StructField):
        c = F.coalesce(F.col(f"`{f.name}`"), F.lit(""))
        if isinstance(f.dataType, T.StringType):
            return c.alias(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.regexp_replace(c, "[fF]$", "")
        return F.when(c != "", c.cast(f.dataType)).alias(f.name)

    return raw.select(*(cell(f) for f in schema.fields))


def json_type(v) -> T.DataType:
    if v is None:
        return T.NullType()
    if isinstance(v, bool):
        return T.BooleanType()
    if isinstance(v, int):
        return T.IntegerType() if -(2**31) <= v < 2**31 else T.LongType()
    if isinstance(v, float):
        return T.DoubleType()
    if isinstance(v, str):
        return T.StringType()
    if isinstance(v, list):
        kind = T.NullType()
        for x in v:
            kind = merge_types(kind, json_type(x))
        return T.ArrayType(kind, any(x is None for x in v))
    return T.StructType([T.StructField(k, json_type(x)) for k, x in v.items()])


def merge_types(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type of values of either: integer widens to long, float to double; integer and floating do not meet."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    for narrow, wide in ((T.IntegerType, T.LongType), (T.FloatType, T.DoubleType)):
        if {type(a), type(b)} == {narrow, wide}:
            return wide()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merge_types(a.elementType, b.elementType), a.containsNull or b.containsNull)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = list(dict.fromkeys([*a.names, *b.names]))
        return T.StructType([T.StructField(n, merge_types(a[n].dataType if n in a.names else T.NullType(), b[n].dataType if n in b.names else T.NullType())) for n in names])
    raise InferenceError(f"{a.simpleString()} and {b.simpleString()} do not meet")


def json_schema(documents: list[str]) -> T.StructType:
    kind: T.DataType = T.NullType()
    for d in documents:
        kind = merge_types(kind, json_type(json.loads(d)))
    if not isinstance(kind, T.StructType):
        raise InferenceError("the documents are no objects")
    return kind


def infer_json(spark: SparkSession, path: str) -> T.StructType:
    """The schema of all objects (one per line) under a path, merged on the executors."""
    kinds = spark.read.text(path).where("trim(value) <> ''").mapInPandas(lambda frames: (f.assign(value=[json_schema(f["value"].tolist()).json()]) if len(f) == 1 else f.iloc[:1].assign(value=[json_schema(f["value"].tolist()).json()]) for f in frames if len(f)), "value string")
    out: T.DataType = T.NullType()
    for r in kinds.distinct().collect():
        out = merge_types(out, T.StructType.fromJson(json.loads(r["value"])))
    return out
