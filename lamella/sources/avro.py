"""Avro containers without a package: blocks of records, decoded and encoded by their schema, a file a task.

Unions of null and one type are nullable values; other unions are structs of nullable member0, member1, ...; enums are text.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .footers import list_files, open_file
from .parts import write_parts

MAGIC = b"Obj\x01"
#: Records of a block that is written, and of a batch that is read.
BLOCK_ROWS, BATCH_ROWS = 4_000, 4_000
_DAY, _EPOCH = dt.date(1970, 1, 1), dt.datetime(1970, 1, 1)
_SPARK = {"null": T.NullType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType()}
_AVRO = {T.BooleanType: "boolean", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.BinaryType: "bytes", T.StringType: "string", T.DateType: {"type": "int", "logicalType": "date"}, T.TimestampType: {"type": "long", "logicalType": "timestamp-micros"}, T.TimestampNTZType: {"type": "long", "logicalType": "local-timestamp-micros"}}


class AvroError(ValueError):
    """A file or schema that cannot be read."""


class Cursor:
    """Bytes and a place in them."""

    def __init__(self, raw: bytes, at: int = 0):
        self.raw, self.at = raw, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.raw):
            raise AvroError("the data ends too soon")
        self.at += n
        return self.raw[self.at - n : self.at]

    def long(self) -> int:
        n = shift = 0
        while True:
            b = self.take(1)[0]
            n |= (b & 0x7F) << shift
            if b < 0x80:
                return (n >> 1) ^ -(n & 1)
            shift += 7

    def blob(self) -> bytes:
        return self.take(self.long())

    def unpack(self, code: str) -> Any:
        return struct.unpack(code, self.take(struct.calcsize(code)))[0]


def zigzag(n: int) -> bytes:
    n, out = (n << 1) ^ (n >> 63), bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _nullable(schema: Any) -> Any | None:
    """The type that a union makes nullable, where it is null and one other."""
    if isinstance(schema, list) and len(schema) == 2 and "null" in schema:
        return next(s for s in schema if s != "null")
    return None


def spark_type(schema: Any, named: dict[str, Any]) -> T.DataType:
    """The Spark type of an Avro schema; named gathers types by name."""
    if isinstance(schema, list):
        inner = _nullable(schema)
        if inner is not None:
            return spark_type(inner, named)
        rest = [s for s in schema if s != "null"]
        return spark_type(rest[0], named) if len(schema) == 1 else T.StructType([T.StructField(f"member{k}", spark_type(s, named)) for k, s in enumerate(rest)])
    if isinstance(schema, str):
        return _SPARK[schema] if schema in _SPARK else spark_type(named[schema], named)
    kind, logical = schema["type"], schema.get("logicalType")
    if "name" in schema and kind in ("record", "enum", "fixed"):
        named[schema["name"]] = schema
    if logical == "decimal":
        return T.DecimalType(schema["precision"], schema.get("scale", 0))
    if logical == "date":
        return T.DateType()
    if logical in ("timestamp-millis", "timestamp-micros"):
        return T.TimestampType()
    if logical in ("local-timestamp-millis", "local-timestamp-micros"):
        return T.TimestampNTZType()
    if kind == "record":
        return T.StructType([T.StructField(f["name"], spark_type(f["type"], named), isinstance(f["type"], list) and "null" in f["type"]) for f in schema["fields"]])
    if kind == "array":
        return T.ArrayType(spark_type(schema["items"], named), isinstance(schema["items"], list))
    if kind == "map":
        return T.MapType(T.StringType(), spark_type(schema["values"], named), isinstance(schema["values"], list))
    return {"enum": T.StringType(), "fixed": T.BinaryType()}.get(kind) or spark_type(kind, named)


def decoder(schema: Any, named: dict[str, Any]) -> Callable[[Cursor], Any]:
    """What reads one value of a schema."""
    if isinstance(schema, list):
        parts = [decoder(s, named) for s in schema]
        rest = [k for k, s in enumerate(schema) if s != "null"]
        if len(rest) < 2:
            return lambda c: parts[c.long()](c)

        def union(c: Cursor) -> dict | None:
            k = c.long()
            v = parts[k](c)
            return None if k not in rest else {f"member{i}": v if r == k else None for i, r in enumerate(rest)}

        return union
    if isinstance(schema, str) and schema in named:
        return lambda c: decoder(named[schema], named)(c)  # may be within itself: made when met
    if isinstance(schema, str):
        return {"null": lambda c: None, "boolean": lambda c: c.take(1) != b"\x00", "int": Cursor.long, "long": Cursor.long, "float": lambda c: c.unpack("<f"), "double": lambda c: c.unpack("<d"), "bytes": Cursor.blob, "string": lambda c: c.blob().decode()}[schema]
    kind, logical = schema["type"], schema.get("logicalType")
    if "name" in schema and kind in ("record", "enum", "fixed"):
        named[schema["name"]] = schema
    if kind == "record":
        fields = [(f["name"], decoder(f["type"], named)) for f in schema["fields"]]
        return lambda c: {n: f(c) for n, f in fields}
    if kind in ("array", "map"):
        item = decoder(schema["items" if kind == "array" else "values"], named)

        def many(c: Cursor) -> list:
            out = []
            while n := c.long():
                if n < 0:
                    n = -n
                    c.long()  # bytes of the block
                out += [item(c) if kind == "array" else (c.blob().decode(), item(c)) for _ in range(n)]
            return out

        return many
    if kind == "enum":
        return lambda c: schema["symbols"][c.long()]
    plain = (lambda c: c.take(schema["size"])) if kind == "fixed" else decoder(kind, named)
    if logical == "decimal":
        return lambda c: Decimal(int.from_bytes(plain(c), "big", signed=True)).scaleb(-schema.get("scale", 0))
    if logical == "date":
        return lambda c: _DAY + dt.timedelta(days=plain(c))
    if logical and "timestamp-" in logical:
        per = 1_000 if logical.endswith("millis") else 1
        return lambda c: _EPOCH + dt.timedelta(microseconds=plain(c) * per)
    return plain


def header(f) -> tuple[dict, str, bytes, int]:
    """(schema, codec, sync mark, place of the first block) of a container."""
    f.seek(0)
    c = Cursor(f.read(min(f.size(), 1 << 20)))
    if c.take(4) != MAGIC:
        raise AvroError("not an Avro container")
    meta = {}
    while n := c.long():
        if n < 0:
            n = -n
            c.long()
        for _ in range(n):
            key = c.blob().decode()
            meta[key] = c.blob()
    return json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), c.take(16), c.at


def _plain(raw: bytes, codec: str) -> bytes:
    if codec == "null":
        return raw
    if codec == "deflate":
        return zlib.decompress(raw, -15)
    if codec == "snappy":
        size, shift = 0, 0
        for b in raw:  # the length that the block states of itself
            size |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                break
        return pa.decompress(raw[:-4], decompressed_size=size, codec="snappy").to_pybytes()
    if codec == "zstandard":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    raise AvroError(f"codec {codec} is not known")


def records(f) -> Iterator[dict]:
    """The records of a container, block by block."""
    schema, codec, sync, at = header(f)
    read, size = decoder(schema, {}), f.size()
    while at < size:
        f.seek(at)
        head = Cursor(f.read(min(20, size - at)))
        n, length = head.long(), head.long()
        f.seek(at + head.at)
        c = Cursor(_plain(f.read(length), codec))
        for _ in range(n):
            yield read(c)
        if f.read(16) != sync:
            raise AvroError("a block does not end in the sync mark")
        at += head.at + length + 16


def read_avro(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The records of the containers under a path. The schema, unless given, is the first file's; a task reads a file."""
    files = list_files(spark, path, True)
    if schema is None:
        first = files.orderBy("file").first()
        if first is None:
            raise AvroError(f"no file under {path}")
        with open_file(first["file"]) as f:
            schema = spark_type(header(f)[0], {})
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                with open_file(uri) as f:
                    rows: list[dict] = []
                    for r in records(f):
                        rows.append(r)
                        if len(rows) == BATCH_ROWS:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.select("file").mapInArrow(run, schema)


def avro_schema(kind: T.DataType, name: str = "record") -> Any:
    """The Avro schema of a Spark type."""
    if isinstance(kind, T.StructType):
        return {"type": "record", "name": name, "fields": [{"name": f.name, "type": _or_null(avro_schema(f.dataType, f"{name}_{f.name}"), f.nullable)} for f in kind.fields]}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": _or_null(avro_schema(kind.elementType, f"{name}_item"), kind.containsNull)}
    if isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise AvroError("keys of maps are text")
        return {"type": "map", "values": _or_null(avro_schema(kind.valueType, f"{name}_value"), kind.valueContainsNull)}
    if isinstance(kind, T.DecimalType):
        return {"type": "bytes", "logicalType": "decimal", "precision": kind.precision, "scale": kind.scale}
    if type(kind) not in _AVRO:
        raise AvroError(f"{kind.simpleString()} has no Avro type")
    return _AVRO[type(kind)]


def _or_null(schema: Any, nullable: bool) -> Any:
    return ["null", schema] if nullable else schema


def encoder(schema: Any) -> Callable[[Any], bytes]:
    """What writes one value, for schemas of avro_schema()."""
    if isinstance(schema, list):
        inner = encoder(schema[1])
        return lambda v: b"\x00" if v is None else b"\x02" + inner(v)
    if isinstance(schema, str):
        text = lambda v: zigzag(len(v)) + v
        return {"boolean": lambda v: b"\x01" if v else b"\x00", "int": zigzag, "long": zigzag, "float": lambda v: struct.pack("<f", v), "double": lambda v: struct.pack("<d", v), "bytes": text, "string": lambda v: text(v.encode())}[schema]
    kind, logical = schema["type"], schema.get("logicalType")
    if kind == "record":
        fields = [(f["name"], encoder(f["type"])) for f in schema["fields"]]
        return lambda v: b"".join(e(v[n]) for n, e in fields)
    if kind == "array":
        item = encoder(schema["items"])
        return lambda v: (zigzag(len(v)) + b"".join(map(item, v)) if v else b"") + b"\x00"
    if kind == "map":
        value = encoder(schema["values"])
        return lambda v: (zigzag(len(v)) + b"".join(zigzag(len(k.encode())) + k.encode() + value(x) for k, x in v) if v else b"") + b"\x00"
    if logical == "decimal":

        def decimal(v: Decimal) -> bytes:
            n = int(v.scaleb(schema["scale"]))
            raw = n.to_bytes(n.bit_length() // 8 + 1, "big", signed=True)
            return zigzag(len(raw)) + raw

        return decimal
    if logical == "date":
        return lambda v: zigzag((v - _DAY).days)
    return lambda v: zigzag((v.replace(tzinfo=None) - _EPOCH) // dt.timedelta(microseconds=1))


def write_avro(df: DataFrame, path: str, *, codec: str = "deflate") -> int:
    """df as containers in a new folder, a file a partition; returns the number of records. A task that is tried again writes another
    file, and only files of tasks that ended well are moved into the folder."""
    if codec not in ("null", "deflate"):
        raise AvroError(f"codec {codec} is not written")
    schema, names = avro_schema(df.schema), df.columns

    def part(batches: Iterator[pa.RecordBatch], out) -> int:
        write, sync, n = encoder(schema), os.urandom(16), 0
        meta = {"avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode()}
        out.write(MAGIC + zigzag(len(meta)) + b"".join(zigzag(len(k)) + k.encode() + zigzag(len(v)) + v for k, v in meta.items()) + b"\x00" + sync)
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK_ROWS):
                block = b.slice(lo, BLOCK_ROWS)
                rows = zip(*(c.to_pylist() for c in block.columns), strict=True)
                raw = b"".join(write(dict(zip(names, r, strict=True))) for r in rows)
                if codec == "deflate":
                    z = zlib.compressobj(6, zlib.DEFLATED, -15)
                    raw = z.compress(raw) + z.flush()
                out.write(zigzag(block.num_rows) + zigzag(len(raw)) + raw + sync)
                n += block.num_rows
        return n

    return write_parts(df, path, ".avro", part)
