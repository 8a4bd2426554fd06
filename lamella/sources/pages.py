"""Page headers, dictionaries and column indexes, decoded from the file's compact Thrift structures."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from decimal import localcontext

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .footers import list_files, open_file
from .footers import through_files as footer_order
from .values import Kind, logical_of, physical_of

PAGE_TYPES = {0: "DATA_PAGE", 1: "INDEX_PAGE", 2: "DICTIONARY_PAGE", 3: "DATA_PAGE_V2"}
ENCODINGS = {0: "PLAIN", 2: "PLAIN_DICTIONARY", 3: "RLE", 4: "BIT_PACKED", 5: "DELTA_BINARY_PACKED", 6: "DELTA_LENGTH_BYTE_ARRAY", 7: "DELTA_BYTE_ARRAY", 8: "RLE_DICTIONARY", 9: "BYTE_STREAM_SPLIT"}
BOUNDARY = {0: "UNORDERED", 1: "ASCENDING", 2: "DESCENDING"}


class Compact:
    """Thrift's compact protocol, read into dictionaries by field id."""

    def __init__(self, raw: bytes, at: int = 0):
        self.raw, self.at = raw, at

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.raw[self.at]
            self.at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    def zigzag(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def value(self, kind: int):
        if kind in (1, 2):
            return kind == 1
        if kind == 3:
            self.at += 1
            return struct.unpack_from("<b", self.raw, self.at - 1)[0]
        if kind in (4, 5, 6):
            return self.zigzag()
        if kind == 7:
            self.at += 8
            return struct.unpack_from("<d", self.raw, self.at - 8)[0]
        if kind == 8:
            n = self.varint()
            self.at += n
            return self.raw[self.at - n : self.at]
        if kind in (9, 10):
            head = self.raw[self.at]
            self.at += 1
            n = head >> 4 if head >> 4 != 15 else self.varint()
            inner = head & 15
            if inner in (1, 2):
                out = [b == 1 for b in self.raw[self.at : self.at + n]]
                self.at += n
                return out
            return [self.value(inner) for _ in range(n)]
        if kind == 11:
            n = self.varint()
            if not n:
                return {}
            kinds = self.raw[self.at]
            self.at += 1
            return {self.value(kinds >> 4): self.value(kinds & 15) for _ in range(n)}
        if kind == 12:
            return self.struct()
        raise ValueError(f"compact type {kind}")

    def struct(self) -> dict:
        out, last = {}, 0
        while True:
            head = self.raw[self.at]
            self.at += 1
            if head == 0:
                return out
            last = last + (head >> 4) if head >> 4 else self.zigzag()
            out[last] = self.value(head & 15)


def _headers(f, start: int, end: int) -> Iterator[tuple[int, int, dict]]:
    """(place of the header, place of the data, header) of each page in a chunk."""
    at = start
    while at < end:
        f.seek(at)
        c = Compact(f.read(min(64 << 10, end - at)))
        header = c.struct()
        yield at, at + c.at, header
        at += c.at + header[3]


def _each(spark: SparkSession, path: str, rows, schema: str) -> DataFrame:
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uri in frame["file"]:
                with open_file(uri) as f:
                    meta = pq.ParquetFile(f)
                    yield pd.DataFrame(list(rows(uri, f, meta)), columns=names).astype({})

    return list_files(spark, path, True).mapInPandas(run, schema)


def _chunk_range(c) -> tuple[int, int]:
    start = c.dictionary_page_offset if c.has_dictionary_page and c.dictionary_page_offset else c.data_page_offset
    return start, start + c.total_compressed_size


def page_headers(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A row per page: file, row_group, path, page, page_type, encoding, n_values, compressed, uncompressed, header_bytes, crc_stated (a checksum is there)."""

    def rows(uri, f, meta):
        m = meta.metadata
        for g in range(m.num_row_groups):
            for k in range(m.num_columns):
                c = m.row_group(g).column(k)
                if columns and c.path_in_schema not in columns:
                    continue
                for n, (at, data, h) in enumerate(_headers(f, *_chunk_range(c))):
                    own = h.get(5) or h.get(7) or h.get(8) or {}
                    encoding = own.get(4 if 8 in h else 2)
                    yield (uri, g, c.path_in_schema, n, PAGE_TYPES.get(h[1], str(h[1])), ENCODINGS.get(encoding, str(encoding)), own.get(1, 0), h[3], h[2], data - at, 4 in h)

    return _each(spark, path, rows, "file string, row_group int, path string, page int, page_type string, encoding string, n_values long, compressed long, uncompressed long, header_bytes int, crc_stated boolean")


def verify_checksums(spark: SparkSession, path: str) -> DataFrame:
    """file, pages, checked (pages that state a checksum) and bad (whose data gives another one)."""

    def rows(uri, f, meta):
        pages = checked = bad = 0
        m = meta.metadata
        for g in range(m.num_row_groups):
            for k in range(m.num_columns):
                for _, data, h in _headers(f, *_chunk_range(m.row_group(g).column(k))):
                    pages += 1
                    if 4 in h:
                        f.seek(data)
                        checked += 1
                        bad += zlib.crc32(f.read(h[3])) != h[4] & 0xFFFFFFFF
        yield uri, pages, checked, bad

    return _each(spark, path, rows, "file string, pages long, checked long, bad long")


def _unpack(raw: bytes, codec: str, size: int) -> bytes:
    if codec == "UNCOMPRESSED":
        return raw
    name = {"SNAPPY": "snappy", "GZIP": "gzip", "ZSTD": "zstd", "LZ4_RAW": "lz4_raw", "LZ4": "lz4_raw", "BROTLI": "brotli"}[codec]
    return pa.decompress(raw, decompressed_size=size, codec=name).to_pybytes()


def plain_values(raw: bytes, kind: str, n: int, width: int = 0) -> list:
    """Values of PLAIN encoding."""
    code = {"INT32": "i", "INT64": "q", "FLOAT": "f", "DOUBLE": "d"}.get(kind)
    if code:
        return list(struct.unpack_from(f"<{n}{code}", raw))
    if kind == "BYTE_ARRAY":
        out, at = [], 0
        for _ in range(n):
            size, = struct.unpack_from("<I", raw, at)
            out.append(raw[at + 4 : at + 4 + size])
            at += 4 + size
        return out
    if kind == "BOOLEAN":
        return [bool(raw[k // 8] >> (k % 8) & 1) for k in range(n)]
    width = 12 if kind == "INT96" else width
    return [raw[k * width : (k + 1) * width] for k in range(n)]


def dictionaries(spark: SparkSession, path: str, column: str) -> DataFrame:
    """A row per entry of the dictionary of a column's chunks: file, row_group, entry, value (text)."""

    def rows(uri, f, meta):
        m = meta.metadata
        for g in range(m.num_row_groups):
            for k in range(m.num_columns):
                c = m.row_group(g).column(k)
                if c.path_in_schema != column:
                    continue
                for _, data, h in _headers(f, *_chunk_range(c)):
                    if h[1] != 2:
                        break
                    f.seek(data)
                    raw = _unpack(f.read(h[3]), c.compression, h[2])
                    for n, v in enumerate(plain_values(raw, c.physical_type, h[7][1], meta.schema.column(k).length or 0)):
                        yield uri, g, n, v.decode("utf-8", "backslashreplace") if isinstance(v, bytes) else str(v)

    return _each(spark, path, rows, "file string, row_group int, entry int, value string")


def _footer(f) -> dict:
    size = f.size()
    f.seek(size - 8)
    n, mark = struct.unpack("<I4s", f.read(8))
    if mark != b"PAR1":
        raise ValueError("the footer is encrypted or this is no such file")
    f.seek(size - 8 - n)
    return Compact(f.read(n)).struct()


def _bound(raw: bytes, kind: str) -> str | None:
    code = {"INT32": "<i", "INT64": "<q", "FLOAT": "<f", "DOUBLE": "<d"}.get(kind)
    if code:
        return str(struct.unpack(code, raw)[0]) if raw else None
    return str(raw == b"\x01").lower() if kind == "BOOLEAN" else raw.decode("utf-8", "backslashreplace")


def column_indexes(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A row per page of the column and offset indexes: file, row_group, path, page, first_row, offset, size, null_page, null_count, min_value, max_value, boundary_order. Chunks without an index have none."""

    def rows(uri, f, meta):
        m, raw = meta.metadata, _footer(f)
        for g, rg in enumerate(raw.get(4, ())):
            for k, chunk in enumerate(rg[1]):
                c = m.row_group(g).column(k)
                if (columns and c.path_in_schema not in columns) or 4 not in chunk:
                    continue
                f.seek(chunk[4])
                places = Compact(f.read(chunk[5])).struct()[1]
                index = {}
                if 6 in chunk:
                    f.seek(chunk[6])
                    index = Compact(f.read(chunk[7])).struct()
                for n, p in enumerate(places):
                    empty = index.get(1, [False] * len(places))[n]
                    bounds = (None, None) if empty or not index else (_bound(index[2][n], c.physical_type), _bound(index[3][n], c.physical_type))
                    nulls = index.get(5)
                    yield (uri, g, c.path_in_schema, n, p[3], p[1], p[2], bool(empty), nulls[n] if nulls else None, *bounds, BOUNDARY.get(index.get(4)))

    return _each(spark, path, rows, "file string, row_group int, path string, page int, first_row long, offset long, size int, null_page boolean, null_count long, min_value string, max_value string, boundary_order string")


def through_files(index: DataFrame, groups: DataFrame) -> DataFrame:
    """column_indexes() of one column with page and first_row counted on through the row groups and files of the table, files in order of path; groups are its row_groups()."""
    held = index.groupBy("file", "row_group").agg(F.count("*").alias("k"))  # a row per row group
    own, files = W.partitionBy("file").orderBy("row_group"), W.orderBy("file")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inner = held.select("file", "row_group", before("k", own).alias("a"))
    outer = held.groupBy("file").agg(F.sum("k").alias("k")).select("file", before("k", files).alias("b"))  # a row per file
    rows = footer_order(groups).select("file", "row_group", "table_row")
    d = index.join(inner, ["file", "row_group"]).join(F.broadcast(outer), "file").join(rows, ["file", "row_group"])
    return d.withColumns({"page": (F.col("page") + F.col("a") + F.col("b")).cast("int"), "first_row": F.col("table_row") + F.col("first_row")}).drop("a", "b", "table_row")


def _comparable(raw: bytes, kind: Kind):
    """What a bound is compared as: a number or bytes in the order of its type; None where it cannot be read or is NaN."""
    try:
        v = physical_of(raw, kind)
        v = logical_of(v, kind) if kind.logical in ("Decimal", "Float16") or not kind.signed else v
    except (struct.error, ValueError):
        return None
    return None if isinstance(v, float) and v != v else v


def _leaves(a: pa.Array, path: list[str]) -> pa.Array:
    """The values of the one primitive column below an array, without those of missing parents."""
    while True:
        if isinstance(a, pa.ExtensionArray):
            a = a.storage
        elif pa.types.is_dictionary(a.type):
            a = a.dictionary_decode()
        elif pa.types.is_struct(a.type):
            a = a.flatten()[0]
        elif pa.types.is_map(a.type):
            a = a.take(pa.array(range(len(a)), pa.int64()))  # keys and items are those of the whole array, whatever the slice
            a = a.keys if path[-1] == "key" and not pa.types.is_nested(a.type.key_type) and not _has_key(a.type.item_type) else a.items
        elif pa.types.is_nested(a.type):
            a = a.flatten()
        else:
            return a


def _has_key(kind: pa.DataType) -> bool:
    return pa.types.is_nested(kind) and any(kind.field(k).name == "key" or _has_key(kind.field(k).type) for k in range(kind.num_fields))


def _in_order(a: pa.Array, kind: Kind) -> pa.Array:
    """Values in a type whose order is that of the column and of _comparable()."""
    t = a.type
    if pa.types.is_timestamp(t):
        return a.cast(pa.timestamp({"milliseconds": "ms", "microseconds": "us", "nanoseconds": "ns"}[kind.unit], t.tz), safe=False).cast(pa.int64())
    if pa.types.is_date(t):
        return a.cast(pa.date32()).cast(pa.int32())
    if pa.types.is_time(t) or pa.types.is_duration(t):
        return a.cast(pa.int32() if pa.types.is_time32(t) else pa.int64())
    if pa.types.is_float16(t):
        return a.cast(pa.float32())
    if pa.types.is_decimal(t) or pa.types.is_integer(t) or pa.types.is_floating(t) or pa.types.is_boolean(t):
        return a
    return a.cast(pa.large_binary())


def _faults(f, meta, g: int, k: int, chunk: dict) -> Iterator[tuple[int | None, str]]:
    """(page, problem) of a chunk's indexes."""
    rg, column = meta.metadata.row_group(g), meta.schema.column(k)
    kind, flat, rows = Kind.of(column), column.max_repetition_level == 0, rg.num_rows
    places = index = None
    if 4 in chunk:
        f.seek(chunk[4])
        places = Compact(f.read(chunk[5])).struct()[1]
        for p, place in enumerate(places):
            if place[3] <= places[p - 1][3] if p else place[3] != 0:
                yield p, "first rows do not rise" if p else "the first page does not begin with the first row"
    if 6 not in chunk:
        return
    f.seek(chunk[6])
    index = Compact(f.read(chunk[7])).struct()
    n = len(index[1]) if places is None else len(places)
    if not all(len(index[x]) == n for x in (1, 2, 3, 5) if x in index or x != 5):
        yield None, "the lists of the index differ in length"
        return
    low, high = ([None if index[1][p] or not kind.ordered else _comparable(v, kind) for p, v in enumerate(index[x])] for x in (2, 3))
    last = None
    for p in range(n):
        if index[1][p]:
            if index[2][p] or index[3][p]:
                yield p, "a page of nulls has bounds"
            continue
        if low[p] is None or high[p] is None:
            if kind.ordered and kind.physical not in ("FLOAT", "DOUBLE") and kind.logical != "Float16":
                yield p, "a bound cannot be read"
            continue
        if low[p] > high[p]:
            yield p, "the least value is above the greatest"
        if last is not None and index.get(4) == 1 and (low[p] < low[last] or high[p] < high[last]):
            yield p, "bounds are not ascending"
        if last is not None and index.get(4) == 2 and (low[p] > low[last] or high[p] > high[last]):
            yield p, "bounds are not descending"
        last = p
    if places is None or any(b[3] <= a[3] for a, b in zip(places, places[1:], strict=False)):
        return  # without the places of pages their values cannot be told apart
    values = meta.read_row_group(g, columns=[column.path]).column(0)
    ends = [p[3] for p in places[1:]] + [rows]
    counts = None if flat else [(h.get(5) or h.get(8))[1] for _, _, h in _headers(f, *_chunk_range(rg.column(k))) if h[1] in (0, 3)]
    for p, (place, end) in enumerate(zip(places, ends, strict=True)):
        part = values.slice(place[3], end - place[3])
        leaves = [_leaves(c, column.path.split(".")) for c in part.chunks]
        there = sum(len(x) - x.null_count for x in leaves)
        if index[1][p] and there:
            yield p, "a page of nulls has values"
        if 5 in index and index[5][p] != (len(part) if flat else counts[p]) - there:
            yield p, "the null count is wrong"
        if low[p] is None or high[p] is None:
            continue
        for x in leaves:
            found = pc.min_max(_in_order(x, kind))
            a, b = found["min"].as_py(), found["max"].as_py()
            if a is not None and a < low[p]:
                yield p, "a value is below the least"
            if b is not None and b > high[p]:
                yield p, "a value is above the greatest"


def check_indexes(spark: SparkSession, path: str) -> DataFrame:
    """Contracts of column and offset indexes that a file breaks: file, row_group, path, page, problem. All chunks with an index are judged, in the order of their type:
    the index by itself, and its bounds and null counts against the values of each page. Values that are NaN and types without an order (INT96, intervals) have no bounds to compare."""

    def rows(uri, f, meta):
        for g, rg in enumerate(_footer(f).get(4, ())):
            for k, chunk in enumerate(rg[1]):
                with localcontext(prec=100):  # decimals of any length stay exact
                    found = list(dict.fromkeys(_faults(f, meta, g, k, chunk)))
                for page, problem in found:
                    yield uri, g, meta.schema.column(k).path, page, problem

    return _each(spark, path, rows, "file string, row_group int, path string, page int, problem string")
