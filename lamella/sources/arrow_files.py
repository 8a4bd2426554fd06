"""Files with what Spark's own writer does not offer: codecs and encodings by column, and modular encryption. Tasks write and read them through Arrow."""

from __future__ import annotations

import base64
import hashlib
import hmac
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from .footers import fitted, list_files, open_file
from .parts import write_parts


class CryptoError(ValueError):
    """A key that is missing or does not open what it should."""


def wrap(key: bytes, master: bytes) -> str:
    """A data key under a master key: its bytes under a keyed stream, with a tag."""
    nonce = os.urandom(16)
    body = _stream(key, master, nonce)
    return base64.b64encode(nonce + body + hmac.digest(master, b"tag" + nonce + body, hashlib.sha256)).decode()


def unwrap(wrapped: str, master: bytes) -> bytes:
    raw = base64.b64decode(wrapped)
    nonce, body, tag = raw[:16], raw[16:-32], raw[-32:]
    if not hmac.compare_digest(tag, hmac.digest(master, b"tag" + nonce + body, hashlib.sha256)):
        raise CryptoError("the master key does not open this data key")
    return _stream(body, master, nonce)


def _stream(data: bytes, master: bytes, nonce: bytes) -> bytes:
    pad = b"".join(hmac.digest(master, nonce + k.to_bytes(4, "big"), hashlib.sha256) for k in range(-(-len(data) // 32)))
    return bytes(a ^ b for a, b in zip(data, pad, strict=False))


@dataclass(frozen=True)
class Keys:
    """Master keys by name (hex), which stand in for a key service, and what they are for.

    footer names the key of the footer; columns maps key names to columns; columns under no key stay open. plain_footer leaves
    the footer readable (and signed). Data keys are drawn for each file and wrapped once, or with double_wrapping twice.
    """

    masters: dict[str, str]
    footer: str | None = None
    columns: dict[str, list[str]] = field(default_factory=dict)
    plain_footer: bool = False
    double_wrapping: bool = True
    algorithm: str = "AES_GCM_V1"

    def _factory(self):
        import pyarrow.parquet.encryption as pe

        masters = {k: bytes.fromhex(v) for k, v in self.masters.items()}

        class Service(pe.KmsClient):
            def __init__(self, _):
                super().__init__()

            def wrap_key(self, key_bytes, master_key_identifier):
                return wrap(key_bytes, masters[master_key_identifier]).encode()

            def unwrap_key(self, wrapped_key, master_key_identifier):
                if master_key_identifier not in masters:
                    raise CryptoError(f"no key {master_key_identifier}")
                return unwrap(wrapped_key, masters[master_key_identifier])

        return pe.CryptoFactory(Service), pe.KmsConnectionConfig()

    def encryption(self):
        """Properties for one file's writer. Each file needs its own."""
        import pyarrow.parquet.encryption as pe

        factory, connection = self._factory()
        config = pe.EncryptionConfiguration(footer_key=self.footer, column_keys=self.columns, plaintext_footer=self.plain_footer, double_wrapping=self.double_wrapping, encryption_algorithm=self.algorithm)
        return factory, factory.file_encryption_properties(connection, config)

    def decryption(self):
        factory, connection = self._factory()
        return factory, factory.file_decryption_properties(connection)

    def check(self, names: list[str]) -> None:
        if self.footer is None or not self.columns:
            raise CryptoError("a footer key and keys of columns are needed")
        for k in (self.footer, *self.columns):
            if k not in self.masters:
                raise CryptoError(f"no key {k}")
        used = [c for cs in self.columns.values() for c in cs]
        if len(set(used)) < len(used) or (bad := [c for c in used if c not in names]):
            raise CryptoError("a column under two keys" if len(set(used)) < len(used) else f"no column {bad[0]}")


@dataclass(frozen=True)
class FileOptions:
    """codec for all columns or codecs by column, with levels; encodings by column, others with dictionaries; keys to encrypt under; key-value metadata for the footers."""

    codec: str = "snappy"
    codecs: dict[str, str] = field(default_factory=dict)
    levels: dict[str, int] = field(default_factory=dict)
    encodings: dict[str, str] = field(default_factory=dict)
    row_group_rows: int = 1 << 20
    page_version: str = "1.0"
    checksums: bool = True
    keys: Keys | None = None
    metadata: dict[str, str] = field(default_factory=dict)


def write_files(df: DataFrame, path: str, o: FileOptions | None = None) -> int:
    """df as a new folder of files, one a partition; the number of rows. Row groups are gathered in the task's memory, so row_group_rows bounds it."""
    o = o or FileOptions()
    if bad := [c for c in (*o.codecs, *o.levels, *o.encodings) if c not in df.columns]:
        raise ValueError(f"no column {bad[0]}")
    if o.keys is not None:
        o.keys.check(df.columns)
    schema = to_arrow_schema(df.schema)
    codecs = {c: o.codecs.get(c, o.codec) for c in df.columns}

    def write(batches: Iterator[pa.RecordBatch], out) -> int:
        n, held = 0, []
        factory, crypt = o.keys.encryption() if o.keys is not None else (None, None)
        w = pq.ParquetWriter(out, schema.with_metadata(o.metadata or None), compression=codecs, compression_level=o.levels or None, use_dictionary=[c for c in df_columns if c not in o.encodings], column_encoding=o.encodings or None, data_page_version=o.page_version, write_page_checksum=o.checksums, encryption_properties=crypt)
        with w:
            for b in batches:
                b = pa.RecordBatch.from_arrays([fitted(c, f.type) for c, f in zip(b.columns, schema, strict=True)], schema=schema)
                held.append(b)
                n += b.num_rows
                if (full := sum(x.num_rows for x in held)) >= o.row_group_rows:  # whole row groups only; the rest waits for the next batch
                    t, whole = pa.Table.from_batches(held, schema), full - full % o.row_group_rows
                    w.write_table(t.slice(0, whole), row_group_size=o.row_group_rows)
                    held = t.slice(whole).to_batches() if whole < full else []
            if held:
                w.write_table(pa.Table.from_batches(held, schema), row_group_size=o.row_group_rows)
        del factory  # lives as long as the writer
        return n

    df_columns = df.columns
    return write_parts(df, path, ".parquet", write)


def read_encrypted(spark: SparkSession, path: str, keys: Keys, schema: T.StructType | None = None) -> DataFrame:
    """The rows of encrypted files under a path, or of some columns by schema: keys of columns that are not asked for are not needed. A task reads a file."""
    files = list_files(spark, path, True).select("file")
    if schema is None:
        with open_file(files.orderBy("file").first()["file"]) as f:
            factory, crypt = keys.decryption()
            schema = from_arrow_schema(pq.ParquetFile(f, decryption_properties=crypt).schema_arrow)
            del factory
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                with open_file(uri) as f:
                    factory, crypt = keys.decryption()
                    for part in pq.ParquetFile(f, decryption_properties=crypt).iter_batches(columns=arrow.names):
                        yield pa.RecordBatch.from_arrays([fitted(part.column(c.name), c.type) for c in arrow], schema=arrow)
                    del factory

    return files.mapInArrow(run, schema)
