"""Values as a file stores them and as predicates state them: the two directions, by a column's physical and logical type."""

from __future__ import annotations

import datetime as dt
import json
import re
import struct
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

_EPOCH, _DAY = dt.datetime(1970, 1, 1), dt.date(1970, 1, 1)
_PER = {"milliseconds": 1_000, "microseconds": 1_000_000, "nanoseconds": 1_000_000_000}
_CODE = {"INT32": "<i", "INT64": "<q", "FLOAT": "<f", "DOUBLE": "<d"}


@dataclass(frozen=True)
class Kind:
    """A column's types, as its footer says; as JSON it travels with a summary."""

    physical: str
    logical: str = "None"
    scale: int = 0
    unit: str = ""
    utc: bool = False
    signed: bool = True
    bits: int = 64

    @classmethod
    def of(cls, column) -> Kind:
        """Of a column of a pyarrow Parquet schema."""
        said = json.loads(column.logical_type.to_json())
        return cls(column.physical_type, said["Type"], said.get("scale", 0), said.get("timeUnit", ""), said.get("isAdjustedToUTC", False), said.get("isSigned", True), said.get("bitWidth", 64))

    def to_json(self) -> str:
        return json.dumps(vars(self))

    @classmethod
    def from_json(cls, text: str) -> Kind:
        return cls(**json.loads(text))

    @property
    def ordered(self) -> bool:
        """Whether bounds of this kind can be compared; INT96 and intervals have no order."""
        return self.physical != "INT96" and self.logical not in ("Interval", "Undefined", "Geometry", "Geography", "Variant")


def physical_of(raw: bytes, kind: Kind) -> Any:
    """A value from its plain bytes without a length."""
    if kind.physical == "BOOLEAN":
        return raw != b"\x00"
    return struct.unpack(_CODE[kind.physical], raw)[0] if kind.physical in _CODE else bytes(raw)


def logical_of(value: Any, kind: Kind) -> Any:
    """What a stored value means: date, datetime (UTC, without a zone), Decimal, str, or the value itself. Bytes that are no UTF-8 raise."""
    if kind.logical == "String" or kind.logical in ("Enum", "JSON"):
        return value.decode("utf-8")
    if kind.logical == "Date":
        return _DAY + dt.timedelta(days=value)
    if kind.logical == "Timestamp":
        return _EPOCH + dt.timedelta(microseconds=value * 1_000_000 // _PER[kind.unit])
    if kind.logical == "Decimal":
        whole = int.from_bytes(value, "big", signed=True) if isinstance(value, bytes) else value
        return Decimal(whole).scaleb(-kind.scale)
    if kind.logical == "Float16":
        return struct.unpack("<e", value)[0]
    if kind.logical == "Int" and not kind.signed:
        return value & (1 << kind.bits) - 1
    return value


def literal(value: Any, kind: Kind) -> Any:
    """A predicate's value in the terms of logical_of(); datetimes with a zone in UTC, those without one in local time where the column holds instants, as Spark reads them."""
    if isinstance(value, dt.datetime) and kind.logical == "Timestamp":
        if value.tzinfo is not None or kind.utc:
            value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return value
    if kind.logical == "Decimal" and isinstance(value, (int, float)) and not isinstance(value, bool):
        return Decimal(str(value))
    return bytes(value) if isinstance(value, bytearray) else value


def stored(value: Any, kind: Kind) -> bytes | None:
    """The plain bytes by which filters hash a predicate's value; None where the kind cannot hold it."""
    v = literal(value, kind)
    try:
        if kind.logical == "Date":
            v = (v - _DAY).days
        elif kind.logical == "Timestamp":
            micros = (v - _EPOCH) // dt.timedelta(microseconds=1)
            v = micros * _PER[kind.unit] // 1_000_000
            if kind.unit == "milliseconds" and micros % 1000:
                return None
        elif kind.logical == "Decimal":
            whole = v.scaleb(kind.scale)
            if whole != whole.to_integral_value() or kind.physical not in _CODE:
                return None
            v = int(whole)
        if kind.physical in ("INT32", "INT64"):
            return struct.pack(_CODE[kind.physical], v) if v == int(v) else None
        if kind.physical in ("FLOAT", "DOUBLE"):
            return struct.pack(_CODE[kind.physical], float(v))
        return v.encode() if isinstance(v, str) else bytes(v) if isinstance(v, bytes) else None
    except (struct.error, TypeError, AttributeError, ArithmeticError, ValueError):
        return None


_WRITER = re.compile(r"(?P<app>.*?)\s+version\s*(?:(?P<version>[^(]*?)\s*(?:\(\s*build\s*(?P<build>[^)]*?)\s*\))?)?\s*")
#: The writer whose binary bounds were wrong, the first version that was right, and the patched line (from, below) in between.
FAULTY, RIGHT_FROM, PATCHED = "parquet-mr", (1, 8, 0), ("cdh", 5, 5)


@dataclass(frozen=True)
class Writer:
    """Who wrote a file."""

    application: str
    version: str | None = None
    build: str | None = None

    @classmethod
    def parse(cls, created_by: str) -> Writer:
        m = _WRITER.fullmatch(created_by)
        if not m:
            raise ValueError(f"not a writer's name: {created_by!r}")
        return cls(m["app"], m["version"] or None, m["build"] or None)

    @property
    def numbers(self) -> tuple[int, int, int] | None:
        m = re.match(r"(\d+)\.(\d+)\.(\d+)", self.version or "")
        return tuple(map(int, m.groups())) if m else None

    @property
    def patched(self) -> bool:
        """A vendor's 1.5.0 that has the mend."""
        m = re.fullmatch(r"1\.5\.0-cdh(\d+)\.(\d+).*", self.version or "")
        return bool(m) and (int(m[1]), int(m[2])) >= PATCHED[1:]


def trusted_bounds(created_by: str | None, physical: str) -> bool:
    """Whether bounds of a column can be believed: those of binary columns not where the writer is unknown or had them wrong."""
    if physical not in ("BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY"):
        return True
    try:
        w = Writer.parse(created_by or "")
    except ValueError:
        return False
    if w.application != FAULTY:
        return True
    return w.numbers is not None and ((w.numbers >= RIGHT_FROM and not (w.numbers == RIGHT_FROM and re.match(r"1\.8\.0(rc|-SNAPSHOT)", w.version))) or w.patched)
