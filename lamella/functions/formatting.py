"""Values as text, and sizes as people read them."""

from __future__ import annotations

import struct
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_text(days: Column) -> Column:
    """Days since 1970-01-01 as yyyy-MM-dd."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM-dd")


def timestamp_text(value: Column, unit: str = "micros", *, utc: bool = True) -> Column:
    """An epoch count of millis, micros or nanos as yyyy-MM-ddTHH:mm:ss with the unit's digits, and +0000 for instants in UTC."""
    per = {"millis": 1_000, "micros": 1_000_000, "nanos": 1_000_000_000}[unit]
    seconds, rest = F.floor(value / F.lit(per).cast("decimal(20,0)")).cast("long"), None
    rest = F.pmod(value, F.lit(per))
    day, s = F.floor(seconds / 86_400).cast("int"), F.pmod(seconds, F.lit(86_400))
    digits = {"millis": 3, "micros": 6, "nanos": 9}[unit]
    text = F.concat(date_text(day), F.lit("T"), time_text(s, "seconds"), F.lit("."), F.lpad(rest.cast("string"), digits, "0"))
    return F.concat(text, F.lit("+0000")) if utc else text


def time_text(value: Column, unit: str = "micros") -> Column:
    """A count since midnight as HH:mm:ss with the unit's digits."""
    per = {"seconds": 1, "millis": 1_000, "micros": 1_000_000, "nanos": 1_000_000_000}[unit]
    s = F.floor(value / per).cast("long")
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    text = F.concat(two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s % 3600 / 60)), F.lit(":"), two(s % 60))
    digits = {"seconds": 0, "millis": 3, "micros": 6, "nanos": 9}[unit]
    return F.concat(text, F.lit("."), F.lpad(F.pmod(value, F.lit(per)).cast("string"), digits, "0")) if digits else text


def unsigned_text(value: Column, bits: int = 64) -> Column:
    """A signed integer column's bits read as unsigned."""
    whole = value.cast("decimal(20,0)")
    return F.when(value < 0, whole + F.lit(str(2**bits)).cast("decimal(20,0)")).otherwise(whole).cast("decimal(20,0)").cast("string")


def decimal_text(unscaled: Column, scale: int) -> Column:
    return (unscaled.cast(f"decimal(38,{scale})") / F.lit(10**scale)).cast(f"decimal(38,{scale})").cast("string") if scale else unscaled.cast("string")


def hex_text(raw: Column) -> Column:
    return F.concat(F.lit("0x"), F.upper(F.hex(raw)))


def uuid_text(raw: Column) -> Column:
    """Sixteen bytes in the usual groups."""
    h = F.lower(F.hex(raw))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def interval_text(raw: bytes) -> str:
    """Twelve bytes of months, days and milliseconds, each little-endian and unsigned."""
    months, days, millis = struct.unpack("<3I", raw)
    return f"interval({months} months, {days} days, {millis} millis)"


def float16_of(raw: bytes) -> float:
    return struct.unpack("<e", raw)[0]


def float16(c: Column) -> Column:
    """Two little-endian bytes as a float."""
    return F.pandas_udf(lambda s: s.map(lambda b: None if b is None else float16_of(bytes(b))).astype("float32"), "float")(c)


def uuid_bytes(text: str) -> bytes:
    return uuid.UUID(text).bytes


def human_size(n: float) -> str:
    """A byte count with up to three decimals and a unit, such as 1.500 kB."""
    for unit, step in (("GB", 1 << 30), ("MB", 1 << 20), ("kB", 1 << 10)):
        if n >= step:
            return f"{n / step:.3f} {unit}"
    return f"{n:g} B"


def human_count(n: float) -> str:
    for unit, step in (("B", 10**9), ("M", 10**6), ("k", 10**3)):
        if n >= step:
            return f"{n / step:.3f} {unit}"
    return f"{n:g}"
