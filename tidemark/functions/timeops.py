"""Times as microseconds since 1970 and TIMESTAMP_NTZ, free of the session's time zone."""

from __future__ import annotations

import datetime as dt
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Microseconds of each accepted unit (nanoseconds must come out whole).
UNIT_US = {"us": 1, "ms": 1_000, "s": 1_000_000, "sec": 1_000_000, "m": 60_000_000, "min": 60_000_000, "h": 3_600_000_000, "hr": 3_600_000_000, "d": 86_400_000_000}
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
DAY_US = UNIT_US["d"]


def duration_us(text: str | int) -> int:
    """'200ms', '1h30m', '7d' or a number of microseconds, as microseconds. Unknown units raise ValueError."""
    if isinstance(text, int):
        return text
    found = re.findall(r"(\d+)\s*([a-z]+)", text.strip().lower())
    if not found or re.sub(r"\s+", "", text.lower()) != "".join(n + u for n, u in found):
        raise ValueError(f"not a duration: {text!r}")
    total_ns = 0
    for n, unit in found:
        if unit == "ns":
            total_ns += int(n)
        elif unit in UNIT_US:
            total_ns += int(n) * UNIT_US[unit] * 1000
        else:
            raise ValueError(f"unknown unit in duration {text!r}")
    if total_ns % 1000 or not total_ns:
        raise ValueError(f"not a whole, positive number of microseconds: {text!r}")
    return total_ns // 1000


def duration_ns(text: str | int) -> int:
    return duration_us(text) * 1000


def to_us(value: object) -> int | None:
    """Microseconds since 1970 of None, a number of microseconds, a string, or a Python, NumPy or pandas time."""
    if value is None:
        return None
    if isinstance(value, int | np.integer):
        return int(value)
    stamp = pd.Timestamp(value)
    if stamp.tzinfo is not None:
        stamp = stamp.tz_convert("UTC").tz_localize(None)
    return int(np.datetime64(stamp.to_datetime64(), "us").astype(np.int64))


def epoch_us(col: Column | str) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ.

    The difference of two such times is an interval that no zone enters; ``timestampdiff`` would go
    through the session's zone and miss hours that it skips.
    """
    since = (F.col(col) if isinstance(col, str) else col) - F.expr(EPOCH)
    return (since.cast("interval second").cast("decimal(18,6)") * 1_000_000).cast("long")


def ticks(df: DataFrame, col: str) -> Column:
    """A time in microseconds, or a whole number as it is."""
    return F.col(col).cast("long") if isinstance(df.schema[col].dataType, T.IntegralType) else epoch_us(col)


def from_us(col: Column | str) -> Column:
    """TIMESTAMP_NTZ of microseconds since 1970."""
    us = F.col(col) if isinstance(col, str) else col
    return F.timestamp_add("MICROSECOND", us.cast("long"), F.expr(EPOCH))


def from_ns(col: Column | str) -> Column:
    """TIMESTAMP_NTZ of nanoseconds since 1970, cut to microseconds (downwards)."""
    ns = F.col(col) if isinstance(col, str) else col
    return from_us(F.floor(ns.cast("decimal(20,0)") / 1000))


def as_ntz(df: DataFrame, col: str) -> DataFrame:
    """``col`` as TIMESTAMP_NTZ: dates and timestamps are cast, numbers are nanoseconds, strings that don't parse become null."""
    kind = df.schema[col].dataType
    if isinstance(kind, T.TimestampNTZType):
        return df
    if isinstance(kind, T.DateType | T.TimestampType):
        return df.withColumn(col, F.col(col).cast("timestamp_ntz"))
    if isinstance(kind, T.NumericType):
        return df.withColumn(col, from_ns(F.col(col)))
    return df.withColumn(col, F.col(col).try_cast("timestamp_ntz"))


def floor_us(us: Column, width: int) -> Column:
    """Start of the left-closed bucket of ``width`` microseconds."""
    return us - F.pmod(us, F.lit(width))


def ceil_us(us: Column, width: int) -> Column:
    """End of the right-closed bucket of ``width`` microseconds."""
    return us + F.pmod(-us, F.lit(width))


def offset(ts: Column | str, by: str, back: bool = False) -> Column:
    """``ts`` moved by a duration."""
    us = duration_us(by)
    return F.timestamp_add("MICROSECOND", F.lit(-us if back else us).cast("long"), F.col(ts) if isinstance(ts, str) else ts)


def day_of(ts: Column | str) -> Column:
    return (F.col(ts) if isinstance(ts, str) else ts).cast("date")


def dates_between(start: str, end: str) -> list[str]:
    """All days from ``start`` to ``end``, both included."""
    a, b = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    if a > b:
        raise ValueError(f"start {start} is after end {end}")
    return [(a + dt.timedelta(days=k)).isoformat() for k in range((b - a).days + 1)]
