"""Order-book factors, derived factors, time of day and leading trims."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import finite_or_null, quotient, ratio, sum_of
from tidemark.functions.timeops import epoch_us, to_us
from tidemark.operators.checks import require_columns, require_rows

LEVELS = 25
EPS = 1e-9


def book_columns(levels: int = LEVELS) -> list[str]:
    """Flat names of a book snapshot: side[level].price and side[level].amount."""
    return [f"{side}[{k}].{what}" for what in ("price", "amount") for side in ("asks", "bids") for k in range(levels)]


def base_factors(df: DataFrame, by: list[str], ts: str = "ts", levels: int = LEVELS, keep: list[str] | None = None) -> DataFrame:
    """vwap, imbalance (asks minus bids), spread, mid and log return of a snapshot's levels.

    A null level counts as 0; no amount at all gives null vwap and imbalance. The first row of each
    group has no return.
    """
    require_columns(df, book_columns(levels), "book snapshot")
    q = {(s, w): [F.col(f"`{s}[{k}].{w}`") for k in range(levels)] for s in ("asks", "bids") for w in ("price", "amount")}
    ask, bid = sum_of(q["asks", "amount"]), sum_of(q["bids", "amount"])
    paid = sum_of([p * a for s in ("asks", "bids") for p, a in zip(q[s, "price"], q[s, "amount"], strict=True)])
    best_ask, best_bid = q["asks", "price"][0], q["bids", "price"][0]
    out = df.select(
        *(keep if keep is not None else [*by, ts]),
        ratio(paid, ask + bid).alias("vwap"),
        ratio(ask - bid, ask + bid).alias("imbalance"),
        (best_ask - best_bid).alias("spread"),
        ((best_ask + best_bid) / 2).alias("mid"),
    )
    out = log_return(out, "mid", by, ts)
    return out.withColumns({c: finite_or_null(F.col(c)) for c in ("vwap", "imbalance", "spread", "mid", "log_return")})


def log_return(df: DataFrame, col: str, by: list[str], ts: str = "ts", name: str = "log_return", tie: list[str] | None = None) -> DataFrame:
    """ln(x) minus that of the row before, inside each group."""
    order = Window.partitionBy(*by).orderBy(ts, *(tie or []))
    return df.withColumn(name, F.ln(col) - F.lag(F.ln(col)).over(order))


def derived_factors(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Ratios and squares of the base factors and of the volatilities ``vol_*m_lag0``; with time-of-day columns if ``ts`` is a time.

    Spread and vwap's distance are shares of mid (infinite where mid is 0); volatilities are divided by one that is lifted by ``EPS``.
    """
    c = F.col
    over = lambda x, y: c(x) / (c(y) + EPS)
    made = {
        "spread_pct": quotient(c("spread"), c("mid")),
        "vwap_mid_diff": quotient(c("vwap") - c("mid"), c("mid")),
        "vol_ratio_1_5": over("vol_1m_lag0", "vol_5m_lag0"),
        "vol_ratio_5_30": over("vol_5m_lag0", "vol_30m_lag0"),
        "vol_ratio_5_60": over("vol_5m_lag0", "vol_60m_lag0"),
        "vol_ratio_30_120": over("vol_30m_lag0", "vol_120m_lag0"),
        "imbalance_sq": c("imbalance") * c("imbalance"),
        "abs_imbalance": F.abs("imbalance"),
        "lr_sq": c("log_return") * c("log_return"),
        "lr_abs": F.abs("log_return"),
    }
    return time_of_day(df.withColumns(made), ts)


def time_of_day(df: DataFrame, ts: str = "ts") -> DataFrame:
    """hour, minute, and the minute of the day as a point on a circle; unchanged if ``ts`` is absent or no time."""
    if ts not in df.columns or not isinstance(df.schema[ts].dataType, T.TimestampNTZType | T.TimestampType):
        return df
    angle = (F.hour(ts) * 60 + F.minute(ts)) * (2 * math.pi / 1440)
    return df.withColumns({"hour": F.hour(ts), "minute": F.minute(ts), "tod_sin": F.sin(angle), "tod_cos": F.cos(angle)})


def trim_leading(df: DataFrame, minutes: int = 15, ts: str = "ts") -> DataFrame:
    """Rows whose time of day is at least ``minutes`` after midnight, on every day."""
    require_columns(df, [ts])
    return df.where(F.hour(ts) * 60 + F.minute(ts) >= minutes)


def time_range(df: DataFrame, start: object = None, end: object = None, ts: str = "ts", check: bool = False) -> DataFrame:
    """start <= ts <= end; an open end is None. ``check`` raises if nothing is left."""
    us = epoch_us(ts) if isinstance(df.schema[ts].dataType, T.TimestampNTZType) else F.col(ts)
    if start is not None:
        df = df.where(us >= to_us(start)) if not isinstance(df.schema[ts].dataType, T.TimestampNTZType) else df.where(F.col(ts) >= F.lit(_stamp(start)).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(us <= to_us(end)) if not isinstance(df.schema[ts].dataType, T.TimestampNTZType) else df.where(F.col(ts) <= F.lit(_stamp(end)).cast("timestamp_ntz"))
    return require_rows(df, "time range") if check else df


def _stamp(value: object) -> str:
    """Text of a time, for a literal that the Parquet scan can take as a pushed filter."""
    import pandas as pd

    return str(pd.Timestamp(to_us(value), unit="us"))


def clip_to(df: DataFrame, other: DataFrame, by: list[str], ts: str = "ts", other_ts: str = "ts_grid") -> DataFrame:
    """Rows between the first and last time of ``other`` in the same group, both included."""
    ends = other.groupBy(*by).agg(F.min(other_ts).alias("_a"), F.max(other_ts).alias("_b"))
    return df.join(ends, by).where(F.col(ts).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")
