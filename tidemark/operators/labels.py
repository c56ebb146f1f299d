"""Volatility as features and forward labels; lag features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timeops import duration_us, epoch_us
from tidemark.operators.checks import divisible, require_aligned, require_even, require_known, steps
from tidemark.operators.resample import with_halo

JOINS = ("left", "right", "full", "inner", "cross")


def feature_join(origin: DataFrame, vol: DataFrame, cols: list[str], by: list[str], ts: str = "ts", vol_ts: str = "ts_grid", how: str = "left", suffix: str = "_lag0", check: bool = False) -> DataFrame:
    """Equal-time join; each column of ``cols`` arrives as name + ``suffix``."""
    require_known(cols, vol.columns, "volatility columns")
    if how not in JOINS:
        raise ValueError(f"how must be one of {JOINS}")
    right = vol.select(*by, F.col(vol_ts).alias(ts), F.col(vol_ts).alias("_matched"), *[F.col(c).alias(f"{c}{suffix}") for c in cols])
    if how == "cross":
        right = right.withColumnsRenamed({c: f"_{c}" for c in [*by, ts]})
        out = origin.join(right, F.lit(True), "inner")
        out = out.drop(*[f"_{c}" for c in [*by, ts]])
    else:
        out = origin.join(right, [*by, ts], how)
    return require_aligned(out, ts, "_matched", allow_empty=True) if check else out.drop("_matched")


def forward_labels(df: DataFrame, cols: list[str], ahead: str | int, by: list[str], ts: str = "ts", prefix: str = "y_", step: str | int | None = None, check: bool = True) -> DataFrame:
    """Value ``ahead`` later on an even grid, as ``prefix`` + name; null in each group's tail, whose rows stay.

    With ``check`` the grid is verified to be even; without it ``step`` must be given.
    """
    if not check and step is None:
        raise ValueError("an unchecked grid needs a step")
    width = require_even(df, ts, tuple(by), step) if check else duration_us(step)
    k = divisible(ahead, width)
    if not check:
        order = Window.partitionBy(*by).orderBy(ts)
        return df.select("*", *[F.lead(c, k).over(order).alias(f"{prefix}{c}") for c in cols])
    near, inside = with_halo(df, duration_us(ahead), by, ts, back=False), Window.partitionBy(*by, "_in").orderBy("_us")
    out = near.select("*", *[F.lead(c, k).over(inside).alias(f"{prefix}{c}") for c in cols]).where("_in = _own")
    return out.drop("_us", "_own", "_in")


def forward_labels_by_time(df: DataFrame, cols: list[str], ahead: str | int, by: list[str], ts: str = "ts", prefix: str = "y_") -> DataFrame:
    """The same by an equal-time join with the rows moved back: exact with gaps, too."""
    moved = df.select(*by, F.timestamp_add("MICROSECOND", F.lit(-duration_us(ahead)).cast("long"), F.col(ts)).alias(ts), *[F.col(c).alias(f"{prefix}{c}") for c in cols])
    return df.join(moved, [*by, ts], "left")


def label_join(origin: DataFrame, vol: DataFrame, cols: list[str], ahead: str | int, by: list[str], ts: str = "ts", vol_ts: str = "ts_grid", how: str = "inner", step: str | int | None = None, check: bool = True) -> DataFrame:
    """``origin`` with forward labels of ``vol`` at the same time."""
    shifted = forward_labels(vol.select(*by, F.col(vol_ts).alias(ts), *cols), cols, ahead, by, ts, step=step, check=check).drop(*cols)
    return origin.join(shifted, [*by, ts], how)


def lag_features(df: DataFrame, col: str, lags: list[str], by: list[str], ts: str = "ts", prefix: str | None = None, step: int | None = None, check: bool = True) -> DataFrame:
    """``prefix_lag<d>``: the value d earlier, counted in rows of the median step. A ``_lag0`` at the name's end goes.

    With ``check`` each lag's row must lie exactly d back (a missing row raises); rows of a group's start have no lag.
    """
    if step is None:
        got = steps(df, ts, tuple(by)).agg(F.percentile("step", 0.5, F.col("n")).alias("step")).first().step
        if got is None:
            raise ValueError("fewer than two times")
        step = int(got)
    name, order = (prefix or col).removesuffix("_lag0"), Window.partitionBy(*by).orderBy(ts)
    rows = {d: divisible(d, step) for d in lags}
    if not check:
        return df.select("*", *[F.lag(col, n).over(order).alias(f"{name}_lag{d}") for d, n in rows.items()])
    near, inside = with_halo(df, max(map(duration_us, lags)), by, ts), Window.partitionBy(*by, "_in").orderBy("_us")
    made = [(F.lag(col, n).over(inside).alias(f"{name}_lag{d}"), F.lag("_us", n).over(inside).alias(f"_at{k}")) for k, (d, n) in enumerate(rows.items())]
    out = near.select("*", *[c for both in made for c in both]).where("_in = _own")
    # off the grid: a row that lies elsewhere than d back, or none there although the group began by then
    firsts = df.groupBy(*by).agg(F.min(epoch_us(ts)).alias("_first"))
    off = [F.coalesce(F.col("_us") - F.col(f"_at{k}") != duration_us(d), F.col("_us") - duration_us(d) >= F.col("_first")) for k, d in enumerate(rows)]
    bad = out.join(firsts, by).agg(*[F.count_if(x).alias(d) for d, x in zip(rows, off, strict=True)]).first().asDict()
    if any(bad.values()):
        raise ValueError(f"rows whose lag isn't exactly as long as wanted: {bad}")
    return out.drop("_us", "_own", "_in", *[f"_at{k}" for k in range(len(rows))])
