"""Input checks that raise ValueError. Each runs one small aggregate at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timeops import DAY_US, duration_us, epoch_us, floor_us, ticks


def require_columns(df: DataFrame, names: list[str], what: str = "input") -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}")


def require_known(names: list[str], known: list[str], what: str) -> None:
    """All of ``names`` are among the allowed ones."""
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"unknown {what}: {unknown}; allowed are {sorted(known)}")


def steps(df: DataFrame, ts: str = "ts", by: tuple[str, ...] = (), bucket: str | int = DAY_US) -> DataFrame:
    """(step, n): distances between neighbouring times of each entity, with their counts; in microseconds, or in a whole number's own unit."""
    return _steps(df, ts, by, bucket).groupBy("step").agg(F.count("*").alias("n"))


def even_groups(df: DataFrame, by: tuple[str, ...], ts: str = "ts") -> DataFrame:
    """The entities whose times are evenly spaced (two times at least), for runs that leave out the others."""
    return _steps(df, ts, by).groupBy(*by).agg(F.min("step").alias("_a"), F.max("step").alias("_b")).where("_a = _b").select(*by)


def _steps(df: DataFrame, ts: str, by: tuple[str, ...], bucket: str | int = DAY_US) -> DataFrame:
    """The entity and the distance, for each two neighbouring times.

    Rows are dealt to (entity, time bucket), so that one long entity isn't sorted by one task; the step into a bucket is
    found over one summary row per bucket.
    """
    plain = isinstance(df.schema[ts].dataType, T.IntegralType)
    width = duration_us(bucket) * (1000 if plain else 1)
    rows = df.select(*by, ticks(df, ts).alias("_us")).where("_us is not null").withColumn("_bucket", floor_us(F.col("_us"), width))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_us")
    own = rows.select(*by, (F.col("_us") - F.lag("_us").over(inside)).alias("step"))
    ends = rows.groupBy(*by, "_bucket").agg(F.min("_us").alias("_a"), F.max("_us").alias("_b"))
    across = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bucket")
    between = ends.select(*by, (F.col("_a") - F.lag("_b").over(across)).alias("step"))
    return own.unionAll(between).where("step is not null")


def require_even(df: DataFrame, ts: str = "ts", by: tuple[str, ...] = (), step: str | int | None = None) -> int:
    """The one step between neighbouring times; raises if there are several, none, or another than ``step``. Whole numbers keep their unit."""
    found = [r.step for r in steps(df, ts, by).limit(2).collect()]
    if len(found) != 1:
        raise ValueError("times are not evenly spaced" if found else "fewer than two times")
    if step is not None and found[0] != duration_us(step):
        raise ValueError(f"step is {found[0]} us, wanted {duration_us(step)}")
    return found[0]


def grid_faults(df: DataFrame, step: str | int, ts: str = "ts", by: tuple[str, ...] = ()) -> DataFrame:
    """Per entity: rows, rows whose distance to the one before isn't ``step``, missing grid points."""
    width = duration_us(step)
    rows = df.select(*by, F.lit(None).cast("long").alias("step"), F.lit(1).alias("row"))
    rows = rows.unionAll(_steps(df, ts, by).select(*by, "step", F.lit(0).alias("row")))
    bad = (F.col("step") != width).cast("long")
    missing = F.greatest(F.expr(f"step div {width}") - 1, F.lit(0))
    return rows.groupBy(*by).agg(
        F.sum("row").alias("n_rows"), F.coalesce(F.sum(bad), F.lit(0)).alias("n_uneven"), F.coalesce(F.sum(F.when(F.col("step").isNotNull(), missing)), F.lit(0)).alias("n_missing")
    )


def divisible(lag: str | int, step: int) -> int:
    """Whole number of steps in ``lag``."""
    us = duration_us(lag)
    if us % step:
        raise ValueError(f"{lag!r} is no multiple of the step of {step} us")
    return us // step


def require_aligned(df: DataFrame, left: str, right: str, delta: str | int = 0, allow_empty: bool = False, drop: bool = True) -> DataFrame:
    """Rows where ``right`` is present must have right - left = ``delta``; both helper columns can be dropped."""
    want = 0 if delta in (0, "0") else duration_us(delta)
    apart = epoch_us(right) - epoch_us(left)
    got = df.where(F.col(right).isNotNull()).agg(F.count("*").alias("n"), F.count_if(apart != want).alias("bad")).first()
    if not got.n and not allow_empty:
        raise ValueError("nothing joined")
    if got.bad:
        raise ValueError(f"{got.bad} of {got.n} rows are not {want} us apart")
    return df.drop(right) if drop else df


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def require_history(df: DataFrame, start: Column, ts: str = "ts") -> None:
    """The earliest time is at or before ``start``."""
    if not df.agg(F.coalesce(F.min(ts) <= start, F.lit(False)).alias("ok")).first().ok:
        raise ValueError("history doesn't reach back to the start of the window")


def readiness(df: DataFrame, by: list[str], start: Column, least: int, ts: str = "ts") -> DataFrame:
    """Per entity, in one aggregate: first_ts, last_ts, n_days (with rows), full_history (rows at or before ``start``), enough_days (``least``).

    For runs that leave out what ``require_history`` and ``require_days`` would raise on. Null times count for nothing; an entity
    without any has null times, no days and neither history nor days enough.
    """
    made = df.groupBy(*by).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.countDistinct(F.to_date(ts)).alias("n_days"))
    return made.withColumns({"full_history": F.coalesce(F.col("first_ts") <= start, F.lit(False)), "enough_days": F.col("n_days") >= least})


def require_days(df: DataFrame, least: int, day: str = "date") -> list:
    """Sorted distinct days, ``least`` at least (days are few; they come to the driver)."""
    days = sorted(r[0] for r in df.select(day).distinct().collect())
    if len(days) < least:
        raise ValueError(f"{len(days)} days, needed are {least}")
    return days
