"""Regular grids and as-of joins to the last row at or before a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timeops import DAY_US, ceil_us, duration_us, epoch_us, floor_us, from_us


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], ts: str = "ts", right_ts: str | None = None, cols: list[str] | None = None, tie: list[str] | None = None, bucket: str | int = DAY_US) -> DataFrame:
    """Left rows with the columns of the last right row at or before them, in the same ``by`` group; null if none.

    The matched row is carried as one struct, so its own nulls stay null. Rows of both sides are dealt
    to (group, time bucket); what a bucket's start has seen is the last row of the buckets before it,
    found over one summary row per bucket. So one hot group is spread over as many tasks as it has
    buckets, and no pair of rows is ever made. ``tie`` orders right rows of equal time. Null in ``by`` is a group as others are.
    """
    width, right_ts = duration_us(bucket), right_ts or ts
    cols = cols or [c for c in right.columns if c not in {*by, right_ts}]
    tie = tie or []
    value = F.struct(F.col(right_ts).alias("_ts"), *cols)
    marks = right.select(*by, epoch_us(right_ts).alias("_us"), F.struct(epoch_us(right_ts).alias("us"), *[F.col(t).alias(f"_t{k}") for k, t in enumerate(tie)]).alias("_rank"), value.alias("_value"))
    marks = marks.withColumn("_bucket", floor_us(F.col("_us"), width))
    rows = left.select(*[F.col(c) for c in by], epoch_us(ts).alias("_us"), F.struct(*left.columns).alias("_row")).withColumn("_bucket", floor_us(F.col("_us"), width))
    both = marks.select(*by, "_bucket", "_us", F.lit(0).alias("_side"), "_rank", "_value", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row")).unionByName(
        rows.select(*by, "_bucket", "_us", F.lit(1).alias("_side"), F.lit(None).cast(marks.schema["_rank"].dataType).alias("_rank"), F.lit(None).cast(marks.schema["_value"].dataType).alias("_value"), "_row")
    )
    # one row per bucket of either side: the last value of the buckets before it
    ends = both.groupBy(*by, "_bucket").agg(F.max_by("_value", "_rank").alias("_end"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "_bucket", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_us", "_side", "_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_found", F.last("_value", ignorenulls=True).over(inside)).where("_side = 1")
    ends = ends.select(*[F.col(c).alias(f"_e{k}") for k, c in enumerate([*by, "_bucket"])], "_carried")
    same = [F.col(c).eqNullSafe(F.col(f"_e{k}")) for k, c in enumerate([*by, "_bucket"])]
    found = found.join(ends, same, "left").withColumn("_found", F.coalesce("_found", "_carried"))
    kept = [F.col(f"_found.{c}").alias(c) for c in cols]
    return found.select("_row.*", F.col("_found._ts").alias("matched_ts"), *kept)


def time_grid(df: DataFrame, step: str | int, by: list[str], ts: str = "ts") -> DataFrame:
    """For each group all times from floor(min) to ceil(max), ``step`` apart, both ends included."""
    width = duration_us(step)
    ends = df.groupBy(*by).agg(F.min(epoch_us(ts)).alias("_a"), F.max(epoch_us(ts)).alias("_b"))
    # days first, then the points of each day: no row holds a whole long grid
    a, b = floor_us(F.col("_a"), width), ceil_us(F.col("_b"), width)
    chunk = max(1, DAY_US // width) * width
    parts = ends.select(*by, a.alias("_a"), b.alias("_b")).select(*by, "_b", F.explode(F.sequence("_a", "_b", F.lit(chunk))).alias("_c"))
    points = F.explode(F.sequence("_c", F.least(F.col("_b"), F.col("_c") + chunk - width), F.lit(width)))
    return parts.select(*by, points.alias("_us")).select(*by, from_us("_us").alias(ts))


def locf_grid(df: DataFrame, step: str | int, by: list[str], cols: list[str], ts: str = "ts", tie: list[str] | None = None) -> DataFrame:
    """``df`` on a regular grid: each point has the last row at or before it."""
    return asof_backward(time_grid(df, step, by, ts), df, by, ts, cols=cols, tie=tie)


def block_starts(df: DataFrame, every: str | int, ts: str = "ts") -> DataFrame:
    """Starts of blocks that begin at the earliest time of all."""
    width = duration_us(every)
    ends = df.agg(F.min(epoch_us(ts)).alias("_a"), F.max(epoch_us(ts)).alias("_b")).where("_a is not null")
    return ends.select(F.explode(F.sequence("_a", "_b", F.lit(width))).alias("_us")).select(from_us("_us").alias("block_start"))


def block_of(df: DataFrame, every: str | int, origin: Column, ts: str = "ts") -> DataFrame:
    """``df`` with the start of its block [start, start + every), counted from ``origin`` (a TIMESTAMP_NTZ)."""
    width = duration_us(every)
    return df.withColumn("block_start", from_us(epoch_us(origin) + floor_us(epoch_us(ts) - epoch_us(origin), width)))
