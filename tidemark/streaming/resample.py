"""Tumbling downsampling of a stream: the batch plan under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeops import duration_us
from tidemark.operators.resample import AggItem, plan_columns


def stream_downsample(df: DataFrame, width: str, late: str, by: list[str], plan: list[AggItem], ts: str = "ts", right_closed: bool = True, tie: list[str] | None = None) -> DataFrame:
    """Buckets (t - width, t] labelled t, or [t, t + width) labelled t, given out once no row up to ``late`` behind can come.

    ``ts`` must be a TIMESTAMP (watermarks don't take NTZ in every sink). State holds open buckets only.
    """
    shift = 1 if right_closed else 0
    moved = df.withColumn("_at", F.timestamp_add("MICROSECOND", F.lit(-shift).cast("long"), F.col(ts))).withWatermark("_at", f"{duration_us(late)} microseconds")
    frame = F.window("_at", f"{duration_us(width)} microseconds")
    out = moved.groupBy(*by, frame.alias("_w")).agg(*plan_columns(plan, F.struct(ts, *(tie or []))))
    return out.withColumn(ts, F.col("_w.end" if right_closed else "_w.start")).drop("_w")
