"""Trailing windows and as-of joins on streams: whole time buckets leave the state under a watermark, the batch operators do the rest.

A row is dealt to its group's time bucket and, if a later bucket's rows look back on it, to that one as well (its halo). A bucket
is given out once, whole, when the watermark has passed its end; state is bounded by the rows of open buckets (bucket
width and lateness), and the watermark is the timer that drops them. A group is spread over its buckets, so a hot group isn't one state.
State lists are written anew with every micro-batch that has rows of them: keep ``buckets`` small where batches come often.

What is given out is computed by ``rolling_trailing`` and ``asof_backward`` themselves and lands as Parquet, a folder per
micro-batch that is overwritten when a batch is run again after a failure, so each row is there once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.timeops import duration_us
from tidemark.operators.asof import asof_backward
from tidemark.operators.resample import AggItem, rolling_trailing, with_halo


def whole_buckets(df: DataFrame, reach: int, late: str, by: list[str], ts: str = "ts", buckets: int = 4) -> DataFrame:
    """(``_bucket``, ``_rows``): all rows of a group's time bucket (and its halo of ``reach`` microseconds), in append mode.

    Rows up to ``late`` behind the latest are waited for; later ones are dropped with the bucket that they belong to.
    ``_rows`` holds the columns of ``df``, ``_us``, ``_own`` and ``_in``. Rows without a time are left out. A row whose ``by`` is null is of the group null.
    """
    width = max(1, reach + 1) * buckets  # as ``with_halo`` cuts time
    rows = with_halo(df.where(F.col(ts).isNotNull()), reach, by, ts, buckets=buckets)
    # a halo row stands at the start of the bucket that it is sent to: at most ``reach`` ahead of its own time
    at = F.timestamp_micros(F.greatest("_us", "_in"))
    rows = rows.select(*[F.col(f"`{c}`").alias(f"_k{k}") for k, c in enumerate(by)], at.alias("_at"), F.struct(*rows.columns).alias("_row"))
    rows = rows.withWatermark("_at", f"{duration_us(late) + reach} microseconds")
    keys = [f"_k{k}" for k in range(len(by))]
    return rows.groupBy(*keys, F.window("_at", f"{width} microseconds").alias("_bucket")).agg(F.collect_list("_row").alias("_rows"))


def start(buckets: DataFrame, apply: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Run ``apply`` over the rows of each batch's whole buckets and append the outcome to the Parquet table ``path``."""

    def step(found: DataFrame, number: int) -> None:
        rows = found.select(F.explode("_rows").alias("_row")).select("_row.*")
        apply(rows).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={number}")

    writer = buckets.writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def trailing_stream(df: DataFrame, width: str | int, late: str, by: list[str], plan: list[AggItem], path: str, checkpoint: str, ts: str = "ts", tie: list[str] | None = None, keep: list[str] | None = None, buckets: int = 4, trigger: dict | None = None) -> StreamingQuery:
    """``rolling_trailing`` of a stream: for each row the plan over (t - width, t], once its bucket is closed."""
    keep = keep if keep is not None else [*by, ts]

    def apply(rows: DataFrame) -> DataFrame:
        own = rows.withColumn("_mine", F.col("_in") == F.col("_own")).withColumnRenamed("_in", "_cell").drop("_us", "_own")
        out = rolling_trailing(own, width, [*by, "_cell"], plan, ts, tie, [*keep, "_mine"], buckets)
        return out.where("_mine").drop("_mine")

    return start(whole_buckets(df, duration_us(width) - 1, late, by, ts, buckets), apply, path, checkpoint, trigger)


def asof_stream(left: DataFrame, right: DataFrame, by: list[str], within: str | int, late: str, path: str, checkpoint: str, ts: str = "ts", cols: list[str] | None = None, tie: list[str] | None = None, buckets: int = 4, trigger: dict | None = None) -> StreamingQuery:
    """``asof_backward`` of two streams: left rows with the last right row at or before them, not longer than ``within`` ago; null if none.

    The bound is what keeps state finite. Both sides share one state; ``late`` counts from the later of the two sides, so a side that
    lags behind the other by more loses rows.
    """
    reach = duration_us(within)
    cols = cols or [c for c in right.columns if c not in {*by, ts}]
    sides = [df.select(*by, ts, F.lit(k).alias("_side"), *[(F.struct(*d.columns) if d is df else F.lit(None).cast(d.select(F.struct(*d.columns).alias("x")).schema["x"].dataType)).alias(n) for n, d in (("_left", left), ("_right", right))]) for k, df in enumerate((left, right))]
    both = sides[0].unionByName(sides[1])

    def apply(rows: DataFrame) -> DataFrame:
        rows = rows.withColumnRenamed("_in", "_cell")
        own = rows.where("_side = 0 and _cell = _own").select("_cell", "_left.*")
        seen = rows.where("_side = 1").select("_cell", "_right.*")
        out = asof_backward(own, seen, [*by, "_cell"], ts, cols=cols, tie=tie, bucket=(reach + 1) * buckets).drop("_cell")
        near = F.unix_micros(F.col(ts)) - F.unix_micros("matched_ts") <= reach
        return out.withColumns({c: F.when(near, F.col(f"`{c}`")) for c in ["matched_ts", *cols]})

    return start(whole_buckets(both, reach, late, by, ts, buckets), apply, path, checkpoint, trigger)
