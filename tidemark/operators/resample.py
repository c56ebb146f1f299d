"""Aggregation plans, tumbling and trailing windows, and collapsing of repeated times."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import no_nulls
from tidemark.functions.timeops import DAY_US, ceil_us, duration_us, epoch_us, floor_us, from_us, ticks


@dataclass(frozen=True)
class AggItem:
    """One output of a plan: ``how`` is last, mean or std; the target is no feature."""

    source: str
    how: str
    name: str
    feature: bool = True


def agg_plan(cols: list[str], target: str | None = None, multi: tuple[str, ...] = ()) -> list[AggItem]:
    """Target: its last value under its own name. Columns in ``multi`` or named ``*_mean``: last, mean and std. Others: last."""
    plan = [AggItem(target, "last", target, False)] if target else []
    for c in cols:
        if c != target:
            many = c in multi or c.endswith("_mean")
            plan += [AggItem(c, how, f"{c}_{how}") for how in (("last", "mean", "std") if many else ("last",))]
    return plan


def feature_names(plan: list[AggItem]) -> list[str]:
    return [x.name for x in plan if x.feature]


def plan_columns(plan: list[AggItem], order: Column) -> list[Column]:
    """Aggregates of a plan; ``order`` says which row is last. The sample std of one row is 0."""
    make = {
        "last": lambda c: F.max_by(c, order),
        "mean": lambda c: F.avg(c),
        "std": lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0)),
    }
    return [make[x.how](F.col(f"`{x.source}`")).alias(x.name) for x in plan]


def _order(ts: str, tie: list[str] | None) -> Column:
    return F.struct(ts, *(tie or []))


def downsample_right(df: DataFrame, width: str | int, by: list[str], plan: list[AggItem], ts: str = "ts", tie: list[str] | None = None, drop_nulls: bool = True) -> DataFrame:
    """Right-closed buckets (t - width, t] labelled t, counted from 1970."""
    end = from_us(ceil_us(epoch_us(ts), duration_us(width)))
    out = df.groupBy(*by, end.alias("_end")).agg(*plan_columns(plan, _order(ts, tie))).withColumnRenamed("_end", ts)
    return no_nulls(out) if drop_nulls else out


def downsample_left(df: DataFrame, width: str | int, by: list[str], cols: list[str], ts: str = "ts") -> DataFrame:
    """Left-closed buckets [t, t + width) labelled t: mean of each column."""
    start = from_us(floor_us(epoch_us(ts), duration_us(width)))
    return df.groupBy(*by, start.alias("_start")).agg(*[F.avg(c).alias(c) for c in cols]).withColumnRenamed("_start", ts)


def with_halo(df: DataFrame, reach: int, by: list[str], ts: str = "ts", back: bool = True, buckets: int = 64) -> DataFrame:
    """Rows with ``_us``, their own time bucket ``_own`` and the bucket ``_in`` that they are dealt to.

    A bucket also gets the rows up to ``reach`` microseconds before it (behind it, if not ``back``), so that windows of
    that width over (``by``, ``_in``) are whole for its own rows. A hot group is spread over as many tasks as it has buckets.
    """
    width = max(1, reach + 1) * buckets
    us = epoch_us(ts)
    own, other = floor_us(us, width), floor_us(us + reach if back else us - reach, width)
    return df.withColumn("_us", us).withColumn("_own", own).withColumn("_in", F.explode(F.when(own == other, F.array(own)).otherwise(F.array(own, other))))


def previous(df: DataFrame, col: str, by: list[str], ts: str = "ts", tie: list[str] | None = None, name: str = "previous", bucket: str | int = DAY_US) -> DataFrame:
    """The value of the row before, in its group. Rows are dealt to (group, time bucket); a bucket's last row is carried to the next by a row per bucket."""
    order, by_bucket = [ts, *(tie or [])], [*by, "_bucket"]
    rows = df.withColumn("_bucket", floor_us(ticks(df, ts), duration_us(bucket)))
    own = F.lag(F.struct(F.col(col).alias("x"))).over(Window.partitionBy(*by_bucket).orderBy(*order))
    ends = rows.groupBy(*by_bucket).agg(F.max_by(F.struct(F.col(col).alias("x")), F.struct(*order)).alias("_end"))
    ends = ends.select(*by_bucket, F.lag("_end").over(Window.partitionBy(*by).orderBy("_bucket")).alias("_carried"))
    out = rows.withColumn("_before", own).join(ends, by_bucket, "left")
    return out.select(*df.columns, F.coalesce("_before", "_carried")["x"].alias(name))


def rolling_trailing(df: DataFrame, width: str | int, by: list[str], plan: list[AggItem], ts: str = "ts", tie: list[str] | None = None, keep: list[str] | None = None, buckets: int = 64, drop_nulls: bool = False, tasks: int | None = None) -> DataFrame:
    """For each row the plan over (t - width, t]; rows of equal time see each other.

    Time is cut into blocks of one ``width``. A window is then the end of one block and the beginning of the next: both are
    running aggregates, from either side of a block, and each row looks up the one that begins behind its t - width.
    So the work doesn't grow with the rows in a window, and nothing is ever subtracted: counts, sums and variances of the two
    parts are combined, which loses no digits and lets a NaN or infinity go with its row.

    Rows are dealt once, to (group, time bucket of ``buckets`` widths); those of a bucket's last width also go to the next
    bucket as its halo. So the shuffle grows by 1 / ``buckets`` at most, and a hot group isn't sorted by one task.
    ``tasks``: how many get them, where the caller knows the rows; else as many as the session's shuffles have.
    """
    w = duration_us(width)
    keep = keep if keep is not None else [*by, ts]
    moments = list(dict.fromkeys(x.source for x in plan if x.how != "last"))
    deal = [F.col(f"`{c}`").alias(f"_g{k}") for k, c in enumerate(by)]
    kept = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)]) if keep else F.lit(0)
    rows = with_halo(df, w - 1, by, ts, buckets=buckets).select(
        *deal,
        "_in",
        "_us",
        (F.col("_in") == F.col("_own")).alias("_mine"),
        F.expr(f"_us div {w} - if(_us % {w} < 0, 1, 0)").alias("_block"),
        kept.alias("_keep"),
        F.struct(*[F.col(f"`{c}`") for c in (tie or [])]).alias("_tie") if tie else F.lit(0).alias("_tie"),
        *[F.col(f"`{x.source}`").alias(f"_v{k}") for k, x in enumerate(plan) if x.how == "last"],
        *[F.col(f"`{c}`").cast("double").alias(f"_m{k}") for k, c in enumerate(moments)],
    )
    cell = [*[f"_g{k}" for k in range(len(by))], "_in"]
    rows = rows.repartition(*([tasks] if tasks else []), *cell)  # all windows below are within these
    block = Window.partitionBy(*cell, "_block")
    begin = block.orderBy("_us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    end = block.orderBy(F.desc("_us")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    peers = block.orderBy("_us").rangeBetween(0, 0)

    def state(frame) -> Column:
        parts = [F.struct(F.count(f"_m{k}").over(frame).alias("n"), F.sum(f"_m{k}").over(frame).alias("s"), F.var_pop(f"_m{k}").over(frame).alias("v")).alias(f"m{k}") for k in range(len(moments))]
        return F.struct(F.lit(0).alias("some"), *parts)

    lasts = [F.max_by(f"_v{k}", "_tie").over(peers).alias(f"l{k}") for k, x in enumerate(plan) if x.how == "last"]
    rows = rows.select(*cell, "_us", "_block", "_mine", "_keep", state(begin).alias("_begin"), state(end).alias("_end"), F.struct(F.lit(0).alias("some"), *lasts).alias("_last"))
    # each row stands in its block with the aggregate behind it, and asks in the block before at its own t - width
    have = F.struct(F.col("_block").alias("b"), F.col("_us").alias("at"), F.lit(1).alias("has"), F.col("_end").alias("state"), F.when(F.lit(False), F.struct("_keep", "_begin", "_last")).alias("row"))
    ask = F.struct((F.col("_block") - 1).alias("b"), (F.col("_us") - w).alias("at"), F.lit(0).alias("has"), F.when(F.lit(False), F.col("_end")).alias("state"), F.struct("_keep", "_begin", "_last").alias("row"))
    both = rows.select(*cell, F.explode(F.when(F.col("_mine"), F.array(have, ask)).otherwise(F.array(have))).alias("x"))
    both = both.select(*cell, F.col("x.b").alias("_block"), F.col("x.at").alias("_at"), F.col("x.has").alias("_has"), F.col("x.state").alias("_state"), F.col("x.row").alias("_row"))
    behind = block.orderBy(F.desc("_at"), "_has").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_found", F.last("_state", ignorenulls=True).over(behind)).where("_has = 0")

    def value(k: int, x: AggItem) -> Column:
        if x.how == "last":
            return F.col(f"_row._last.l{k}")
        m = moments.index(x.source)
        n1, s1, v1 = (F.coalesce(F.col(f"_row._begin.m{m}.{c}"), F.lit(0.0)) for c in "nsv")
        n2, s2, v2 = (F.coalesce(F.col(f"_found.m{m}.{c}"), F.lit(0.0)) for c in "nsv")
        n = n1 + n2
        if x.how == "mean":
            return F.when(n > 0, (s1 + s2) / n)
        apart = F.when((n1 > 0) & (n2 > 0), F.try_divide(s1, n1) - F.try_divide(s2, n2)).otherwise(0.0)
        spread = n1 * v1 + n2 * v2 + F.try_divide(apart * apart * n1 * n2, n)
        return F.when(n > 1, F.sqrt(spread / (n - 1))).otherwise(0.0)

    out = found.select(*[F.col(f"_row._keep.c{k}").alias(c) for k, c in enumerate(keep)], *[value(k, x).alias(x.name) for k, x in enumerate(plan)])
    return no_nulls(out) if drop_nulls else out


def last_by_time(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row for each ``by``: that which comes last by ``order``, whole."""
    rest = [c for c in df.columns if c not in by]
    out = df.groupBy(*by).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("_last"))
    return out.select(*by, "_last.*")


def bucket_last_ceil(df: DataFrame, width: str | int, by: list[str], order: list[str], ts: str = "ts", label: str = "ts_grid") -> DataFrame:
    """Last row of each right-closed bucket, labelled by the bucket's end."""
    return last_by_time(df.withColumn(label, from_us(ceil_us(epoch_us(ts), duration_us(width)))), [*by, label], order)


def first_by_bucket(df: DataFrame, width: str | int, by: list[str], cols: list[str], ts: str = "ts") -> DataFrame:
    """First value that isn't null, per column, of each left-closed bucket."""
    start = from_us(floor_us(epoch_us(ts), duration_us(width)))
    return df.groupBy(*by, start.alias("bucket")).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), epoch_us(ts))).alias(c) for c in cols])
