"""Checks that ride along: counted while a frame is written or read, not by jobs of their own.

Each function gives (frame, verify). ``verify`` is called after the first action over the frame; it waits for the counts and
raises ValueError where they tell of faults. A stage that ran twice after a lost executor may count a row twice, so faults are
confirmed by the exact check of ``checks`` before anything is raised; clean counts need no further job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.functions.timeops import duration_us, epoch_us
from tidemark.operators.checks import require_aligned, require_even, require_rows
from tidemark.operators.resample import with_halo

Verify = Callable[[], dict]


def _stepped(df: DataFrame, step: str | int, by: list[str], ts: str) -> tuple[DataFrame, list[Column]]:
    """Rows with the distance to the row before where that is within reach, and what is counted of them.

    Rows are dealt to (entity, time bucket) with a halo of one step. A row without a row before it within reach must be its
    entity's first: as many such rows as entities (entities are few) means that all are.
    """
    near = with_halo(df, duration_us(step), by, ts)
    inside = Window.partitionBy(*by, "_in").orderBy("_us")
    near = near.withColumn("_step", F.col("_us") - F.lag("_us").over(inside)).where("_in = _own")
    alone = F.col("_step").isNull()
    entity = F.struct(*[F.col(f"`{c}`") for c in by]) if by else F.lit(0)
    counts = [
        F.count(F.lit(1)).alias("n_rows"),
        F.size(F.collect_set(F.when(alone, entity))).cast("long").alias("n_groups"),
        (F.count_if(F.col("_step") != duration_us(step)) + F.count_if(alone) - F.size(F.collect_set(F.when(alone, entity)))).alias("n_off"),
    ]
    return near, counts


def even_counts(df: DataFrame, step: str | int, by: list[str], ts: str = "ts") -> DataFrame:
    """One row: n_rows, n_groups, n_off (rows that aren't one step behind the row before, but for each entity's first)."""
    near, counts = _stepped(df, step, by, ts)
    return near.agg(*counts)


def watch_even(df: DataFrame, step: str | int, by: list[str], ts: str = "ts") -> tuple[DataFrame, Verify]:
    """``df`` while its times are checked to be ``step`` apart in each entity."""
    seen = Observation()
    near, counts = _stepped(df, step, by, ts)

    def verify() -> dict:
        got = seen.get
        if got["n_off"] or got["n_rows"] <= got["n_groups"]:
            require_even(df, ts, tuple(by), step)
        return got

    return near.observe(seen, *counts).drop("_us", "_own", "_in", "_step"), verify


def watch_aligned(df: DataFrame, left: str, right: str, delta: str | int = 0, allow_empty: bool = False, drop: bool = True) -> tuple[DataFrame, Verify]:
    """``df`` while right - left is checked to be ``delta`` wherever ``right`` is there."""
    want, seen = 0 if delta in (0, "0") else duration_us(delta), Observation()
    out = df.observe(seen, F.count(right).alias("n_joined"), F.count_if(epoch_us(right) - epoch_us(left) != want).alias("n_off"))

    def verify() -> dict:
        got = seen.get
        if got["n_off"] or not (got["n_joined"] or allow_empty):
            require_aligned(df, left, right, delta, allow_empty)
        return got

    return out.drop(right) if drop else out, verify


def watch_rows(df: DataFrame, what: str = "input") -> tuple[DataFrame, Verify]:
    """``df`` while its rows are counted; none at all is an error."""
    seen = Observation()

    def verify() -> dict:
        got = seen.get
        if not got["n_rows"]:
            require_rows(df, what)
        return got

    return df.observe(seen, F.count(F.lit(1)).alias("n_rows")), verify


def stop_if(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """``df``; the job that meets a row where ``bad`` is true fails with ``message``."""
    return df.where(F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True))
