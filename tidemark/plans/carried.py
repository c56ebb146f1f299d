"""Rolling windows carried forward: each arriving day (or block) is aggregated once, windows are put together from what is stored.

A full build (``operators.datasets.training_sample`` over ``rolling_splits``) reads a row once for every window that it is in. Here a
unit's rows are read when it arrives, and three small tables are kept, a partition per unit, published whole (``sources.publish``):

* parts: per group and right-closed bucket what the plan's aggregates need (last row; count, mean and squared spread), which
  combine where a bucket reaches over two units;
* trails: the trailing windows of its rows, once for each number of earlier units of the same split that they may look back on;
* tails: its last rows within one width, for the units behind it (only if a split to predict has several units).

So a step forward costs one unit and the sizes of the aggregates, whatever the length of the train window. A run that died is
run again: units whose parts are in place are left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import no_nulls
from tidemark.functions.timeops import ceil_us, duration_us, epoch_us, from_us
from tidemark.operators.datasets import window_rows
from tidemark.operators.resample import AggItem, rolling_trailing
from tidemark.sources.publish import done_partitions, publish, read_published

PARTS, TRAILS, TAILS = "carried_parts", "carried_trails", "carried_tails"
#: Rows that a task of the trailing windows gets, or about one group's part if that has more.
TASK_ROWS = 25_000


@dataclass(frozen=True)
class Carried:
    """Where and how windows are carried: units are named by column ``unit``, whose values must sort as text in order of time."""

    root: str
    freq: str
    by: tuple[str, ...]
    plan: tuple[AggItem, ...]
    train: int
    val: int
    test: int
    step: int = 1
    unit: str = "date"
    ts: str = "ts"
    tie: tuple[str, ...] = ()

    @property
    def back(self) -> int:
        """Earlier units that a row to predict may look back on at most."""
        return max(self.val, self.test, 1) - 1

    @property
    def moments(self) -> list[str]:
        return list(dict.fromkeys(x.source for x in self.plan if x.how != "last"))


def carried_units(spark: SparkSession, how: Carried) -> list[str]:
    """Units that have arrived, in order."""
    return sorted(unquote(p).split("=", 1)[1] for p in done_partitions(spark, how.root, PARTS, how.freq))


def arrive(df: DataFrame, how: Carried) -> list[str]:
    """Take in the units of ``df`` that haven't arrived yet, behind those that have; gives their names.

    Only ``df`` and the tails of the last units stored are read. Rows without a unit or time are left out; a unit that arrived is
    final, and a new one that isn't behind all stored, or overlaps another in time, raises.
    """
    spark = df.sparkSession
    us = epoch_us(how.ts)
    rows = df.withColumn("unit", F.col(how.unit).cast("string")).where(F.col("unit").isNotNull() & F.col(how.ts).isNotNull())
    done = carried_units(spark, how)
    spans = [r for r in rows.groupBy("unit").agg(F.min(us).alias("a"), F.max(us).alias("b"), F.count("*").alias("n")).orderBy("unit").collect() if r.unit not in done]  # a row a unit
    if not spans:
        return []
    fresh = [r.unit for r in spans]
    if done and fresh[0] <= done[-1]:
        raise ValueError(f"unit {fresh[0]} isn't behind {done[-1]}")
    if any(x.b >= y.a for x, y in zip(spans, spans[1:])):  # noqa: B905
        raise ValueError("units overlap in time, or don't sort as their times")
    rows = rows.where(F.col("unit").isin(fresh)).select(*dict.fromkeys(["unit", *how.by, how.ts, *how.tie, *[x.source for x in how.plan]]))
    if how.back:
        ends = spark.createDataFrame([(r.unit, r.b) for r in spans], "unit string, _last long")
        tail = rows.join(F.broadcast(ends), "unit").where(us > F.col("_last") - duration_us(how.freq)).drop("_last")
        publish(tail, how.root, TAILS, "skip", how.freq)
    publish(_trails(spark, rows, [*done, *fresh], fresh, how, sum(r.n for r in spans)), how.root, TRAILS, "skip", how.freq)
    publish(_parts(rows, how), how.root, PARTS, "skip", how.freq)  # last: it is the mark of a unit taken in
    return fresh


def _parts(rows: DataFrame, how: Carried) -> DataFrame:
    end = from_us(ceil_us(epoch_us(how.ts), duration_us(how.freq)))
    order = F.struct(how.ts, *how.tie)
    lasts = F.struct(F.lit(0).alias("some"), *[F.col(f"`{x.source}`").alias(f"l{k}") for k, x in enumerate(how.plan) if x.how == "last"])
    made = [F.max(order).alias("_at"), F.max_by(lasts, order).alias("_last")]
    for k, c in enumerate(how.moments):
        x = F.col(f"`{c}`").cast("double")
        made.append(F.struct(F.count(x).alias("n"), F.avg(x).alias("m"), (F.var_pop(x) * F.count(x)).alias("v")).alias(f"_m{k}"))
    return rows.groupBy("unit", *how.by, end.alias("_end")).agg(*made)


def _trails(spark: SparkSession, rows: DataFrame, units: list[str], fresh: list[str], how: Carried, n: int) -> DataFrame:
    """Trailing windows of the fresh units' rows, for each number ``back`` of earlier units that they look back on; ``n`` fresh rows, dealt to as many tasks as they need."""
    seen = rows.select("*", F.col("unit").alias("_for"), F.lit(0).alias("_apart"))
    place = {u: k for k, u in enumerate(units)}
    behind = [(units[place[u] - d], u, d) for u in fresh for d in range(1, how.back + 1) if place[u] >= d]
    if behind:
        wanted = {x[0] for x in behind}
        tails = read_published(spark, how.root, TAILS, how.freq, keep=lambda v: v["unit"] in wanted).withColumn("unit", F.col("unit").cast("string"))
        table = spark.createDataFrame(behind, "unit string, _for string, _apart int")
        seen = seen.unionByName(tails.join(F.broadcast(table), "unit"))
    seen = seen.withColumn("back", F.explode(F.sequence("_apart", F.lit(how.back)))).withColumn("_fresh", F.col("_apart") == 0)
    keep = ["_for", "back", "_fresh", *how.by, how.ts]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * (how.back + 1) // TASK_ROWS))
    out = rolling_trailing(seen, how.freq, [*how.by, "_for", "back"], list(how.plan), how.ts, list(how.tie), keep, drop_nulls=True, tasks=tasks)
    return out.where("_fresh").drop("_fresh").withColumnRenamed("_for", "unit")


def combined(parts: DataFrame, by: list[str], how: Carried) -> DataFrame:
    """The plan's aggregates from parts, of which a group has one per unit at most (in most buckets one in all)."""
    states = F.array_sort(F.collect_list(F.struct("unit", *[f"_m{k}" for k in range(len(how.moments))])))
    got = parts.groupBy(*by, "_end").agg(F.max_by("_last", "_at").alias("_last"), states.alias("_states"))

    def folded(k: int) -> Column:
        def add(a: Column, x: Column) -> Column:
            x = x[f"_m{k}"]
            n, apart = a["n"] + x["n"], x["m"] - a["m"]
            both = F.struct(n.alias("n"), (a["m"] + apart * x["n"] / n).alias("m"), (a["v"] + x["v"] + apart * apart * a["n"] * x["n"] / n).alias("v"))
            return F.when(x["n"] == 0, a).when(a["n"] == 0, x).otherwise(both)

        return F.aggregate("_states", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("m"), F.lit(None).cast("double").alias("v")), add)

    got = got.select("*", *[folded(k).alias(f"_s{k}") for k in range(len(how.moments))])

    def value(k: int, x: AggItem) -> Column:
        if x.how == "last":
            return F.col(f"_last.l{k}")
        s = F.col(f"_s{how.moments.index(x.source)}")
        return s["m"] if x.how == "mean" else F.when(s["n"] > 1, F.sqrt(s["v"] / (s["n"] - 1))).otherwise(0.0)

    return no_nulls(got.select(*by, F.col("_end").alias(how.ts), *[value(k, x).alias(x.name) for k, x in enumerate(how.plan)]))


def carried_windows(spark: SparkSession, how: Carried, newest_only: bool = False) -> DataFrame:
    """Rows of all windows (or the newest) with window_id, window_name and split, as the full build has them, from the stored tables."""
    units = carried_units(spark, how)
    if len(units) < how.train + how.val + how.test:
        raise ValueError(f"{len(units)} units, needed are {how.train + how.val + how.test}")
    rows = window_rows(units, how.train, how.val, how.test, how.step, newest_only)
    table = spark.createDataFrame(rows, "unit string, window_id int, window_name string, split string, back int")  # a row per unit and window
    by = ["window_id", "window_name", "split", *how.by]

    def stored(kind: str, train: bool) -> DataFrame | None:
        own = {r[0] for r in rows if (r[3] == "train") == train}
        try:
            df = read_published(spark, how.root, kind, how.freq, keep=lambda v: v["unit"] in own)
        except FileNotFoundError:
            return None
        return df.withColumn("unit", F.col("unit").cast("string"))

    made, parts, trails = [], stored(PARTS, True), stored(TRAILS, False)
    if parts is not None:
        made.append(combined(parts.join(F.broadcast(table.where("split = 'train'").drop("back")), "unit"), by, how))
    if trails is not None:
        found = trails.join(F.broadcast(table.where("split <> 'train'")), ["unit", "back"])
        made.append(found.select(*by, how.ts, *[f"`{x.name}`" for x in how.plan]))
    return reduce(DataFrame.unionByName, made)
