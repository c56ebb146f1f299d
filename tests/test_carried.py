import datetime as dt
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidemark.operators.datasets import rolling_splits, training_sample
from tidemark.operators.resample import agg_plan
from tidemark.plans import carried
from tidemark.plans.carried import Carried, arrive, carried_units, carried_windows
from tidemark.sources.publish import done_partitions

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id long, s string, ts timestamp_ntz, date date, x double, z double, y double"
PLAN = agg_plan(["x", "z"], "y", ("x",))


def rows(spark, days=8, seed=4):
    rng, out = random.Random(seed), []
    for d in range(days):
        for k in range(60):
            at = T0 + dt.timedelta(days=d, seconds=rng.choice([0, 1, 30, 86399, rng.randrange(86400)]))
            out.append((len(out), rng.choice("AAB"), at, at.date(), 1e6 + rng.uniform(-1, 1), rng.choice([None, 1.0, 2.0]), rng.random()))
    return spark.createDataFrame(out, SCHEMA)


def full(df, how, **more):
    split = rolling_splits(df, "date", how.train, how.val, how.test, how.step, **more)
    by = ["window_id", "window_name", "split", *how.by]
    down, roll, _ = training_sample(split.where("split = 'train'"), split.where("split <> 'train'"), how.freq, ["x", "z"], "y", by, multi=("x",), tie=["id"])
    return down.unionByName(roll)


def plain(df):
    return sorted(tuple(None if v is None else round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in df.collect())


@pytest.mark.parametrize(("train", "val", "test", "freq"), [(3, 1, 1, "6h"), (2, 3, 2, "30h"), (4, 0, 1, "7h")])
def test_carried_windows_are_those_of_the_full_build(spark, tmp_path, train, val, test, freq):
    how = Carried(str(tmp_path), freq, ("s",), tuple(PLAN), train, val, test, tie=("id",))
    df = rows(spark)
    assert len(arrive(df.where("date <= '2024-01-06'"), how)) == 6
    for day in ("2024-01-07", "2024-01-08"):  # nothing but the new day is handed in
        assert arrive(df.where(F.col("date") == day), how) == [day]
    got, want = carried_windows(spark, how), full(df, how)
    assert plain(got.select(*want.columns)) == plain(want)
    newest = carried_windows(spark, how, newest_only=True)
    last = want.where(F.col("window_id") == want.agg(F.max("window_id")).first()[0])
    assert plain(newest.select(*want.columns)) == plain(last)


def test_units_arrive_once_and_in_order(spark, tmp_path):
    how, df = Carried(str(tmp_path), "6h", ("s",), tuple(PLAN), 2, 1, 1, tie=("id",)), rows(spark)
    assert carried_units(spark, how) == [] and arrive(df.where("x < 0"), how) == []
    with pytest.raises(ValueError):
        carried_windows(spark, how)
    arrive(df.where("date between '2024-01-03' and '2024-01-06'"), how)
    before = plain(carried_windows(spark, how))
    assert arrive(df.where("date = '2024-01-05'"), how) == []  # final
    with pytest.raises(ValueError):
        arrive(df.where("date = '2024-01-01'"), how)
    with pytest.raises(ValueError):  # two units at the same times
        arrive(df.where("date > '2024-01-06'").withColumn("date", F.when(F.col("id") % 2 == 0, F.lit("2024-01-07")).otherwise(F.lit("2024-01-08"))), how)
    assert plain(carried_windows(spark, how)) == before


def test_a_run_that_died_is_run_again(spark, tmp_path, monkeypatch):
    how, df = Carried(str(tmp_path), "6h", ("s",), tuple(PLAN), 2, 2, 1, tie=("id",)), rows(spark)
    real = carried.publish

    def dies(part, root, kind, *rest):
        if kind == carried.PARTS:
            raise KeyboardInterrupt
        return real(part, root, kind, *rest)

    monkeypatch.setattr(carried, "publish", dies)
    with pytest.raises(KeyboardInterrupt):
        arrive(df, how)
    assert carried_units(spark, how) == [] and len(done_partitions(spark, str(tmp_path), carried.TRAILS, "6h")) == 8
    monkeypatch.setattr(carried, "publish", real)
    assert len(arrive(df, how)) == 8
    want = full(df, how)
    assert plain(carried_windows(spark, how).select(*want.columns)) == plain(want)


def test_blocks_as_units_and_columns_in_the_way(spark, tmp_path):
    """Units named by times, groups that are null, more columns of ``df`` than the plan reads."""
    df = rows(spark, 2).withColumn("block", F.date_trunc("hour", F.col("ts"))).withColumns({"unit": F.lit("other"), "back": F.lit(7)})
    df = df.withColumn("block", F.date_format("block", "yyyy-MM-dd HH:00")).withColumn("s", F.when(F.col("s") == "A", F.col("s")))
    how = replace(Carried(str(tmp_path), "20m", ("s",), tuple(agg_plan(["x"], "y", ("x",))), 2, 1, 1, tie=("id",)), unit="block")
    arrive(df, how)
    got = carried_windows(spark, how)
    split = rolling_splits(df, "block", 2, 1, 1)
    down, roll, _ = training_sample(split.where("split = 'train'"), split.where("split <> 'train'"), "20m", ["x"], "y", ["window_id", "window_name", "split", "s"], multi=("x",), tie=["id"])
    want = down.unionByName(roll)
    assert plain(got.select(*want.columns)) == plain(want) and got.count() > 0


def test_more_rows_are_dealt_to_more_tasks(spark, tmp_path, monkeypatch):
    """A task's sorts hold its rows, so their number mustn't grow with the table."""
    monkeypatch.setattr(carried, "TASK_ROWS", 20, raising=False)
    sizes, real = [], carried.publish

    def counted(part, root, kind, *rest):
        if kind == carried.TRAILS:
            sizes.extend(r["count"] for r in part.groupBy(F.spark_partition_id()).count().collect())
        return real(part, root, kind, *rest)

    monkeypatch.setattr(carried, "publish", counted)
    arrive(rows(spark), Carried(str(tmp_path), "6h", ("s",), tuple(PLAN), 3, 2, 1, tie=("id",)))
    assert len(sizes) > 8 and max(sizes) < sum(sizes) / 5  # the session's shuffles have 4
