import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.watch import even_counts, stop_if, watch_aligned, watch_even, watch_rows

T0 = dt.datetime(2024, 1, 1)


def grid(spark, skip=(), extra=()):
    rows = [(g, T0 + dt.timedelta(seconds=10 * k), float(k)) for g in "ab" for k in range(300) if (g, k) not in skip]
    return spark.createDataFrame(rows + list(extra), "g string, ts timestamp_ntz, x double")


def save(df):
    df.write.format("noop").mode("overwrite").save()


def test_even_grid_needs_no_further_job(spark):
    tracker = spark.sparkContext.statusTracker()
    df, verify = watch_even(grid(spark), "10s", ["g"])
    spark.sparkContext.setJobGroup("watch", "", False)
    try:
        save(df)
        jobs = len(tracker.getJobIdsForGroup("watch"))
        assert verify() == {"n_rows": 600, "n_groups": 2, "n_off": 0}
        assert len(tracker.getJobIdsForGroup("watch")) == jobs
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert df.columns == ["g", "ts", "x"] and df.exceptAll(grid(spark)).count() == 0
    assert df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1  # one scan


@pytest.mark.parametrize("skip, extra", [([("a", 7)], []), ([("b", 64), ("b", 128), ("b", 64 * 3)], []), ([], [("a", T0 + dt.timedelta(seconds=5), 0.0)]), ([("a", k) for k in range(60, 260)], [])])
def test_faults_raise_wherever_they_lie(spark, skip, extra):
    df, verify = watch_even(grid(spark, set(skip), extra), "10s", ["g"])
    save(df)
    with pytest.raises(ValueError, match="evenly"):
        verify()


def test_counts_do_not_depend_on_buckets(spark):
    rng = random.Random(2)
    skip = {(g, rng.randrange(1, 300)) for g in "ab" for _ in range(40)}
    got = even_counts(grid(spark, skip), "10s", ["g"]).first()
    want = sum(1 for g, k in skip if (g, k + 1) not in skip and k < 299)
    assert (got.n_rows, got.n_groups, got.n_off) == (600 - len(skip), 2, want)


def test_aligned_and_rows(spark):
    df = grid(spark).withColumn("later", F.col("ts") + F.expr("interval 5 seconds"))
    out, verify = watch_aligned(df, "ts", "later", "5s")
    save(out)
    assert verify() == {"n_joined": 600, "n_off": 0} and "later" not in out.columns
    out, verify = watch_aligned(df, "ts", "later", "6s")
    save(out)
    with pytest.raises(ValueError, match="600 of 600"):
        verify()
    out, verify = watch_aligned(df.where("x < 0"), "ts", "later", "5s")
    save(out)
    with pytest.raises(ValueError, match="nothing"):
        verify()
    out, verify = watch_rows(df.where("x < 0"))
    save(out)
    with pytest.raises(ValueError, match="empty"):
        verify()


def test_stop_if(spark):
    assert stop_if(grid(spark), F.col("x") < 0, "negative").count() == 600
    with pytest.raises(Exception, match="too large"):
        save(stop_if(grid(spark), F.col("x") > 298, "too large"))
