import datetime as dt
import math
import random
import statistics
import time

import pytest

from tidemark.operators.resample import agg_plan, bucket_last_ceil, downsample_left, downsample_right, feature_names, first_by_bucket, last_by_time, rolling_trailing

T0 = dt.datetime(2024, 1, 1)
US = dt.timedelta(microseconds=1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, ts timestamp_ntz, id int, x double, y double")


def test_plan_names():
    plan = agg_plan(["x", "z_mean", "y", "t"], "t", ("x",))
    assert feature_names(plan) == ["x_last", "x_mean", "x_std", "z_mean_last", "z_mean_mean", "z_mean_std", "y_last"]
    assert plan[0].name == "t" and not plan[0].feature


def test_bucket_edges(spark):
    df = frame(spark, [("a", at(10) - US, 1, 1.0, 1.0), ("a", at(10), 2, 2.0, 2.0), ("a", at(10) + US, 3, 4.0, 4.0)])
    right = {r.ts: r.x_mean for r in downsample_right(df, "10s", ["g"], agg_plan(["x"], None, ("x",)), tie=["id"]).collect()}
    assert right == {at(10): 1.5, at(20): 4.0}
    left = {r.ts: r.x for r in downsample_left(df, "10s", ["g"], ["x"]).collect()}
    assert left == {at(0): 1.0, at(10): 3.0}


def test_one_row_has_std_zero_and_nulls_drop_rows(spark):
    df = frame(spark, [("a", at(1), 1, 5.0, None), ("b", at(1), 2, float("nan"), 1.0)])
    plan = agg_plan(["x", "y"], None, ("x",))
    assert downsample_right(df, "10s", ["g"], plan, drop_nulls=False).where("g = 'a'").first().x_std == 0.0
    assert [r.g for r in downsample_right(df, "10s", ["g"], plan).collect()] == ["b"]


@pytest.mark.parametrize("buckets", [1, 3, 64])
def test_rolling_equals_brute_force_for_any_dealing(spark, buckets):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), at(rng.randint(0, 300)), k, rng.random(), float(k)) for k in range(200)]
    plan = agg_plan(["x", "y"], None, ("x",))
    got = {r.id: r for r in rolling_trailing(frame(spark, rows), "20s", ["g"], plan, tie=["id"], keep=["id"], buckets=buckets).collect()}
    assert len(got) == len(rows)
    for g, ts, k, _, _ in rows:
        own = [(t, i, x, y) for h, t, i, x, y in rows if h == g and ts - dt.timedelta(seconds=20) < t <= ts]
        last = max(own, key=lambda m: m[:2])
        r = got[k]
        assert (r.x_last, r.y_last) == last[2:]
        assert r.x_mean == pytest.approx(statistics.fmean(m[2] for m in own))
        assert r.x_std == pytest.approx(statistics.stdev(m[2] for m in own) if len(own) > 1 else 0.0)


def test_rolling_at_a_bucket_edge_equals_the_bucket(spark):
    rng = random.Random(3)
    rows = [("a", at(rng.randint(0, 100)), k, rng.random(), 0.0) for k in range(100)] + [("a", at(10 * k), 1000 + k, rng.random(), 0.0) for k in range(11)]
    plan = agg_plan(["x"], None, ("x",))
    down = {r.ts: r for r in downsample_right(frame(spark, rows), "10s", ["g"], plan, tie=["id"]).collect()}
    for r in rolling_trailing(frame(spark, rows), "10s", ["g"], plan, tie=["id"]).collect():
        if r.ts in down:
            d = down[r.ts]
            assert (r.x_last, pytest.approx(r.x_mean), pytest.approx(r.x_std)) == (d.x_last, d.x_mean, d.x_std)


def test_rolling_far_from_zero_with_nulls_and_nan(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), at(rng.randint(-300, 300)), k, rng.choice([None, *[5e7 + rng.random() for _ in range(6)]]), None) for k in range(300)]
    rows.append(("a", at(40), 1000, float("nan"), None))
    plan = agg_plan(["x", "y"], None, ("x", "y"))
    got = {r.id: r for r in rolling_trailing(frame(spark, rows), "20s", ["g"], plan, tie=["id"], keep=["id"]).collect()}
    for g, ts, k, *_ in rows:
        own = [x for h, t, _, x, _ in rows if h == g and ts - dt.timedelta(seconds=20) < t <= ts and x is not None]
        r = got[k]
        if any(math.isnan(x) for x in own):
            assert math.isnan(r.x_mean) and g == "a" and at(40) <= ts < at(60)
        else:
            assert r.x_mean == (pytest.approx(statistics.fmean(own), abs=1e-7) if own else None)
            assert r.x_std == pytest.approx(statistics.stdev(own) if len(own) > 1 else 0.0, abs=1e-7)
        assert (r.y_last, r.y_mean, r.y_std) == (None, None, 0.0)


def test_rolling_takes_no_longer_for_wide_windows(spark):
    df = spark.range(120_000).selectExpr("cast(id % 1 as string) as g", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, id * 0.02) as ts", "cast(id as int) as id", "cast(id % 97 as double) as x", "0.0D as y")
    plan, took = agg_plan(["x"], None, ("x",)), {}
    for width in ("1s", "1s", "600s"):  # the first warms up
        begin = time.perf_counter()
        rolling_trailing(df, width, ["g"], plan, tie=["id"]).write.format("noop").mode("overwrite").save()
        took[width] = time.perf_counter() - begin
    assert took["600s"] < 5 * took["1s"] + 2  # 30,000 rows a window instead of 50
    exchanges = rolling_trailing(df, "1s", ["g"], plan, tie=["id"])._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges == 1


def test_last_rows_are_whole(spark):
    df = frame(spark, [("a", at(1), 1, 1.0, 1.0), ("a", at(1), 2, None, 2.0), ("a", at(11), 3, 3.0, 3.0)])
    assert [(r.id, r.x) for r in last_by_time(df, ["g", "ts"], ["id"]).orderBy("ts").collect()] == [(2, None), (3, 3.0)]
    assert [(r.ts_grid, r.id) for r in bucket_last_ceil(df, "10s", ["g"], ["ts", "id"]).orderBy("ts_grid").collect()] == [(at(10), 2), (at(20), 3)]
    assert [(r.bucket, r.x) for r in first_by_bucket(df, "10s", ["g"], ["x"]).orderBy("bucket").collect()] == [(at(0), 1.0), (at(10), 3.0)]


def test_empty(spark):
    none = frame(spark, [])
    plan = agg_plan(["x"], "y", ("x",))
    assert downsample_right(none, "1s", ["g"], plan).collect() == rolling_trailing(none, "1s", ["g"], plan).collect() == []
