import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import checks
from tidemark.operators.factors import base_factors, book_columns, clip_to, derived_factors, time_of_day, time_range, trim_leading
from tidemark.operators.labels import feature_join, forward_labels, forward_labels_by_time, label_join, lag_features

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def book(spark, rows):
    names = book_columns(2)  # asks prices, bids prices, asks amounts, bids amounts
    return spark.createDataFrame([("s", at(t), *[None if x is None else float(x) for x in v]) for t, v in rows], "symbol string, ts timestamp_ntz, " + ", ".join(f"`{c}` double" for c in names))


def test_base_factors(spark):
    df = book(spark, [(0, (101, 102, 99, 98, 1, 3, 2, 4)), (1, (103, 104, 99, 98, 1, None, None, 4)), (2, (101, 102, 99, 98, 0, 0, 0, 0)), (3, (None,) * 8)])
    r = base_factors(df, ["symbol"], levels=2).orderBy("ts").collect()
    assert r[0].vwap == pytest.approx((101 + 3 * 102 + 2 * 99 + 4 * 98) / 10)
    assert r[0].imbalance == pytest.approx((4 - 6) / 10)
    assert (r[0].spread, r[0].mid, r[0].log_return) == (2, 100, None)
    assert r[1].vwap == pytest.approx((103 + 4 * 98) / 5)  # nulls count as 0
    assert r[1].log_return == pytest.approx(math.log(101 / 100))
    assert (r[2].vwap, r[2].imbalance) == (None, None)
    assert (r[3].vwap, r[3].mid) == (None, None)
    with pytest.raises(ValueError):
        base_factors(df.drop("asks[0].price"), ["symbol"], levels=2)


def test_infinite_values_become_null(spark):
    df = book(spark, [(0, (math.inf, 102, 99, 98, 1, 3, 2, 4))])
    r = base_factors(df, ["symbol"], levels=2).first()
    assert (r.vwap, r.spread, r.mid) == (None, None, None)


def test_derived_factors_and_time_of_day(spark):
    cols = {"vwap": 2.0, "mid": 4.0, "spread": 1.0, "imbalance": -0.5, "log_return": -0.1, "vol_1m_lag0": 1.0, "vol_5m_lag0": 2.0, "vol_30m_lag0": 4.0, "vol_60m_lag0": 8.0, "vol_120m_lag0": 0.0}
    df = spark.createDataFrame([(at(3600 * 6), *cols.values())], "ts timestamp_ntz, " + ", ".join(f"{c} double" for c in cols))
    r = derived_factors(df).first()
    assert r.vwap_mid_diff == pytest.approx(-0.5)  # a share of mid
    zero = derived_factors(df.withColumn("mid", F.lit(0.0))).first()
    assert zero.spread_pct == math.inf and zero.vwap_mid_diff == math.inf
    assert r.spread_pct == pytest.approx(0.25) and r.vol_ratio_1_5 == pytest.approx(0.5) and r.vol_ratio_5_60 == pytest.approx(0.25)
    assert r.vol_ratio_30_120 == pytest.approx(4e9) and r.imbalance_sq == 0.25 and r.abs_imbalance == 0.5 and r.lr_abs == 0.1
    assert (r.hour, r.minute) == (6, 0) and r.tod_sin == pytest.approx(1) and r.tod_cos == pytest.approx(0, abs=1e-9)
    assert time_of_day(df.drop("ts")).columns == df.drop("ts").columns


def test_leading_trim_is_per_day(spark):
    times = [dt.datetime(2024, 1, d, 0, 14, 59, 999_999) for d in (1, 2)] + [dt.datetime(2024, 1, d, 0, 15) for d in (1, 2)]
    got = [r.ts for r in trim_leading(spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")).orderBy("ts").collect()]
    assert got == times[2:]


def test_time_range_is_inclusive_and_reaches_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(at(k),) for k in range(5)], "ts timestamp_ntz")
    assert time_range(df, at(1), at(3)).count() == 3
    df.write.parquet(str(tmp_path / "t"))
    plan = time_range(spark.read.parquet(str(tmp_path / "t")), at(1))._jdf.queryExecution().executedPlan().toString()
    assert "DataFilters: [isnotnull(ts" in plan
    with pytest.raises(ValueError):
        time_range(df, at(50), check=True)
    assert time_range(df.select(F.lit(5).cast("long").alias("ts")), 5, 5).count() == 5


def test_clip(spark):
    df = spark.createDataFrame([("a", at(k)) for k in range(6)] + [("b", at(0))], "symbol string, ts timestamp_ntz")
    vol = spark.createDataFrame([("a", at(1)), ("a", at(4))], "symbol string, ts_grid timestamp_ntz")
    assert sorted(r.ts for r in clip_to(df, vol, ["symbol"]).collect()) == [at(k) for k in range(1, 5)]


def grid(spark, n=6, skip=()):
    return spark.createDataFrame([("a", at(20 * k), float(k)) for k in range(n) if k not in skip], "symbol string, ts timestamp_ntz, v double")


def test_forward_labels(spark):
    got = [r.y_v for r in forward_labels(grid(spark), ["v"], "40s", ["symbol"]).orderBy("ts").collect()]
    assert got == [2.0, 3.0, 4.0, 5.0, None, None]
    with pytest.raises(ValueError):  # a missing row
        forward_labels(grid(spark, skip=(3,)), ["v"], "40s", ["symbol"])
    with pytest.raises(ValueError):  # no whole number of steps
        forward_labels(grid(spark), ["v"], "30s", ["symbol"])
    by_time = [r.y_v for r in forward_labels_by_time(grid(spark, skip=(3,)), ["v"], "40s", ["symbol"]).orderBy("ts").collect()]
    assert by_time == [2.0, None, 4.0, None, None]


def test_lags(spark):
    r = lag_features(grid(spark), "v", ["20s", "1m"], ["symbol"], prefix="v_lag0").orderBy("ts").collect()
    assert [x.v_lag20s for x in r] == [None, 0, 1, 2, 3, 4]
    assert [x.v_lag1m for x in r] == [None, None, None, 0, 1, 2]
    with pytest.raises(ValueError):
        lag_features(grid(spark), "v", ["30s"], ["symbol"])
    with pytest.raises(ValueError):
        lag_features(grid(spark, 1), "v", ["20s"], ["symbol"])
    gap = grid(spark, 40, skip=(20,))
    with pytest.raises(ValueError):  # a missing row makes a lag too long
        lag_features(gap, "v", ["1m"], ["symbol"])
    assert lag_features(gap, "v", ["1m"], ["symbol"], check=False).count() == 39
    long = lag_features(grid(spark, 500), "v", ["1m"], ["symbol"])  # over many time buckets
    assert long.where("v_lag1m <> v - 3 or (v_lag1m is null and v > 2)").isEmpty()


@pytest.mark.parametrize(("how", "n"), [("left", 6), ("right", 4), ("inner", 3), ("full", 7), ("cross", 24)])
def test_feature_join(spark, how, n):
    vol = spark.createDataFrame([("a", at(20 * k), float(k)) for k in (0, 2, 4, 9)], "symbol string, ts_grid timestamp_ntz, vol double")
    out = feature_join(grid(spark), vol, ["vol"], ["symbol"], how=how)
    assert out.count() == n and "vol_lag0" in out.columns
    with pytest.raises(ValueError):
        feature_join(grid(spark), vol, ["other"], ["symbol"])


def test_label_join_keeps_null_tails(spark):
    vol = grid(spark).withColumnsRenamed({"ts": "ts_grid", "v": "vol"})
    got = label_join(grid(spark), vol, ["vol"], "20s", ["symbol"]).orderBy("ts").collect()
    assert [r.y_vol for r in got] == [1.0, 2.0, 3.0, 4.0, 5.0, None]


def test_checks(spark):
    g = grid(spark)
    assert checks.require_even(g, "ts", ("symbol",)) == 20_000_000
    for bad in (grid(spark, skip=(2,)), grid(spark, 1)):
        with pytest.raises(ValueError):
            checks.require_even(bad, "ts", ("symbol",))
    with pytest.raises(ValueError):
        checks.require_even(g, "ts", ("symbol",), "10s")
    faults = checks.grid_faults(grid(spark, skip=(2, 3)), "20s", by=("symbol",)).first()
    assert (faults.n_rows, faults.n_uneven, faults.n_missing) == (4, 1, 2)
    checks.require_history(g, F.lit(str(at(0))).cast("timestamp_ntz"))
    with pytest.raises(ValueError):
        checks.require_history(g, F.lit(str(at(-1))).cast("timestamp_ntz"))
    moved = g.withColumn("m", F.timestamp_add("SECOND", F.lit(1), "ts"))
    with pytest.raises(ValueError):
        checks.require_aligned(moved, "ts", "m")
    assert checks.require_aligned(moved, "ts", "m", "1s").columns == g.columns
    with pytest.raises(ValueError):
        checks.require_aligned(moved.limit(0), "ts", "m")
    with pytest.raises(ValueError):
        checks.require_rows(g.limit(0))
    with pytest.raises(ValueError):
        checks.require_days(g.withColumn("date", F.col("ts").cast("date")), 2)
