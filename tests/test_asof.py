import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_backward, block_of, block_starts, locf_grid, time_grid

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize("bucket", ["1d", "1m", "7s"])
def test_equals_brute_force_for_any_bucket(spark, bucket):
    rng = random.Random(4)
    left = [(rng.choice("ab"), at(rng.randint(0, 600)), k) for k in range(150)]
    right = [(rng.choice("abc"), at(rng.randint(50, 500)), k, rng.choice([None, k * 1.5])) for k in range(80)]
    got = asof_backward(spark.createDataFrame(left, "g string, ts timestamp_ntz, k int"), spark.createDataFrame(right, "g string, ts timestamp_ntz, id int, x double"), ["g"], tie=["id"], bucket=bucket)
    rows = {r.k: r for r in got.collect()}
    assert len(rows) == len(left)
    for g, ts, k in left:
        best = max(((t, i, x) for h, t, i, x in right if h == g and t <= ts), key=lambda m: m[:2], default=(None, None, None))
        assert (rows[k].matched_ts, rows[k].id, rows[k].x) == best


def test_null_of_the_matched_row_stays(spark):
    left = spark.createDataFrame([("a", at(10)), ("a", at(0))], "g string, ts timestamp_ntz")
    right = spark.createDataFrame([("a", at(1), 1.0), ("a", at(5), None)], "g string, ts timestamp_ntz, x double")
    got = {r.ts: r for r in asof_backward(left, right, ["g"]).collect()}
    assert got[at(10)].x is None and got[at(10)].matched_ts == at(5)
    assert got[at(0)].matched_ts is None


def test_empty_sides(spark):
    left = spark.createDataFrame([("a", at(10))], "g string, ts timestamp_ntz")
    right = spark.createDataFrame([], "g string, ts timestamp_ntz, x double")
    assert asof_backward(left, right, ["g"]).first().x is None
    assert asof_backward(left.limit(0), right, ["g"]).collect() == []


def test_grid_goes_from_floor_to_ceil(spark):
    df = spark.createDataFrame([("a", at(7), 1.0), ("a", at(21), 2.0), ("b", at(20), 3.0)], "g string, ts timestamp_ntz, x double")
    got = sorted((r.g, r.ts, r.x) for r in locf_grid(df, "10s", ["g"], ["x"]).collect())
    assert got == sorted([("a", at(0), None), ("a", at(10), 1.0), ("a", at(20), 1.0), ("a", at(30), 2.0), ("b", at(20), 3.0)], key=lambda r: r[:2])


def test_long_grids_are_cut_by_days(spark):
    df = spark.createDataFrame([("a", at(0)), ("a", at(86_400 * 3 + 5))], "g string, ts timestamp_ntz")
    got = [r.ts for r in time_grid(df, "1h", ["g"]).orderBy("ts").collect()]
    assert got == [at(3600 * k) for k in range(74)]
    assert time_grid(df, "2d", ["g"]).count() == 4  # buckets count from 1970: day 19,722 to 19,728


def test_blocks_count_from_the_origin(spark):
    df = spark.createDataFrame([(at(5),), (at(14),), (at(15),), (at(36),)], "ts timestamp_ntz")
    assert [r[0] for r in block_starts(df, "10s").orderBy("block_start").collect()] == [at(5), at(15), at(25), at(35)]
    got = block_of(df, "10s", F.lit(str(at(5))).cast("timestamp_ntz"))
    assert [r.block_start for r in got.orderBy("ts").collect()] == [at(5), at(5), at(15), at(35)]


def test_a_null_group_is_carried_over_buckets_as_others_are(spark):
    t = dt.datetime(2024, 1, 1)
    left = spark.createDataFrame([(None, t + dt.timedelta(days=3)), ("a", t + dt.timedelta(days=3))], "k string, ts timestamp_ntz")
    right = spark.createDataFrame([(None, t, 1), ("a", t, 2)], "k string, ts timestamp_ntz, v int")
    assert {r.k: r.v for r in asof_backward(left, right, ["k"]).collect()} == {None: 1, "a": 2}
