import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import finite, finite_or_null, no_nulls, r6, ratio, sum_of
from tidemark.functions.timeops import as_ntz, ceil_us, dates_between, duration_ns, duration_us, epoch_us, floor_us, from_ns, from_us, offset, to_us


@pytest.mark.parametrize(("text", "us"), [("20ms", 20_000), ("1h30m", 5_400_000_000), ("7d", 604_800_000_000), ("2 hr", 7_200_000_000), ("5min", 300_000_000), ("1000ns", 1), ("3sec", 3_000_000), (17, 17), ("250us", 250)])
def test_durations(text, us):
    assert duration_us(text) == us
    assert duration_ns(text) == us * 1000


@pytest.mark.parametrize("text", ["", "5", "5 parsecs", "h", "1ns", "-5s", "5s!", "0s"])
def test_what_is_no_duration(text):
    with pytest.raises(ValueError):
        duration_us(text)


def test_to_us():
    assert to_us(None) is None
    assert to_us(5) == to_us(np.int64(5)) == 5
    want = 1_704_067_200_000_000
    assert {to_us(x) for x in ("2024-01-01", dt.datetime(2024, 1, 1), np.datetime64("2024-01-01T00:00:00", "ns"), "2024-01-01T01:00:00+01:00")} == {want}


def test_dates():
    assert dates_between("2024-02-28", "2024-03-01") == ["2024-02-28", "2024-02-29", "2024-03-01"]
    with pytest.raises(ValueError):
        dates_between("2024-03-02", "2024-03-01")


def test_buckets_at_their_edges(spark):
    rows = [(-1,), (0,), (1,), (999_999,), (1_000_000,), (1_000_001,), (-1_000_000,)]
    df = spark.createDataFrame(rows, "us long").select("us", floor_us(F.col("us"), 1_000_000).alias("a"), ceil_us(F.col("us"), 1_000_000).alias("b"))
    for r in df.collect():
        assert r.a == r.us // 1_000_000 * 1_000_000
        assert r.b == -(-r.us // 1_000_000) * 1_000_000


def test_times_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(1_704_067_200_000_123,)], "us long").select("us", from_us("us").alias("ts"), from_ns(F.col("us") * 1000 + 999).alias("from_ns"), offset(from_us("us"), "1d", back=True).alias("before"))
        r = df.select("*", epoch_us("ts").alias("again")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert r.ts == dt.datetime(2024, 1, 1, 0, 0, 0, 123) == r.from_ns
    assert r.before == dt.datetime(2023, 12, 31, 0, 0, 0, 123)
    assert r.again == r.us


def test_hours_that_the_session_zone_skips(spark):
    skipped = dt.datetime(2024, 3, 10, 2, 30, 0, 7)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(skipped,), (dt.datetime(1965, 7, 1, 0, 0, 0, 1),), (dt.datetime(2150, 7, 1),), (None,)], "ts timestamp_ntz")
        rows = df.select("ts", epoch_us("ts").alias("us"), from_us(epoch_us("ts")).alias("again")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    for r in rows[:3]:
        assert r.again == r.ts and r.us == (r.ts - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    assert rows[3].us is None


@pytest.mark.parametrize(("kind", "value"), [("string", "2024-01-01 00:00:05"), ("long", 1_704_067_205_000_000_000), ("timestamp_ntz", dt.datetime(2024, 1, 1, 0, 0, 5))])
def test_as_ntz(spark, kind, value):
    df = as_ntz(spark.createDataFrame([(value,), (None,)], f"t {kind}"), "t")
    assert [r.t for r in df.collect()] == [dt.datetime(2024, 1, 1, 0, 0, 5), None]


def test_strings_that_are_no_time_and_dates(spark):
    assert as_ntz(spark.createDataFrame([("soon",)], "t string"), "t").first().t is None
    assert as_ntz(spark.createDataFrame([(dt.date(2024, 1, 2),)], "t date"), "t").first().t == dt.datetime(2024, 1, 2)


def test_scalars(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), 2.0), (float("inf"), 0.0), (None, None)], "x double, y double")
    assert [r[0] for r in df.select(sum_of([F.col("x"), F.col("y")])).collect()[:1]] == [1.0]
    assert [r[0] for r in df.select(finite(F.col("x"))).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(finite_or_null(F.col("x"))).collect()][2] is None
    assert df.select(ratio(F.col("x"), F.col("y"))).collect()[2][0] is None
    assert no_nulls(df).count() == 2  # NaN is a value
    assert spark.range(1).select(r6(F.lit(-1e-9))).first()[0] == 0.0
