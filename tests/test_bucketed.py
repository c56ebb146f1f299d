"""Bucketed tables: joins without exchanges, partitions replaced, layouts kept."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import pipeline
from tidemark.sources.bucketed import add_bucketed, join_bucketed, open_bucketed

KEYS = ["symbol", "ts"]



def numbers(spark, n, name, day, times=1):
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("symbol"), F.col("id").alias("ts"), (F.col("id") * times).alias(name), F.lit(day).cast("date").alias("date"))


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_have_no_exchange_and_days_are_replaced(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for day, times in (("2024-01-01", 7), ("2024-01-02", 1), ("2024-01-01", 1)):  # the first day again, with other values
        add_bucketed(numbers(spark, 500, "x", day, times), a, KEYS, 4, ["date"])
        add_bucketed(numbers(spark, 400, "y", day, 2 * times), b, KEYS, 4, ["date"])
    left, right = (open_bucketed(spark, p).where("date = '2024-01-01'") for p in (a, b))
    out = join_bucketed(left, [right.drop("date")], KEYS)
    text = plan(out)
    assert "Exchange" not in text and text.count("SortMergeJoin") >= 1
    got = out.where("symbol is not null").collect()
    assert len(got) == sum(1 for k in range(500) if k % 3)
    assert all(r.x == r.ts and r.y == (2 * r.ts if r.ts < 400 else None) for r in got)
    assert out.count() == 500  # rows with a null key stay, and match nothing
    assert open_bucketed(spark, a).count() == 1000


def test_rows_without_partitions_are_added(spark, tmp_path):
    path = str(tmp_path / "t")
    add_bucketed(numbers(spark, 10, "x", "2024-01-01"), path, KEYS, 2)
    add_bucketed(numbers(spark, 10, "x", "2024-01-01"), path, KEYS, 2)
    assert open_bucketed(spark, path).count() == 20


def test_other_layouts_raise_and_empty_tables_open(spark, tmp_path):
    path = str(tmp_path / "t")
    add_bucketed(numbers(spark, 0, "x", "2024-01-01"), path, KEYS, 2, ["date"])
    assert open_bucketed(spark, path).count() == 0
    for df, keys, n in ((numbers(spark, 3, "y", "2024-01-01"), KEYS, 2), (numbers(spark, 3, "x", "2024-01-01"), ["ts"], 2), (numbers(spark, 3, "x", "2024-01-01"), KEYS, 3)):
        with pytest.raises(ValueError):
            add_bucketed(df, path, keys, n, ["date"])
    with pytest.raises(ValueError):
        add_bucketed(numbers(spark, 3, "x", "2024-01-01").drop("ts"), str(tmp_path / "u"), KEYS, 2)


def test_stored_blocks_equal_ready_blocks(spark, tmp_path):
    """Blocks of several days and features out of the buckets are those built in one go, and their plan exchanges nothing."""
    rows = spark.range(3 * 24 * 4).select(
        (F.timestamp_add("HOUR", (F.col("id") / 3).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))).alias("ts"),
        F.concat(F.lit("S"), F.col("id") % 3).alias("symbol"),
        (F.hash("id") % 100).cast("double").alias("a"),
        (F.hash("id", F.lit(1)) % 100).cast("double").alias("b"),
    )
    rows = rows.withColumns({"y": F.col("a") + F.col("b"), "date": F.to_date("ts")})
    config = pipeline.Config(["S0", "S1", "S2"], ["S0", "S1"], target="y", features=("a", "b"), neighbor_counts=(1, 2), train_window="1d", train_subsample="2h")
    days = ["2024-01-02", "2024-01-04"]
    for day in days:
        pipeline.store_day(rows, day, config, str(tmp_path / "ready"), 3)
    got = pipeline.stored_blocks(spark, config, str(tmp_path / "ready"), days)
    text = plan(got)
    assert "Exchange" not in text and "Broadcast" not in text
    want = pipeline.ready_block(rows, days[0], config).unionByName(pipeline.ready_block(rows, days[1], config))
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
