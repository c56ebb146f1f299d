import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators.asof import asof_backward
from tidemark.operators.resample import agg_plan, rolling_trailing
from tidemark.streaming.windows import asof_stream, trailing_stream

T0 = dt.datetime(2024, 1, 1)
PLAN = agg_plan(["x"], None, ("x",))
SCHEMA = "id long, k string, ts timestamp, x double"


def ticks(n=600, seed=1):
    rng, out, at = random.Random(seed), [], 0
    for i in range(n):
        at += rng.choice([0, 100, 900, 1500])
        out.append((i, rng.choice(["a", "a", "a", "b", None]), T0 + dt.timedelta(milliseconds=at - rng.choice([0, 0, 4000])), rng.uniform(-5, 5)))
    return out


def feed(spark, path, rows, number):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/part={number}")


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).parquet(f"{path}/part=*")


def beat(rows):
    return [(None, "beat", max(r[2] for r in rows) + dt.timedelta(days=1), None)]


def plain(df):
    return sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in df.collect())


def test_trailing_windows_over_several_runs_are_those_of_the_batch(spark, tmp_path):
    src, out, ck, rows = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), ticks()
    parts = [rows[:200], rows[200:400], rows[400:], beat(rows)]
    sizes = []
    for k, part in enumerate(parts):  # each run goes on from the checkpoint
        feed(spark, src, part, k)
        trailing_stream(stream(spark, src), "5s", "10s", ["k"], PLAN, out, ck, tie=["id"], keep=["id", "k", "ts"]).awaitTermination()
        sizes.append(spark.read.parquet(out).count())
    assert 0 < sizes[1] < sizes[2] < sizes[3]  # whole buckets appear as time goes on
    got = spark.read.parquet(out).drop("batch").where("id is not null")
    want = rolling_trailing(spark.createDataFrame(rows, SCHEMA), "5s", ["k"], PLAN, tie=["id"], keep=["id", "k", "ts"])
    assert plain(got.select(*want.columns)) == plain(want)


def test_rows_behind_the_watermark_are_dropped_with_their_bucket(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    rows = [(k, "a", T0 + dt.timedelta(seconds=k), 1.0) for k in range(100)]
    for k, part in enumerate([rows, [(500, "a", T0 + dt.timedelta(seconds=1), 9.0)], beat(rows)]):
        feed(spark, src, part, k)
        trailing_stream(stream(spark, src), "2s", "1s", ["k"], PLAN, out, ck, tie=["id"], keep=["id"]).awaitTermination()
    got = spark.read.parquet(out).where("id is not null")
    assert {r.id for r in got.collect()} == set(range(100)) and got.agg(F.max("x_last")).first()[0] == 1.0


def test_asof_of_two_streams(spark, tmp_path):
    left, right = ticks(300, 2), ticks(300, 3)
    paths = {n: str(tmp_path / n) for n in ("l", "r", "out", "ck")}
    for k, (a, b) in enumerate([(left[:150], right[:150]), (left[150:], right[150:]), (beat(left + right), [])]):
        feed(spark, paths["l"], a, k)
        feed(spark, paths["r"], b, k)
        quotes = stream(spark, paths["r"]).select("k", "ts", F.col("id").alias("qid"), F.col("x").alias("quote"))
        asof_stream(stream(spark, paths["l"]), quotes, ["k"], "3s", "60s", paths["out"], paths["ck"], tie=["qid"]).awaitTermination()
    got = spark.read.parquet(paths["out"]).drop("batch").where("id is not null")
    r = spark.createDataFrame(right, SCHEMA).select("k", "ts", F.col("id").alias("qid"), F.col("x").alias("quote"))
    want = asof_backward(spark.createDataFrame(left, SCHEMA), r, ["k"], tie=["qid"])
    near = F.unix_micros("ts") - F.unix_micros("matched_ts") <= 3_000_000
    want = want.withColumns({c: F.when(near, F.col(c)) for c in ("matched_ts", "qid", "quote")})
    assert plain(got.select(*want.columns)) == plain(want)
    assert 0 < got.where("qid is null").count() < 300
