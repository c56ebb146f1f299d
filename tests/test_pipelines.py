import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.factors import book_columns
from tidemark.operators.resample import agg_plan, downsample_left, downsample_right
from tidemark.plans import models, pipeline
from tidemark.sources import tables
from tidemark.streaming.resample import stream_downsample

T0 = dt.datetime(2024, 1, 1)
SYMBOLS = ["A", "B", "C"]


def inputs(spark, n_days=5, step=600):
    rng = random.Random(1)
    names = book_columns(2)
    snaps, vols = [], []
    for s in SYMBOLS:
        for d in range(n_days):
            for k in range(86_400 // step):
                t = T0 + dt.timedelta(days=d, seconds=k * step)
                mid = 100 + math.sin(k / 9) + rng.random()
                snaps.append((s, t.date(), t, mid + 1, mid + 2, mid - 1, mid - 2, *[rng.random() + 0.5 for _ in range(4)]))
                vols.append((s, t.date(), t, *[rng.random() + 0.1 for _ in range(5)]))
    snap = spark.createDataFrame(snaps, "symbol string, date date, ts timestamp_ntz, " + ", ".join(f"`{c}` double" for c in names))
    vol = spark.createDataFrame(vols, "symbol string, date date, ts_grid timestamp_ntz, vol_1m double, vol_5m double, vol_30m double, vol_60m double, vol_120m double")
    return snap, vol


VOLS = ["vol_1m", "vol_5m", "vol_30m", "vol_60m", "vol_120m"]


def test_raw_to_report(spark, tmp_path):
    config = pipeline.Config(
        SYMBOLS, ["A", "B"], features=("mid", "imbalance"), neighbor_counts=(1, 2), train_window="1d", train_subsample="1h", block="6h", freqs=("1h",), train_days=2, label_ahead="20m", levels=2,
        boost=models.BoostParams(rounds=2, depth=2, least_rows=5),
    )
    snap, vol = inputs(spark)
    state, said = pipeline.State(), []
    state.put("snapshots", snap)
    state.put("vol", vol)
    pipeline.run_stages(spark, config, pipeline.cache_stages(str(tmp_path), VOLS, ["vol_5m"]), state, said.append)
    a = state.get("aligned")
    assert a.where("hour = 0 and minute < 15").isEmpty() and state.notes["features"][:2] == ["vwap", "imbalance"]
    assert a.where(F.col("y_vol_5m").isNull()).count() == 3 * 5 * 2  # the last 20 minutes of each day
    assert a.count() == 3 * 5 * (144 - 2)
    origin = a.agg(F.min("ts")).first()[0]
    assert state.get("blocks").agg(F.min("block_start")).first()[0] == origin
    # neighbours, windows and models over the days that have a history
    days = [f"2024-01-0{d}" for d in (2, 3, 4, 5)]
    pipeline.run_stages(spark, config, pipeline.main_stages(str(tmp_path), days), state, said.append)
    ready = state.get("ready")
    assert ready.count() == 3 * 4 * 142 and "mid_time_nn2_mean" in ready.columns and "imbalance_symbol_nn1_mean" in ready.columns
    assert {r.split for r in state.get("dataset").select("split").distinct().collect()} == {"train", "val", "test"}
    assert state.get("metrics_1h").first().n > 0 and math.isfinite(state.get("overall_1h").first().rmse)
    assert tables.read_json(spark, f"{tmp_path}/1h/meta/run_config.json")["symbol_codes"] == {"A": 0, "B": 1, "C": 2}
    assert tables.read_json(spark, f"{tmp_path}/meta/train_stage_summary.json")["freqs"]["1h"]["n_windows"] == 1
    frames = pipeline.report(state.get("predictions_1h"), state.get("importance_1h"), 3)
    assert frames["top_features"].count() == 3 and frames["by_symbol"].count() == 3
    assert [x.split(":")[0] for x in said] == ["aligned", "blocks", "all", "ready", "dataset", "train", "all"]


def test_uneven_symbols_are_left_out_or_raise(spark):
    snap, vol = inputs(spark, 1)
    broken = vol.where("not (symbol = 'B' and hour(ts_grid) = 5)")
    with pytest.raises(ValueError):
        pipeline.aligned(snap, broken, VOLS, ["vol_5m"], "20m", levels=2)
    got = pipeline.aligned(snap, broken, VOLS, ["vol_5m"], "20m", levels=2, on_error="skip")
    assert {r.symbol for r in got.select("symbol").distinct().collect()} == {"A", "C"}


def test_history_is_required(spark):
    snap, vol = inputs(spark, 2)
    df = pipeline.aligned(snap, vol, VOLS, ["vol_5m"], "20m", levels=2)
    config = pipeline.Config(SYMBOLS, ["A"], features=("mid",), train_window="1d")
    with pytest.raises(ValueError):
        pipeline.window_cache(df, "2024-01-01", config, check=True)
    train, query = pipeline.window_cache(df, "2024-01-02", config)
    assert train.agg(F.max("ts")).first()[0] < dt.datetime(2024, 1, 2) <= query.agg(F.min("ts")).first()[0]


def test_models(spark):
    rng = random.Random(3)
    rows = [(f"window_{k % 2:03d}", "train" if k % 5 else "test", float(x), 2.0 * x + rng.random() / 10, rng.random()) for k, x in enumerate(rng.choices(range(50), k=400))]
    df = spark.createDataFrame(rows, "window_name string, split string, x double, y double, noise double")
    params = models.BoostParams(rounds=5, least_rows=5)
    made, gains, metrics = models.train_windows(df, ["x", "noise"], "y", [], params)
    assert metrics.count() == 2 and all(r["corr"] > 0.9 for r in metrics.collect())
    best = gains.groupBy("feature").agg(F.avg("importance_gain").alias("g"), F.sum("importance_split").alias("s")).orderBy(F.desc("g")).collect()
    assert best[0].feature == "x" and best[0].s > 0
    assert models.train_windows(df, ["x"], "y", [], params, done=("window_000",))[2].count() == 1
    with pytest.raises(ValueError):
        models.train_windows(df.where("split = 'train'"), ["x"], "y", [], params)
    line = models.linear_baseline(df.where("split = 'train'"), df.where("split = 'test'"), ["x"], "y", []).selectExpr("max(abs(y_true - y_pred)) AS m").first()
    assert line.m < 0.2


def test_manifest():
    assert pipeline.manifest(["ts", "a", "b", "a", "y", "symbol"], "y") == ["a", "b"]


@pytest.mark.parametrize("right", [True, False])
def test_stream_equals_batch(spark, tmp_path, right):
    rng = random.Random(5)
    rows = [("ab"[k % 2], T0 + dt.timedelta(seconds=rng.randint(0, 400)), k, rng.random()) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, ts timestamp_ntz, id int, x double")
    path = str(tmp_path / "in")
    df.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    plan = agg_plan(["x"], None, ("x",))
    stream = spark.readStream.schema("g string, ts timestamp, id int, x double").parquet(path)
    out = stream_downsample(stream, "1m", "1s", ["g"], plan, right_closed=right, tie=["id"])
    name = f"made_{right}".lower()
    query = out.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {(r.g, r.ts): r for r in spark.table(name).collect()}
    if right:
        want = {(r.g, r.ts): r for r in downsample_right(df, "1m", ["g"], plan, tie=["id"]).collect()}
        assert set(got) == set(want)
        assert all(got[k].x_last == want[k].x_last and got[k].x_mean == pytest.approx(want[k].x_mean) for k in want)
    else:
        want = {(r.g, r.ts): r.x for r in downsample_left(df, "1m", ["g"], ["x"]).collect()}
        assert {k: pytest.approx(v.x_mean) for k, v in got.items()} == want
