"""The three composed pipelines: raw to aligned blocks, blocks to models, results to reports."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timeops import DAY_US, duration_us, offset
from tidemark.operators.asof import block_of
from tidemark.operators.checks import even_groups, require_columns, require_history
from tidemark.operators.datasets import raw_block, rolling_splits, training_sample, with_day
from tidemark.operators.factors import base_factors, clip_to, derived_factors, trim_leading
from tidemark.operators.importance import importance_mean, top_features
from tidemark.operators.labels import feature_join, label_join
from tidemark.operators.metrics import evaluate, with_errors
from tidemark.operators.neighbors import neighbor_block, symbol_neighbors, time_neighbors
from tidemark.operators.resample import downsample_left
from tidemark.plans.models import BoostParams, train_windows
from tidemark.sources.bucketed import add_bucketed, join_bucketed, open_bucketed
from tidemark.sources.tables import list_partitions, write_json, write_table

#: Base factors that serve as features unless others are named.
DEFAULT_FEATURES = ("vwap", "imbalance", "spread", "mid", "log_return")

#: What rows of stored day tables are bucketed by and joined on.
KEYS = ["symbol", "ts"]


@dataclass(frozen=True)
class Config:
    """Settings of a run; what the data decide (symbols, dates, base symbols) has no default."""

    symbols: list[str]
    base_symbols: list[str]
    target: str = "y_vol_5m"
    features: tuple[str, ...] = DEFAULT_FEATURES
    neighbor_counts: tuple[int, ...] = (5, 10, 20, 50, 100)
    grid: str = "20ms"
    train_window: str = "7d"
    train_subsample: str = "200ms"
    block: str = "1h"
    freqs: tuple[str, ...] = ("100ms", "200ms", "500ms", "1s")
    train_days: int = 21
    val_days: int = 1
    test_days: int = 1
    step: int = 1
    label_ahead: str = "5m"
    levels: int = 25
    boost: BoostParams = field(default_factory=BoostParams)


@dataclass
class State:
    """Frames handed from stage to stage; they are lazy, so this costs nothing."""

    frames: dict[str, DataFrame] = field(default_factory=dict)
    notes: dict[str, object] = field(default_factory=dict)

    def put(self, name: str, value: DataFrame) -> None:
        self.frames[name] = value

    def get(self, name: str) -> DataFrame:
        return self.frames[name]


Stage = Callable[[SparkSession, Config, State], None]


def run_stages(spark: SparkSession, config: Config, stages: list[tuple[str, Stage]], state: State | None = None, report: Callable[[str], None] = print) -> State:
    """Stages in order; the seconds of each and of all are reported."""
    state, began = state or State(), time.monotonic()
    for name, stage in stages:
        at = time.monotonic()
        stage(spark, config, state)
        report(f"{name}: {time.monotonic() - at:.1f} s")
    report(f"all: {time.monotonic() - began:.1f} s")
    return state


def manifest(columns: list[str], target: str, keys: tuple[str, ...] = ("ts", "symbol", "date")) -> list[str]:
    """Ordered unique feature names, the target and keys left out."""
    return [c for c in dict.fromkeys(columns) if c != target and c not in keys]


def aligned(snapshots: DataFrame, vol: DataFrame, vol_cols: list[str], label_cols: list[str], ahead: str, levels: int = 25, trim_minutes: int = 15, check: bool = True, on_error: str = "raise") -> DataFrame:
    """Snapshots and volatility of all symbols and days at once: clip, factors, volatilities, derived factors, labels, trim.

    A symbol's day whose volatility grid is uneven raises, or is left out if ``on_error`` is skip.
    """
    by = ["symbol", "date"]
    if on_error not in ("raise", "skip"):
        raise ValueError("on_error must be raise or skip")
    if on_error == "skip":
        vol = vol.join(even_groups(vol, tuple(by), "ts_grid"), by, "left_semi")
    df = base_factors(clip_to(snapshots, vol, by), by, levels=levels)
    df = feature_join(df, vol, vol_cols, by)
    df = derived_factors(df)
    df = label_join(df, vol, label_cols, ahead, by, check=check)
    return trim_leading(df, trim_minutes)


def blocks(df: DataFrame, every: str) -> DataFrame:
    """Aligned rows with their block; blocks count from the earliest time of all symbols."""
    origin = df.agg(F.min("ts")).first()[0]
    return block_of(df, every, F.lit(str(origin)).cast("timestamp_ntz"))


def of_days(df: DataFrame, first: str, last: str, day: str = "date") -> DataFrame:
    """Rows of these days, by the table's partition column if it has one, so that other days' directories aren't read."""
    return df.where(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date"))) if day in df.columns else df


def window_cache(df: DataFrame, day: str, config: Config, check: bool = False) -> tuple[DataFrame, DataFrame]:
    """(train, query) of a day: the window before it, averaged to the train frequency, and the day's raw rows."""
    start = F.lit(f"{day} 00:00:00").cast("timestamp_ntz")
    cols = [*config.features, config.target]
    back = -(-duration_us(config.train_window) // DAY_US)
    own = of_days(df, str(date.fromisoformat(day) - timedelta(days=back)), day)
    own = own.where(F.col("symbol").isin(config.symbols)).select("ts", "symbol", *cols)
    begin, end = offset(start, config.train_window, back=True), offset(start, "1d")
    if check:
        require_history(own, begin)
    train = own.where((F.col("ts") >= begin) & (F.col("ts") < start))
    return downsample_left(train, config.train_subsample, ["symbol"], list(config.features)), own.where((F.col("ts") >= start) & (F.col("ts") < end))


def ready_block(df: DataFrame, day: str, config: Config) -> DataFrame:
    """Query rows of a day with neighbour features, base features and the target."""
    train, query = window_cache(df, day, config)
    near = neighbor_block(train, query, list(config.features), list(config.neighbor_counts), config.base_symbols)
    return near.join(of_days(df, day, day), ["ts", "symbol"], "left")


def store_day(df: DataFrame, day: str, config: Config, root: str, buckets: int) -> None:
    """A day's rows, and the neighbour features of each feature, as tables under ``root`` bucketed by time and symbol; a day stored before is replaced."""
    train, query = window_cache(df, day, config)
    on = lambda rows: rows.withColumn("date", F.lit(day).cast("date"))
    add_bucketed(on(query.select("ts", "symbol")), f"{root}/query", KEYS, buckets, ["date"])
    start = F.lit(f"{day} 00:00:00").cast("timestamp_ntz")
    own = of_days(df, day, day).where((F.col("ts") >= start) & (F.col("ts") < offset(start, "1d")))
    add_bucketed(on(own.drop("date")), f"{root}/base", KEYS, buckets, ["date"])
    for f in config.features:
        for kind, make in (("time", time_neighbors), ("symbol", symbol_neighbors)):
            add_bucketed(on(make(train, query, f, list(config.neighbor_counts), config.base_symbols)), f"{root}/{kind}_{f}", KEYS, buckets, ["date"])


def stored_blocks(spark: SparkSession, config: Config, root: str, days: list[str]) -> DataFrame:
    """``ready_block`` of all these days out of ``store_day``'s tables: two joins a feature and one with the base, and no row is exchanged."""

    def table(name: str) -> DataFrame:
        rows = open_bucketed(spark, f"{root}/{name}")
        return rows.where(F.col("date").isin([date.fromisoformat(d) for d in days]))

    parts = [f"{kind}_{f}" for f in config.features for kind in ("time", "symbol")]
    return join_bucketed(table("query"), [table(name).drop("date") for name in [*parts, "base"]], KEYS)


def training_dataset(ready: DataFrame, config: Config, newest_only: bool = False) -> DataFrame:
    """Rolling windows by day at every frequency: split train is bucketed, val and test trail."""
    features = manifest(ready.columns, config.target)
    split = rolling_splits(with_day(raw_block(ready.drop("date"), config.target)), "date", config.train_days, config.val_days, config.test_days, config.step, newest_only)
    by, out = ["window_id", "window_name", "split", "symbol"], None
    for freq in config.freqs:
        down, roll, _ = training_sample(split.where("split = 'train'"), split.where("split <> 'train'"), freq, features, config.target, by, multi=config.features)
        made = down.unionByName(roll).withColumn("freq", F.lit(freq))
        out = made if out is None else out.unionByName(made)
    return out


def train_all(dataset: DataFrame, config: Config, freq: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(predictions, importances, metrics per window, metrics over all) of one frequency."""
    own = dataset.where(F.col("freq") == freq).drop("freq")
    features = [c for c in own.columns if c not in ("window_id", "window_name", "split", "symbol", "ts", config.target)]
    made, gains, metrics = train_windows(own, features, config.target, ["ts", "symbol"], config.boost)
    return made, gains, metrics, evaluate(made, [])


def report(predictions: DataFrame, importances: DataFrame, k: int = 20) -> dict[str, DataFrame]:
    """Frames behind the usual reports."""
    require_columns(predictions, ["y_true", "y_pred"], "predictions")
    return {
        "errors": with_errors(predictions),
        "overall": evaluate(predictions, []),
        "by_symbol": evaluate(predictions, ["symbol"]).orderBy("rmse", "symbol"),
        "top_features": top_features(importances, k),
    }


def run_config(spark: SparkSession, config: Config, root: str, freq: str, days: list) -> None:
    """The settings behind a frequency's dataset, with its symbol codes and days."""
    codes = {s: k for k, s in enumerate(sorted(config.symbols))}
    write_json(spark, asdict(config) | {"freq": freq, "symbol_codes": codes, "n_days": len(days), "days": [str(d) for d in days]}, f"{root}/meta/run_config.json")


def freq_summary(spark: SparkSession, config: Config, root: str, freq: str, metrics: DataFrame, importances: DataFrame, overall: DataFrame) -> dict:
    """Overall metrics and mean importances of a frequency as tables, and a summary, which is also returned."""
    overall.write.mode("overwrite").parquet(f"{root}/overall")
    importance_mean(importances).write.mode("overwrite").parquet(f"{root}/importance_mean")
    found = spark.read.parquet(f"{root}/overall").first()
    summary = {"freq": freq, "n_windows": metrics.count(), "boost": asdict(config.boost), "overall": found.asDict() if found else {}}
    write_json(spark, summary, f"{root}/meta/run_summary.json")
    return summary


def cache_stages(root: str, vol_cols: list[str], label_cols: list[str]) -> list[tuple[str, Stage]]:
    """Raw to aligned and blocks; the state must hold ``snapshots`` and ``vol``."""

    def align(spark: SparkSession, config: Config, state: State) -> None:
        df = aligned(state.get("snapshots"), state.get("vol"), vol_cols, label_cols, config.label_ahead, config.levels)
        path = write_table(df.withColumn("symbol", F.col("symbol")), root, "aligned")
        state.put("aligned", spark.read.parquet(path))
        state.notes["features"] = manifest(df.columns, config.target)

    def cut(spark: SparkSession, config: Config, state: State) -> None:
        state.put("blocks", spark.read.parquet(write_table(blocks(state.get("aligned"), config.block), root, "blocks", freq=config.block)))

    return [("aligned", align), ("blocks", cut)]


def main_stages(root: str, days: list[str]) -> list[tuple[str, Stage]]:
    """Aligned rows to models; the state must hold ``aligned``."""

    def ready(spark: SparkSession, config: Config, state: State) -> None:
        for day in days:
            made = ready_block(state.get("aligned"), day, config)
            write_table(made.withColumn("date", F.lit(day).cast("date")), root, "ready")
        state.put("ready", spark.read.parquet(f"{root}/ready"))

    def dataset(spark: SparkSession, config: Config, state: State) -> None:
        made = training_dataset(state.get("ready"), config)
        state.put("dataset", spark.read.parquet(write_table(made, root, "dataset")))
        for freq in config.freqs:
            run_config(spark, config, f"{root}/{freq}", freq, list_partitions(spark, root, "ready"))

    def train(spark: SparkSession, config: Config, state: State) -> None:
        done = {}
        for freq in config.freqs:
            made, gains, metrics, overall = train_all(state.get("dataset"), config, freq)
            for kind, df in (("predictions", made), ("importance", gains), ("metrics", metrics)):
                state.put(f"{kind}_{freq}", spark.read.parquet(write_table(df, f"{root}/{freq}", kind)))
            state.put(f"overall_{freq}", overall)
            done[freq] = freq_summary(spark, config, f"{root}/{freq}", freq, *(state.get(f"{k}_{freq}") for k in ("metrics", "importance")), overall)
        write_json(spark, {"freqs": done, "target": config.target}, f"{root}/meta/train_stage_summary.json")

    return [("ready", ready), ("dataset", dataset), ("train", train)]
