"""Gradient-boosted regression over windows, importances, and the lag and linear baselines."""

from __future__ import annotations

import re
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.datasets import assembled
from tidemark.operators.metrics import evaluate
from tidemark.operators.resample import previous
from tidemark.plans.boosting import LeafParams, train_leafwise
from tidemark.sources.tables import staged


@dataclass(frozen=True)
class BoostParams:
    """Spark's boosted trees; depth 6 has 64 leaves at most."""

    rate: float = 0.05
    depth: int = 6
    rounds: int = 20
    row_share: float = 0.8
    feature_share: float = 0.8
    least_rows: int = 200
    seed: int = 42


def split_counts(model, features: list[str]) -> dict[str, int]:
    """How often each feature splits, read from the model's description."""
    found = Counter(int(k) for k in re.findall(r"If \(feature (\d+)", model.toDebugString))
    return {f: found.get(k, 0) for k, f in enumerate(features)}


def train_boosted(train: DataFrame, features: list[str], target: str, params: BoostParams = BoostParams()):
    """(model, importances): gain-like and split importances of each feature."""
    booster = GBTRegressor(
        maxIter=params.rounds, stepSize=params.rate, maxDepth=params.depth, subsamplingRate=params.row_share,
        featureSubsetStrategy=str(params.feature_share), minInstancesPerNode=params.least_rows, seed=params.seed, cacheNodeIds=True,
    )
    model = booster.fit(assembled(train, features, target).select("features", "label"))
    gain, splits = model.featureImportances.toArray(), split_counts(model, features)
    rows = [(f, float(gain[k]), splits[f]) for k, f in enumerate(features)]
    return model, train.sparkSession.createDataFrame(rows, "feature string, importance_gain double, importance_split long")


def predict(model, df: DataFrame, features: list[str], target: str, keep: list[str], as_float: bool = True) -> DataFrame:
    return model.transform(assembled(df, features, target, as_float)).select(*keep, F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))


def train_window(own: DataFrame, features: list[str], target: str, keep: list[str], params: BoostParams | LeafParams) -> tuple[DataFrame, DataFrame]:
    """(predictions of the test rows, importances) of one window; leaf-wise trees stop early by its val rows, if it has any."""
    train, test = own.where("split = 'train'"), own.where("split = 'test'")
    if isinstance(params, BoostParams):
        model, gains = train_boosted(train, features, target, params)
        return predict(model, test, features, target, keep), gains
    model = train_leafwise(train, features, target, params, own.where("split = 'val'"), keep or None)
    rows = [(f, g, k) for f, (g, k) in model.importances().items()]
    gains = own.sparkSession.createDataFrame(rows, "feature string, importance_gain double, importance_split long")
    test = model.predict(test, "_made").select(*keep, F.col(target).cast("float").cast("double").alias("y_true"), F.col("_made").alias("y_pred"))
    return test, gains


def train_windows(splits: DataFrame, features: list[str], target: str, keep: list[str], params: BoostParams | LeafParams = BoostParams(), done: tuple[str, ...] = (), at_once: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fit on each window's train rows, predict its test rows: (predictions, importances, metrics per window).

    Windows named in ``done`` are left out. ``splits`` is written once, and ``at_once`` windows are fitted side by side, so that
    one window's small jobs don't leave the cluster idle; only window names come to the driver.
    """
    splits = staged(splits)
    sizes = splits.groupBy("window_name").agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("train", "test")]).collect()
    if not [r for r in sizes if r.window_name not in done]:
        raise ValueError("no window to train")
    names = sorted(r.window_name for r in sizes if r.window_name not in done and r.train and r.test)
    if not names:
        raise ValueError("every window lacks train or test rows")

    def one(name: str) -> tuple[DataFrame, DataFrame]:
        own = splits.where(F.col("window_name") == name)
        return tuple(df.withColumn("block_name", F.lit(name)) for df in train_window(own, features, target, keep, params))

    with ThreadPoolExecutor(at_once) as pool:
        made = list(pool.map(inheritable_thread_target(splits.sparkSession)(one), names))
    predictions, importances = (reduce(DataFrame.unionByName, frames) for frames in zip(*made, strict=True))
    return predictions, importances, evaluate(predictions, ["block_name"])


def lag_baseline(df: DataFrame, col: str, by: list[str], ts: str = "ts", tie: list[str] | None = None, name: str = "y_pred") -> DataFrame:
    """The value before as the forecast."""
    return previous(df, col, by, ts, tie, name)


def linear_baseline(train: DataFrame, test: DataFrame, features: list[str], target: str, keep: list[str], ridge: float = 0.0) -> DataFrame:
    model = LinearRegression(regParam=ridge).fit(assembled(train, features, target, False).select("features", "label"))
    return predict(model, test, features, target, keep, False)
