"""Parquet tables partitioned by date, symbol, block, frequency or window: one layout for every intermediate."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timeops import duration_us
from tidemark.operators.checks import require_columns
from tidemark.operators.metrics import evaluate
from tidemark.operators.shape import union_widened
from tidemark.sources.raw import _exists

#: Partition columns of each kind of table.
LAYOUT = {
    "aligned": ["date", "symbol"],
    "blocks": ["date", "block_start"],
    "windows": ["date", "role"],
    "neighbors": ["date"],
    "ready": ["date"],
    "dataset": ["freq", "window_name", "split"],
    "predictions": ["block_name"],
    "metrics": [],
    "partials": ["block_name"],
    "importance": ["block_name"],
    "carried_parts": ["unit"],
    "carried_trails": ["unit"],
    "carried_tails": ["unit"],
}


def freq_name(freq: str) -> str:
    return freq.strip().lower()


def table_path(root: str, kind: str, freq: str | None = None) -> str:
    return f"{root.rstrip('/')}/{kind}" + (f"_{freq_name(freq)}" if freq else "")


def read_table(spark: SparkSession, root: str, kind: str, columns: list[str] | None = None, where: Column | None = None, freq: str | None = None) -> DataFrame:
    """A stored table; filters on partition columns prune directories, others reach the scan. Block starts are TIMESTAMP_NTZ again, whatever folder names look like."""
    df = spark.read.parquet(table_path(root, kind, freq))
    if "block_start" in LAYOUT[kind]:
        df = df.withColumn("block_start", F.col("block_start").cast("timestamp_ntz"))
    df = df if where is None else df.where(where)
    return df.select(*columns) if columns else df


def read_aligned(spark: SparkSession, root: str, symbols: list[str], dates: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows of the named symbols; each must be there."""
    df = read_table(spark, root, "aligned")
    if dates:
        df = df.where(F.col("date").isin([date.fromisoformat(d) for d in dates]))
    there = {r[0] for r in df.select("symbol").distinct().collect()}
    if missing := [s for s in symbols if s not in there]:
        raise FileNotFoundError(f"no aligned rows of {missing}")
    df = df.where(F.col("symbol").isin(symbols))
    return df.select(*columns) if columns else df


def read_slice(df: DataFrame, start: Column, end: Column, ts: str = "ts", closed: str = "left") -> DataFrame:
    """[start, end), or [start, end] if ``closed`` is both."""
    return df.where((F.col(ts) >= start) & ((F.col(ts) <= end) if closed == "both" else (F.col(ts) < end)))


def read_history(df: DataFrame, day_start: Column, window: str, ts: str = "ts", check: bool = False) -> tuple[DataFrame, bool | None]:
    """Rows of [day start - window, day start) and, with ``check``, whether they reach back to its beginning."""
    start = F.timestamp_add("MICROSECOND", F.lit(-duration_us(window)).cast("long"), day_start)
    got = read_slice(df, start, day_start, ts)
    full = df.agg((F.min(ts) <= start).alias("x")).first().x if check else None
    return got, full


def base_slice(base: DataFrame, neighbors: DataFrame, ts: str = "ts", symbol: str = "symbol") -> DataFrame:
    """Base rows between the first and last time of the neighbour rows (both included), of their symbols."""
    ends = neighbors.agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    kept = base.join(F.broadcast(ends), F.col(ts).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")  # one row
    return kept.join(neighbors.select(symbol).distinct(), symbol, "left_semi")


def list_partitions(spark: SparkSession, root: str, kind: str, until: str | None = None, day: str = "date") -> list:
    """Sorted partition values (days, blocks, windows) that are stored, up to a day."""
    df = read_table(spark, root, kind).select(day).distinct()
    if until:
        df = df.where(F.col(day) <= F.lit(until).cast("date"))
    got = sorted(r[0] for r in df.collect())
    if not got:
        raise FileNotFoundError(f"no {kind} under {root}")
    return got


def read_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Result files of several runs, their columns widened to common types, with the file each row is from."""
    frames = [spark.read.option("recursiveFileLookup", True).parquet(p).withColumn("pred_file", F.col("_metadata.file_path")) for p in paths]
    return union_widened(frames)


def evaluate_files(spark: SparkSession, paths: list[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Metrics of each result file, best first: pred_file, folder, symbol (the rows' own, or the folder's name where they have none)."""
    df = read_results(spark, paths)
    require_columns(df, [y, p], "results")
    folder = F.element_at(F.split("pred_file", "/"), -2)
    own = F.col("symbol").cast("string") if "symbol" in df.columns else F.lit(None).cast("string")
    names = df.groupBy("pred_file").agg(F.coalesce(F.min(own), F.first(folder)).alias("symbol"), F.first(folder).alias("folder"))
    return evaluate(df, ["pred_file"], y, p).join(names, "pred_file").orderBy("rmse", "pred_file")


def read_features(spark: SparkSession, paths: dict[str, str], columns: list[str]) -> dict[str, DataFrame]:
    """A frame for each feature whose table is there and has rows; absent and empty ones are left out."""
    frames = {f: spark.read.parquet(path).select(*columns, f) for f, path in paths.items() if _exists(spark, path)}
    return {f: df for f, df in frames.items() if not df.isEmpty()}


def previous_day_tail(spark: SparkSession, root: str, day: str, n: int, kind: str = "blocks", block: str = "block_start", freq: str | None = None) -> list:
    """The last ``n`` blocks stored of the day before; none if that day isn't there."""
    before = date.fromisoformat(day) - timedelta(days=1)
    got = read_table(spark, root, kind, freq=freq).where(F.col("date") == F.lit(str(before)).cast("date")).select(block).distinct().orderBy(F.desc(block)).limit(n)
    return sorted(r[0] for r in got.collect())


def scratch_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under ``spark.checkpoint.dir``; on one machine a temporary one will do."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        shared = tempfile.gettempdir()
    return f"{shared.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once under ``scratch_dir`` and read back: computed once, outlives lost executors, and nothing stays in their memory."""
    path = f"{scratch_dir(df.sparkSession)}/staged"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def feature_columns(df: DataFrame, keys: tuple[str, ...] = ("ts", "symbol", "date"), target: str | None = None) -> list[str]:
    return [c for c in df.columns if c not in keys and c != target]


def write_table(df: DataFrame, root: str, kind: str, mode: str = "overwrite", freq: str | None = None) -> str:
    """Write zstd Parquet by the kind's partition columns.

    overwrite: the partitions that ``df`` has are replaced, others stay. skip: partitions that are stored already
    are left as they are (their rows of ``df`` go). error: nothing may be there.
    """
    spark, path, by = df.sparkSession, table_path(root, kind, freq), LAYOUT[kind]
    if mode == "skip" and _exists(spark, path):
        if not by:
            return path
        df = df.join(F.broadcast(spark.read.parquet(path).select(*by).distinct()), by, "left_anti")  # one row a partition
    if by:
        df = df.hint("rebalance", *by)  # a partition's rows come together; AQE cuts a large one into files of the advised size
    writer = df.write.option("compression", "zstd").option("partitionOverwriteMode", "dynamic")
    writer = writer.partitionBy(*by) if by else writer
    writer.mode({"overwrite": "overwrite", "skip": "append", "error": "error"}[mode]).parquet(path)
    return path


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """A small configuration or summary; what JSON doesn't know is written as text."""
    text = json.dumps(value, default=lambda x: x.__dict__ if hasattr(x, "__dict__") else str(x), sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> object:
    return json.loads(spark.read.text(path).first().value)


def symbols_of_list(text: str) -> list[str]:
    """Symbols of a list file: one '- NAMEUSDT' a line, comments ignored, each once, in order."""
    names = [line.split("#")[0].strip() for line in text.splitlines()]
    names = [n.removeprefix("-").strip().strip("'\"") for n in names if n.startswith("-")]
    return list(dict.fromkeys(n for n in names if n.endswith("USDT")))


def chunks(items: list, size: int = 15) -> list[list]:
    return [items[k : k + size] for k in range(0, len(items), size)]


def named_groups(items: list, size: int = 15, name: Callable[[int], str] = "group_{:02d}".format) -> dict[str, list]:
    return {name(k): part for k, part in enumerate(chunks(items, size))}
