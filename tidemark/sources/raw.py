"""Raw inputs: book snapshots as CSV, volatility series as NPZ."""

from __future__ import annotations

import io
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timeops import ceil_us, duration_ns, duration_us, epoch_us, floor_us, from_ns, from_us
from tidemark.operators.asof import locf_grid
from tidemark.operators.checks import require_even
from tidemark.operators.factors import book_columns
from tidemark.operators.resample import last_by_time

#: Columns of a volatility series.
VOL_COLUMNS = ["vol_1m", "vol_5m", "vol_10m", "vol_15m", "vol_30m", "vol_60m", "vol_120m"]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# The layout and names of snapshot files.
def snapshot_path(root: str, symbol: str, date: str) -> str:
    return f"{root}/{symbol}/book_snapshot_25/binance-futures_book_snapshot_25_{date}_{symbol}.csv"


def read_snapshots(spark: SparkSession, paths: list[str], columns: list[str] | None = None, timestamp: str = "timestamp", same_header: bool = False) -> DataFrame:
    """CSV book snapshots (also gz or zst) with an explicit schema: int64 microseconds, doubles; ``ts`` is added.

    Columns are found by name, in each file's own order: files are grouped by their header row, which is read first, 16 files at
    a time. With ``same_header`` only the first file's is read beforehand, however many files there are; one that has another fails
    when it is read, because Spark compares each file's header with the schema.
    """
    wanted = columns or book_columns()
    known = T.StructType([T.StructField(timestamp, T.LongType()), *[T.StructField(c, T.DoubleType()) for c in book_columns()]])
    alike: dict[tuple, list[str]] = {}

    def head(path: str) -> tuple:
        return tuple(spark.read.option("header", True).csv(path).columns)

    if same_header:
        alike[head(paths[0])] = paths
    else:
        with ThreadPoolExecutor(16) as pool:
            for path, names in zip(paths, pool.map(inheritable_thread_target(spark)(head), paths), strict=True):
                alike.setdefault(names, []).append(path)

    def read(head: tuple, files: list[str]) -> DataFrame:
        schema = T.StructType([known[c] if c in known.names else T.StructField(c, T.StringType()) for c in head])
        df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(files)
        return df.select(timestamp, from_us(F.col(timestamp)).alias("ts"), *[f"`{c}`" for c in wanted])

    return reduce(DataFrame.unionByName, (read(head, files) for head, files in alike.items()))


def load_snapshot(spark: SparkSession, root: str, symbol: str, date: str, columns: list[str] | None = None, subsample: str | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """One symbol and day; .gz wins over .zst over plain. Equal times collapse to the last row; ``subsample`` puts the rows on a regular grid by as-of."""
    base = snapshot_path(root, symbol, date)
    found = next((base + e for e in (".gz", ".zst", "") if _exists(spark, base + e)), None)
    if not found:
        raise FileNotFoundError(f"{base}.gz or .zst")
    df = read_snapshots(spark, [found], columns)
    # gz and zst can't be split: one task reads, then rows are dealt out
    df = df.withColumn("_line", F.monotonically_increasing_id()).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "ts")
    if start is not None:
        df = df.where(F.col("ts") >= start)
    if end is not None:
        df = df.where(F.col("ts") <= end)
    df = last_by_time(df, ["ts"], ["_line"]).drop("_line").withColumns({"symbol": F.lit(symbol), "date": F.lit(date).cast("date")})
    if subsample:
        cols = [c for c in df.columns if c not in ("ts", "symbol", "date")]
        quoted = df.withColumnsRenamed({c: c.replace("[", "_").replace("].", "_") for c in cols})
        names = [c for c in quoted.columns if c not in ("ts", "symbol", "date")]
        df = locf_grid(quoted, subsample, ["symbol", "date"], names).drop("matched_ts").withColumnsRenamed(dict(zip(names, cols, strict=True)))
    return df


def symbols_with_snapshots(spark: SparkSession, root: str, symbols: list[str], date: str, on_error: str = "raise") -> list[str]:
    """Symbols whose snapshot file of a day is there, looked up before any plan is built.

    ``on_error`` raise: a missing one is an error; skip: it is left out. None at all is an error either way.
    """
    there = [s for s in symbols if any(_exists(spark, snapshot_path(root, s, date) + e) for e in (".gz", ".zst", ""))]
    if not there or (on_error == "raise" and len(there) < len(symbols)):
        raise FileNotFoundError(f"no snapshots on {date} of {[s for s in symbols if s not in there]}")
    return there


def ingest_volatility(spark: SparkSession, pattern: str, columns: list[str] | None = None) -> DataFrame:
    """NPZ files ({symbol}/{date}_volatility.npz, structured array ``data``) as rows: path, timestamp (ns), doubles.

    Files are read by Spark as binaries and unpacked where they lie, one symbol and day at a time.
    """
    wanted = columns or VOL_COLUMNS

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                data = np.load(io.BytesIO(content), allow_pickle=False)["data"]
                frame = {"path": path, "timestamp": data["timestamp"].astype(np.int64)}
                yield pd.DataFrame(frame | {c: data[c].astype(np.float64) for c in wanted})

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    rows = files.mapInPandas(unpack, "path string, timestamp long, " + ", ".join(f"`{c}` double" for c in wanted))
    return rows.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("symbol"), F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})_volatility", 1).cast("date").alias("date"), "timestamp", *wanted)


def align_volatility(vol: DataFrame, resolution: str | int, by: list[str], check: bool = True) -> DataFrame:
    """Volatility on its grid: the last row of each right-closed bucket, labelled ``ts_grid``; steps must be even.

    Steps and buckets are those of the nanoseconds: only the grid point becomes a time.
    """
    if check:
        require_even(vol, "timestamp", tuple(by))
    grid = from_ns(ceil_us(F.col("timestamp"), duration_ns(resolution)))
    return last_by_time(vol.withColumn("ts_grid", grid), [*by, "ts_grid"], ["timestamp"])


def on_grid(ts: Column, step: str | int, up: bool = False) -> Column:
    """A time moved to its grid point, down or up."""
    width = duration_us(step)
    return from_us((ceil_us if up else floor_us)(epoch_us(ts), width))
