"""Rolling train, validation and test windows; symbol codes; training samples by frequency."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import no_nulls
from tidemark.functions.timeops import day_of
from tidemark.operators.checks import require_days
from tidemark.operators.resample import agg_plan, downsample_right, feature_names, rolling_trailing


def symbol_codes(df: DataFrame, symbol: str = "symbol") -> DataFrame:
    """(symbol, symbol_code): rank from 0 in sorted order of the distinct symbols."""
    names = df.select(symbol).where(F.col(symbol).isNotNull()).distinct()
    return names.select(symbol, (F.row_number().over(Window.orderBy(symbol)) - 1).cast("int").alias("symbol_code"))


def with_symbol_code(df: DataFrame, codes: DataFrame, symbol: str = "symbol", check: bool = False) -> DataFrame:
    """``df`` with the code of its symbol; ``check`` raises on a symbol without one."""
    out = df.join(codes, symbol, "left")
    if check and not out.where(F.col("symbol_code").isNull()).isEmpty():
        raise ValueError("symbol without a code")
    return out


def resolve_symbol_code(df: DataFrame, symbol: str = "symbol") -> DataFrame:
    """The code under one name: ``symbol_code`` if there, else ``symbol_code_last``, else by sorted order."""
    if "symbol_code" in df.columns:
        return df
    if "symbol_code_last" in df.columns:
        return df.withColumn("symbol_code", F.col("symbol_code_last").cast("int"))
    return with_symbol_code(df, symbol_codes(df, symbol), symbol)


def raw_block(df: DataFrame, target: str, ts: str = "ts", symbol: str = "symbol") -> DataFrame:
    """Keys, target and everything else, in this order, without rows that hold a null."""
    rest = [c for c in df.columns if c not in (ts, symbol, target)]
    return no_nulls(df.select(ts, symbol, target, *[f"`{c}`" for c in rest]))


def window_rows(units: list, train: int, val: int, test: int, step: int = 1, newest_only: bool = False) -> list[tuple]:
    """(unit, window_id, window_name, split, units of the same split before it) for each unit of each window."""
    span, rows = train + val + test, []
    starts = list(enumerate(range(0, len(units) - span + 1, step)))
    for i, at in starts[-1:] if newest_only else starts:
        for k in range(span):
            split, back = ("train", k) if k < train else ("val", k - train) if k < train + val else ("test", k - train - val)
            rows.append((units[at + k], i, f"window_{i:03d}_{units[at + train + val]}", split, back))
    return rows


def rolling_splits(df: DataFrame, unit: str, train: int, val: int, test: int, step: int = 1, newest_only: bool = False) -> DataFrame:
    """Each row once for every window that its unit (a day or block) is in, with window_id, window_name and split.

    Windows count the units that exist, in order; gaps are no units. The units are few (one a day or
    block): they come to the driver, and their windows are a small table for a broadcast join.
    """
    units = require_days(df, train + val + test, unit)
    rows = [r[:4] for r in window_rows(units, train, val, test, step, newest_only)]
    table = df.sparkSession.createDataFrame(rows, f"`{unit}` {df.schema[unit].dataType.simpleString()}, window_id int, window_name string, split string")
    return df.join(F.broadcast(table), unit)


def with_day(df: DataFrame, ts: str = "ts", name: str = "date") -> DataFrame:
    return df.withColumn(name, day_of(ts))


def training_sample(train: DataFrame, pred: DataFrame, freq: str, features: list[str], target: str, by: list[str], ts: str = "ts", multi: tuple[str, ...] = (), tie: list[str] | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Right-closed buckets of the train rows, trailing windows of the rows to predict, and their common features."""
    plan = agg_plan(features, target, multi)
    down = downsample_right(train, freq, by, plan, ts, tie)
    roll = rolling_trailing(pred, freq, by, plan, ts, tie, drop_nulls=True)
    if down.columns != roll.columns:
        raise ValueError("train and prediction columns differ")
    return down, roll, feature_names(plan)


def freq_fanout(df: DataFrame, freqs: list[str], features: list[str], target: str, by: list[str], ts: str = "ts", multi: tuple[str, ...] = (), tie: list[str] | None = None) -> DataFrame:
    """The right-closed sample at every frequency, named in ``freq``."""
    plan = agg_plan(features, target, multi)
    made = [downsample_right(df, f, by, plan, ts, tie).withColumn("freq", F.lit(f)) for f in freqs]
    return reduce(lambda a, b: a.unionByName(b), made)


def assembled(df: DataFrame, features: list[str], target: str, as_float: bool = True) -> DataFrame:
    """``features`` vector and ``label``, rounded to 32-bit floats as the models see them."""
    cast = (lambda c: F.col(f"`{c}`").cast("float").cast("double")) if as_float else (lambda c: F.col(f"`{c}`").cast("double"))
    out = df.withColumns({f"_f{k}": cast(c) for k, c in enumerate(features)} | {"label": cast(target)})
    made = VectorAssembler(inputCols=[f"_f{k}" for k in range(len(features))], outputCol="features", handleInvalid="keep").transform(out)
    return made.drop(*[f"_f{k}" for k in range(len(features))])
