"""Pivot, unpivot, unions, samples and normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timeops import DAY_US, duration_us, floor_us, ticks


def symbols_of(df: DataFrame, symbol: str = "symbol", most: int = 5_000) -> list[str]:
    """Sorted distinct symbols for explicit pivot columns; more than ``most`` raise."""
    got = sorted(r[0] for r in df.select(symbol).where(F.col(symbol).isNotNull()).distinct().limit(most + 1).collect())
    if len(got) > most:
        raise ValueError(f"more than {most} symbols")
    return got


def common_symbols(train: DataFrame, query: DataFrame, symbol: str = "symbol") -> list[str]:
    """Symbols of both sides; none in common raises."""
    there = set(symbols_of(query, symbol))
    both = [s for s in symbols_of(train, symbol) if s in there]
    if not both:
        raise ValueError("no symbol in common")
    return both


def pivot_feature(df: DataFrame, feature: str, symbols: list[str], ts: str = "ts", symbol: str = "symbol", fill_mean: bool = True, tie: list[str] | None = None) -> DataFrame:
    """One row a time, one column a symbol; what is missing gets the column's mean.

    Of several rows of one time and symbol the first by ``tie`` counts (without it, the least value): no result hangs on the shuffle.
    """
    value = F.col(f"`{feature}`")
    wide = df.groupBy(ts).pivot(symbol, symbols).agg(F.min_by(value, F.when(value.isNotNull(), F.struct(*(tie or []), value))))
    if not fill_mean:
        return wide
    means = wide.agg(*[F.avg(f"`{s}`").alias(f"_m{k}") for k, s in enumerate(symbols)])
    filled = [F.coalesce(F.col(f"`{s}`"), F.col(f"_m{k}")).alias(s) for k, s in enumerate(symbols)]
    return wide.join(F.broadcast(means), F.lit(True)).select(ts, *filled)  # one row


def unpivot_long(wide: DataFrame, symbols: list[str], name: str, ts: str = "ts", symbol: str = "symbol") -> DataFrame:
    """(symbol, ts, value) rows of a wide frame."""
    return wide.unpivot([ts], [f"`{s}`" for s in symbols], symbol, name).withColumn(symbol, F.regexp_replace(symbol, "^`|`$", "")).select(symbol, ts, name)


def union_widened(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by name, numeric columns widened to double where their types differ, missing columns null."""
    kinds: dict[str, set[str]] = {}
    for df in frames:
        for name, kind in df.dtypes:
            kinds.setdefault(name, set()).add(kind)
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    wide = {n: "double" if k <= numeric and k & {"float", "double"} else "bigint" if k <= numeric else "string" for n, k in kinds.items() if len(k) > 1}
    out = None
    for df in frames:
        df = df.withColumns({n: F.col(n).cast(t) for n, t in wide.items() if n in df.columns})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def hash_sample(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """``n`` rows by the least MD5 of seed and key, joined by colons: the same rows at every run and partitioning, and in any engine."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in key])), *key).limit(n)


def stride_sample(df: DataFrame, every: int, order: list[str], by: list[str], bucket: str | int = DAY_US) -> DataFrame:
    """Rows 0, ``every``, 2 * ``every`` ... of each group, by ``order`` (a time or whole number first).

    Rows are numbered within time buckets; how many come before a bucket is summed over a row per bucket.
    """
    by_bucket = [*by, "_bucket"]
    rows = df.withColumn("_bucket", floor_us(ticks(df, order[0]), duration_us(bucket)))
    sizes = rows.groupBy(*by_bucket).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by_bucket, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    k = F.row_number().over(Window.partitionBy(*by_bucket).orderBy(*order)) - 1
    return rows.withColumn("_k", k).join(sizes, by_bucket).where((F.col("_before") + F.col("_k")) % every == 0).select(*df.columns)


def normalised(df: DataFrame, col: str, by: list[str], name: str | None = None) -> DataFrame:
    """(x - min) / (max - min) in each group; 0 where all are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(col).over(w), F.max(col).over(w)
    return df.withColumn(name or col, F.when(high > low, (F.col(col) - low) / (high - low)).otherwise(0.0))


def first_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """A diagnostic sample."""
    return df.orderBy(*order).limit(n)
