"""Forecast metrics from sums over one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import finite, ratio
from tidemark.functions.timeops import duration_us, epoch_us, floor_us, from_us

EPS = 1e-12


def qlike(y: Column, p: Column, eps: float = EPS) -> Column:
    """r - ln r - 1 with r the ratio of squares, each at least ``eps``."""
    r = F.greatest(y * y, F.lit(eps)) / F.greatest(p * p, F.lit(eps))
    return r - F.ln(r) - 1


def qlike_plain(y: Column, p: Column, eps: float = EPS) -> Column:
    """The bucketed form: r - ln(r + eps) - 1 with r = y / (p + eps), not squared; null where r + eps isn't positive."""
    r = ratio(y, p + eps)
    return F.when(r + eps > 0, r - F.ln(r + eps) - 1)


def correlation(y: Column, p: Column) -> Column:
    """Pearson's; null where either side is constant (``corr`` would raise)."""
    spread = F.stddev_pop(y) * F.stddev_pop(p)
    return ratio(F.covar_pop(y, p), spread)


def evaluate(df: DataFrame, by: list[str], y: str = "y_true", p: str = "y_pred", eps: float = EPS, check: bool = False) -> DataFrame:
    """n, rmse, mae, corr and qlike over pairs that are both finite, for each ``by`` (or overall)."""
    t, q = F.col(y).cast("double"), F.col(p).cast("double")
    rows = df.where(finite(t) & finite(q))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg((t - q) * (t - q))).alias("rmse"),
        F.avg(F.abs(t - q)).alias("mae"),
        correlation(t, q).alias("corr"),
        F.avg(qlike(t, q, eps)).alias("qlike"),
    )
    if check and rows.isEmpty():
        raise ValueError("no pair of finite values")
    return out


def evaluate_models(df: DataFrame, models: list[str], by: list[str], y: str = "y_true", check: bool = False) -> DataFrame:
    """One row per model column (and group), from the unpivoted frame. ``check`` raises on any null."""
    if check and df.agg(F.max(F.greatest(*[F.col(c).isNull().cast("int") for c in [y, *models]])).alias("x")).first().x:
        raise ValueError("nulls among the values")
    long = df.select(*by, F.col(y).cast("double").alias(y), F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("y_pred")) for m in models])).alias("_m")).select(*by, y, "_m.*")
    return evaluate(long, [*by, "model"], y)


def evaluate_all(df: DataFrame, models: list[str], symbol: str = "symbol", y: str = "y_true", by_symbol: bool = True) -> DataFrame:
    """Metrics of all rows (symbol ALL), and of each symbol."""
    total = evaluate_models(df, models, [], y).select(F.lit("ALL").alias(symbol), "*")
    return total.unionByName(evaluate_models(df, models, [symbol], y)) if by_symbol else total


def bucketed(df: DataFrame, width: str | int, by: list[str], ts: str = "ts", y: str = "y_true", p: str = "y_pred", eps: float = EPS) -> DataFrame:
    """mse, rmse, mae, unsquared qlike and corr of each left-closed bucket."""
    t, q = F.col(y).cast("double"), F.col(p).cast("double")
    start = from_us(floor_us(epoch_us(ts), duration_us(width)))
    return df.where(finite(t) & finite(q)).groupBy(*by, start.alias("bucket")).agg(
        F.count("*").alias("n"),
        F.avg((t - q) * (t - q)).alias("mse"),
        F.sqrt(F.avg((t - q) * (t - q))).alias("rmse"),
        F.avg(F.abs(t - q)).alias("mae"),
        F.avg(qlike_plain(t, q, eps)).alias("qlike"),
        correlation(t, q).alias("corr"),
    )


def with_errors(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    return df.withColumns({"error": F.col(p) - F.col(y), "abs_error": F.abs(F.col(p) - F.col(y))})


# The tolerances within which two models' true values count as equal.
TRUTH_ABSOLUTE, TRUTH_RELATIVE = 1e-4, 1e-8


def truth_disagreements(df: DataFrame, other: DataFrame, keys: list[str], y: str = "y_true", absolute: float = TRUTH_ABSOLUTE, relative: float = TRUTH_RELATIVE) -> DataFrame:
    """Rows of equal keys whose true values differ by more than ``absolute`` plus ``relative`` of the other's: models must be judged on the same truth.

    Equal infinities agree, NaN agrees with nothing, null with null alone.
    """
    both = df.select(*keys, F.col(y).alias("_a")).join(other.select(*keys, F.col(y).alias("_b")), keys)
    a, b = F.col("_a").cast("double"), F.col("_b").cast("double")
    # two finite values are compared; any other pair must be the same infinity
    apart = F.when(finite(a) & finite(b), F.abs(a - b) > absolute + relative * F.abs(b)).otherwise((a != b) | F.isnan(a) | F.isnan(b))
    far = F.when(a.isNull() | b.isNull(), a.isNull() != b.isNull()).otherwise(apart)
    return both.where(far).select(*keys, F.col("_a").alias("y_left"), F.col("_b").alias("y_right"))


#: Statistics that metrics are made of; those of several blocks combine into those of their union.
PARTS = ("n", "sq", "abs", "qlike", "mean_t", "mean_q", "spread_t", "spread_q", "shared")


def partials(df: DataFrame, by: list[str], y: str = "y_true", p: str = "y_pred", eps: float = EPS) -> DataFrame:
    """The ``PARTS`` of each ``by`` over pairs that are both finite: sums of errors, means, and spreads around the own means."""
    t, q = F.col(y).cast("double"), F.col(p).cast("double")
    return df.where(finite(t) & finite(q)).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum((t - q) * (t - q)).alias("sq"),
        F.sum(F.abs(t - q)).alias("abs"),
        F.sum(qlike(t, q, eps)).alias("qlike"),
        F.avg(t).alias("mean_t"),
        F.avg(q).alias("mean_q"),
        (F.var_pop(t) * F.count("*")).alias("spread_t"),
        (F.var_pop(q) * F.count("*")).alias("spread_q"),
        (F.covar_pop(t, q) * F.count("*")).alias("shared"),
    )


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """n, rmse, mae, corr and qlike of each ``by`` from the ``PARTS`` of any finer groups.

    Spreads are brought to the common mean by the distances of the means, so no large numbers cancel. A group's parts
    may be any number: they are aggregated twice, never gathered.
    """
    key = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    means = parts.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(*[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(f"_{c}") for c in ("mean_t", "mean_q")])
    both = parts.join(means, key) if by else parts.join(F.broadcast(means), F.lit(True))  # one row
    t, q, n = F.col("mean_t") - F.col("_mean_t"), F.col("mean_q") - F.col("_mean_q"), F.col("n")
    sums = both.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("sq").alias("sq"), F.sum("abs").alias("abs"), F.sum("qlike").alias("q"),
        F.sum(F.col("spread_t") + n * t * t).alias("tt"), F.sum(F.col("spread_q") + n * q * q).alias("qq"), F.sum(F.col("shared") + n * t * q).alias("tq"),
    )
    return sums.where("n > 0").select(
        *by,
        "n",
        F.sqrt(F.col("sq") / F.col("n")).alias("rmse"),
        (F.col("abs") / F.col("n")).alias("mae"),
        ratio(F.col("tq"), F.sqrt(F.col("tt")) * F.sqrt(F.col("qq"))).alias("corr"),
        (F.col("q") / F.col("n")).alias("qlike"),
    )
