"""Registered queries over the driver's tables: each applies one operator; ``catalog_sql`` holds the SQL."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.catalog_sql import ORACLE_SQL
from tidemark.functions.scalars import no_nulls, r6, r9
from tidemark.functions.timeops import as_ntz, epoch_us, offset
from tidemark.operators import asof, checks, datasets, factors, importance, labels, metrics, neighbors, resample, shape, watch
from tidemark.operators.factors import book_columns
from tidemark.plans import boosting, carried, models, pipeline
from tidemark.sources import arrays, publish, raw, tables
from tidemark.streaming import resample as stream
from tidemark.streaming import windows as stream_windows

__all__ = ["ORACLE_SQL", "QUERIES"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(*(cols or ("event_id", "ts", "user_id", "event_type", "value")))


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in cols})


def digits(df: DataFrame, *cols: str) -> DataFrame:
    """Nine significant digits, for values that may be very large."""
    return df.withColumns({c: r9(F.col(c)) for c in cols})


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


VALUE_PLAN = resample.agg_plan(["value", "user_id"], None, ("value",))
PAIR = ["event_type"]


def downsample_right_closed(spark, d):
    out = resample.downsample_right(events(spark, d), "6h", PAIR, VALUE_PLAN, tie=["event_id"])
    return rounded(out, "value_last", "value_mean", "value_std")


def downsample_left_mean(spark, d):
    return rounded(resample.downsample_left(events(spark, d), "6h", PAIR, ["value"]), "value")


def rolling_trailing(spark, d):
    out = resample.rolling_trailing(events(spark, d), "1h", PAIR, VALUE_PLAN, tie=["event_id"], keep=["event_id", "event_type", "ts"])
    return rounded(out, "value_last", "value_mean", "value_std")


def asof_backward(spark, d):
    e = events(spark, d)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return asof.asof_backward(left, right, ["user_id"], tie=["view_id"])


def grid_locf(spark, d):
    return asof.locf_grid(events(spark, d), "6h", PAIR, ["event_id", "value"], tie=["event_id"])


def dedup_last_by_ts(spark, d):
    return resample.last_by_time(read(spark, d, "orders").select("o_orderdate", "o_orderkey", "o_custkey", "o_totalprice"), ["o_orderdate"], ["o_orderkey"])


def bucket_last_ceil(spark, d):
    return resample.bucket_last_ceil(events(spark, d), "1d", PAIR, ["ts", "event_id"])


def first_by_bucket(spark, d):
    odd = events(spark, d).withColumn("value", F.when(F.col("value") > 5, F.col("value")))
    return resample.first_by_bucket(odd, "1d", PAIR, ["value"])


BOOK_LEVELS = 7


def _book(spark, d):
    """A book per order: side O asks and F bids, level by line number."""
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_quantity", "l_extendedprice")
    made = []
    for side, status in (("asks", "O"), ("bids", "F")):
        for k in range(BOOK_LEVELS):
            own = (F.col("l_linestatus") == status) & (F.col("l_linenumber") == k + 1)
            amount, paid = (F.sum(F.when(own, F.col(c))) for c in ("l_quantity", "l_extendedprice"))
            made += [(paid / amount).alias(f"{side}[{k}].price"), amount.alias(f"{side}[{k}].amount")]
    owner = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return lines.groupBy("l_orderkey").agg(*made).join(owner, "l_orderkey")


def book_factors(spark, d):
    out = factors.base_factors(_book(spark, d), ["o_custkey"], "l_orderkey", BOOK_LEVELS)
    return rounded(out, "vwap", "imbalance", "spread", "mid", "log_return")


def derived_factors(spark, d):
    order = Window.partitionBy("event_type").orderBy("ts", "event_id")
    back = lambda k: F.lag("value", k).over(order)
    df = events(spark, d).select(
        "event_id", "ts", F.col("value").alias("vwap"), back(1).alias("mid"), (F.col("value") - back(2)).alias("spread"), ((F.col("value") - back(2)) / 100).alias("imbalance"),
        (F.col("value") - back(3)).alias("log_return"), *[(back(k) + 10).alias(f"vol_{m}m_lag0") for k, m in ((1, 1), (2, 5), (3, 30), (4, 60), (5, 120))],
    )
    out = factors.derived_factors(df)
    names = ["spread_pct", "vwap_mid_diff", "vol_ratio_1_5", "vol_ratio_5_30", "vol_ratio_5_60", "vol_ratio_30_120", "imbalance_sq", "abs_imbalance", "lr_sq", "lr_abs"]
    return digits(rounded(out.where("lr_abs is not null and vol_ratio_30_120 is not null").select("event_id", *names), *names[2:]), *names[:2])


def time_of_day(spark, d):
    return rounded(factors.time_of_day(events(spark, d, "event_id", "ts")), "tod_sin", "tod_cos")


def trim_leading(spark, d):
    return factors.trim_leading(events(spark, d, "event_id", "ts"))


def time_range_filter(spark, d):
    return factors.time_range(events(spark, d, "event_id", "ts", "value"), "2024-01-05 06:00:00", "2024-01-20 18:00:00")


def clip_to_range(spark, d):
    e = events(spark, d)
    other = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("ts_grid"))
    return factors.clip_to(e, other, ["user_id"]).select("user_id", "event_id", "ts")


def log_return(spark, d):
    df = datasets.with_day(events(spark, d)).withColumn("price", F.col("value") + 1)
    return rounded(factors.log_return(df, "price", ["event_type", "date"], tie=["event_id"]).select("event_id", "event_type", "date", "log_return"), "log_return")


def _dense(spark, d, width: str):
    """Mean value per type and bucket, on a grid without gaps over whole days."""
    e = events(spark, d)
    days = resample.downsample_left(e, width, PAIR, ["value"])
    ends = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    kinds = e.select("event_type").distinct()
    grid = asof.time_grid(kinds.join(ends, F.lit(True)).select("event_type", F.explode(F.array(F.col("a").cast("date").cast("timestamp_ntz"), F.col("b").cast("date").cast("timestamp_ntz"))).alias("ts")), width, PAIR)
    return grid.join(days, ["event_type", "ts"], "left")


def _daily(spark, d):
    return _dense(spark, d, "1d")


def forward_label(spark, d):
    return rounded(labels.forward_labels(_daily(spark, d), ["value"], "2d", PAIR), "value", "y_value")


def forward_label_by_time(spark, d):
    return rounded(labels.forward_labels_by_time(_daily(spark, d), ["value"], "2d", PAIR), "value", "y_value")


def lag_features(spark, d):
    out = labels.lag_features(_daily(spark, d), "value", ["1d", "7d"], PAIR, prefix="value_lag0")
    return rounded(out, "value", "value_lag1d", "value_lag7d")


def _vol(spark, d):
    e = events(spark, d)
    plan = [resample.AggItem("value", "std", "vol_5m"), resample.AggItem("value", "mean", "vol_1m")]
    return resample.downsample_right(e, "1d", PAIR, plan, tie=["event_id"]).withColumnRenamed("ts", "ts_grid")


def feature_join(spark, d):
    out = labels.feature_join(_daily(spark, d), _vol(spark, d), ["vol_5m", "vol_1m"], PAIR, check=True)
    return rounded(out, "value", "vol_5m_lag0", "vol_1m_lag0")


def label_join(spark, d):
    vol = _daily(spark, d).select("event_type", F.col("ts").alias("ts_grid"), F.coalesce("value", F.lit(0.0)).alias("vol_5m"))
    out = labels.label_join(_daily(spark, d), vol, ["vol_5m"], "3d", PAIR)
    return rounded(out, "value", "y_vol_5m")


def symbol_code_map(spark, d):
    customers = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("symbol"))
    return datasets.with_symbol_code(customers, datasets.symbol_codes(read(spark, d, "nation").select(F.col("n_name").alias("symbol"))), check=True)


def _hourly(spark, d, hours: str = "6h"):
    return resample.downsample_left(events(spark, d), hours, PAIR, ["value"]).withColumnRenamed("event_type", "symbol")


def pivot_fill_mean(spark, d):
    h = _hourly(spark, d, "1h")
    names = shape.symbols_of(h)
    return rounded(shape.pivot_feature(h, "value", names), *names)


def unpivot_long(spark, d):
    h = _hourly(spark, d, "1h")
    names = shape.symbols_of(h)
    return rounded(shape.unpivot_long(shape.pivot_feature(h, "value", names), names, "value"), "value")


def _parts(spark, d):
    h = _hourly(spark, d)
    return h.where(F.col("ts") < at("2024-01-22")), h.where(F.col("ts") >= at("2024-01-22"))


BASE = ["click", "purchase", "view"]


def time_neighbors(spark, d):
    out = neighbors.time_neighbors(*_parts(spark, d), "value", [3, 5], BASE)
    return rounded(out, "value_time_nn3_mean", "value_time_nn5_mean")


def symbol_neighbors(spark, d):
    out = neighbors.symbol_neighbors(*_parts(spark, d), "value", [1, 2], BASE)
    return rounded(out, "value_symbol_nn1_mean", "value_symbol_nn2_mean")


def time_neighbors_manhattan(spark, d):
    return rounded(neighbors.time_neighbors(*_parts(spark, d), "value", [3], BASE, metric="manhattan"), "value_time_nn3_mean")


def time_neighbors_chebyshev(spark, d):
    return rounded(neighbors.time_neighbors(*_parts(spark, d), "value", [3], BASE, p=float("inf")), "value_time_nn3_mean")


def time_neighbors_weighted(spark, d):
    return rounded(neighbors.time_neighbors(*_parts(spark, d), "value", [3], BASE, metric_params={"w": [4.0, 1.0, 0.25]}), "value_time_nn3_mean")


def time_neighbors_mahalanobis(spark, d):
    return rounded(neighbors.time_neighbors(*_parts(spark, d), "value", [3], BASE, metric="mahalanobis"), "value_time_nn3_mean")


def time_neighbors_correlation(spark, d):
    return rounded(neighbors.time_neighbors(*_parts(spark, d), "value", [3], BASE, metric="correlation"), "value_time_nn3_mean")


def time_neighbors_canberra(spark, d):
    return rounded(neighbors.time_neighbors(*_parts(spark, d), "value", [3], BASE, metric="canberra"), "value_time_nn3_mean")


def trimmed(values, axis):
    """Mean without the least and the greatest value."""
    return (values.sum(axis) - values.min(axis) - values.max(axis)) / (values.shape[axis] - 2)


def time_neighbors_trimmed(spark, d):
    return rounded(neighbors.time_neighbors(*_parts(spark, d), "value", [5], BASE, agg=trimmed), "value_time_nn5_trimmed")


def symbol_neighbors_chebyshev(spark, d):
    return rounded(neighbors.symbol_neighbors(*_parts(spark, d), "value", [2], BASE, p=float("inf")), "value_symbol_nn2_mean")


def symbol_neighbors_cosine(spark, d):
    return rounded(neighbors.symbol_neighbors(*_parts(spark, d), "value", [2], BASE, metric="cosine"), "value_symbol_nn2_mean")


def symbol_neighbors_weighted(spark, d):
    """Later times weigh more."""
    train, query = _parts(spark, d)
    w = train.select("ts").distinct().select("ts", F.dayofmonth("ts").cast("double").alias("w"))
    return rounded(neighbors.symbol_neighbors(train, query, "value", [2], BASE, metric_params={"w": w}), "value_symbol_nn2_mean")


def symbol_neighbors_manhattan(spark, d):
    return rounded(neighbors.symbol_neighbors(*_parts(spark, d), "value", [2], BASE, p=1), "value_symbol_nn2_mean")


def neighbor_block(spark, d):
    train, query = _parts(spark, d)
    out = neighbors.neighbor_block(train, query, ["value"], [3], BASE, target="value")
    return rounded(out, "value", "value_time_nn3_mean", "value_symbol_nn3_mean")


def vector_neighbors(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    out = neighbors.nearest(v, v, 5, exclude_self=True)
    return out.select(F.col("key").alias("query_id"), "rank", F.col("neighbor").alias("vec_id"), r6(F.col("distance")).alias("distance"))


def _forecast(spark, d):
    e = events(spark, d)
    return models.lag_baseline(e.withColumn("y_true", F.col("value")), "value", PAIR, tie=["event_id"])


METRICS = ("rmse", "mae", "corr", "qlike")


def metrics_overall(spark, d):
    return digits(rounded(metrics.evaluate(_forecast(spark, d), []), *METRICS[:3]), "qlike")


def metrics_by_symbol(spark, d):
    return digits(rounded(metrics.evaluate(_forecast(spark, d), PAIR), *METRICS[:3]), "qlike")


def metrics_merged(spark, d):
    """Statistics of each day, published in two runs of which the second brings days again, merged into metrics by type."""
    df = _forecast(spark, d).withColumn("block_name", F.col("ts").cast("date").cast("string"))
    root, cut = tables.scratch_dir(spark), at("2024-01-16")
    for part in (df.where(F.col("ts") < cut), df.where(F.col("ts") >= at("2024-01-10"))):
        publish.publish(metrics.partials(part, ["block_name", "event_type"]), root, "partials")
    got = metrics.merged(publish.read_published(spark, root, "partials"), PAIR)
    return digits(rounded(got, *METRICS[:3]), "qlike")


def metrics_models(spark, d):
    order = Window.partitionBy("event_type").orderBy("ts", "event_id")
    df = _forecast(spark, d).withColumn("lag2", F.lag("value", 2).over(order)).withColumnsRenamed({"y_pred": "lag1", "event_type": "symbol"})
    return rounded(metrics.evaluate_all(df.where("lag2 is not null"), ["lag1", "lag2"]).select("symbol", "model", "n", "rmse", "mae"), "rmse", "mae")


def metrics_bucketed(spark, d):
    return digits(rounded(metrics.bucketed(_forecast(spark, d), "1d", PAIR), "mse", *METRICS[:3]), "qlike")


def prediction_errors(spark, d):
    return rounded(metrics.with_errors(_forecast(spark, d)).select("event_id", "error", "abs_error"), "error", "abs_error")


def lag_baseline(spark, d):
    return _forecast(spark, d).select("event_id", "event_type", "y_true", "y_pred")


def truth_check(spark, d):
    f = _forecast(spark, d).select("event_id", "y_true")
    return metrics.truth_disagreements(f, f.withColumn("y_true", F.when(F.col("y_true") > 100, F.col("y_true") + 1).otherwise(F.col("y_true"))), ["event_id"])


def _importances(spark, d):
    lines = read(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    parts = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("feature"))
    return lines.join(parts, "l_partkey").select("feature", F.year("l_shipdate").cast("string").alias("block_name"), F.col("l_extendedprice").alias("importance_gain"), F.col("l_quantity").cast("long").alias("importance_split"))


def importance_mean(spark, d):
    return rounded(importance.importance_mean(_importances(spark, d)), "mean_gain", "mean_split")


def importance_topk(spark, d):
    return rounded(importance.top_features(_importances(spark, d), 10), "mean_gain", "mean_split")


def importance_heatmap(spark, d):
    return rounded(importance.importance_heatmap(_importances(spark, d), 8), "value")


def importance_heatmap_split(spark, d):
    return rounded(importance.importance_heatmap(_importances(spark, d), 8, col=importance.SPLIT), "value")


def importance_matrix(spark, d):
    years = [str(y) for y in range(1995, 2002)]
    out = importance.heatmap_matrix(_importances(spark, d), 8, years)
    return rounded(out, *years).withColumnsRenamed({y: f"y{y}" for y in years})


def rolling_day_splits(spark, d):
    out = datasets.rolling_splits(datasets.with_day(events(spark, d)), "date", 21, 1, 1)
    return out.groupBy("window_id", "window_name", "split", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def rolling_block_splits(spark, d):
    e = events(spark, d)
    blocks = pipeline.blocks(e, "2d")
    out = datasets.rolling_splits(blocks, "block_start", 6, 0, 1)
    return out.groupBy("window_id", "split").agg(F.count("*").alias("n"), F.min("block_start").alias("first_block"), F.max("block_start").alias("last_block"))


def block_cut(spark, d):
    return pipeline.blocks(events(spark, d), "36h").select("event_id", "block_start")


def block_starts(spark, d):
    return asof.block_starts(events(spark, d), "36h")


def freq_fanout(spark, d):
    out = datasets.freq_fanout(events(spark, d), ["3h", "6h", "1d"], ["user_id"], "value", PAIR, tie=["event_id"])
    return rounded(out, "value")


def training_sample(spark, d):
    e = datasets.with_day(events(spark, d))
    split = datasets.rolling_splits(e, "date", 21, 1, 1)
    by = ["window_id", "split", "event_type"]
    down, roll, _ = datasets.training_sample(split.where("split = 'train'"), split.where("split <> 'train'"), "6h", ["user_id"], "value", by, tie=["event_id"])
    return rounded(down.unionByName(roll), "value")


def carried_windows(spark, d):
    """Windows of 20 + 2 + 1 days, the last days arriving one by one."""
    e, root = datasets.with_day(events(spark, d)), tables.scratch_dir(spark)
    how = carried.Carried(root, "6h", ("event_type",), tuple(VALUE_PLAN), 20, 2, 1, tie=("event_id",))
    days = checks.require_days(e, 23)
    for own in (days[:-2], days[-2:-1], days[-1:]):
        carried.arrive(e.where(F.col("date").between(own[0], own[-1])), how)
    return rounded(carried.carried_windows(spark, how).drop("window_name"), "value_last", "value_mean", "value_std")


def window_cache(spark, d):
    e = events(spark, d).withColumnRenamed("event_type", "symbol")
    config = pipeline.Config(["click", "view"], ["click"], target="user_id", features=("value",), train_subsample="6h")
    train, query = pipeline.window_cache(e, "2024-01-20", config)
    return rounded(train.select("ts", "symbol", "value", F.lit("train").alias("role")).unionByName(query.select("ts", "symbol", "value", F.lit("query").alias("role"))), "value")


def history_slice(spark, d):
    return tables.read_history(events(spark, d, "event_id", "ts"), at("2024-01-20"), "7d")[0]


def base_slice(spark, d):
    e = events(spark, d).withColumnRenamed("event_type", "symbol")
    return tables.base_slice(e, e.where("symbol = 'click' and value > 20").select("ts", "symbol")).select("event_id", "symbol", "ts")


def symbol_readiness(spark, d):
    """Which users have a history from the third of the month on, and rows on eight days."""
    return checks.readiness(events(spark, d, "user_id", "ts"), ["user_id"], at("2024-01-03"), 8)


def typed_times(spark, d):
    """Times out of whole nanoseconds, out of texts of which some are no times, and out of dates."""
    text = F.when(F.col("event_type") == "click", "no time").otherwise(F.col("ts").cast("string"))
    e = events(spark, d).select("event_id", (epoch_us("ts") * 1000 + 999).alias("from_ns"), text.alias("from_text"), F.to_date("ts").alias("from_date"))
    for c in ("from_ns", "from_text", "from_date"):
        e = as_ntz(e, c)
    return e


def stored_tails(spark, d):
    """Blocks of six hours, stored by day; for each stored day until the tenth the last two blocks of the day before."""
    root = tables.scratch_dir(spark)
    tables.write_table(datasets.with_day(pipeline.blocks(events(spark, d), "6h")), root, "blocks")
    days = tables.list_partitions(spark, root, "blocks", "2024-01-10")
    rows = [(day, block) for day in days for block in tables.previous_day_tail(spark, root, str(day), 2)]
    return spark.createDataFrame(rows, "date date, block_start timestamp_ntz")


def feature_tables(spark, d):
    """Features stored each by itself and joined again; of four asked for, one table is empty and one isn't there."""
    e, root = events(spark, d), tables.scratch_dir(spark)
    kept = {"value": e, "user_id": e, "event_type": e.limit(0)}
    for name, rows in kept.items():
        rows.select("event_id", "ts", name).write.parquet(f"{root}/{name}")
    frames = tables.read_features(spark, {name: f"{root}/{name}" for name in [*kept, "props"]}, ["event_id", "ts"])
    out = events(spark, d, "event_id", "ts").withColumn("n_features", F.lit(len(frames)))
    for rows in frames.values():
        out = out.join(rows, ["event_id", "ts"], "left")
    return out


def prediction_blocks(spark, d):
    """Predictions and errors stored by block; two blocks are read, by their folders."""
    root = tables.scratch_dir(spark)
    made = metrics.with_errors(_forecast(spark, d)).withColumnRenamed("event_type", "block_name")
    tables.write_table(made, root, "predictions")
    return rounded(tables.read_table(spark, root, "predictions", ["event_id", "block_name", "y_true", "y_pred", "abs_error"], F.col("block_name").isin("click", "view")), "abs_error")


def run_summary(spark, d):
    """What a finished run leaves: overall metrics and mean importances as tables, and a summary in JSON."""
    root, f = tables.scratch_dir(spark), _forecast(spark, d)
    config = pipeline.Config([], [])
    pipeline.freq_summary(spark, config, root, "6h", metrics.evaluate(f, PAIR), _importances(spark, d), metrics.evaluate(f, []))
    said = tables.read_json(spark, f"{root}/meta/run_summary.json")
    over = rounded(spark.read.parquet(f"{root}/overall").select("n", *METRICS[:3]), *METRICS[:3])
    gains = rounded(spark.read.parquet(f"{root}/importance_mean"), "mean_gain").select("feature", "mean_gain")
    return gains.join(F.broadcast(over)).withColumns({"freq": F.lit(said["freq"]), "n_windows": F.lit(said["n_windows"]).cast("long")})  # one row


def prepared_block(spark, d):
    """A block without rows that hold nulls, symbols as codes, features as 32-bit vectors and the label."""
    block = datasets.raw_block(_features(spark, d)[0].withColumnRenamed("event_type", "symbol"), "value")
    made = datasets.assembled(datasets.resolve_symbol_code(block), ["value_lag3h", "value_lag1d", "symbol_code"], "value").select("ts", "symbol", "label", vector_to_array("features").alias("x"))
    return rounded(made.select("ts", "symbol", "label", *[F.col("x")[k].alias(n) for k, n in enumerate(("lag3h", "lag1d", "code"))]), "label", "lag3h", "lag1d")


def report_frames(spark, d):
    """The frames behind a report, one below the other: overall, by symbol, leading features."""
    made = pipeline.report(_forecast(spark, d).withColumnRenamed("event_type", "symbol"), _importances(spark, d), 5)
    cols, none = ["n", "rmse", "mae"], F.lit(None).cast("double")
    parts = [made["overall"].select(F.lit("all").alias("item"), *cols, none.alias("mean_gain")), made["by_symbol"].select(F.col("symbol").alias("item"), *cols, none.alias("mean_gain"))]
    parts.append(made["top_features"].select(F.col("feature").alias("item"), F.lit(None).cast("long").alias("n"), none.alias("rmse"), none.alias("mae"), "mean_gain"))
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), "rmse", "mae", "mean_gain")


def union_dedup(spark, d):
    e = events(spark, d)
    kept = e.where(F.col("event_type").isin(["click", "view"])).select("user_id", "event_type")
    return shape.union_widened([kept, e.select(F.col("user_id").cast("int").alias("user_id"), "event_type")]).distinct()


def null_safe_drop(spark, d):
    e = events(spark, d).withColumn("half", F.when(F.col("value") > 50, F.col("value")).when(F.col("value") < 10, F.lit(float("nan"))))
    return no_nulls(e.select("event_id", "half")).select("event_id", F.isnan("half").alias("is_nan"))


def alignment_check(spark, d):
    return checks.grid_faults(_hourly(spark, d, "1h"), "1h", by=("symbol",))


def even_counts(spark, d):
    """The same counts over a grid with gaps and over one without."""
    gaps, whole = (watch.even_counts(df, step, [g]) for df, step, g in ((_hourly(spark, d, "1h"), "1h", "symbol"), (_daily(spark, d), "1d", "event_type")))
    return gaps.withColumn("grid", F.lit("hourly")).unionByName(whole.withColumn("grid", F.lit("daily")))


def step_counts(spark, d):
    return checks.steps(_hourly(spark, d, "1h"), by=("symbol",))


def grid_points(spark, d):
    e = events(spark, d)
    up, down = (raw.on_grid(F.col("ts"), "15m", u) for u in (True, False))
    return e.select("event_id", up.alias("grid_up"), down.alias("grid_down"), offset("ts", "90m").alias("later"), offset("ts", "1d", back=True).alias("earlier"))


def stride_sample(spark, d):
    return shape.stride_sample(events(spark, d), 10, ["ts", "event_id"], PAIR).select("event_id", "event_type")


def hash_sample(spark, d):
    return shape.hash_sample(events(spark, d), 100, ["event_id"]).select("event_id", "value")


def _features(spark, d):
    df = labels.lag_features(_dense(spark, d, "3h"), "value", ["3h", "6h", "1d"], PAIR)
    return no_nulls(df), ["value_lag3h", "value_lag6h", "value_lag1d"]


def linear_baseline(spark, d):
    df, names = _features(spark, d)
    cut = at("2024-01-22")
    made = models.linear_baseline(df.where(F.col("ts") < cut), df.where(F.col("ts") >= cut), names, "value", ["ts", "event_type"])
    return rounded(made, "y_true", "y_pred")


def gbt_rolling(spark, d):
    df, names = _features(spark, d)
    split = datasets.rolling_splits(datasets.with_day(df), "date", 21, 1, 1)
    return models.train_windows(split, names, "value", ["ts", "event_type"])[0]


def boost_leafwise(spark, d):
    """Leaf-wise trees per window, stopped by its validation day: predictions."""
    df, names = _features(spark, d)
    split = datasets.rolling_splits(datasets.with_day(df), "date", 21, 2, 2, newest_only=True)
    params = boosting.LeafParams(rate=0.3, leaves=6, rounds=4, bins=32, least_rows=10, patience=2)
    return rounded(models.train_windows(split, names, "value", ["ts", "event_type"], params)[0], "y_true", "y_pred")


def boost_stumps(spark, d):
    """Two rounds of the best single split of any feature, over all rows."""
    df, names = _features(spark, d)
    params = boosting.LeafParams(rate=0.5, leaves=2, rounds=2, bins=16, row_share=1.0, feature_share=1.0, least_rows=20)
    return rounded(boosting.train_leafwise(df, names, "value", params).predict(df).select("event_type", "ts", "y_pred"), "y_pred")


def volatility_grid(spark, d):
    """Nanosecond times a little past the events', on a six-hour grid."""
    ns = epoch_us("ts") * 1000 + F.col("event_id") % 1000
    vol = events(spark, d).select("event_type", "event_id", ns.alias("timestamp"), F.col("value").alias("vol_5m"))
    return raw.align_volatility(vol, "6h", PAIR, check=False)


def snapshot_files(spark, d):
    """Books written as CSV with a header and read back by name."""
    names = book_columns()
    book = _book(spark, d).withColumn("timestamp", F.col("l_orderkey")).withColumns({c: F.lit(None).cast("double") for c in names if int(c.split("[")[1].split("]")[0]) >= BOOK_LEVELS})
    path = tables.scratch_dir(spark)
    book.select(*[f"`{c}`" for c in reversed(names)], "timestamp", F.lit("x").alias("exchange")).write.option("header", True).csv(path)
    df = raw.read_snapshots(spark, [path])
    out = factors.base_factors(df.withColumn("none", F.lit(0)), ["none"], "timestamp", keep=["none", "timestamp", "ts"]).select("timestamp", "ts", "vwap", "imbalance", "spread", "mid")
    return rounded(out, "vwap", "imbalance", "spread", "mid")


def table_sinks(spark, d):
    """Aligned partitions: overwritten by date and symbol, then added to where a partition isn't there yet, read by symbol and day."""
    e = datasets.with_day(events(spark, d, "event_id", "ts", "event_type", "value").withColumnRenamed("event_type", "symbol"))
    root = tables.scratch_dir(spark)
    tables.write_table(e.where("symbol in ('click', 'view')").withColumn("value", F.lit(-1.0)), root, "aligned")
    tables.write_table(e.where("symbol = 'click'"), root, "aligned")
    tables.write_table(e, root, "aligned", mode="skip")
    return tables.read_aligned(spark, root, ["click", "signup", "view"], ["2024-01-05", "2024-01-06"], ["event_id", "symbol", "date", "value"])


def npz_arrays(spark, d):
    """Two days of events, written as float32 arrays per type and day and read back, one day pruned."""
    e = events(spark, d).where((F.col("ts") >= at("2024-01-05")) & (F.col("ts") < at("2024-01-07"))).select(F.col("event_type").alias("symbol"), F.to_date("ts").alias("date"), "ts", "event_id", "value")
    root = tables.scratch_dir(spark)
    arrays.write_npz(e.withColumn("split", F.lit("pred")), root, ["value"], {"event_id": "long"}, ["symbol", "date"], order=["event_id"])
    out = arrays.read_npz(spark, root, "split string, event_id long, value float", ["symbol", "date"]).where("date = '2024-01-06'")
    return out.select("symbol", F.to_date("date").alias("date"), "event_id", F.col("value").cast("double").alias("value"))


def result_files(spark, d):
    """Metrics of each result file; files are named by their type's folder."""
    made = _forecast(spark, d).select(F.col("event_type").alias("kind"), "y_true", "y_pred")
    root = tables.scratch_dir(spark)
    made.repartition("kind").write.partitionBy("kind").parquet(root)
    out = tables.evaluate_files(spark, [root]).select(F.regexp_replace("symbol", "kind=", "").alias("symbol"), "n", *METRICS)
    return digits(rounded(out, *METRICS[:3]), "qlike")


def aligned_table(spark, d):
    """Factors, volatilities, derived factors and labels of hourly books, one symbol and day after the other."""
    by = ["symbol", "date"]
    hourly = datasets.with_day(_dense(spark, d, "1h").withColumnRenamed("event_type", "symbol")).withColumn("v", F.coalesce("value", F.lit(0.0)) + 1)
    level = {"asks[0].price": F.col("v") + 1, "bids[0].price": F.col("v"), "asks[0].amount": F.hour("ts") + 1.0, "bids[0].amount": F.lit(2.0)}
    snapshots = hourly.withColumns(level).select(*by, "ts", *[f"`{c}`" for c in level])
    vols = {f"vol_{m}m": F.col("v") * (k + 1) for k, m in enumerate((1, 5, 30, 60, 120))}
    vol = hourly.withColumns(vols).select(*by, F.col("ts").alias("ts_grid"), *vols)
    out = pipeline.aligned(snapshots, vol, list(vols), ["vol_5m"], "2h", levels=1)
    return rounded(out.select(*by, "ts", "vwap", "imbalance", "log_return", "spread_pct", "vol_ratio_30_120", "vol_5m_lag0", "y_vol_5m"), "vwap", "imbalance", "log_return", "spread_pct", "vol_ratio_30_120", "vol_5m_lag0", "y_vol_5m")


READY = ["ts", "symbol", "y", "value", "value_time_nn2_mean", "value_symbol_nn2_mean"]


def _ready(spark, d):
    e = datasets.with_day(_dense(spark, d, "3h").withColumnRenamed("event_type", "symbol")).withColumn("value", F.coalesce("value", F.lit(0.0))).withColumn("y", F.col("value") * 2)
    return e, pipeline.Config(["click", "purchase", "view"], ["click", "purchase", "view"], target="y", features=("value",), neighbor_counts=(2,), train_subsample="6h")


def ready_block(spark, d):
    """A day's rows with neighbour features out of the week before."""
    e, config = _ready(spark, d)
    return rounded(pipeline.ready_block(e, "2024-01-20", config).select(*READY), *READY[2:])


def ready_block_stored(spark, d):
    """Two days' rows, stored in buckets with their features and joined without an exchange; the first day is stored twice."""
    (e, config), root = _ready(spark, d), tables.scratch_dir(spark)
    days = ["2024-01-20", "2024-01-21"]
    for day in [days[0], *days]:
        pipeline.store_day(e, day, config, root, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rounded(pipeline.stored_blocks(spark, config, root, days).select(*READY), *READY[2:])


def stream_downsample(spark, d):
    """Six-hour buckets of the events as a stream: each is given out once, when the watermark has passed it, into a Parquet table."""
    live, root, close = _stream(spark, d)
    out = stream.stream_downsample(live, "6h", "1h", PAIR, VALUE_PLAN, tie=["event_id"])
    for step in (lambda: None, close):
        step()
        out.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    made = spark.read.parquet(f"{root}/out").where("event_type is not null").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return rounded(made, "value_last", "value_mean", "value_std")


def _stream(spark, d):
    """The events as a stream, and a later row that closes the last buckets, which comes in a second run."""
    root = tables.scratch_dir(spark)
    e = read(spark, d, "events")
    live = spark.readStream.schema(e.schema).parquet(f"{d}/events.parquet*").unionByName(spark.readStream.schema(e.schema).parquet(f"{root}/closing*"))
    live = live.withColumn("ts", F.col("ts").cast("timestamp"))

    def close():
        last = e.select(*[(F.max("ts") + F.expr("interval 400 days") if c == "ts" else F.lit(None).cast(e.schema[c].dataType)).alias(c) for c in e.columns])
        last.write.parquet(f"{root}/closing")

    return live, root, close


def stream_trailing(spark, d):
    """The trailing hour of each event, as a stream in append mode: one run over the events, one that goes on from its checkpoint."""
    live, root, close = _stream(spark, d)
    for step in (lambda: None, close):
        step()
        stream_windows.trailing_stream(live, "1h", "1h", PAIR, VALUE_PLAN, f"{root}/out", f"{root}/checkpoint", tie=["event_id"], keep=["event_id", "event_type", "ts"], buckets=24).awaitTermination()
    out = spark.read.parquet(f"{root}/out").where("event_id is not null").drop("batch").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return rounded(out, "value_last", "value_mean", "value_std")


def stream_asof(spark, d):
    """Each purchase with the user's last view of the five days before it, both sides as streams."""
    live, root, close = _stream(spark, d)
    left = live.where("event_type = 'purchase' or event_type is null").select("event_id", "user_id", "ts", "value")
    right = live.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    for step in (lambda: None, close):
        step()
        stream_windows.asof_stream(left, right, ["user_id"], "5d", "1h", f"{root}/out", f"{root}/checkpoint", tie=["view_id"], buckets=2).awaitTermination()
    out = spark.read.parquet(f"{root}/out").where("event_id is not null").drop("batch")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "matched_ts")})


_ALL = [
    downsample_right_closed, downsample_left_mean, rolling_trailing, asof_backward, grid_locf, dedup_last_by_ts, bucket_last_ceil, first_by_bucket, book_factors, derived_factors,
    time_of_day, trim_leading, time_range_filter, clip_to_range, log_return, forward_label, forward_label_by_time, lag_features, feature_join, label_join, symbol_code_map,
    pivot_fill_mean, unpivot_long, time_neighbors, symbol_neighbors, neighbor_block, vector_neighbors, metrics_overall, metrics_by_symbol, metrics_merged, metrics_models, metrics_bucketed,
    prediction_errors, lag_baseline, truth_check, importance_mean, importance_topk, importance_heatmap, importance_matrix, rolling_day_splits, rolling_block_splits, block_cut,
    block_starts, freq_fanout, training_sample, window_cache, history_slice, base_slice, union_dedup, null_safe_drop, alignment_check, even_counts, step_counts, grid_points, stride_sample,
    hash_sample, linear_baseline, gbt_rolling, boost_leafwise, boost_stumps, time_neighbors_manhattan, time_neighbors_chebyshev, time_neighbors_weighted, symbol_neighbors_manhattan, time_neighbors_mahalanobis, time_neighbors_correlation, time_neighbors_canberra,
    time_neighbors_trimmed, symbol_neighbors_chebyshev, symbol_neighbors_cosine, symbol_neighbors_weighted, importance_heatmap_split,
    volatility_grid, snapshot_files, table_sinks, npz_arrays, result_files, aligned_table, ready_block, ready_block_stored, stream_downsample, stream_trailing, stream_asof, carried_windows,
    symbol_readiness, typed_times, stored_tails, feature_tables, prediction_blocks, run_summary, prepared_block, report_frames,
]
QUERIES = {f.__name__: f for f in _ALL}
