import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import datasets, importance, shape
from tidemark.operators.metrics import bucketed, evaluate, evaluate_all, evaluate_models, truth_disagreements, with_errors

T0 = dt.datetime(2024, 1, 1)


def test_only_finite_pairs_count(spark):
    rows = [(1.0, 2.0), (2.0, 2.0), (None, 1.0), (1.0, None), (math.nan, 1.0), (1.0, math.inf)]
    r = evaluate(spark.createDataFrame(rows, "y_true double, y_pred double"), []).first()
    assert r.n == 2 and r.rmse == pytest.approx(math.sqrt(0.5)) and r.mae == 0.5
    assert r["corr"] is None  # predictions are constant
    with pytest.raises(ValueError):
        evaluate(spark.createDataFrame([(None, 1.0)], "y_true double, y_pred double"), [], check=True)


def test_qlike_is_clipped_at_zero_predictions(spark):
    r = evaluate(spark.createDataFrame([(1.0, 0.0)], "y_true double, y_pred double"), [], eps=0.5).first()
    assert r.qlike == pytest.approx(2 - math.log(2) - 1)


def test_bucketed_qlike_keeps_rows_of_zero(spark):
    df = spark.createDataFrame([(T0, 0.0, 1.0), (T0, 1.0, 1.0)], "ts timestamp_ntz, y_true double, y_pred double")
    assert bucketed(df, "5m", []).first().qlike == pytest.approx((-math.log(1e-12) - 1) / 2, rel=1e-6)


def test_top_features_follow_the_column_asked_for(spark):
    df = spark.createDataFrame([("a", "w", 9.0, 1), ("b", "w", 1.0, 9)], "feature string, block_name string, importance_gain double, importance_split long")
    for col, best in ((importance.GAIN, "a"), (importance.SPLIT, "b")):
        assert [r.feature for r in importance.importance_heatmap(df, 1, col=col).collect()] == [best]
    only = df.drop(importance.GAIN)
    assert importance.importance_heatmap(only, 1, col=importance.SPLIT).first().feature == "b"
    with pytest.raises(ValueError):
        importance.importance_heatmap(only, 1)


def test_models_and_all(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, 3.0), ("b", 2.0, 3.0, 2.0)], "symbol string, y_true double, m1 double, m2 float")
    got = {(r.symbol, r.model): r.mae for r in evaluate_all(df, ["m1", "m2"]).collect()}
    assert got == {("ALL", "m1"): 0.5, ("ALL", "m2"): 1.0, ("a", "m1"): 0.0, ("a", "m2"): 2.0, ("b", "m1"): 1.0, ("b", "m2"): 0.0}
    with pytest.raises(ValueError):
        evaluate_models(df.withColumn("m1", F.lit(None).cast("double")), ["m1"], [], check=True)


def test_buckets_errors_and_disagreement(spark):
    df = spark.createDataFrame([(T0, 2.0, 1.0, 1), (T0 + dt.timedelta(minutes=5), 2.0, 4.0, 2)], "ts timestamp_ntz, y_true double, y_pred double, id int")
    got = bucketed(df, "5m", []).orderBy("bucket").collect()
    assert [r.mse for r in got] == [1.0, 4.0] and got[0].qlike == pytest.approx(2 - math.log(2) - 1)
    assert [r.error for r in with_errors(df).collect()] == [-1.0, 2.0]
    assert truth_disagreements(df, df.withColumn("y_true", F.lit(2.0)), ["id"]).count() == 0
    assert truth_disagreements(df, df.withColumn("y_true", F.lit(2.5)), ["id"]).count() == 2


def test_true_values_agree_within_tolerances(spark):
    inf, nan = math.inf, math.nan
    pairs = [(1.0, 1.00005), (1.0, 1.0002), (1e6, 1e6 + 0.01), (1e6, 1e6 + 0.02), (inf, inf), (inf, -inf), (inf, 1.0), (nan, nan), (None, None), (None, 1.0), (1.0, None)]
    left, right = (spark.createDataFrame([(i, p[k]) for i, p in enumerate(pairs)], "id int, y_true double") for k in (0, 1))
    assert sorted(r.id for r in truth_disagreements(left, right, ["id"]).collect()) == [1, 3, 5, 6, 7, 9, 10]
    assert truth_disagreements(left, right, ["id"], absolute=1e-9, relative=0.0).count() == 9


def days(spark, which):
    return spark.createDataFrame([(dt.date(2024, 1, d), d, k) for d in which for k in range(2)], "date date, d int, k int")


def test_rolling_splits_count_available_days(spark):
    df = days(spark, [1, 2, 5, 6, 9])
    out = datasets.rolling_splits(df, "date", 2, 1, 1)
    got = {(r.window_id, r.split, r.d) for r in out.collect()}
    assert got == {(0, "train", 1), (0, "train", 2), (0, "val", 5), (0, "test", 6), (1, "train", 2), (1, "train", 5), (1, "val", 6), (1, "test", 9)}
    assert {r.window_name for r in out.collect()} == {"window_000_2024-01-06", "window_001_2024-01-09"}
    assert {r.d for r in datasets.rolling_splits(df, "date", 2, 1, 1, newest_only=True).where("split = 'test'").collect()} == {9}
    assert datasets.rolling_splits(df, "date", 1, 0, 1, step=2).select("window_id").distinct().count() == 2
    with pytest.raises(ValueError):
        datasets.rolling_splits(df, "date", 5, 1, 1)


def test_symbol_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "symbol string")
    codes = datasets.symbol_codes(df)
    assert {r.symbol: r.symbol_code for r in codes.collect()} == {"a": 0, "b": 1}
    with pytest.raises(ValueError):
        datasets.with_symbol_code(spark.createDataFrame([("z",)], "symbol string"), codes, check=True).collect()
    assert datasets.resolve_symbol_code(df.withColumn("symbol_code_last", F.lit(7.0))).first().symbol_code == 7
    assert datasets.resolve_symbol_code(df.where("symbol = 'b'")).first().symbol_code == 0


def test_raw_block_and_vectors(spark):
    df = spark.createDataFrame([("s", T0, 1.0, 2.0, 3.0), ("s", T0, None, 2.0, 3.0), ("s", T0, 1.0, math.nan, 0.1)], "symbol string, ts timestamp_ntz, `f.1` double, f2 double, y double")
    block = datasets.raw_block(df, "y")
    assert block.columns == ["ts", "symbol", "y", "f.1", "f2"] and block.count() == 2
    rows = datasets.assembled(block.where("not isnan(f2)"), ["f.1", "f2"], "y").collect()
    assert list(rows[0].features) == [1.0, 2.0]


def test_importances(spark):
    df = spark.createDataFrame([("f", "b1", 2.0, 1), ("f", "b2", 4.0, 3), ("g", "b1", 3.0, 5), ("h", "b1", 0.5, 5)], "feature string, block_name string, importance_gain double, importance_split long")
    assert [r.feature for r in importance.top_features(df, 2).collect()] == ["f", "g"]  # equal means, by name
    cells = {(r.feature, r.block_name): r.value for r in importance.block_importance(df, 2).collect()}
    assert cells == {("f", "b1"): 2.0, ("f", "b2"): 4.0, ("g", "b1"): 3.0, ("g", "b2"): 0.0}
    scaled = {(r.feature, r.block_name): r.value for r in importance.importance_heatmap(df, 2).collect()}
    assert scaled[("f", "b1")] == 0.0 and scaled[("g", "b1")] == 1.0
    assert importance.heatmap_matrix(df, 2, ["b1", "b2"]).where("feature = 'g'").first().b2 == 0.0
    with pytest.raises(ValueError):
        importance.importance_mean(df.drop("importance_gain", "importance_split"))


def test_shapes(spark):
    a, b = spark.createDataFrame([(1, "x")], "n int, s string"), spark.createDataFrame([(2.5, True)], "n double, extra boolean")
    out = shape.union_widened([a, b])
    assert dict(out.dtypes)["n"] == "double" and out.count() == 2
    df = spark.range(100).withColumn("g", F.col("id") % 2)
    assert sorted(r.id for r in shape.stride_sample(df, 25, ["id"], ["g"]).collect()) == [0, 1, 50, 51]
    assert shape.hash_sample(df, 10, ["id"]).collect() == shape.hash_sample(df.repartition(7), 10, ["id"]).collect()
    assert {r.v for r in shape.normalised(df.withColumn("v", F.lit(3.0)), "v", ["g"]).collect()} == {0.0}
    with pytest.raises(ValueError):
        shape.common_symbols(spark.createDataFrame([("a",)], "symbol string"), spark.createDataFrame([("b",)], "symbol string"))
    with pytest.raises(ValueError):
        shape.symbols_of(df.select(F.col("id").cast("string").alias("symbol")), most=10)


def test_merged_partials_equal_metrics_over_all_rows(spark):
    import random

    from tidemark.operators.metrics import evaluate, merged, partials

    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(7), 1e6 + rng.gauss(0, 1), 1e6 + rng.gauss(0, 1)) for _ in range(500)] + [("c", 1, 2.0, 3.0), ("c", 2, 2.0, 5.0), ("d", 1, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "g string, block int, y_true double, y_pred double")
    parts = partials(df, ["g", "block"])
    for by in (["g"], []):
        want = {tuple(r[c] for c in by): r for r in evaluate(df, by).collect()}
        got = {tuple(r[c] for c in by): r for r in merged(parts, by).collect()}
        assert set(got) == set(want)
        for k, w in want.items():
            assert got[k].n == w.n
            for c in ("rmse", "mae", "corr", "qlike"):
                assert got[k][c] == (w[c] if w[c] is None else pytest.approx(w[c], rel=1e-8)), (k, c)


def test_readiness_of_each_entity(spark):
    from tidemark.operators.checks import readiness

    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-02 05:00:00"), ("a", "2024-01-02 06:00:00"), ("b", "2024-01-02 00:00:01"), ("c", None), (None, "2024-01-01 10:00:00")]
    df = spark.createDataFrame(rows, "symbol string, ts string").selectExpr("symbol", "cast(ts as timestamp_ntz) as ts")
    start = F.lit("2024-01-02").cast("timestamp_ntz")
    got = {r.symbol: (r.n_days, r.full_history, r.enough_days, r.first_ts is None) for r in readiness(df, ["symbol"], start, 2).collect()}
    assert got == {"a": (2, True, True, False), "b": (1, False, False, False), "c": (0, False, False, True), None: (1, True, False, False)}
    assert readiness(df.limit(0), ["symbol"], start, 2).collect() == []
