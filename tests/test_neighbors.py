import datetime as dt
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import neighbors
from tidemark.operators.neighbors import nearest, neighbor_block, symbol_neighbors, time_neighbors
from tidemark.operators.shape import pivot_feature, unpivot_long

T0 = dt.datetime(2024, 1, 1)


def at(k):
    return T0 + dt.timedelta(minutes=k)


def apart(a, b, p):
    d = [abs(x - y) for x, y in zip(a, b, strict=True)]
    return max(d) if math.isinf(p) else sum(x**p for x in d)


@pytest.mark.parametrize("p", [1, 2, 3, math.inf])
@pytest.mark.parametrize("cell", [7, 10_000])
def test_nearest_equals_brute_force(spark, p, cell):
    rng = random.Random(2)
    train = [(k, [float(rng.randint(0, 9)) for _ in range(3)]) for k in range(90)]  # many ties
    query = [(1000 + k, [float(rng.randint(-3, 12)) for _ in range(3)]) for k in range(25)]
    kind = "key long, vector array<double>"
    got = nearest(spark.createDataFrame([*query, (1, None), (None, [0.0] * 3)], kind), spark.createDataFrame([*train, (5000, None), (5001, [None, 1.0, 1.0])], kind), 6, p, cell=cell)
    rows = sorted((r.key, r.rank, r.neighbor) for r in got.collect())
    want = []
    for q, x in query:
        best = sorted((apart(x, y, p), t) for t, y in train)[:6]
        want += [(q, k + 1, t) for k, (_, t) in enumerate(best)]
    assert rows == sorted(want)


def test_more_wanted_than_there_are_and_self_left_out(spark):
    df = spark.createDataFrame([(k, [float(k)]) for k in range(4)], "key long, vector array<double>")
    got = nearest(df, df, 9, exclude_self=True)
    assert sorted((r.key, r.neighbor) for r in got.collect()) == [(a, b) for a in range(4) for b in range(4) if a != b]
    assert nearest(df, df.limit(0), 3).collect() == []


def series(spark, rows):
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double")


def test_time_neighbours_and_prefixes(spark):
    train = series(spark, [(s, at(k), v) for k, (a, b, c) in enumerate([(0, 0, 1), (1, 1, 2), (5, 5, 3), (9, 9, 4)]) for s, v in (("a", float(a)), ("b", float(b)), ("c", float(c)))])
    query = series(spark, [(s, at(100), v) for s, v in (("a", 1.0), ("b", 2.0), ("c", 50.0))])
    got = {r.symbol: r for r in time_neighbors(train, query, "x", [1, 2, 10], ["a", "b"]).collect()}
    assert (got["c"].x_time_nn1_mean, got["c"].x_time_nn2_mean, got["c"].x_time_nn10_mean) == (2.0, 1.5, 2.5)
    assert got["a"].x_time_nn1_mean == 1.0
    with pytest.raises(ValueError):
        time_neighbors(train, query, "x", [1], ["nobody"])


def test_symbol_neighbours(spark):
    train = series(spark, [(s, at(k), v + k) for k in range(3) for s, v in (("a", 0.0), ("b", 1.0), ("c", 10.0), ("d", 9.0))])
    query = series(spark, [(s, at(100), v) for s, v in (("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", 4.0))])
    got = {r.symbol: (r.x_symbol_nn1_mean, r.x_symbol_nn2_mean) for r in symbol_neighbors(train, query, "x", [1, 2], ["a", "b", "c"]).collect()}
    assert got == {"a": (2.0, 2.5), "b": (1.0, 2.0), "c": (2.0, 1.5), "d": (3.0, 2.5)}
    only = {r.symbol: r.x_symbol_nn1_mean for r in symbol_neighbors(train, query, "x", [1], ["a"]).collect()}
    assert only == {"a": 1.0, "b": 1.0, "c": 1.0, "d": 1.0}  # the one base symbol has its own value
    sums = symbol_neighbors(train, query, "x", [1], ["a", "b"], agg=F.max)
    assert "x_symbol_nn1_max" in sums.columns


def test_block_has_a_row_per_query_row(spark):
    train = series(spark, [(s, at(k), float(k)) for k in range(4) for s in "ab"])
    query = series(spark, [(s, at(100 + k), float(k)) for k in range(2) for s in "ab"])
    out = neighbor_block(train, query, ["x"], [1, 2], ["a", "b"], target="x")
    assert out.count() == 4 and set(out.columns) == {"ts", "symbol", "x", "x_time_nn1_mean", "x_time_nn2_mean", "x_symbol_nn1_mean", "x_symbol_nn2_mean"}


def test_pivot_fills_means_and_unpivots(spark):
    df = series(spark, [("a.b", at(0), 1.0), ("a.b", at(1), 3.0), ("c", at(0), 5.0)])
    wide = pivot_feature(df, "x", ["a.b", "c"])
    assert {r.ts: (r["a.b"], r["c"]) for r in wide.collect()} == {at(0): (1.0, 5.0), at(1): (3.0, 5.0)}
    assert sorted(tuple(r) for r in unpivot_long(wide, ["a.b", "c"], "x").collect()) == [("a.b", at(0), 1.0), ("a.b", at(1), 3.0), ("c", at(0), 5.0), ("c", at(1), 5.0)]


def test_metrics(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "key int, vector array<double>")
    w = np.array([4.0, 1.0, 0.25])
    cases = {
        ("cosine", None): 1 - (x @ x.T) / np.outer(*[np.linalg.norm(x, axis=1)] * 2),
        ("manhattan", None): np.abs(x[:, None] - x).sum(2),
        ("chebyshev", None): np.abs(x[:, None] - x).max(2),
        ("minkowski", "w"): (w * (x[:, None] - x) ** 2).sum(2),
        ("seuclidean", "V"): ((x[:, None] - x) ** 2 / w).sum(2),
    }
    for (metric, param), far in cases.items():
        p, moved = neighbors.metric_space(metric, 2, {param: w.tolist()} if param else None)
        placed = df.select("key", moved(F.col("vector")).alias("vector"))
        got = {(r.key, r["rank"]): r.neighbor for r in neighbors.nearest(placed, placed, 3, p, exclude_self=True).collect()}
        np.fill_diagonal(far, np.inf)
        want = {(i, k + 1): int(j) for i in range(60) for k, j in enumerate(np.argsort(far[i], kind="stable")[:3])}
        assert got == want, metric
    with pytest.raises(ValueError):
        neighbors.metric_space("jaccard")


@pytest.mark.parametrize("metric", ["hamming", "canberra", "braycurtis", "correlation", "mahalanobis"])
def test_other_metrics_equal_brute_force(spark, metric, monkeypatch):
    rng = np.random.default_rng(4)
    t, q = rng.integers(-3, 4, (90, 4)) + 0.5, rng.integers(-3, 4, (25, 4)) + 0.5
    cov = np.cov(t.T)

    def far(a, b):
        if metric == "hamming":
            return np.mean(a != b)
        if metric == "canberra":
            return np.sum(np.abs(a - b) / (np.abs(a) + np.abs(b)))
        if metric == "braycurtis":
            return np.sum(np.abs(a - b)) / max(np.sum(np.abs(a + b)), 1e-300)
        if metric == "correlation":
            return 1 - np.corrcoef(a, b)[0, 1]
        return (a - b) @ np.linalg.inv(cov) @ (a - b)

    if metric == "correlation":  # constant vectors have none
        t, q = (x[x.std(axis=1) > 0] for x in (t, q))
    p, moved = neighbors.metric_space(metric, params={"V": cov} if metric == "mahalanobis" else None)
    frames = [spark.createDataFrame([(k, [float(v) for v in x]) for k, x in enumerate(m)], "key long, vector array<double>").withColumn("vector", moved(F.col("vector"))) for m in (q, t)]
    got = neighbors.nearest(*frames, 4, p, cell=20).collect()
    for k in range(len(q)):
        mine = sorted((r["rank"], r.neighbor) for r in got if r.key == k)
        own = [far(q[k], t[i]) for _, i in mine]
        assert [r for r, _ in mine] == [1, 2, 3, 4]
        assert own == pytest.approx(sorted(far(q[k], x) for x in t)[:4], abs=1e-9)


def test_any_callable_over_neighbours(spark):
    rows = [(T0 + dt.timedelta(hours=k), s, float((k * 7 + j * 3) % 11)) for k in range(12) for j, s in enumerate("abc")]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, symbol string, value double")
    train, query = df.where(F.col("ts") < T0 + dt.timedelta(hours=8)), df.where(F.col("ts") >= T0 + dt.timedelta(hours=8))
    for made in (neighbors.time_neighbors, neighbors.symbol_neighbors):
        a = made(train, query, "value", [2, 3], ["a", "b", "c"], agg=np.mean)
        b = made(train, query, "value", [2, 3], ["a", "b", "c"])
        assert a.columns == b.columns
        x, y = (sorted(f.collect(), key=lambda r: (r.ts, r.symbol)) for f in (a, b))
        for r, w in zip(x, y):
            assert tuple(r)[:2] == tuple(w)[:2] and tuple(r)[2:] == pytest.approx(tuple(w)[2:])


def test_nearest_by_products_are_those_by_differences_in_a_fraction_of_the_time():
    rng = np.random.default_rng(5)
    for shift, scale in ((0, 1), (1e6, 1e-3), (-3, 1e60)):
        t, q = (shift + scale * rng.standard_normal((n, 8)) for n in (3000, 40))
        t[1000:1400] = t[7]  # copies: ties
        q[:3] = t[5:8]
        keys = rng.permutation(len(t))
        d = neighbors._distances(q, t, 2)
        want = [sorted((d[i, j], keys[j]) for j in range(len(t)))[:6] for i in range(len(q))]
        i, j, far = neighbors._best(q, t, keys, 6, 2)
        assert [list(zip(far[i == k], keys[j[i == k]], strict=True)) for k in range(len(q))] == want
        most = np.array([w[2][0] for w in want])  # a bound that was met before
        i, j, far = neighbors._best(q, t, keys, 6, 2, most)
        assert [list(zip(far[i == k], keys[j[i == k]], strict=True)) for k in range(len(q))] == [[x for x in w if x[0] <= m] for w, m in zip(want, most, strict=True)]
    t, q = rng.standard_normal((20_000, 64)), rng.standard_normal((400, 64))
    at = time.process_time()
    neighbors._best(q, t, np.arange(len(t)), 6, 2)
    quick, at = time.process_time() - at, time.process_time()
    np.argsort(neighbors._distances(q, t, 2), axis=1, kind="stable")
    assert quick < (time.process_time() - at) / 3
