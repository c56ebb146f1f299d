"""Nearest-neighbour features: exact search over cells around pivots, and neighbours among times or among symbols."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.shape import common_symbols, pivot_feature, unpivot_long
from tidemark.sources.tables import staged

#: Rows of a cell's chunk, distances that a task holds at once, and pivots at most.
CELL, HELD, PIVOTS = 20_000, 4_000_000, 1_024


def _distances(q: np.ndarray, t: np.ndarray, p: float | str) -> np.ndarray:
    """Minkowski distances without the root (the largest difference for p = inf), or those of a named metric, summed coordinate by coordinate."""
    out = np.zeros((len(q), len(t)))
    if isinstance(p, str):
        whole = np.zeros_like(out)
        for k in range(q.shape[1]):
            a, b = q[:, k, None], t[None, :, k]
            if p == "hamming":
                out += a != b
            elif p == "canberra":
                size = np.abs(a) + np.abs(b)
                out += np.divide(np.abs(a - b), size, out=np.zeros_like(out), where=size > 0)
            else:
                out += np.abs(a - b)
                whole += np.abs(a + b)
        return np.divide(out, whole, out=np.where(out > 0, np.inf, 0.0), where=whole > 0) if p == "braycurtis" else out / max(1, q.shape[1]) if p == "hamming" else out
    for k in range(q.shape[1]):
        d = np.abs(q[:, k, None] - t[None, :, k])
        out = np.maximum(out, d) if np.isinf(p) else out + (d if p == 1 else d * d if p == 2 else d**p)
    return out


def _pairs(q: np.ndarray, t: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (i, j), summed coordinate by coordinate as in ``_distances``."""
    out = np.zeros(len(i))
    for k in range(q.shape[1]):
        d = q[i, k] - t[j, k]
        out += d * d
    return out


def _ranked(i: np.ndarray, j: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's ``n`` nearest of the pairs (i, j), ties to the smaller j."""
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < n], j[place < n], d[place < n]


def _best(q: np.ndarray, t: np.ndarray, keys: np.ndarray, n: int, p: float | str, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place in ``t``, distance) of each query's ``n`` nearest that are no farther than ``most``, ties to the smaller key.

    Squared Euclidean distances come from one matrix product about the centre of ``t``; pairs that its rounding error can't
    exclude are computed again coordinate by coordinate, and only these distances are compared and given.
    """
    order = np.argsort(keys, kind="stable")
    t = t[order]
    n = min(n, len(t))
    most = np.full(len(q), np.inf) if most is None else most
    size = max(np.abs(q).max(initial=0), np.abs(t).max(initial=0))
    rows, found = max(1, HELD // max(1, len(t))), []
    quick = p == 2 and 1e-100 < size < 1e100
    if quick:
        centre = t.mean(0)
        about, far = q - centre, t - centre
        q_norm, t_norm = (about * about).sum(1), (far * far).sum(1)
        off = 4 * (q.shape[1] + 8) * np.finfo(float).eps * (np.sqrt(q_norm) + np.sqrt(t_norm.max())) ** 2 + 1e-250  # more than rounding can do
        about, far = np.hstack([-2 * about, np.ones((len(q), 1))]), np.hstack([far, t_norm[:, None]]).T.copy()
    for a in range(0, len(q), rows):
        own, limit = q[a : a + rows], most[a : a + rows].copy()
        if quick:
            d = about[a : a + rows] @ far  # less the query's own norm, which is the same in a row
            norm, slack = q_norm[a : a + rows], off[a : a + rows]
            limit += slack - norm
            free = np.flatnonzero(np.isinf(limit))
            if len(free):
                limit[free] = np.partition(d[free], n - 1, axis=1)[:, n - 1] + 2 * slack[free]
            i, j = np.divmod(np.flatnonzero(d <= limit[:, None]), len(t))
            i, j, d = _ranked(i, j, _pairs(own, t, i, j), n)
        else:
            d = _distances(own, t, p)
            if np.isfinite(size):
                i, j = np.divmod(np.flatnonzero(d <= np.partition(d, n - 1, axis=1)[:, n - 1 : n]), len(t))
                i, j, d = _ranked(i, j, d[i, j], n)
            else:
                j = np.argsort(d, axis=1, kind="stable")[:, :n]
                i, d, j = np.repeat(np.arange(len(own)), n), np.take_along_axis(d, j, 1).ravel(), j.ravel()
        near = ~(d > most[a : a + rows][i])
        found.append((a + i[near], order[j[near]], d[near]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


#: Metrics with sums of their own; the last keeps no triangle inequality, so that all cells are met.
NAMED = ("hamming", "canberra", "braycurtis")
#: Metrics that are Minkowski distances of some p.
METRICS = {"euclidean": 2, "l2": 2, "manhattan": 1, "cityblock": 1, "l1": 1, "chebyshev": float("inf"), "infinity": float("inf")}


def _rooted(p: float | str) -> bool:
    """Whether distances are sums of which a root must be taken."""
    return not isinstance(p, str) and not np.isinf(p) and p > 1


def _length(d: np.ndarray, p: float | str) -> np.ndarray:
    """Distances for which the triangle inequality holds, of sums without the root."""
    return d ** (1 / p) if _rooted(p) else d


def _unit(x: Column) -> Column:
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    return F.transform(x, lambda v: F.try_divide(v, norm))


def _centred(x: Column) -> Column:
    mean = F.try_divide(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), F.size(x).cast("double"))
    return F.transform(x, lambda v: v - mean)


def whitening(covariance: np.ndarray | None = None, inverse: np.ndarray | None = None):
    """The linear map under which Mahalanobis distances are Euclidean ones, as a function of an array column."""
    low = np.linalg.cholesky(np.linalg.inv(np.asarray(covariance, float)) if inverse is None else np.asarray(inverse, float))
    return lambda x: F.array(*[reduce(add, (F.lit(float(low[i, j])) * F.get(x, F.lit(i)) for i in range(len(low)))) for j in range(len(low))])


def metric_space(metric: str = "minkowski", p: float = 2, params: dict | None = None):
    """(p, function of an array column): the space in which the metric is a Minkowski distance, or a named metric in place of p.

    ``params``: ``w``, weights of the coordinates; ``V``, their variances (seuclidean) or covariance (mahalanobis), or its inverse
    ``VI``. Cosine distances order points as Euclidean ones between unit vectors do, correlation distances as those between
    centred unit vectors. Other metrics raise.
    """
    params = params or {}
    if metric == "cosine":
        return 2, _unit
    if metric == "correlation":
        return 2, lambda x: _unit(_centred(x))
    if metric == "mahalanobis":
        if not {"V", "VI"} & params.keys():
            raise ValueError("mahalanobis needs V or VI")
        return 2, whitening(params.get("V"), params.get("VI"))
    if metric in NAMED:
        return metric, lambda x: x
    if metric == "seuclidean":
        scale, p = [1 / v**0.5 for v in params["V"]], 2
    elif metric == "minkowski" or metric in METRICS:
        p = METRICS.get(metric, p)
        scale = [w if np.isinf(p) else w ** (1 / p) for w in params["w"]] if "w" in params else None
    else:
        raise ValueError(f"unknown metric {metric!r}; known are correlation, cosine, mahalanobis, minkowski, seuclidean, {', '.join(sorted([*METRICS, *NAMED]))}")
    if scale is None:
        return p, lambda x: x
    factors = F.array(*[F.lit(float(s)) for s in scale])
    return p, lambda x: F.zip_with(x, factors, lambda v, s: v * s)


def covariance(df: DataFrame, cols: list[str]) -> np.ndarray:
    """Sample covariance of columns, from one aggregate."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1)]
    got = df.agg(*[F.covar_samp(F.col(f"`{cols[i]}`"), F.col(f"`{cols[j]}`")).alias(f"v{k}") for k, (i, j) in enumerate(pairs)]).first()
    out = np.zeros((len(cols), len(cols)))
    for k, (i, j) in enumerate(pairs):
        out[i, j] = out[j, i] = got[k]
    return out


def gathered(found: DataFrame, by: list[Column | str], rank: str, value: str, counts: list[int], agg, names: list[str]) -> DataFrame:
    """``agg`` over each group's values of the n first ranks, for every n of ``counts``.

    A Spark aggregate function (of ``pyspark.sql.functions``) is planned as such. Any other callable gets matrices, a row per
    group and a column per neighbour in order of rank, and ``axis=1``, as ``numpy.mean`` or ``numpy.median`` take them; values go to
    it in Arrow batches, as many per group as the largest n. Missing values are NaN.
    """
    if (getattr(agg, "__module__", None) or "").startswith("pyspark"):
        return found.groupBy(*by).agg(*[agg(F.when(F.col(rank) <= n, F.col(value))).alias(name) for n, name in zip(counts, names, strict=True)])
    near = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(value).cast("double").alias("v"))))
    lists = found.where(F.col(rank) <= max(counts)).groupBy(*by).agg(F.transform(near, lambda x: x["v"]).alias("_near"))

    @F.pandas_udf("array<double>")
    def over(parts: pd.Series) -> pd.Series:
        out, sizes = np.full((len(parts), len(counts)), np.nan), parts.map(len).to_numpy()
        for size in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == size)
            values = np.stack([np.asarray(x, float) for x in parts.iloc[rows]])
            for k, n in enumerate(counts):
                out[rows, k] = agg(values[:, :n], axis=1)
        return pd.Series(list(out))

    keys = [c for c in lists.columns if c != "_near"]
    return lists.select(*keys, over("_near").alias("_made")).select(*keys, *[F.get("_made", F.lit(k)).alias(name) for k, name in enumerate(names)])


def _name(agg) -> str:
    return getattr(agg, "__name__", "mean").replace("avg", "mean")


def nearest(query: DataFrame, train: DataFrame, n: int, p: float | str = 2, key: str = "key", vector: str = "vector", cell: int = CELL, exclude_self: bool = False) -> DataFrame:
    """(key, rank, neighbor, distance): each query's ``n`` nearest rows of ``train`` by Minkowski-p or a ``NAMED`` metric, ties to the smaller key.

    Exact, without a cross join or broadcast of either side. Train rows lie in cells, that of the nearest
    of up to ``PIVOTS`` pivots (train rows taken by hash, which every task knows), large cells in several
    chunks; no task holds more than about ``cell`` rows of either side. A query first meets one chunk of
    its own cell, which bounds its n-th distance, then only cells whose radius reaches into that bound
    (triangle inequality), and there only what is within it is given out. ``distance`` has no root taken. Rows with a null key, vector or component take
    no part. ``train`` and its cells are written once to the scratch folder, so nothing is kept in memory behind the search.
    """
    sound = F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    query = query.where(sound).select(F.col(key).alias("_q"), F.col(vector).cast("array<double>").alias("_x"))
    train = train.where(sound).select(F.col(key).alias("_t"), F.col(vector).cast("array<double>").alias("_x"))
    train = staged(train)
    most = n + int(exclude_self)
    kind, q_kind = train.schema["_t"].dataType.simpleString(), query.schema["_q"].dataType.simpleString()
    wanted = min(PIVOTS, max(1, -(-train.count() // cell)))
    taken = train.orderBy(F.xxhash64("_t"), "_t").limit(wanted).collect()
    pivots = np.array([r["_x"] for r in taken], np.float64)

    def lengths(vectors: pd.Series) -> np.ndarray:
        return _length(_distances(np.stack(vectors), pivots, p), p)

    def pieces(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (part.iloc[at : at + 1000] for part in parts for at in range(0, len(part), 1000))

    def settled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in pieces(parts):
            far = lengths(rows["_x"])
            own = far.argmin(1)
            yield rows.assign(_cell=own.astype(np.int32), _far=far[np.arange(len(rows)), own])

    if len(pivots) > 1:
        train = staged(train.mapInPandas(settled, f"_t {kind}, _x array<double>, _cell int, _far double"))
    else:
        train = train.withColumns({"_cell": F.lit(0), "_far": F.lit(0.0)})
    sizes = train.groupBy("_cell").agg(F.ceil(F.count("*") / cell).cast("int").alias("_chunks"), F.max("_far").alias("_radius"))
    found = sizes.collect()  # a row for each pivot
    chunks, radius = np.zeros(max(1, len(pivots)), np.int64), np.full(max(1, len(pivots)), -np.inf)
    for r in found:
        chunks[r["_cell"]], radius[r["_cell"]] = r["_chunks"], r["_radius"]
    there = chunks > 0
    train = train.join(F.broadcast(sizes.select("_cell", "_chunks")), "_cell")
    train = train.select("_t", "_x", "_cell", F.pmod(F.xxhash64("_t"), F.col("_chunks")).cast("int").alias("_chunk"))

    def search(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(t):
            return pd.DataFrame({"_q": q["_q"][:0], "_t": t["_t"][:0], "_d": np.zeros(0)})
        own, at, far = _best(np.stack(q["_x"]), np.stack(t["_x"]), t["_t"].to_numpy(), most, p, q["_most"].to_numpy())
        return pd.DataFrame({"_q": q["_q"].to_numpy()[own], "_t": t["_t"].to_numpy()[at], "_d": far})

    def met(q: DataFrame) -> DataFrame:
        """Queries and train rows of the same chunk; a crowd of queries comes in parts, each with the chunk's rows."""
        cells = ["_cell", "_chunk"]
        parts = q.groupBy(*cells).agg(F.ceil(F.count("*") / cell).cast("int").alias("_parts"))
        q = q.join(parts, cells).withColumn("_part", F.pmod(F.xxhash64("_q"), F.col("_parts")).cast("int")).drop("_parts")
        t = train.join(parts, cells).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
        cells.append("_part")
        return q.groupBy(*cells).cogroup(t.groupBy(*cells)).applyInPandas(search, f"_q {q_kind}, _t {kind}, _d double")

    def first(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in pieces(parts):
            own = np.where(there, lengths(rows["_x"]), np.inf).argmin(1)
            yield rows.assign(_cell=own.astype(np.int32), _chunk=np.int32(0), _most=np.inf)

    def within(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each chunk of each cell that may hold one of the query's nearest."""
        for rows in pieces(parts):
            reach = np.full(len(rows), np.inf) if p == "braycurtis" else rows["_r"].fillna(np.inf).to_numpy()
            i, c = np.nonzero(there & (lengths(rows["_x"]) - radius <= reach[:, None] * (1 + 1e-9) + 1e-12))
            many = chunks[c]
            number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            own = rows.iloc[np.repeat(i, many)]
            yield own[["_q", "_x"]].assign(_cell=np.repeat(c, many).astype(np.int32), _chunk=number.astype(np.int32), _most=own["_d"].fillna(np.inf))

    schema = f"_q {q_kind}, _x array<double>, _cell int, _chunk int, _most double"
    if len(pivots) > 1 or chunks.sum() > 1:
        bound = met(query.mapInPandas(first, schema)).groupBy("_q").agg(F.max("_d").alias("_d"), F.count("*").alias("_n")).where(F.col("_n") >= most)
        root = F.pow("_d", F.lit(1 / p)) if _rooted(p) else F.col("_d")
        query = query.join(bound.select("_q", "_d", root.alias("_r")), "_q", "left").mapInPandas(within, schema)
    else:
        query = query.withColumns({"_cell": F.lit(0), "_chunk": F.lit(0), "_most": F.lit(float("inf"))})
    found = met(query)
    if exclude_self:
        found = found.where("_q <> _t")
    order = Window.partitionBy("_q").orderBy("_d", "_t")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return found.select(F.col("_q").alias(key), "rank", F.col("_t").alias("neighbor"), F.col("_d").alias("distance"))


def time_neighbors(train: DataFrame, query: DataFrame, feature: str, counts: list[int], base: list[str] | None = None, p: float = 2, ts: str = "ts", symbol: str = "symbol", agg=F.avg, metric: str = "minkowski", metric_params: dict | None = None) -> DataFrame:
    """``{feature}_time_nn{n}_mean`` for every query time and symbol, all n from one search at the largest.

    Times are points whose coordinates are the base symbols' values, their distances as in ``metric_space``; a feature is the ``agg`` of a
    symbol's train values at the n nearest train times. With fewer than n train times all count.
    """
    symbols = common_symbols(train, query, symbol)
    base = [s for s in base or symbols if s in symbols]
    if not base:
        raise ValueError("no base symbol among the common ones")
    train_wide, query_wide = (pivot_feature(df, feature, symbols, ts, symbol) for df in (train, query))
    if metric == "mahalanobis" and not metric_params:
        metric_params = {"V": covariance(train_wide, base)}
    p, moved = metric_space(metric, p, metric_params)
    point = moved(F.array(*[F.col(f"`{s}`") for s in base]))
    found = nearest(query_wide.select(F.col(ts).alias("key"), point.alias("vector")), train_wide.select(F.col(ts).alias("key"), point.alias("vector")), max(counts), p)
    values = unpivot_long(train_wide, symbols, "_value", ts, symbol).withColumnRenamed(ts, "neighbor")
    names = [f"{feature}_time_nn{n}_{_name(agg)}" for n in counts]
    return gathered(found.join(values, "neighbor"), [F.col("key").alias(ts), symbol], "rank", "_value", counts, agg, names)


def symbol_neighbors(train: DataFrame, query: DataFrame, feature: str, counts: list[int], base: list[str], p: float = 2, ts: str = "ts", symbol: str = "symbol", agg=F.avg, metric: str = "minkowski", metric_params: dict | None = None) -> DataFrame:
    """``{feature}_symbol_nn{n}_mean``: a symbol's nearest base symbols by their train paths, itself left out; their values at the query time.

    A base symbol without another has its own value; other symbols without a neighbour NaN. Coordinates are train times: ``metric_params``
    has their weights ``w`` or variances ``V`` as a frame of (``ts``, the name); without ``V``, seuclidean takes each time's variance over the
    base symbols (times without one don't count). Mahalanobis distances aren't defined with more times than symbols, and raise.
    """
    symbols = common_symbols(train, query, symbol)
    base = [s for s in base if s in symbols]
    if not base:
        raise ValueError("no base symbol among the common ones")
    paths = unpivot_long(pivot_feature(train, feature, symbols, ts, symbol), symbols, "_value", ts, symbol)
    params = metric_params or {}
    if metric in ("cosine", "correlation"):
        if metric == "correlation":
            means = paths.groupBy(symbol).agg(F.avg("_value").alias("_mean"))
            paths = paths.join(means, symbol).select(symbol, ts, (F.col("_value") - F.col("_mean")).alias("_value"))
        norms = paths.groupBy(symbol).agg(F.sqrt(F.sum(F.col("_value") * F.col("_value"))).alias("_norm"))
        paths, p = paths.join(norms, symbol).select(symbol, ts, F.try_divide("_value", "_norm").alias("_value")), 2
    elif metric == "seuclidean":
        spread = params["V"].select(ts, F.col("V").alias("_v")) if "V" in params else paths.where(F.col(symbol).isin(base)).groupBy(ts).agg(F.var_samp("_value").alias("_v"))
        paths, p = paths.join(spread.where("_v > 0"), ts).select(symbol, ts, (F.col("_value") / F.sqrt("_v")).alias("_value")), 2
    elif metric == "mahalanobis":
        raise ValueError("mahalanobis between symbols would need more symbols than times")
    else:
        p, _ = metric_space(metric, p)
    others = paths.where(F.col(symbol).isin(base)).select(ts, F.col(symbol).alias("_base"), F.col("_value").alias("_b"))
    apart, weight = F.abs(F.col("_value") - F.col("_b")), F.lit(1.0)
    if "w" in params:
        others, weight = others.join(params["w"].select(ts, F.col("w").alias("_w")), ts), F.col("_w")
    if isinstance(p, str):
        size = F.abs("_value") + F.abs("_b")
        far = {"hamming": F.avg((F.col("_value") != F.col("_b")).cast("double")), "canberra": F.sum(F.when(size > 0, apart / size).otherwise(0.0)), "braycurtis": F.try_divide(F.sum(apart), F.sum(F.abs(F.col("_value") + F.col("_b"))))}[p]
    else:
        far = F.max(weight * apart) if np.isinf(p) else F.sum(weight * (apart * apart if p == 2 else F.pow(apart, F.lit(float(p)))))
    pairs = paths.join(others, ts).where(F.col(symbol) != F.col("_base")).groupBy(symbol, "_base").agg(far.alias("_d"))
    order = Window.partitionBy(symbol).orderBy("_d", "_base")
    near = pairs.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= max(counts)).select(symbol, "_base", "_rank")
    now = unpivot_long(pivot_feature(query, feature, symbols, ts, symbol), symbols, "_value", ts, symbol)
    names = [f"{feature}_symbol_nn{n}_{_name(agg)}" for n in counts]
    values = near.join(now.select(ts, F.col(symbol).alias("_base"), "_value"), "_base")
    made = gathered(values, [ts, symbol], "_rank", "_value", counts, agg, names)
    own = F.when(F.col(symbol).isin(base), F.col("_value")).otherwise(F.lit(float("nan")))
    return now.join(made, [ts, symbol], "left").select(ts, symbol, *[F.coalesce(name, own).alias(name) for name in names])


def neighbor_block(train: DataFrame, query: DataFrame, features: list[str], counts: list[int], base: list[str], p: float = 2, ts: str = "ts", symbol: str = "symbol", target: str | None = None) -> DataFrame:
    """Query rows with both kinds of neighbour features of every feature, one join per feature and kind."""
    out = query.select(ts, symbol, *([target] if target else []))
    for f in features:
        for made in (time_neighbors(train, query, f, counts, base, p, ts, symbol), symbol_neighbors(train, query, f, counts, base, p, ts, symbol)):
            out = out.join(made, [ts, symbol], "left")
    return out
