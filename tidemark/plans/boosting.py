"""Leaf-wise boosted regression trees over histograms, with early stopping on validation rows.

Rows are binned once and written; a tree takes one aggregation for each level it has, over (node, feature, bin). Which leaf to
split next is decided from those sums on the driver (a number of them set by leaves, features and bins, never by rows).
"""

from __future__ import annotations

import heapq
import math
import random
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.sources.tables import scratch_dir

#: Trees added in one expression, so that generated code stays small.
CHUNK = 8


@dataclass(frozen=True)
class LeafParams:
    """``leaves`` per tree at most, best gain first. ``patience``: rounds without a better validation error before it stops (0: never)."""

    rate: float = 0.05
    leaves: int = 64
    rounds: int = 100
    bins: int = 255
    row_share: float = 0.8
    feature_share: float = 0.8
    least_rows: int = 200
    penalty: float = 1.0
    patience: int = 10
    seed: int = 42


@dataclass
class Node:
    """A leaf with its ``value``, or a split: rows whose bin of ``feature`` is at most ``bin`` go left (missing values are in bin 0)."""

    total: int
    rows: int
    value: float
    feature: int | None = None
    bin: int = 0
    cut: float = 0.0
    gain: float = 0.0
    left: int = 0
    right: int = 0
    depth: int = 0
    open: bool = True  # its histogram isn't known yet
    choice: tuple | None = None


@dataclass
class Model:
    features: list[str]
    base: float
    trees: list[list[Node]] = field(default_factory=list)
    val_errors: list[float] = field(default_factory=list)

    def importances(self) -> dict[str, tuple[float, int]]:
        """Sum of gains and number of splits of each feature."""
        out = {f: (0.0, 0) for f in self.features}
        for node in (n for t in self.trees for n in t if n.feature is not None):
            g, k = out[self.features[node.feature]]
            out[self.features[node.feature]] = (g + node.gain, k + 1)
        return out

    def predict(self, df: DataFrame, name: str = "y_pred") -> DataFrame:
        out = df.withColumn(name, F.lit(self.base))
        for k in range(0, len(self.trees), CHUNK):
            parts = [_walk(t, lambda n: _at_most(F.col(f"`{self.features[n.feature]}`").cast("double"), n.cut), _value) for t in self.trees[k : k + CHUNK]]
            out = out.withColumn(name, reduce(lambda a, b: a + b, parts, F.col(name)))
        return out


def _value(node: Node) -> Column:
    return F.lit(node.value)


def _at_most(x: Column, cut: float) -> Column:
    return x.isNull() | F.isnan(x) | (x <= cut)


def _walk(tree: list[Node], goes_left, leaf, at: int = 0) -> Column:
    node = tree[at]
    if node.feature is None:
        return leaf(node)
    return F.when(goes_left(node), _walk(tree, goes_left, leaf, node.left)).otherwise(_walk(tree, goes_left, leaf, node.right))


def cuts_of(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Per feature the distinct values at ranks ceil(n * k / bins): exact up to 10,000 rows, within a ten-thousandth of the ranks beyond."""
    shares = [k / bins for k in range(1, bins)]
    plain = [F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in features]
    got = df.agg(*[F.percentile_approx(x, shares, 10_000).alias(f"c{k}") for k, x in enumerate(plain)]).first()
    return [sorted(set(x or [])) for x in got]


def _binned(x: Column, cuts: list[float]) -> Column:
    """0 for a missing value, else 1 + the number of cuts below it."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low + 1)
        mid = (low + high) // 2
        return F.when(x <= cuts[mid], search(low, mid)).otherwise(search(mid + 1, high))

    return F.when(x.isNull() | F.isnan(x), 0).otherwise(search(0, len(cuts)))


def best_split(sums: dict[tuple[int, int], tuple[int, int]], use: list[int], total: int, rows: int, params: LeafParams) -> tuple[float, int, int, int, int] | None:
    """(gain, feature, bin, left sum, left rows) of the best split of a node; of equal gains the first feature and bin."""
    best, found = 0.0, None
    whole = total * total / (rows + params.penalty)
    by: dict[int, dict[int, tuple[int, int]]] = {}
    for (f, b), v in sums.items():
        by.setdefault(f, {})[b] = v
    for f in use:
        g = n = 0
        for b in sorted(by.get(f, {})):
            g, n = g + by[f][b][0], n + by[f][b][1]
            if n < params.least_rows or rows - n < params.least_rows:
                continue
            gain = g * g / (n + params.penalty) + (total - g) ** 2 / (rows - n + params.penalty) - whole
            if gain > best * (1 + 1e-12):
                best, found = gain, (gain, f, b, g, n)
    return found


def selected(tree: list[Node], leaves: int) -> list[int]:
    """The nodes that best-first growth splits, given the gains known so far.

    A node whose histogram isn't known can't be split yet. Gains still to come can only push others out, so what isn't selected now
    never will be, and a level's open nodes are all that need a histogram.
    """
    out, heap = [], [(-tree[0].choice[0], 0)] if tree[0].choice else []
    while heap and len(out) < leaves - 1:
        _, k = heapq.heappop(heap)
        out.append(k)
        for kid in (tree[k].left, tree[k].right):
            if tree[kid].choice:
                heapq.heappush(heap, (-tree[kid].choice[0], kid))
    return out


def grow_tree(histograms, use: list[int], cuts: list[list[float]], grain: float, params: LeafParams) -> list[Node]:
    """One tree; ``histograms(tree)`` gives, for each open node, {(feature, bin): (sum, rows)} of its rows."""
    tree = [Node(0, 0, 0.0)]
    while any(n.open for n in tree):
        for k, sums in histograms(tree).items():
            node = tree[k]
            if k == 0:  # the root's totals are any feature's
                mine = [v for (f, _), v in sums.items() if f == use[0]]
                node.total, node.rows = sum(g for g, _ in mine), sum(n for _, n in mine)
                node.value = -params.rate * grain * node.total / (node.rows + params.penalty)
            node.choice = best_split(sums, use, node.total, node.rows, params)
        for n in tree:
            n.open = False
        for k in selected(tree, params.leaves):
            node = tree[k]
            if node.left:
                continue
            _, _, _, g, n = node.choice
            node.left, node.right = len(tree), len(tree) + 1
            for total, rows in ((g, n), (node.total - g, node.rows - n)):
                tree.append(Node(total, rows, -params.rate * grain * total / (rows + params.penalty), depth=node.depth + 1))
    kept = set(selected(tree, params.leaves))
    for k, node in enumerate(tree):
        if k in kept:
            gain, node.feature, node.bin, *_ = node.choice
            node.gain = gain * grain * grain
            own = cuts[node.feature]
            node.cut = own[node.bin - 1] if 0 < node.bin <= len(own) else -math.inf  # bin 0: only missing values go left
    return tree


def train_leafwise(train: DataFrame, features: list[str], target: str, params: LeafParams = LeafParams(), val: DataFrame | None = None, keys: list[str] | None = None) -> Model:
    """Fit on ``train``; with ``val`` and patience the trees of the round with the least validation error stay.

    Sums are of whole numbers (errors in units of 2 ** -30 of the largest target's power of two), so trees don't depend on the
    order of rows or tasks. Rows of a round are drawn by the hash of ``keys`` (of all features and the target, if none are
    given). Null or NaN targets are left out; missing features are a bin of their own, before all others. No train row raises.
    """
    spark = train.sparkSession
    y = F.col(f"`{target}`").cast("double")
    top = train.where(~F.isnan(y)).agg(F.max(F.abs(y)).alias("m"), F.count(y).alias("n")).first()
    if not top.n:
        raise ValueError("no train row has a target")
    grain = 2.0 ** (math.ceil(math.log2(top.m)) - 30) if top.m else 1.0
    cuts = cuts_of(train, features, params.bins)

    def prepared(df: DataFrame, is_val: bool) -> DataFrame:
        draw = F.xxhash64(*[F.col(f"`{c}`") for c in (keys or [*features, target])])
        made = [_binned(F.col(f"`{c}`").cast("double"), cuts[k]).cast("short").alias(f"b{k}") for k, c in enumerate(features)]
        return df.where(y.isNotNull() & ~F.isnan(y)).select(y.alias("y"), F.lit(is_val).alias("val"), draw.alias("draw"), *made)

    rows = prepared(train, False)
    rows = rows if val is None else rows.unionByName(prepared(val, True))
    where = scratch_dir(spark)

    def saved(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{where}/{name}")
        return spark.read.schema(df.schema).parquet(f"{where}/{name}")

    whole = F.floor(F.col("y") / grain + 0.5).cast("long")
    rows = saved(rows, "binned")
    base = rows.where("not val").agg(F.sum(whole).alias("s")).first().s / top.n * grain
    rows = rows.withColumn("pred", F.lit(base))
    model, best, since, rng = Model(features, base), None, 0, random.Random(params.seed)
    for k in range(params.rounds):
        use = sorted(rng.sample(range(len(features)), max(1, round(params.feature_share * len(features)))))
        drawn = F.pmod(F.xxhash64("draw", F.lit(params.seed + k)), F.lit(1_000_000)) < round(params.row_share * 1_000_000)
        part = rows.where(~F.col("val") & drawn) if params.row_share < 1 else rows.where("not val")
        part = part.withColumn("g", F.floor((F.col("pred") - F.col("y")) / grain + 0.5).cast("long"))

        def histograms(tree: list[Node], part: DataFrame = part, use: list[int] = use) -> dict:
            node = _walk_open(tree)
            cells = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"b{f}").alias("b")) for f in use]))
            sums = part.select(node.alias("node"), "g", cells.alias("x")).where("node is not null").groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.count("*").alias("n"))
            out: dict = {}
            for r in sums.collect():
                out.setdefault(r.node, {})[r.f, r.b] = (r.g, r.n)
            return out

        tree = grow_tree(histograms, use, cuts, grain, params)
        if tree[0].feature is None:
            break  # nothing left to gain
        model.trees.append(tree)
        seen = Observation()
        moved = rows.withColumn("pred", F.col("pred") + _walk(tree, lambda n: F.col(f"b{n.feature}") <= n.bin, _value))
        rows = saved(moved.observe(seen, F.avg(F.when(F.col("val"), F.pow(F.col("pred") - F.col("y"), 2))).alias("e")), f"round{k}")
        if val is not None and params.patience:
            error = seen.get["e"]
            if error is None:
                continue  # no validation row
            model.val_errors.append(math.sqrt(error))
            best, since = (len(model.trees), 0) if best is None or model.val_errors[-1] < min(model.val_errors[:-1]) * (1 - 1e-12) else (best, since + 1)
            if since >= params.patience:
                break
    if best:
        model.trees = model.trees[:best]
    return model


def _walk_open(tree: list[Node]) -> Column:
    """The open node that a row lies in, null if its leaf isn't open."""

    def down(k: int) -> Column:
        node = tree[k]
        if node.left:
            _, f, b, *_ = node.choice
            return F.when(F.col(f"b{f}") <= b, down(node.left)).otherwise(down(node.right))
        return F.lit(k if node.open else None).cast("int")

    return down(0)


def bin_of(x: float | None, cuts: list[float]) -> int:
    """The bin that ``_binned`` gives."""
    return 0 if x is None or math.isnan(x) else 1 + bisect_left(cuts, x)
