import math
import random

import pytest

from tidemark.plans.boosting import LeafParams, bin_of, train_leafwise

SCHEMA = "k int, a double, b double, c double, y double"


def rows(n=400, seed=3):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        a, b, c = (rng.choice([None, float("nan"), *[rng.gauss(0, 1) for _ in range(12)]]) for _ in range(3))
        y = (3.0 if (a or 0) > 0.3 else -1.0) + (2.0 if (b or 0) > 0 and (a or 0) > 0.3 else 0.0) + rng.gauss(0, 0.2)
        out.append((k, a, b, c, y))
    return out


def plain(train, params, val=()):
    """Leaf-wise boosting one leaf at a time over plain lists."""
    n, top = len(train), max(abs(r[4]) for r in train)
    grain = 2.0 ** (math.ceil(math.log2(top)) - 30)

    def cuts(i):
        values = sorted(r[i] for r in train if r[i] is not None and not math.isnan(r[i]))
        return sorted({values[math.ceil(k / params.bins * len(values)) - 1] for k in range(1, params.bins)})

    at = {i: cuts(i) for i in (1, 2, 3)}
    bins = {r[0]: [bin_of(r[i], at[i]) for i in (1, 2, 3)] for r in [*train, *val]}
    base = sum(math.floor(r[4] / grain + 0.5) for r in train) / n * grain
    pred, errors, history = {r[0]: base for r in [*train, *val]}, [], []
    for _ in range(params.rounds):
        g = {r[0]: math.floor((pred[r[0]] - r[4]) / grain + 0.5) for r in train}

        def best(keys):
            total, found = sum(g[k] for k in keys), None
            for f in range(3):
                for b in sorted({bins[k][f] for k in keys}):
                    left = [k for k in keys if bins[k][f] <= b]
                    if min(len(left), len(keys) - len(left)) < params.least_rows:
                        continue
                    x = sum(g[k] for k in left)
                    gain = x * x / (len(left) + params.penalty) + (total - x) ** 2 / (len(keys) - len(left) + params.penalty) - total * total / (len(keys) + params.penalty)
                    if gain > (found[0] if found else 0.0) * (1 + 1e-12):
                        found = (gain, f, b)
            return found

        leaves = [(list(g), [])]  # rows, and the conditions that lead there
        while len(leaves) < params.leaves:
            choices = [(best(keys), k) for k, (keys, _) in enumerate(leaves)]
            choices = [(c, k) for c, k in choices if c]
            if not choices:
                break
            (_, f, b), k = max(choices, key=lambda x: x[0][0])
            keys, path = leaves.pop(k)
            leaves += [([x for x in keys if bins[x][f] <= b], [*path, (f, b, True)]), ([x for x in keys if bins[x][f] > b], [*path, (f, b, False)])]
        if len(leaves) == 1:
            break
        for keys, path in leaves:
            value = -params.rate * grain * sum(g[k] for k in keys) / (len(keys) + params.penalty)
            for k in pred:
                if all((bins[k][f] <= b) == left for f, b, left in path):
                    pred[k] += value
        history.append(dict(pred))
        if val:
            errors.append(math.sqrt(sum((pred[r[0]] - r[4]) ** 2 for r in val) / len(val)))
    return history, errors


@pytest.mark.parametrize("leaves, rounds", [(2, 3), (7, 3)])
def test_equals_plain_leafwise_growth(spark, leaves, rounds):
    train, val = rows()[:300], rows()[300:]
    params = LeafParams(rate=0.3, leaves=leaves, rounds=rounds, bins=16, row_share=1.0, feature_share=1.0, least_rows=8, penalty=0.0, patience=50)
    history, errors = plain(train, params, val)
    model = train_leafwise(spark.createDataFrame(train, SCHEMA).repartition(3), ["a", "b", "c"], "y", params, spark.createDataFrame(val, SCHEMA))
    assert model.val_errors == pytest.approx(errors, rel=1e-9)
    got = {r.k: r.y_pred for r in model.predict(spark.createDataFrame(train + val, SCHEMA)).collect()}
    want = history[len(model.trees) - 1]
    assert got == pytest.approx(want, rel=1e-9)
    assert max(sum(n.feature is not None for n in t) for t in model.trees) == leaves - 1
    gains = model.importances()
    assert gains["a"][0] > gains["c"][0] and sum(k for _, k in gains.values()) == sum(n.feature is not None for t in model.trees for n in t)


def test_stops_when_validation_gets_worse(spark):
    rng = random.Random(5)
    noise = [(k, rng.random(), rng.random(), rng.random(), rng.gauss(0, 1)) for k in range(120)]
    params = LeafParams(rate=0.8, leaves=16, rounds=12, bins=32, row_share=0.8, feature_share=0.7, least_rows=2, patience=2)
    df, val = (spark.createDataFrame(x, SCHEMA) for x in (noise[:80], noise[80:]))
    model = train_leafwise(df, ["a", "b", "c"], "y", params, val, ["k"])
    best = model.val_errors.index(min(model.val_errors)) + 1
    assert len(model.trees) == best and len(model.val_errors) == min(best + 2, 12)
    again = train_leafwise(df.repartition(5), ["a", "b", "c"], "y", params, val, ["k"])
    assert again == model


def test_edges(spark):
    none = spark.createDataFrame([(1, 1.0, None, None, None)], SCHEMA)
    with pytest.raises(ValueError):
        train_leafwise(none, ["a"], "y")
    flat = spark.createDataFrame([(k, None, None, None, 2.0) for k in range(5)], SCHEMA)
    model = train_leafwise(flat, ["a"], "y", LeafParams(rounds=2, least_rows=1))
    assert model.trees == [] and model.predict(flat).first().y_pred == pytest.approx(2.0)
