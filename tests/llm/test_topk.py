import math
import random

import numpy as np

from tidemark.llm.topk import MTree, top_k


def plain(rows):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(good):
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for m, (c, w) in enumerate(good) if c != q and len(w) == len(v))
            out += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scored[:5])]
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(700)]
    rows += [(1000 + i, rows[i % 5][1]) for i in range(60)]  # ties
    rows += [(5000, None), (5050, [1.0, None] * 4), (5100, [float("nan")] * 8), (5150, [float("inf")] * 8), (None, [1.0] * 8), (6000, [0.5] * 3), (6001, [0.25] * 3), (6050, []), (7000, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, rank string")
    assert sorted(tuple(r) for r in top_k(df).collect()) == plain(rows)
    assert sorted(tuple(r) for r in top_k(df, block=3).collect()) == plain(rows)


def test_tree_prunes_and_is_exact():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 300, (40, 16))
    x = np.floor(centres[rng.integers(0, 40, 6000)] + rng.normal(0, 10, (6000, 16))).astype(np.int64)
    tree = MTree(np.arange(6000), x)
    for q in x[::600]:
        got = sorted(tree.search(-1, q.astype(np.float64), [], 5), key=lambda b: (-b[0], -b[1]))
        want = sorted(zip((x @ q).tolist(), (-np.arange(6000)).tolist(), strict=True), key=lambda b: (-b[0], -b[1]))[:5]
        assert got == want


def test_own_row_takes_no_place_of_its_page():
    rng = np.random.default_rng(8)
    for n in (21, 100, 128, 2000):
        sizes = [n] if n < 200 else rng.integers(6, 51, 70).tolist()
        x = np.concatenate([np.floor(rng.normal(0, 300, 16) + rng.normal(0, 5, (m, 16))) for m in sizes]).astype(np.int64)
        ids = np.arange(len(x))
        ids[3] = 0  # two rows with the query's id
        tree = MTree(ids, x)
        for q in range(0, len(x), 20):
            got = sorted(tree.search(int(ids[q]), x[q].astype(np.float64), [], 5), reverse=True)
            want = sorted(((int(s), -int(i)) for s, i in zip(x @ x[q], ids, strict=True) if i != ids[q]), reverse=True)[:5]
            assert got == want


def test_empty_table(spark):
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_one_query_id_at_two_lengths_and_many_cells(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(n)]) for n in (4, 7) for i in range(120)] + [(50, [1.0] * 4)] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = plain(rows)
    assert sum(r[0] == 50 for r in want) == 25  # two lengths, and three more rows of one
    assert sorted(tuple(r) for r in top_k(df).collect()) == want
    assert sorted(tuple(r) for r in top_k(df, tree=16, block=2, work=500).collect()) == want


def test_stored_tree_finds_the_same():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(0, 300, (3000, 8))).astype(np.int64)
    tree = MTree(np.arange(3000), x)
    again = MTree.unpack(tree.pack())
    for q in x[::300].astype(np.float64):
        assert sorted(tree.search(-1, q, [], 5)) == sorted(again.search(-1, q, [], 5))


def test_many_queries_side_by_side_find_what_each_finds_alone():
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 300, (20, 12))
    x = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 20, (4000, 12))).astype(np.int64)
    x[100:140] = x[100]  # ties
    ids = rng.permutation(4000)
    tree, own = MTree(ids, x), ids[::20]
    q = x[::20].astype(np.float64)
    once = tree.search_all(own, q, [[] for _ in own], 5)
    alone = [tree.search(int(i), v, [], 5) for i, v in zip(own, q, strict=True)]
    assert [sorted(b) for b in once] == [sorted(b) for b in alone]
    for i, v, b in zip(own, x[::20], once, strict=True):
        assert sorted(b, reverse=True) == sorted(((int(s), -int(j)) for s, j in zip(x @ v, ids, strict=True) if j != i), reverse=True)[:5]
    again = tree.search_all(own, q, [list(b) for b in once], 5)  # what is known already keeps its place, and comes in again
    assert all(max(a) == max(b) for a, b in zip(again, once, strict=True))
