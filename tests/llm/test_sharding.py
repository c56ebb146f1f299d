import random
import zlib

import pytest

from tidemark.llm.sharding import fits, minimax_cuts, shard_by_bytes


def best(sizes, k):
    """Smallest capacity by dynamic programming."""
    n = len(sizes)
    cost = [[float("inf")] * (n + 1) for _ in range(k + 1)]
    cost[0][0] = 0
    for s in range(1, k + 1):
        for e in range(n + 1):
            cost[s][e] = min(max(cost[s - 1][b], sum(sizes[b:e])) for b in range(e + 1))
    return cost[k][n]


@pytest.mark.parametrize("seed", range(12))
def test_capacity_is_minimal_and_cuts_keep_it(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 5, 40]) for _ in range(rng.randint(1, 14))]
    k = rng.randint(1, 6)
    capacity, ends = minimax_cuts(sizes, k)
    assert capacity == best(sizes, k)
    assert len(ends) == k and ends[-1] == len(sizes) and ends == sorted(ends)
    assert max(sum(sizes[a:b]) for a, b in zip([0, *ends], ends, strict=False)) <= capacity
    prefix = [0]
    for s in sizes:
        prefix.append(prefix[-1] + s)
    assert fits(prefix, k, capacity) and not fits(prefix, k, capacity - 1)


def test_shards_are_even_whole_and_numbered(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.randint(0, 300))) for _ in range(4000)]
    texts += ["hot copy"] * 1500 + [None, "", "z" * 100_000]
    docs = spark.createDataFrame([(i, t, -1, "u") for i, t in enumerate(texts)] + [(None, "null id", 0, ""), (3, texts[3], 0, "")], "doc_id long, text string, shard int, unit string")
    rows = shard_by_bytes(docs).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        t = ("null id" if r.doc_id is None else texts[r.doc_id]) or ""
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(t.encode()) + 16, zlib.crc32(t.encode()), "bytes", None)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert set(by) == set(range(40))
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    group = {}
    for r in rows:
        group.setdefault("null id" if r.doc_id is None else texts[r.doc_id] or "", set()).add(r.shard)
    assert all(len(s) == 1 for s in group.values())
    sizes = sorted(sum(r["size"] for r in v) for v in by.values())
    assert sizes[-2] < 2.5 * sum(sizes) / 40  # the largest holds one text of 100,000 bytes
    assert {(r.doc_id, r.shard, r.slot) for r in shard_by_bytes(docs).collect()} == {(r.doc_id, r.shard, r.slot) for r in rows}


def test_empty_table(spark):
    assert shard_by_bytes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_huge_group_of_repeated_rows_is_numbered_in_cells(spark, monkeypatch):
    from tidemark.llm import sharding

    monkeypatch.setattr(sharding, "CELL_ROWS", 50)
    docs = spark.createDataFrame([(7, "same text")] * 1200 + [(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    out = sharding.shard_by_bytes(docs, 5).collect()
    for k in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))
    assert len(out) == 1500 and len({r.shard for r in out if r.doc_id == 7 and r.size == 25}) == 1
