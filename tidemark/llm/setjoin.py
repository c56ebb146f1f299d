"""Exact set-similarity join of texts' shingles by prefixes of rare shingles."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import at_once, sliced, stage
from tidemark.llm.components import components

#: Texts whose shingles are counted for the order of shingles, and shingles that it knows, at most; both change costs only, no result.
SAMPLE, KNOWN = 20_000, 500_000
#: Bits of a set's parity map.
MAP_BITS = 512
#: Sets that one cell takes from each side; larger cells are cut into chunks of which each pair meets.
CELL = 2048
#: Pairs of a cell weighed at once, and such found that a worker holds before it hands them on.
PAIRS = 250_000
#: Texts that go to a worker at once, and whose shingles are counted in one go.
ROWS = 500


def least_common(n: int, similar: float) -> int:
    """Elements that a set of ``n`` shares at least with any set as similar as ``similar``."""
    return math.ceil(similar * n - 1e-9)


def common_shingles(docs: DataFrame, text_col: str, shingles, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles seen three times or more in a sample of the texts, in order, and their counts.

    They go to the end of the order by which prefixes are cut. Any order gives the same pairs; this
    one keeps common passages out of the prefixes.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    share = max(1, docs.count() // sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sliced(batches, ROWS):
            seen: Counter = Counter()
            for x in rows.column(0).to_pylist():
                seen.update(shingles(x).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["s", "n"])

    rows = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    sums = rows.mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where("n > 2")
    with at_once(docs.sparkSession, ROWS):
        got = sums.orderBy(F.desc("n"), "s").limit(KNOWN).toArrow()
    names, counts = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
    order = np.argsort(names)
    return names[order], counts[order]


def prefix(found: np.ndarray, common: tuple[np.ndarray, np.ndarray], similar: float) -> np.ndarray:
    """The first elements of a set (sorted hashes), rare ones first: two similar sets share one of these."""
    if not len(found):
        return found
    names, counts = common
    often = np.zeros(len(found), np.int64)
    if len(names):
        at = np.minimum(np.searchsorted(names, found), len(names) - 1)
        often = np.where(names[at] == found, counts[at], 0)
    return found[np.argsort(often, kind="stable")][: len(found) - least_common(len(found), similar) + 1]


def parity(found: np.ndarray) -> bytes:
    """Bit b: whether an odd number of elements fall to b. Two maps differ in no more bits than the sets have elements apart."""
    odd = np.bincount((found % np.uint64(MAP_BITS)).astype(np.int64), minlength=MAP_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def linked(items: DataFrame, check, similar: float, cell: int = CELL) -> DataFrame:
    """(node, root) that join the roots of ``items`` (node, root, n, prefix, map) over all pairs of similar sets.

    ``check`` keeps the truly similar of pairs (a, b). Sets meet in a cell for each prefix element; a
    pair that is as similar passes the bounds on sizes, places and parity maps in the cell of its
    first common element. First each set is checked with its nearest and its smallest partner in a
    cell, so that groups of copies become one root with few pairs; then every pair within the bounds
    whose roots still differ is. Nothing is left out; only pairs apart by root and alike by bounds
    are made.
    """
    items = stage(items)
    facts = items.select("node", "n", "map")
    roots = items.select("node", "root")
    shared = stage(_apart(items.select("root", F.explode("prefix").alias("key"))))  # what this shuffles can go before the places are dealt
    places = items.select("node", F.posexplode("prefix").alias("place", "key"))
    cells = stage(places.join(shared, "key").select("key", "node", "place"))
    tried = None
    for every in (False, True):
        rows = cells.join(roots, "node")
        rows = rows.join(_apart(rows), "key").join(facts, "node")
        pairs = _candidates(rows, similar, every, cell)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        tried = stage(pairs)
        good = check(tried)
        ends = good.join(roots.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        moved = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("top"))
        roots = stage(roots.join(moved, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
    return roots


def _apart(rows: DataFrame) -> DataFrame:
    """Keys (key, held) that rows of different roots have."""
    sums = rows.groupBy("key").agg(F.count("*").alias("held"), F.min("root").alias("low"), F.max("root").alias("high"))
    return sums.where("low < high").select("key", "held")


def _candidates(rows: DataFrame, similar: float, every: bool, cell: int) -> DataFrame:
    """Distinct pairs (a > b) of the cells' sets within the bounds and of different roots."""
    rows = rows.withColumn("m", F.ceil(F.col("held") / cell).cast("int")).withColumn("i", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    names = ["key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "node", "root", "n", "place", "map"]
    rows = rows.select(*names).repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")

    def solve(cols: list, maps: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, lo, hi, node, root, n, place = cols
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        starts = np.flatnonzero(new)
        ends = np.repeat(np.append(starts[1:], len(key)), np.diff(np.append(starts, len(key))))
        later = ends - np.arange(len(key)) - 1
        sums = np.cumsum(later)
        none = np.iinfo(np.int64).max
        near, least = np.full(len(key), none), np.full(len(key), none)
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def made() -> pa.RecordBatch:
            x, y = (np.concatenate(p) for p in zip(*out, strict=True))
            out.clear()
            a, b = np.maximum(node[x], node[y]), np.minimum(node[x], node[y])
            a, b = np.unique(np.stack([a, b]), axis=1) if len(a) else (a, b)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        at = 0
        while at < len(key):
            to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + PAIRS, "right")))
            count = later[at:to]
            x = np.repeat(np.arange(at, to), count)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)
            at = to
            keep = root[x] != root[y]
            x, y = x[keep], y[keep]
            need = np.ceil(similar / (1 + similar) * (n[x] + n[y]) - 1e-9).astype(np.int64)
            keep = np.minimum(n[x] - place[x], n[y] - place[y]) >= need
            keep &= np.minimum(n[x], n[y]) >= need
            x, y, need = x[keep], y[keep], need[keep]
            far = np.zeros(len(x), np.int64)
            for k in range(maps.shape[1]):
                far += np.bitwise_count(maps[x, k] ^ maps[y, k])
            keep = far <= n[x] + n[y] - 2 * need
            x, y, far = x[keep], y[keep], far[keep]
            if every:
                out.append((x, y))
                if sum(len(p) for p, _ in out) >= PAIRS:
                    yield made()
                continue
            np.minimum.at(least, y, x)  # a cell's rows go by node
            for a, b in ((x, y), (y, x)):
                np.minimum.at(near, a, far * len(key) + b)
        if not every:
            for a, b in ((near, near % len(key)), (least, least)):
                yes = np.flatnonzero(a < none)
                out.append((yes, b[yes]))
        if out:
            yield made()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for rows in batches:
            if not rows.num_rows:
                continue
            cols = [rows.column(k).to_numpy().astype(np.int64) for k in range(7)]
            maps = np.frombuffer(b"".join(rows.column(7).to_pylist()), np.uint64).reshape(rows.num_rows, MAP_BITS // 64)
            if held is not None:
                cols, maps = [np.concatenate(p) for p in zip(held[0], cols, strict=True)], np.concatenate([held[1], maps])
            last = int(np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)))[-1])  # this cell may go on
            if last:
                yield from solve([c[:last] for c in cols], maps[:last])
            held = [c[last:] for c in cols], maps[last:]
        if held is not None:
            yield from solve(*held)

    return rows.mapInArrow(apply, "a long, b long").where("a <> b").distinct()
