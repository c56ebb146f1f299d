"""Sharding by a minimax contiguous partition, with DataFrame operations only."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stage

#: Hex digits of the text's digest that name a unit: 65,536 units at most come to the driver.
UNIT_DIGITS = 4
#: Rows that are numbered together: a unit's rows are dealt to as many cells as that takes, so that no task numbers a large one.
CELL_ROWS = 2_000


def fits(prefix: list[int], n_shards: int, capacity: int) -> bool:
    """Greedy check: do the units, in order, fill at most ``n_shards`` shards of ``capacity``?"""
    at = 0
    for _ in range(n_shards):
        at = bisect_right(prefix, prefix[at] + capacity) - 1
        if at == len(prefix) - 1:
            return True
    return False


def minimax_cuts(sizes: list[int], n_shards: int) -> tuple[int, list[int]]:
    """Smallest feasible capacity, and for each shard the index at which it ends.

    The capacity is binary-searched. The cuts then go as near to an equal share of what is left as
    the capacity allows, and every shard takes a unit while there are any, so that a large unit
    leaves no shard empty.
    """
    prefix = [0, *accumulate(sizes)]
    n, total = len(sizes), prefix[-1]
    low, high = max([-(-total // n_shards), *sizes]) if sizes else 0, total
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(prefix, n_shards, mid) else (mid + 1, high)
    first = [n]  # first[k]: least index from which k shards take the rest
    for _ in range(n_shards):
        need, a, b = prefix[first[-1]] - low, 0, first[-1]
        while a < b:
            m = (a + b) // 2
            a, b = (a, m) if prefix[m] >= need else (m + 1, b)
        first.append(a)
    ends, at = [], 0
    for left in range(n_shards, 0, -1):
        share = prefix[at] + (total - prefix[at]) / left
        end = bisect_right(prefix, share) - 1
        if end < n and share - prefix[end] > prefix[end + 1] - share:
            end += 1
        furthest = bisect_right(prefix, prefix[at] + low) - 1
        at = n if left == 1 else min(max(end, first[left - 1], min(at + 1, n)), furthest)
        ends.append(at)
    return low, ends


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, extra: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal rows to shards of near equal bytes, equal texts together.

    Returns id, size (UTF-8 bytes and ``extra``), text_crc32, law, shard, slot (gapless from 0 in
    each shard), grown_shard (null under this law). Null texts are empty texts. Groups of equal texts
    are ordered by digest; groups that share the digest's first 16 bits are one atomic unit, so the
    driver holds 65,536 sizes at most, however many rows there are. Repeated rows and null ids each
    get a slot of their own; an empty table gives no rows; further columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t")).select(
        "id", (F.octet_length("t").cast("long") + extra).alias("size"), F.crc32(F.encode("t", "UTF-8")).alias("crc"), F.md5(F.encode("t", "UTF-8")).alias("digest")
    )
    # the row's number tells repeated rows apart
    rows = stage(rows.withColumns({"unit": F.conv(F.substring("digest", 1, UNIT_DIGITS), 16, 10).cast("int"), "row": F.monotonically_increasing_id()}))
    sums = stage(rows.groupBy("unit").agg(F.sum("size").alias("bytes"), F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("n_cells")))
    units = sorted((r.unit, r.bytes) for r in sums.select("unit", "bytes").collect())
    _, ends = minimax_cuts([b for _, b in units], n_shards)
    names = [u for u, _ in units]
    rows = rows.join(F.broadcast(sums.select("unit", "n_cells")), "unit")  # 65,536 rows at most
    bounds = [names[e] if e < len(names) else 1 << 30 for e in ends[:-1]]
    return _numbered(rows, bounds).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _numbered(rows: DataFrame, bounds: list[int]) -> DataFrame:
    """Shard and slot of each row: cells are counted, their counts summed, rows numbered in cells."""
    shard: Column = F.lit(0)
    if bounds:
        shard = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("unit")))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("row"), F.col("n_cells")).cast("int"))
    cells = rows.groupBy("unit", "cell").agg(F.count("*").alias("n")).withColumn("shard", shard.cast("int"))
    before = Window.partitionBy("shard").orderBy("unit", "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = Window.partitionBy("unit", "cell").orderBy("digest", "id", "row")
    return rows.withColumn("k", F.row_number().over(inside) - 1).join(cells, ["unit", "cell"]).withColumn("slot", (F.col("offset") + F.col("k")).cast("long"))
