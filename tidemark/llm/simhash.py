"""SimHash near-duplicates with a Gray-ordered hierarchical index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import sliced, stage
from tidemark.llm.components import components
from tidemark.llm.setjoin import common_shingles, linked, parity, prefix

SHINGLE = 4
SEED = 42
MOST_BITS = 4
#: The 64 bits in six blocks (start, width). Codes at four or fewer differing bits agree on two of them.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
#: Near copies of whole texts: similarity of the sets of WORDS-word shingles.
WORDS, SIMILAR = 5, 0.8
#: Codes that one index cell takes from each side; buckets beyond it are dealt to several cells.
CELL = 2048
#: Upper levels of the index: bits of the Gray rank that a node's codes share.
LEVELS = (16, 32, 48, 64)
#: Node pairs expanded at once.
PAIRS = 300_000
#: Texts, or pairs of texts, that go to a worker at once.
ROWS = 500


def fingerprint(text: str) -> int:
    """64-bit SimHash of the shingles' XXH64; zero where the text has no words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, k = ends - sizes, min(SHINGLE, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    return majority(xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True))


def majority(hashes: Iterator[int]) -> int:
    """The bits that over half of the 64-bit hashes have; hashes are counted in batches."""
    ones, n = np.zeros(64, np.int64), 0
    while part := list(islice(hashes, 1 << 15)):
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int32)
        n += len(part)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles (of all words, if there are fewer)."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    k = min(k, len(words))
    return np.array(sorted({xxhash.xxh64_intdigest(b" ".join(words[i : i + k])) for i in range(len(words) - k + 1)}) if words else [], np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp as a signed long. Null texts count as empty (fingerprint zero)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sliced(batches):
            fps = np.array([fingerprint(x or "") for x in rows.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(apply, f"id {kind}, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order; codes with a common head are neighbours in it."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Codes of many cells in Gray order; nodes of a level hold the bits that their codes share there.

    A level's masked pattern is kept once for all codes below it. ``links`` goes down pairs of nodes,
    adds up the differences of the patterns passed, and drops both groups once they exceed ``most``.
    """

    def __init__(self, cells: np.ndarray, codes: np.ndarray) -> None:
        rank = gray_rank(codes)
        self.order = np.lexsort((rank, cells))
        cells, codes, rank = cells[self.order], codes[self.order], rank[self.order]
        new = np.ones(len(codes), bool)
        new[1:] = cells[1:] != cells[:-1]
        starts = [np.flatnonzero(new)]
        self.patterns: list[np.ndarray] = [np.zeros(len(starts[0]), np.uint64)]
        done = 0
        for bits in LEVELS:
            head = rank >> np.uint64(64 - bits)
            new = new.copy()
            new[1:] |= head[1:] != head[:-1]
            starts.append(np.flatnonzero(new))
            mask = np.uint64(((1 << (bits - done)) - 1) << (64 - bits))
            self.patterns.append(codes[starts[-1]] & mask)
            done = bits
        self.starts = starts
        #: first[l][i], first[l][i + 1]: range of node i's children on level l + 1.
        self.first = [np.append(np.searchsorted(b, a), len(b)) for a, b in zip(starts[:-1], starts[1:], strict=True)]

    def links(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions in the input whose codes differ in ``most`` bits at most."""
        roots = np.arange(len(self.starts[0]))
        roots = roots[np.diff(np.append(self.starts[0], len(self.order))) > 1]
        a, b = self.first[0][roots], self.first[0][roots + 1]
        todo = [(0, a, b, a, b, np.zeros(len(roots), np.int64))]
        while todo:
            level, a0, a1, b0, b1, apart = todo.pop()
            n = (a1 - a0) * (b1 - b0)
            if not len(n):
                continue
            if n.sum() > PAIRS:
                if len(n) > 1:
                    half = max(1, min(len(n) - 1, int(np.searchsorted(np.cumsum(n), n.sum() // 2))))
                    todo += [(level, *(x[s] for x in (a0, a1, b0, b1, apart))) for s in (slice(None, half), slice(half, None))]
                    continue
                if a1[0] - a0[0] > 1:
                    mid = (a0 + a1) // 2
                    todo += [(level, a0, mid, b0, b1, apart), (level, mid, a1, b0, b1, apart)]
                    continue
                if b1[0] - b0[0] > 1:
                    mid = (b0 + b1) // 2
                    todo += [(level, a0, a1, b0, mid, apart), (level, a0, a1, mid, b1, apart)]
                    continue
            owner = np.repeat(np.arange(len(n)), n)
            off = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            width = (b1 - b0)[owner]
            i, j = a0[owner] + off // width, b0[owner] + off % width
            leaf = level + 1 == len(LEVELS)
            keep = i < j if leaf else i <= j
            i, j, owner = i[keep], j[keep], owner[keep]
            seen = self.patterns[level + 1]
            apart = apart[owner] + np.bitwise_count(seen[i] ^ seen[j])
            keep = apart <= most
            i, j, apart = i[keep], j[keep], apart[keep]
            if leaf:
                yield self.order[self.starts[-1][i]], self.order[self.starts[-1][j]]
            else:
                f = self.first[level + 1]
                todo.append((level + 1, f[i], f[i + 1], f[j], f[j + 1], apart))


def _least(labels: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest label reachable over ``pairs``, of which one batch at a time is held."""
    root = np.arange(len(labels))
    for i, j in pairs:
        a, b = root[i], root[j]
        while (apart := a != b).any():
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
            a, b = root[a], root[b]
    least = labels.copy()
    np.minimum.at(least, root, labels)
    return least[root]


def link_codes(nodes: DataFrame, most: int = MOST_BITS, cell: int = CELL) -> DataFrame:
    """Edges (a, b) that connect all rows of ``nodes`` (node, fp; codes distinct) at ``most`` bits or fewer.

    A cell gives one edge for each code that has a smaller neighbour, not all its pairs.
    """

    def solve(index: GrayIndex, codes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = _least(ids, index.links(most))
        at = low < ids
        return ids[at], low[at]

    return _in_cells(nodes, cell, solve)


def _in_cells(nodes: DataFrame, cell: int, solve, orders: list[str] | tuple[str, ...] = ("fp",), blocks: list[tuple[int, int]] = BLOCKS) -> DataFrame:
    """What ``solve`` finds in each index cell of ``nodes`` (node, fp, and the code's bits in further ``orders``).

    Codes meet in the buckets of any two equal blocks. Buckets are counted first (pre-aggregated);
    lone codes go, and a bucket of more than ``cell`` codes is cut into chunks of which each pair
    makes a cell, so no task takes a whole hot bucket.
    """
    field = {(o, k): F.shiftrightunsigned(o, s).bitwiseAND(F.lit((1 << w) - 1)) for o in orders for k, (s, w) in enumerate(blocks)}
    pairs = [((o, x), (o, y)) for o in orders for x, y in combinations(range(len(blocks)), 2)]
    keys = [F.lit(c) * (1 << 32) + field[x] * (1 << blocks[y[1]][1]) + field[y] for c, (x, y) in enumerate(pairs)]
    rows = nodes.select("node", "fp", F.explode(F.array(*keys)).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / cell).cast("int")
    rows = rows.join(sizes, "key").withColumn("m", chunks).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    rows = rows.select("key", "node", "fp", "i", other.alias("j"))
    # of a bucket's cells i <= j, chunk i and chunk j meet in the one named by both
    rows = rows.select("key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "node", "fp")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def found(names: np.ndarray, codes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        a, b = solve(GrayIndex(names, codes), codes, ids)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for rows in batches:
            k, i, j, node, fp = (rows.column(x).to_numpy() for x in range(5))
            cols = [k, i, j, node, fp] if held is None else [np.concatenate(x) for x in zip(held, (k, i, j, node, fp), strict=True)]
            if not len(cols[0]):
                continue
            new = np.ones(len(cols[0]), bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in cols[:3]], axis=0)
            last = int(np.flatnonzero(new)[-1])  # the last cell may go on in the next batch
            if last:
                yield found(np.cumsum(new)[:last], cols[4][:last].view(np.uint64), cols[3][:last])
            held = [x[last:] for x in cols]
        if held is not None:
            yield found(np.zeros(len(held[0]), np.int64), held[4].copy().view(np.uint64), held[3])

    return rows.mapInArrow(apply, "a long, b long").distinct()


def simhash_components(docs: DataFrame, most: int = MOST_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable, itself included).

    Ids are whole numbers. Equal fingerprints are one node of the index, named by their smallest id.
    Texts without words have fingerprint zero and link like any other; null texts count as empty.
    Rows with a null id link nothing and have a null component; repeated rows each give a row; an
    empty table gives no rows; other columns are not read.
    """
    prints = stage(fingerprints(docs, id_col, text_col))
    nodes = stage(prints.where("id is not null").groupBy("fp").agg(F.min("id").cast("long").alias("node")))
    roots = components(link_codes(nodes, most))
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    out = prints.join(named, "fp", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, most: int = MOST_BITS, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, all its columns, of each group of near copies: that of the smallest id (of equal ids, the first).

    Groups are the components over both kinds of links: fingerprints ``most`` bits apart, as in
    ``simhash_components``, and texts whose five-word shingles are similar by ``similar`` or more.
    The latter are found exactly (``setjoin.linked``) among all distinct sets of shingles and checked
    on the whole texts. Rows with a null id are in no group and stay; an empty table gives no rows; columns may have any names.
    """
    place = docs.columns.index(text_col)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")  # as one column, so that no name clashes with those added
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text_col, lambda x: shingles(x, WORDS)))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sliced(batches):
            texts = [x or "" for x in pc.struct_field(rows.column(0), [place]).to_pylist()]
            fps = np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64)
            cols: list[list] = [[], [], [], []]
            for x in texts:
                found = shingles(x, WORDS)
                for col, value in zip(cols, (hashlib.blake2b(found.tobytes(), digest_size=16).digest(), len(found), prefix(found, common.value, similar).view(np.int64), parity(found)), strict=True):
                    col.append(value)
            kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(fps), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], [*rows.schema.names, "_fp", "_set", "_n", "_prefix", "_map"])

    schema = T.StructType([T.StructField("doc", docs.schema), *[T.StructField(*x) for x in (("_fp", T.LongType()), ("_set", T.BinaryType()), ("_n", T.LongType()), ("_prefix", T.ArrayType(T.LongType())), ("_map", T.BinaryType()))]])
    rows = stage(docs.select(own).mapInArrow(apply, schema).withColumn("_row", F.monotonically_increasing_id()), ROWS)
    name, text = F.col(f"doc.`{id_col}`"), F.col(f"doc.`{text_col}`").cast("string")
    known = rows.where(name.isNotNull())
    # codes and sets are named by a row that has them, so that no id has to be unique; a row links its code to its set
    codes, sets = (stage(known.groupBy(c).agg(F.min("_row").alias("node"))) for c in ("_fp", "_set"))
    same = [known.select("_row", c).join(names, c).select(F.col("_row").alias("a"), F.col("node").alias("b")) for c, names in (("_fp", codes), ("_set", sets))]
    edges = link_codes(codes.select("node", F.col("_fp").alias("fp")), most).unionAll(same[0]).unionAll(same[1])
    first = components(edges)
    named = sets.select("node").join(first, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    items = rows.select(F.col("_row").alias("node"), F.col("_n").alias("n"), F.col("_prefix").alias("prefix"), F.col("_map").alias("map")).join(named, "node")
    texts = rows.select("_row", text.alias("text"))
    moved = linked(items, lambda pairs: _similar(pairs, texts, similar), similar).join(named.withColumnRenamed("root", "old"), "node")
    moved = moved.groupBy(F.col("old").alias("root")).agg(F.min("root").alias("top"))  # rows of one old root have one new root
    groups = known.select(name.alias("id"), "_row").join(first.withColumnRenamed("node", "_row"), "_row", "left").select("id", "_row", F.coalesce("root", "_row").alias("root"))
    groups = groups.join(moved, "root", "left").groupBy(F.coalesce("top", "root").alias("root"))
    stay = groups.agg(F.min(F.struct("id", "_row")).alias("first")).select(F.col("first._row").alias("_row"))
    stay = stay.unionByName(rows.where(name.isNull()).select("_row"))
    return _named(rows, stay).select(*[F.col(f"doc.`{c}`") for c in docs.columns])


def _named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Those of ``rows`` whose ``_row`` is in ``names``.

    Each 64 rows in a line have one number, with a bit for each that is named. Only these numbers are
    broadcast (a bit a row, and their keys), so that no row is dealt out for it.
    """
    word, bit = F.shiftright("_row", 6), F.expr("shiftleft(1L, int(_row & 63))")
    bits = names.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    met = rows.withColumn("_word", word).join(F.broadcast(bits), "_word")
    return met.where(F.col("_bits").bitwiseAND(bit) != 0).select(*rows.columns)


def _similar(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts' shingles are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sliced(batches):
            sets = ([shingles(x or "", WORDS) for x in rows.column(k).to_pylist()] for k in (2, 3))
            yield rows.filter(pa.array([similarity(x, y) >= similar for x, y in zip(*sets, strict=True)], pa.bool_())).select(["a", "b"])

    texts = _named(texts, pairs.select(F.explode(F.array("a", "b")).alias("_row")))
    both = pairs.join(texts.select(F.col("_row").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("_row").alias("b"), F.col("text").alias("text_b")), "b")
    return stage(both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long"), ROWS)
