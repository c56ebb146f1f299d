"""Suffix-array dedup: sampled suffixes, sorted in front-coded runs, merged by loser trees that keep common prefixes."""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shared_dir, stage

#: Bytes of a repeated string.
LENGTH = 200
#: Bytes of a gram. Of a string's grams the first with the least hash is its anchor, so equal strings
#: have their anchors at equal places, and only suffixes at anchors need sorting.
GRAM = 64
#: Bytes hashed at once, and suffixes that a task sorts at once.
CHUNK, HELD = 1 << 19, 60_000
#: Suffixes of a part that one merge takes on average. Suffixes at grams seen over HOT times are cut by distance to the string's
#: start into windows of WINDOW distances, whose strings have all but so many bytes in common: these name the part. Windows that are
#: seen over HOT times themselves (a line of nearly LENGTH bytes in many surroundings) are cut into single distances: whole strings.
PART, HOT, WINDOW = 50_000, 100_000, 17

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_LOW = np.uint64(0xFFFFFFFF)


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of each ``GRAM`` bytes, by doubling widths."""
    h = (b.astype(np.uint64) + _ODD[6]) * _ODD[0]
    h ^= h >> np.uint64(29)
    width, k = 1, 0
    while width < GRAM:
        step = min(width, GRAM - width)
        h = h[: len(h) - step] * _ODD[1 + k % 6] + h[step:]
        h ^= h >> np.uint64(31)
        width, k = width + step, k + 1
    return h * _ODD[3]


def anchors(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For chunks of ``text``: anchors' gram hashes, places, and the least and largest distance to starts of their strings."""
    b = np.frombuffer(text, np.uint8)
    across = LENGTH - GRAM + 1
    for at in range(0, len(b) - LENGTH + 1, CHUNK):
        h = gram_hashes(b[at : at + CHUNK + LENGTH - 1])
        m, width = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64), 1
        while width < across:
            step = min(width, across - width)
            m = np.minimum(m[: len(m) - step], m[step:])
            width += step
        p = (m & _LOW).astype(np.int64)
        first = np.append(0, np.flatnonzero(p[1:] != p[:-1]) + 1)
        last = np.append(first[1:] - 1, len(p) - 1)
        p = p[first]
        yield h[p].view(np.int64), p + at, p - last, p - first


def common(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    differ = int.from_bytes(x[:n]) ^ int.from_bytes(y[:n])
    return n - (differ.bit_length() + 7) // 8


class Run:
    """A sorted run, front-coded: each suffix's prefix in common with the one before, and the rest."""

    __slots__ = ("at", "head", "lcp", "rest", "shared", "size", "sizes", "to")

    def __init__(self, lcp: bytes, sizes: bytes, rest: bytes) -> None:
        self.lcp, self.sizes, self.rest, self.size = lcp, sizes, rest, len(lcp)
        self.at, self.to, self.head, self.shared = -1, 0, b"", 0

    def advance(self) -> None:
        """Next suffix; ``shared``: its prefix in common with the last one, -1 at the end."""
        self.at += 1
        if self.at >= self.size:
            self.head, self.shared = b"", -1
            return
        self.shared = self.lcp[self.at]
        end = self.to + self.sizes[self.at]
        self.head = self.head[: self.shared] + self.rest[self.to : end]
        self.to = end


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """(common prefix with the one before, run, place in it) of all suffixes, in order.

    A loser tree. Every head knows the length of its prefix in common with the last suffix that went
    out; the head with the longer one is the smaller, and only at equal lengths are bytes compared,
    from there on. What is found is kept with the loser.
    """
    if not runs:
        return
    k = 1
    while k < len(runs):
        k *= 2
    for run in runs:
        run.advance()
    players = [*runs, *[Run(b"", b"", b"") for _ in range(k - len(runs))]]
    for run in players[len(runs) :]:
        run.advance()

    def play(x: int, y: int) -> tuple[int, int]:
        a, b = players[x], players[y]
        if a.shared != b.shared:
            return (x, y) if a.shared > b.shared else (y, x)
        if a.shared < 0:
            return x, y
        known = a.shared
        p, q = a.head[known:], b.head[known:]
        both = known + common(p, q)
        if p <= q:
            b.shared = both
            return x, y
        a.shared = both
        return y, x

    losers = [0] * k
    winners = [*[0] * k, *range(k)]
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if k > 1 else 0
    while players[best].shared >= 0:
        run = players[best]
        yield run.shared, best, run.at
        run.advance()
        node = (best + k) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


def repeated(lcp: np.ndarray, left: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which strings of each suffix's anchor occur twice: (suffix, distance from start to anchor) -> bool.

    Suffixes are in order, ``lcp`` is the prefix in common with the one before, ``left`` the bytes
    before the anchor, backwards. At distance a, strings are equal if the suffixes share
    LENGTH - a bytes and the a bytes before are equal.
    """
    out = np.zeros((len(lcp), LENGTH - GRAM + 1), bool)
    same = np.cumsum(lcp < GRAM)  # classes of equal bytes before the anchor, refined byte by byte
    alive = np.arange(len(lcp))
    for a in range(out.shape[1]):
        alive = alive[far[alive] >= a]
        if a:
            codes = pd.factorize(same[alive] * 256 + left[alive, a - 1])[0]
            same[alive] = codes
            alive = alive[np.bincount(codes)[codes] > 1] if len(codes) else alive
        if not len(alive):
            break
        use = alive[near[alive] <= a]
        right = np.cumsum(lcp < LENGTH - a)
        out[use, a] = pd.Series(right[use] * (len(lcp) + 1) + same[use]).duplicated(keep=False).to_numpy()
    return out


#: A run; or, where ``ends`` isn't empty, spans from ``place`` to ``ends`` that a task found repeated by itself.
RUN = "part long, lcp binary, sizes binary, rest binary, lefts binary, before binary, near binary, far binary, place binary, k1 binary, k2 binary, ends binary"
SPANS = "k1 long, k2 long, spans array<long>"


def windows(h: int, right: bytes, left: bytes, near: int, far: int, crowded: frozenset[int] = frozenset()) -> Iterator[tuple[int, bytes, bytes, int, int]]:
    """(key, right, left, near, far) of a suffix at a very frequent gram, for each window of distances from start to anchor.

    ``right`` begins at the gram, ``left`` are the bytes before it, backwards. At distances a to b, equal
    strings share LENGTH - b bytes to the right and a to the left: the key is made of these. In place of a window whose key is
    ``crowded`` come its distances one by one, keyed by the whole string: under such a key all strings are equal.
    """

    def key(a: int, b: int, single: bool) -> int:
        return h ^ int.from_bytes(hashlib.blake2b(right[: LENGTH - b] + b"|" + left[:a], digest_size=8, salt=a.to_bytes(2) + bytes([single])).digest())

    for a in range(near // WINDOW * WINDOW, far + 1, WINDOW):
        b = min(a + WINDOW - 1, LENGTH - GRAM)
        low, high, shared = max(near, a), min(far, b), key(a, b, False)
        if shared not in crowded:
            yield shared, right[: LENGTH - low], left[:high], low, high
            continue
        for d in range(low, high + 1):
            yield key(d, d, True), right[: LENGTH - d], left[:d], d, d


def _often(text: bytes, often: np.ndarray) -> Iterator[tuple[int, bytes, bytes, int, int, int]]:
    """(gram's hash, bytes from it on, bytes before it backwards, near, far, place) of the anchors at very frequent grams."""
    if not len(often):
        return
    for h, p, near, far in anchors(text):
        at = np.isin(h, often)
        for x, place, a, b in zip(h[at].view(np.uint64).tolist(), p[at].tolist(), near[at].tolist(), far[at].tolist(), strict=True):
            yield x, text[place : place + LENGTH - a], text[place - b : place][::-1], a, b, place


def _window_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, key, n) for rows (k1, k2, text, often): how often a text has each window of its very frequent grams."""
    for batch in batches:
        for i, text in enumerate(batch.column(2).to_pylist()):
            found: Counter = Counter()
            for *suffix, _ in _often(text, np.array(batch.column(3)[i].values.to_numpy(zero_copy_only=False), np.int64)):
                found.update(key for key, *_ in windows(*suffix))
            if found:
                keys = pa.array(np.array(list(found), np.uint64).view(np.int64))
                own = [pa.array([batch.column(c)[i].as_py()] * len(found), pa.int64()) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, keys, pa.array(list(found.values()), pa.int64())], ["k1", "k2", "key", "n"])


def collapsed(held: dict[int, dict]) -> tuple[dict[int, list], list[tuple]]:
    """One suffix for all that are equal with what lies before them; and the spans of those that are two or more: they are repeats as they are."""
    runs: dict[int, list] = {}
    spans = []
    for part, found in held.items():
        runs[part] = [(*suffix, *places[0]) for suffix, places in found.items()]
        for (_, _, near, far), places in found.items():
            if len(places) > 1:
                spans += [(k1, k2, at - far, at - near + LENGTH) for at, k1, k2 in places]
    return runs, spans


def _runs(held: dict[int, list], spans: list[tuple] = (), home: int = 0) -> pa.RecordBatch:
    """A row for each part's run, and one for ``spans``, which goes to the part ``home``."""
    rows = []
    for part, found in held.items():
        found.sort()
        rights = [x[0] for x in found]
        shared = [0, *map(common, rights, rights[1:])]
        cols = [np.array(c) for c in zip(*[x[2:] for x in found], strict=True)]
        rows.append((
            part, bytes(shared), bytes(len(r) - s for r, s in zip(rights, shared, strict=True)), b"".join(r[s:] for r, s in zip(rights, shared, strict=True)),
            bytes(len(x[1]) for x in found), b"".join(x[1] for x in found), *[c.astype(np.uint8).tobytes() for c in cols[:2]], *[c.astype(np.int64).tobytes() for c in cols[2:]], b"",
        ))
    if spans:
        k1, k2, begin, end = (np.array(x, np.int64).tobytes() for x in zip(*spans, strict=True))
        rows.append((home, *[b""] * 7, begin, k1, k2, end))
    names = [x.split()[0] for x in RUN.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i else pa.int64()) for i, c in enumerate(cols)], names)


def _spans(k1: np.ndarray, k2: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """One row for each text, its spans as begin, end, begin, end ..."""
    order = np.lexsort((begin, k2, k1))
    k1, k2, begin, end = k1[order], k2[order], begin[order], end[order]
    new = np.ones(len(k1), bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    at = np.flatnonzero(new)
    flat = np.stack([begin, end], 1).ravel()
    lists = pa.ListArray.from_arrays(pa.array(np.append(2 * at, len(flat)), pa.int32()), pa.array(flat, pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(k1[at], pa.int64()), pa.array(k2[at], pa.int64()), lists], ["k1", "k2", "spans"])


def merged_spans(runs: list[dict]) -> pa.RecordBatch:
    """Repeated spans found by merging one part's runs."""
    order = list(merge([Run(r["lcp"], r["sizes"], r["rest"]) for r in runs]))
    cols = np.array(order, np.int64).reshape(-1, 3)
    starts = np.cumsum([0, *[len(r["lcp"]) for r in runs]])
    at = starts[cols[:, 1]] + cols[:, 2]
    near, far, lefts = (np.frombuffer(b"".join(r[x] for r in runs), np.uint8).astype(np.int64)[at] for x in ("near", "far", "lefts"))
    place, k1, k2 = (np.frombuffer(b"".join(r[x] for r in runs), np.int64)[at] for x in ("place", "k1", "k2"))
    before = np.frombuffer(b"".join(r["before"] for r in runs), np.uint8)
    sizes = np.frombuffer(b"".join(r["lefts"] for r in runs), np.uint8).astype(np.int64)
    begin = (np.cumsum(sizes) - sizes)[at]
    left = np.zeros((len(at), max(1, LENGTH - GRAM)), np.uint8)
    off = np.arange(lefts.sum()) - np.repeat(np.cumsum(lefts) - lefts, lefts)
    left[np.repeat(np.arange(len(at)), lefts), off] = before[np.repeat(begin, lefts) + off]
    hits = repeated(cols[:, 0], left, near, far)
    edge = np.diff(np.pad(hits, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (row, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)  # distances a to b - 1
    return _spans(k1[row], k2[row], place[row] - b + 1, place[row] - a + LENGTH)


def _texts(docs: DataFrame, id_col: str, text_col: str, n: int) -> tuple[DataFrame, DataFrame, str]:
    """Rows by the 128-bit key of their text, and the table of distinct texts with its name, bucketed by that key so that no later join shuffles a text."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2"))
    name = f"tidemark_texts_{uuid.uuid4().hex}"
    texts = rows.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    writer = texts.repartition(n, "k1", "k2").write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark).rstrip('/')}/{name}")
    writer.bucketBy(n, "k1", "k2").saveAsTable(name)
    return rows.select("id", "k1", "k2"), spark.table(name), name


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, part: int = PART) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, spans (begin and end, in bytes, of what goes).

    A byte goes if a ``LENGTH``-byte string over it starts anywhere else, in the same text or another.
    Equal texts are one entry of the index (all of a long one goes). Anchors' grams are counted first;
    suffixes at grams seen once can't repeat and stay at home. Of the others, those that a task has
    twice with all that counts of their surroundings are one; they are sorted where they are, cut into
    parts by gram and exchanged front-coded; a loser tree merges each part's runs. Suffixes at grams seen more than
    ``hot`` times go the same way, but as several of fewer distances each, dealt out by far longer strings than the gram
    (``windows``). These windows are counted, too, and those seen more than ``hot`` times come as whole strings, of which a task sends
    one for all that are equal: no group lands in one task. Null texts
    are empty; texts under ``LENGTH`` bytes keep all; repeated rows and null ids each give a row; an
    empty table gives none; further columns are not read.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, texts, name = _texts(docs, id_col, text_col, n)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, counts, owner = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for h, *_ in anchors(text):
                    h, c = np.unique(h, return_counts=True)
                    hashes.append(h)
                    counts.append(c)
                    owner.append(np.full(len(h), i))
            if hashes:
                at = pa.array(np.concatenate(owner))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(hashes)), pa.array(np.concatenate(counts), pa.int64())], ["k1", "k2", "h", "n"])

    whole = texts.select("k1", "k2", F.encode("text", "UTF-8").alias("text"))
    seen = stage(whole.mapInArrow(grams, "k1 long, k2 long, h long, n long"))
    twice = stage(seen.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"))
    total = twice.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") > hot, F.col("n"))).alias("hot")).first()
    wanted = seen.select("k1", "k2", "h").join(twice.select("h", (F.col("n") > hot).alias("hot")), "h")
    lists = wanted.groupBy("k1", "k2").agg(*[F.collect_list(F.when(c, F.col("h"))).alias(name) for c, name in ((~F.col("hot"), "h"), (F.col("hot"), "often"))])
    found, more = whole.join(lists, ["k1", "k2"]).withColumn("crowded", F.array().cast("array<long>")), 0
    if total.hot:  # without such grams there are no windows to count
        asked = whole.join(lists.where("size(often) > 0").select("k1", "k2", "often"), ["k1", "k2"])
        keys = stage(asked.mapInArrow(_window_keys, "k1 long, k2 long, key long, n long"))
        crowds = stage(keys.groupBy("key").agg(F.sum("n").alias("all")).where(F.col("all") > hot))
        more = (keys.agg(F.sum("n")).first()[0] or 0) + WINDOW * (crowds.agg(F.sum("all")).first()[0] or 0)
        own = keys.join(crowds, "key").groupBy("k1", "k2").agg(F.collect_list("key").alias("keys"))
        found = found.join(own, ["k1", "k2"], "left").withColumn("crowded", F.coalesce("keys", "crowded"))
    parts = max(4 * n, -(-((total.n or 0) + more) // part))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = defaultdict(lambda: defaultdict(list))
        size, home = 0, parts + TaskContext.get().partitionId()
        for batch in batches:
            for i, text in enumerate(batch.column(2).to_pylist()):
                place = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                good, often, crowded = (np.array(batch.column(c)[i].values.to_numpy(zero_copy_only=False), np.int64) for c in (3, 4, 5))
                for h, p, near, far in anchors(text):
                    keep = np.isin(h, good)
                    for x, at, a, b in zip((h[keep].view(np.uint64) % np.uint64(parts)).tolist(), p[keep].tolist(), near[keep].tolist(), far[keep].tolist(), strict=True):
                        held[x][text[at : at + LENGTH - a], text[at - b : at][::-1], a, b].append((at, *place))
                        size += 1
                    if size >= HELD:
                        yield _runs(*collapsed(held), home)
                        held.clear()
                        size = 0
                crowded = frozenset(crowded.view(np.uint64).tolist())
                for *suffix, at in _often(text, often):
                    for key, *cut_out in windows(*suffix, crowded):
                        held[key % parts][tuple(cut_out)].append((at, *place))
                        size += 1
                    if size >= HELD:
                        yield _runs(*collapsed(held), home)
                        held.clear()
                        size = 0
        yield _runs(*collapsed(held), home)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for run in batch.to_pylist():
                if run["ends"]:
                    yield _spans(*(np.frombuffer(run[c], np.int64) for c in ("k1", "k2", "place", "ends")))
                    continue
                if held and held[0]["part"] != run["part"]:
                    yield merged_spans(held)
                    held = []
                held.append(run)
        if held:
            yield merged_spans(held)

    spans = found.select("k1", "k2", "text", "h", "often", "crowded").mapInArrow(sort, RUN)
    spans = spans.repartition(n, "part").sortWithinPartitions("part").mapInArrow(combine, SPANS)
    spans = spans.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [removed(*x) for x in zip(*[batch.column(c).to_pylist() for c in (2, 3, 4)], strict=True)]
            cols = zip(*out, strict=True) if out else [[] for _ in range(5)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    done = texts.select("k1", "k2", F.encode("text", "UTF-8").alias("text"), "copies").join(spans, ["k1", "k2"], "left")
    done = done.select("k1", "k2", "text", "copies", "spans").mapInArrow(cut, "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
    out = stage(rows.join(done, ["k1", "k2"]).select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"))
    spark.sql(f"DROP TABLE {name}")  # the catalog keeps no trace; the files lie with the other stages
    return out


def removed(text: bytes, copies: int, spans: list[int] | None) -> tuple[int, int, int, str, list[int]]:
    """(bytes, bytes that go, maximal spans, digest of the rest, the spans) of a text with ``copies`` equal ones."""
    merged: list[int] = []
    if copies > 1 and len(text) >= LENGTH:
        spans = [0, len(text)]
    x = sorted(zip(spans[::2], spans[1::2], strict=True)) if spans else []
    for begin, end in x:
        if merged and begin <= merged[-1]:
            merged[-1] = max(merged[-1], end)
        else:
            merged += [begin, end]
    digest, at = hashlib.sha256(), 0
    for begin, end in zip(merged[::2], merged[1::2], strict=True):
        digest.update(text[at:begin])
        at = end
    digest.update(text[at:])
    return len(text), sum(merged[1::2]) - sum(merged[::2]), len(merged) // 2, digest.hexdigest(), merged
