"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stage

FOLDS, HELD_OUT = 7, 2
#: Counts are held as levels 1 + floor(log(count) / log(STEP)), at most LEVELS of them; what is left to the lower order, as powers of SHARE.
STEP, SHARE, LEVELS = 1.5, 0.64, 110
#: Taken off every count of a word after others. Words and pairs are in the model from their first time, triples from their second
#: (at every size of input): what triples seen once would have stays with the pairs.
DISCOUNT = 0.8
LEAST = (1, 1, 2)
#: The filter has BITS bits for each n-gram and level in it, of which PROBES are set: its size follows the counts.
BITS, PROBES = 9, 6
#: Bytes of a filter that is broadcast, at most; the blocks of a larger one stay where they are, and what to probe comes to them.
BROADCAST = 160 << 20
#: Words whose exact counts are broadcast, at most; the rest is joined.
HEAD = 1 << 20
#: Bytes of text hashed at once, tokens whose n-grams are counted (or asked for) together, or sought beside a whole filter in memory;
#: n-grams that a task holds before it hands them on, and such that it hands on in one batch.
GROUP, TOKENS, BESIDE, HELD, SENT = 1 << 20, 700_000, 120_000, 4_000_000, 500_000
#: Rows that go to a worker at once: texts to count, or blocks' hashes; of texts to score, five times as many.
ROWS = 200

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Words, pairs and triples; and what contexts of one and of two words leave.
UNI, PAIR, TRI, LEFT_ONE, LEFT_TWO = range(5)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def salt(level: int) -> np.uint64:
    return np.uint64(level * int(_A) % (1 << 64))


#: The token that ends a text.
END = mixed(np.array([_A]))[0]
SALT = mixed(np.arange(1, 6, dtype=np.uint64) * _C)
START = np.array([END, END])
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _A)
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of each word (run of bytes that are no space), A-Z lower-cased."""
    b = np.frombuffer(data, np.uint8)
    inside = ~SPACE[b]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64)
    new = np.append(True, np.diff(at) > 1)
    starts = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    powers = np.multiply.accumulate(np.full(int(place.max()) + 1, _C))
    return mixed(np.add.reduceat(_BYTES[b[at]] * powers[place], starts) * _A)


def pieces(texts: Iterable[str | None]) -> Iterator[tuple[int, bytes, bool]]:
    """(text's number, bytes, whether they are its last): long texts are cut at spaces."""
    for i, text in enumerate(texts):
        data, at = (text or "").encode("utf-8", "surrogatepass"), 0
        while len(data) - at > GROUP:
            tail = np.frombuffer(data, np.uint8, offset=at + GROUP)
            cut = next((k + int(np.argmax(s)) for k in range(0, len(tail), 4096) if (s := SPACE[tail[k : k + 4096]]).any()), len(tail))
            yield i, data[at : at + GROUP + cut], at + GROUP + cut == len(data)
            at += GROUP + cut
            if at == len(data):
                break
        else:
            yield i, data[at:], True


def groups(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tokens' hashes, numbers of their texts) for about GROUP bytes at a time; every text ends in END."""
    held: list[tuple[int, bytes, bool]] = []

    def flush() -> tuple[np.ndarray, np.ndarray]:
        words = word_hashes(b" ".join(x for _, x, _ in held))
        # count each piece's words by where words begin
        b = np.frombuffer(b" ".join(x for _, x, _ in held), np.uint8)
        begin = np.flatnonzero(~SPACE[b] & np.append(True, SPACE[b[:-1]])) if len(b) else np.zeros(0, np.int64)
        ends = np.cumsum([len(x) + 1 for _, x, _ in held])
        piece = np.searchsorted(ends, begin, "right")
        last = np.array([f for _, _, f in held])
        tokens = np.full(len(words) + int(last.sum()), END)
        tokens[np.arange(len(words)) + (np.cumsum(last) - last)[piece]] = words
        counts = np.bincount(piece, minlength=len(held)) + last
        return tokens, np.repeat([i for i, _, _ in held], counts)

    size = 0
    for piece in pieces(texts):
        held.append(piece)
        size += len(piece[1]) + 1
        if size >= GROUP:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def gathered(texts: Iterable[str | None], least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``groups`` put together until they have ``least`` tokens."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for found in groups(texts):
        held.append(found)
        size += len(found[0])
        if size >= least:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """32 bits of a word's hash, then 32 of the next one's."""
    return (first >> np.uint64(32) << np.uint64(32)) | (second >> np.uint64(32))


def context_of(pair: np.ndarray) -> np.ndarray:
    """40 bits that name a pair as the context of triples."""
    return mixed(pair + _B) >> np.uint64(24)


def ngrams(tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: its pair with the one before, the pair of the two before, and its triple (40 bits of that pair, 24 of the token).

    ``before``: the two tokens in front. What follows a text's end has nothing but ends before it, so no n-gram goes over two texts.
    """
    line = np.concatenate([before, tokens])
    one, two = line[1:-1], line[:-2].copy()
    two[one == END] = END
    behind = pairs(two, one)
    return pairs(one, tokens), behind, (context_of(behind) << np.uint64(24)) | (tokens >> np.uint64(40))


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order and their summed counts. ``parts`` is emptied, so that what is put in order isn't held twice."""
    h, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    order = np.argsort(h)
    h, c = h[order], c[order]
    new = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[new], np.add.reduceat(c, new) if len(new) else c


def place(kind: int, h: np.ndarray, bits: int) -> np.ndarray:
    """The block of n-grams: that of their context, so a context's n-grams are counted and stored in one place."""
    context = h >> np.uint64(24) if kind in (TRI, LEFT_TWO) else h >> np.uint64(32)
    return (mixed(context + _A) >> np.uint64(64 - bits)).astype(np.int64)


def level(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log(counts) / math.log(STEP) + 1e-9).astype(np.int64) + 1, LEVELS)


def probes(key: np.ndarray, rank: int, size: np.ndarray | int) -> Iterator[np.ndarray]:
    """Bits of (n-gram, level) in a block of ``size`` bits."""
    x = mixed(key + salt(rank))
    a, b = x >> np.uint64(32), (x & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    for k in range(PROBES):
        yield (a + np.uint64(k) * b) % size


def filled(entries: list[tuple[int, np.ndarray, np.ndarray]]) -> bytes:
    """A block of the log-frequency Bloom filter: an n-gram of level v is in it once for each level from 1 to v."""
    size = max(64, -(-BITS * int(sum(steps.sum() for _, _, steps in entries)) // 64) * 64)
    bits = np.zeros(size, bool)
    for kind, h, steps in entries:
        key = h ^ SALT[kind]
        for rank in range(1, int(steps.max(initial=0)) + 1):
            for at in probes(key[steps >= rank], rank, np.uint64(size)):
                bits[at.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


@dataclass
class Filter:
    """Blocks of a filter, end to end; ``first``: the first byte of each block, and the last one's end."""

    data: np.ndarray
    first: np.ndarray

    @classmethod
    def joined(cls, blocks: list[tuple[int, bytes]], n: int) -> Filter:
        """Those of ``n`` blocks that are there; an n-gram of another block isn't found."""
        sizes = np.zeros(n + 1, np.int64)
        for k, bits in blocks:
            sizes[k + 1] = len(bits)
        return cls(np.frombuffer(b"".join(bits for _, bits in sorted(blocks)), np.uint8), np.cumsum(sizes))

    def levels(self, kind: int, h: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Probes level after level until one is missing; the number of those found."""
        out = np.zeros(len(h), np.uint8)
        size = (8 * (self.first[block + 1] - self.first[block])).astype(np.uint64)
        alive, rank = np.flatnonzero(size), 1
        start, key = 8 * self.first[block], h ^ SALT[kind]
        while len(alive) and rank <= LEVELS:
            left = np.arange(len(alive))
            for at in probes(key[alive], rank, size[alive]):
                # most of what isn't there goes at the first bit
                bit = start[alive[left]] + at[left].astype(np.int64)
                left = left[(self.data[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
                if not len(left):
                    break
            alive = alive[left]
            out[alive] = rank
            rank += 1
        return out


def left(context: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts (given in order, side by side), and what the n-grams of ``least`` or more leave of each to the lower order, as powers of SHARE."""
    if not len(context):
        return context, counts
    at = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
    taken = np.add.reduceat(np.where(counts >= least, counts - DISCOUNT, 0), at)
    rest = np.maximum(1 - taken / np.add.reduceat(counts, at), 0.02)
    return context[at], np.round(np.log(rest) / math.log(SHARE)).astype(np.int64)


BLOCKS = "block long, words array<long>, counts array<long>, sums array<struct<kind:int,level:int,n:long,total:long>>, bits binary"


def counted(texts: DataFrame, n: int) -> DataFrame:
    """One row a block: its words with their counts, sums by kind and level, and its part of the filter.

    Tasks count words, pairs and triples of the column ``text`` as far as they hold them, and hand on
    hashes by block; a block is summed in one place and becomes its part of the filter there, so
    nothing is dealt out a second time.
    """
    bits = block_bits(n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], []]

        def flush() -> Iterator[pa.RecordBatch]:
            for kind in (UNI, PAIR, TRI):
                if held[kind]:
                    h, c = added(held[kind])
                    block = place(kind, h, bits).astype(np.int32)
                    order = np.argsort(block, kind="stable")
                    cuts = np.searchsorted(block[order], np.arange((1 << bits) + 1))
                    h, c = h[order], c[order].astype(np.uint32)
                    del block, order
                    full = np.flatnonzero(np.diff(cuts))
                    for some in np.array_split(full, min(len(full), -(-len(h) // SENT))):
                        rows = [(k, kind, h[cuts[k] : cuts[k + 1]].tobytes(), c[cuts[k] : cuts[k + 1]].tobytes()) for k in some.tolist()]
                        cols = zip(*rows, strict=True)
                        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], ["block", "kind", "hs", "cs"])

        def hold(tokens: np.ndarray, before: np.ndarray) -> int:
            pair, _, triple = ngrams(tokens, before)
            size = 0
            for kind, x in ((UNI, tokens), (PAIR, pair), (TRI, triple)):
                codes, names = pd.factorize(x)
                held[kind].append((names, np.bincount(codes).astype(np.uint32)))
                size += len(names)
            return size

        before, size = START, 0
        texts = (x for batch in batches for x in batch.column(0).to_pylist())
        for tokens, _ in gathered(texts, TOKENS):
            size += hold(tokens, before)
            before = np.concatenate([before, tokens])[-2:]
            if size >= HELD:
                yield from flush()
                size = 0
        yield from flush()

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}

        def total() -> pa.RecordBatch:
            sums, entries = [], []
            found = {kind: added(held.get(kind, [(np.zeros(0, np.uint64), np.zeros(0, np.int64))])) for kind in (UNI, PAIR, TRI)}
            for kind, (h, c) in found.items():
                often = c >= LEAST[kind]
                h, c = h[often], c[often]
                steps = level(c) - LEAST[kind] + 1
                entries.append((kind, h, steps))
                n, sum_of = np.bincount(steps, minlength=1), np.bincount(steps, c, 1)
                sums += [{"kind": kind, "level": int(k), "n": int(n[k]), "total": int(sum_of[k])} for k in np.flatnonzero(n)]
            for kind, source, shift in ((LEFT_ONE, PAIR, 32), (LEFT_TWO, TRI, 24)):
                context, steps = left(found[source][0] >> np.uint64(shift), found[source][1], LEAST[source])
                entries.append((kind, context << np.uint64(shift), steps))
            words, counts = found[UNI]
            cols = [pa.array([at], pa.int64()), *[pa.array([x.astype(np.int64)], pa.list_(pa.int64())) for x in (words.view(np.int64), counts)]]
            kinds = pa.list_(pa.struct([("kind", pa.int32()), ("level", pa.int32()), ("n", pa.int64()), ("total", pa.int64())]))
            return pa.RecordBatch.from_arrays([*cols, pa.array([sums], kinds), pa.array([filled(entries)], pa.binary())], ["block", "words", "counts", "sums", "bits"])

        for batch in batches:
            for block, kind, hs, cs in zip(*[batch.column(k) for k in range(4)], strict=True):
                if block.as_py() != at:
                    if held:
                        yield total()
                    at, held = block.as_py(), {}
                held.setdefault(kind.as_py(), []).append((np.frombuffer(hs.as_buffer(), np.uint64), np.frombuffer(cs.as_buffer(), np.uint32).astype(np.int64)))
        if held:
            yield total()

    rows = texts.select("text").mapInArrow(count, "block int, kind int, hs binary, cs binary")
    return rows.repartition(n, "block").sortWithinPartitions("block").mapInArrow(combine, BLOCKS)


def block_bits(n: int) -> int:
    """Blocks, as a power of two: four for each of ``n`` partitions at least."""
    return max(2, (4 * n - 1).bit_length())


@dataclass
class Model:
    """tokens: N; words: V; means: a kind's mean count at each level; head: exact counts of the commonest words; end: of the texts' ends."""

    tokens: int
    words: int
    bits: int
    means: dict
    head: tuple
    end: float
    filter: Filter | None = None

    @property
    def mass(self) -> float:
        return float(self.tokens + self.words + 1)

    def exact(self, h: np.ndarray) -> np.ndarray:
        """Counts of head words, -1 for others."""
        names, counts = self.head
        if not len(names):
            return np.full(len(h), -1)
        at = np.searchsorted(names, h)
        at[at == len(names)] = 0
        return np.where(names[at] == h, counts[at], -1)


def probed(filter: Filter, keys: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Levels of words, pairs and triples, and of what the words, and the triples' first two, leave as contexts. All of a key lie in its block."""
    found = [filter.levels(kind, h, place(kind, h, bits)) for kind, h in enumerate(keys)]
    for kind, source, shift in ((LEFT_ONE, UNI, 32), (LEFT_TWO, TRI, 24)):
        context, back = np.unique(keys[source] >> np.uint64(shift), return_inverse=True)
        h = context << np.uint64(shift)
        found.append(filter.levels(kind, h, place(kind, h, bits))[back])
    return found


class Wanted:
    """What some tokens need of the filter: ``keys`` are the distinct words, pairs and triples; ``scores`` takes what ``probed`` finds."""

    def __init__(self, tokens: np.ndarray, before: np.ndarray) -> None:
        pair, behind, triple = ngrams(tokens, before)
        self.word, words = pd.factorize(np.append(before[1], tokens))
        self.pair, twos = pd.factorize(np.append(pair, behind))
        self.triple, threes = pd.factorize(triple)
        self.after_end = np.append(before[1], tokens[:-1]) == END
        self.keys = [words, twos, threes]

    def scores(self, model: Model, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(log10 of each token's probability, its exact count or -1)."""
        counts = [model.means[kind][np.minimum(found[kind], len(model.means[kind]) - 1)] for kind in (UNI, PAIR, TRI)]
        exact = model.exact(self.keys[UNI])
        word = np.where(exact >= 0, exact, counts[UNI])
        rests = [SHARE ** found[kind].astype(np.float64) for kind in (LEFT_ONE, LEFT_TWO)]
        context, token = self.word[:-1], self.word[1:]
        pair, behind = np.split(self.pair, 2)
        p = (word[token] + 1) / model.mass
        twice = np.where(self.after_end, model.end, counts[PAIR][behind])
        # a triple is no more frequent than its pairs: what the filter finds without them isn't there
        triple = np.where((found[PAIR][pair] >= LEAST[TRI]) & (twice >= LEAST[TRI]), counts[TRI][self.triple], 0)
        for own, often, rest in ((counts[PAIR][pair], word[context], rests[0][context]), (triple, twice, rests[1][self.triple])):
            seen = np.minimum(np.maximum(own - DISCOUNT, 0) / np.maximum(often, 1), 1 - rest)
            p = np.where(often > 0, seen + rest * p, p)
        return np.log10(np.minimum(p, 1)), exact[token]


def fit(docs: DataFrame, head: int = HEAD, broadcast: int = BROADCAST) -> tuple[Model, DataFrame]:
    """A model of the column ``text``, and its blocks. The model has the filter if that is at most ``broadcast`` bytes."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = stage(counted(docs, n), ROWS)
    sums = blocks.select(F.explode("sums").alias("s")).groupBy("s.kind", "s.level").agg(F.sum("s.n").alias("n"), F.sum("s.total").alias("total"))
    found = {(r.kind, r.level): (r.n, r.total) for r in sums.collect()}  # a row for each kind and level
    tokens, words = (sum(x[k] for (kind, _), x in found.items() if kind == UNI) for k in (1, 0))
    means = {}
    for kind in (UNI, PAIR, TRI):
        top = max([lv for k, lv in found if k == kind], default=0)
        means[kind] = np.array([0.0, *[x[1] / x[0] if (x := found.get((kind, lv))) else STEP ** (lv + LEAST[kind] - 1.5) for lv in range(1, top + 1)]])
    kept, cut = 0, LEVELS + 1
    for lv in sorted((lv for k, lv in found if k == UNI), reverse=True):
        if (kept := kept + found[UNI, lv][0]) > head:
            break
        cut = lv
    least = STEP ** (cut - 1) * (1 - 1e-9)
    got = exact_counts(blocks).where(F.col("c") >= least).toArrow()  # ``head`` words at most
    names, exact = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
    order = np.argsort(names)
    end = exact_counts(blocks).where(F.col("h") == int(END.view(np.int64))).first()
    model = Model(tokens, words, block_bits(n), means, (names[order], exact[order]), float(end.c if end else 0))
    if (blocks.agg(F.sum(F.octet_length("bits"))).first()[0] or 0) <= broadcast:
        model.filter = Filter.joined([(r.block, bytes(r.bits)) for r in blocks.select("block", "bits").toLocalIterator()], 1 << model.bits)
    return model, blocks


def exact_counts(blocks: DataFrame) -> DataFrame:
    """(h, c): all words with their counts."""
    return blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select(F.col("w.words").alias("h"), F.col("w.counts").alias("c"))


def summed(model: Model, tokens: np.ndarray, owner: np.ndarray, n: int, score: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of ``n`` texts, whose number is ``owner``: tokens, head words, sum of their base, score; and the other words' hashes."""
    known = count >= 0
    values = (np.ones(len(tokens)), known, np.where(known, np.log10((np.maximum(count, 0) + 1) / model.mass), 0), score)
    sums = np.stack([np.bincount(owner, v, n) for v in values])
    at = np.flatnonzero(~known)
    return sums, np.split(tokens[at], np.searchsorted(owner[at], np.arange(1, n)))


NAMES = ["rid", "n_tokens", "n_head", "base", "score", "rare"]


def rows_of(rids: list, sums: np.ndarray, rare: list[np.ndarray]) -> list[pa.Array]:
    """Columns ``NAMES``."""
    ends = np.cumsum([0, *map(len, rare)])
    flat = np.concatenate([*rare, np.zeros(0, np.uint64)]).view(np.int64)
    return [pa.array(rids, pa.int64()), *[pa.array(sums[k].astype(np.int64)) for k in (0, 1)], *[pa.array(sums[k]) for k in (2, 3)], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]


PARTIAL = "rid long, n_tokens long, n_head long, base double, score double, rare array<long>"


def scored_here(rows: DataFrame, model: Model) -> DataFrame:
    """The rows (rid, id, held_out, text) with ``PARTIAL`` for the text: every worker has the whole filter."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, before = shared.value, START
            sums, rare = np.zeros((4, batch.num_rows)), [[] for _ in range(batch.num_rows)]
            for tokens, owner in gathered(batch.column(1).to_pylist(), BESIDE):
                wanted = Wanted(tokens, before)
                scores = wanted.scores(m, probed(m.filter, wanted.keys, m.bits))
                own, others = summed(m, tokens, owner, batch.num_rows, *scores)
                sums += own
                for held, x in zip(rare, others, strict=True):
                    held.append(x)
                before = np.concatenate([before, tokens])[-2:]
            lists = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in rare]
            cols = rows_of(batch.column(0).to_pylist(), sums, lists)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *cols], ["id", "held_out", *NAMES])

    return rows.select("rid", "text", "id", "held_out").mapInArrow(apply, f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, {PARTIAL}")


def scored_apart(rows: DataFrame, model: Model, blocks: DataFrame) -> DataFrame:
    """The same for a filter of any size: the distinct n-grams of a few megabytes of text go to the blocks' partitions, their levels come back."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = model.bits
    shared = spark.sparkContext.broadcast(model)  # without the filter

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            rids, before = batch.column(0).to_numpy(), START
            for tokens, owner in gathered(batch.column(1).to_pylist(), TOKENS):
                names, at = np.unique(owner, return_inverse=True)
                codes, words = pd.factorize(tokens)
                data = pickle.dumps((words, codes.astype(np.min_scalar_type(len(words))), at.astype(np.min_scalar_type(len(names))), rids[names].tolist(), before))
                lists = [pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), batch.column(c).take(pa.array(names))) for c in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([data], pa.binary()), *lists], ["chunk", "data", "rid", "id", "held_out"])
                before, number = np.concatenate([before, tokens])[-2:], number + 1

    def parts_of(wanted: Wanted) -> list[np.ndarray]:
        return [place(kind, h, bits) % n for kind, h in enumerate(wanted.keys)]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0), batch.column(1), strict=True):
                words, codes, _, _, before = pickle.loads(data.as_py())
                wanted = Wanted(words[codes], before)
                by_part = parts_of(wanted)
                found: dict[int, list] = {}
                for h, part in zip(wanted.keys, by_part, strict=True):
                    order = np.argsort(part, kind="stable")
                    for p, x in enumerate(np.split(h[order], np.searchsorted(part[order], np.arange(1, n)))):
                        found.setdefault(p, []).append(x)
                cols = [pa.array(list(found), pa.int64()), pa.array([1] * n), pa.array([chunk.as_py()] * n, pa.int64()), pa.array([pickle.dumps(x) for x in found.values()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["part", "side", "name", "data"])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, own, own_filter = None, [], None
        for batch in batches:
            for part, side, name, data in zip(*[batch.column(k) for k in range(4)], strict=True):
                if part.as_py() != here:
                    here, own, own_filter = part.as_py(), [], None
                if side.as_py() == 0:
                    own.append((name.as_py(), data.as_py()))
                    continue
                if own_filter is None:
                    own_filter = Filter.joined(own, 1 << bits)
                found = probed(own_filter, pickle.loads(data.as_py()), bits)
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()], pa.int64()), pa.array([here + 1], pa.int64()), pa.array([pickle.dumps(found)], pa.binary())], ["chunk", "part", "data"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, levels, kept, by_part = None, [], None, []

        def done() -> pa.RecordBatch:
            tokens, owner, rids, wanted = kept
            sums, rare = summed(shared.value, tokens, owner, len(rids), *wanted.scores(shared.value, levels))
            return pa.RecordBatch.from_arrays(rows_of(rids, sums, rare), NAMES)

        for batch in batches:
            for chunk, part, data in zip(*[batch.column(k) for k in range(3)], strict=True):
                if chunk.as_py() != here:
                    if kept:
                        yield done()
                    here = chunk.as_py()
                    words, codes, owner, rids, before = pickle.loads(data.as_py())
                    tokens = words[codes]
                    wanted = Wanted(tokens, before)
                    kept, by_part = (tokens, owner.astype(np.int64), rids, wanted), parts_of(wanted)
                    levels = [np.zeros(len(wanted.keys[kind]), np.uint8) for kind in (UNI, PAIR, TRI, UNI, TRI)]
                    continue
                for own, kind, found in zip(levels, (UNI, PAIR, TRI, UNI, TRI), pickle.loads(data.as_py()), strict=True):
                    own[by_part[kind] == part.as_py() - 1] = found
        if kept:
            yield done()

    kind = rows.schema["id"].dataType.simpleString()
    chunks = stage(rows.select("rid", "text", "id", "held_out").mapInArrow(cut, f"chunk long, data binary, rid array<long>, id array<{kind}>, held_out array<boolean>"))
    schema = "part long, side long, name long, data binary"
    own = blocks.select(F.pmod("block", F.lit(n)).alias("part"), F.lit(0).cast("long").alias("side"), F.col("block").alias("name"), F.col("bits").alias("data"))
    met = own.unionAll(chunks.select("chunk", "data").mapInArrow(asked, schema)).repartition(n, "part").sortWithinPartitions("part", "side")
    back = met.mapInArrow(answered, "chunk long, part long, data binary").unionAll(chunks.select("chunk", F.lit(0).cast("long").alias("part"), "data"))
    found = back.repartition(n, "chunk").sortWithinPartitions("chunk", "part").mapInArrow(joined, PARTIAL)
    sums = [F.sum(c).alias(c) for c in NAMES[1:5]]  # a long text lies in several chunks
    names = chunks.select(F.explode(F.arrays_zip("rid", "id", "held_out")).alias("x")).select("x.*").groupBy("rid").agg(F.first("id").alias("id"), F.first("held_out").alias("held_out"))
    return found.groupBy("rid").agg(*sums, F.flatten(F.collect_list("rare")).alias("rare")).join(names, "rid")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, broadcast: int = BROADCAST) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from all rows but those of one fold (crc32 of the id as text). Words, pairs and triples of
    words are counted over all of them; counts (of triples, from 2 on) go as levels into a Bloom filter whose
    size follows them, at any size of input. ``score`` sums log10 of discounted triple probabilities over those of pairs and
    add-one words, read by probing level after level. A filter of ``broadcast`` bytes at most is
    broadcast; the distinct n-grams of the texts are sent to the blocks of a larger one, and find the
    same. ``base_score`` uses exact word counts: those of ``head`` words are broadcast, the other
    tokens are joined. Null texts are empty (one token, the end); null ids count as an empty id, and
    learn; repeated rows each give a row and are counted each; an empty table gives no rows; other
    columns are not read.
    """
    out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS == HELD_OUT
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), out.alias("held_out"))
    model, blocks = fit(rows.where(~F.col("held_out")), head, broadcast)
    rows = rows.withColumn("rid", F.monotonically_increasing_id())
    scored = stage(scored_here(rows, model), 5 * ROWS) if model.filter is not None else stage(scored_apart(rows, model, blocks))
    words = scored.select("rid", F.explode("rare").alias("h")).groupBy("rid", "h").agg(F.count("*").alias("n"))
    words = words.join(exact_counts(blocks), "h", "left")
    each = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(model.mass))
    tail = words.groupBy("rid").agg(F.sum(F.col("n") * each).alias("tail"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_tail"))
    done = scored.drop("rare").join(tail, "rid", "left")
    return done.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail", F.lit(0.0))).alias("base_score"),
        "score",
    )
