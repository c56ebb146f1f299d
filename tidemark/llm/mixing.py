"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import at_once, stage
from tidemark.llm.toxicity import CRC

TOPICS = 8
#: Shares wanted of each margin; values that a margin doesn't name share "other", which keeps its own share.
TARGETS = {
    "source": {f"src{k}": 1 / 20 for k in range(20)},
    "lang": {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1},
    "topic": {f"t{k}": 1 / TOPICS for k in range(TOPICS)},
}
#: Share of all tokens that the sample should hold.
FRACTION = 0.5
ROUNDS, TOLERANCE = 200, 1e-6
SEED = 20_240

WORD = re.compile(r"\w+")
#: What each Latin-1 byte is where words are split: itself, or a blank if no word has it.
PLAIN = bytes(c if WORD.match(chr(c)) else 32 for c in range(256))
#: Characters of texts whose words are counted at once, and bytes that words are hashed side by side; the rest of longer words is hashed word by word.
COUNTED, LONG = 500_000, 32
#: Hashed words that the topic model knows, and rows that are measured or placed at once.
BUCKETS, ROWS = 4_096, 1_000
#: Texts whose vectors are stored as one row, and how each of a block's columns is kept there.
STORED = 500
KINDS = {"hashes": "<i8", "langs": "<i4", "over": "<f8", "sizes": "<i4", "at": "<u2", "n": "<f4"}
#: Sums over all rows are of whole numbers, so many to 1: they don't depend on how rows are dealt to tasks.
WHOLE = 1 << 20
#: Sums that leave a task side by side in one row.
SIDE = 16
#: Rounds end when the sum of all texts' closeness to their centre grows by no more than this share.
HELD = 5e-4
#: A text nearer to its language's mean than this has no direction of its own.
NEAR = 1e-3
#: Words whose bucket a worker remembers before it starts anew.
MEMO_WORDS = 200_000


class Buckets(dict):
    """Hashed number of each word."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        self[word] = number = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return number


def word_counts(words: list[str], memo: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text's words, in order, and the words in each."""
    hashed = np.bincount(np.array([memo[w] for w in words], np.int64), minlength=BUCKETS)
    at = np.flatnonzero(hashed)
    return at, hashed[at]


def only_words(text: str) -> bytes:
    """The lower-case words' UTF-8 bytes, blanks between them; where Latin-1 holds the text, no pattern is searched."""
    text = text.lower()
    try:
        plain = text.encode("latin-1").translate(PLAIN)
    except UnicodeEncodeError:
        return " ".join(WORD.findall(text)).encode("utf-8", "surrogatepass")
    return plain if text.isascii() else plain.decode("latin-1").encode()


def texts_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text (``only_words``), distinct buckets of each, and what ``word_counts`` gives for them, one text after the other."""
    data = b"\n".join([b"", *texts, b""])
    flat = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff((flat > 32).view(np.int8))) + 1
    starts, ends = edges[::2], edges[1::2]
    sizes = ends - starts
    owner = np.searchsorted(np.flatnonzero(flat == 10), starts) - 1
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    at = np.arange(len(starts))
    for k in range(LONG):
        at = at[sizes[at] > k]
        if not len(at):
            break
        c = state[at]
        state[at] = CRC[(c ^ flat[starts[at] + k]) & 255] ^ c >> 8
    for i in np.flatnonzero(sizes > LONG):
        state[i] = ~zlib.crc32(data[starts[i] + LONG : ends[i]], int(~state[i])) & 0xFFFFFFFF
    keys = owner * BUCKETS + ~state % BUCKETS
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    own, buckets = np.divmod(keys[first], BUCKETS)
    return np.bincount(owner, minlength=len(texts)), np.bincount(own, minlength=len(texts)), buckets, np.diff(np.append(first, len(keys)))


@dataclass
class Block:
    """Texts with words: hash of the name and number of the language of each, and the buckets and counts of all, one text after the other.

    Once they are ``moved``, ``n`` are no counts but the parts of a vector, of which ``over`` times the language's mean is still to be taken.
    """

    hashes: np.ndarray
    langs: np.ndarray
    over: np.ndarray
    sizes: np.ndarray
    at: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, langs: np.ndarray, over: np.ndarray, sizes: np.ndarray, at: np.ndarray, n: np.ndarray) -> Block:
        some = sizes > 0
        return cls(hashes[some], langs[some], over[some], sizes[some], at, n)

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def stored(self) -> Iterator[list[bytes]]:
        """The columns of ``STORED`` texts at a time."""
        ends = np.append(self.starts, len(self.at))
        for a in range(0, len(self.sizes), STORED):
            b = min(a + STORED, len(self.sizes))
            flat = slice(ends[a], ends[b])
            parts = (*(x[a:b] for x in (self.hashes, self.langs, self.over, self.sizes)), self.at[flat], self.n[flat])
            yield [x.astype(kind).tobytes() for x, kind in zip(parts, KINDS.values(), strict=True)]

    @classmethod
    def reread(cls, columns: list[pa.Buffer]) -> Block:
        hashes, langs, over, sizes, at, n = (np.frombuffer(x, kind) for x, kind in zip(columns, KINDS.values(), strict=True))
        return cls(hashes, langs.astype(np.int64), over, sizes.astype(np.int64), at.astype(np.int64), n)

    def text(self, i: int) -> tuple[int, float, tuple, tuple]:
        part = slice(self.starts[i], self.starts[i] + self.sizes[i])
        return int(self.langs[i]), float(self.over[i]), tuple(self.at[part].tolist()), tuple(self.n[part].tolist())

    def units(self, rarity: np.ndarray) -> np.ndarray:
        """Log counts by rarity, each text of length 1."""
        weight = np.log1p(self.n) * rarity[self.at]
        return weight / np.repeat(np.sqrt(np.add.reduceat(weight**2, self.starts)) + 1e-12, self.sizes)

    def moved(self, rarity: np.ndarray, means: np.ndarray) -> Block:
        """The texts less their language's means, at length 1 (0: no direction)."""
        units, own = self.units(rarity), np.repeat(self.langs, self.sizes)
        apart = np.add.reduceat(units * (units - 2 * means[own, self.at]), self.starts) + (means**2).sum(1)[self.langs]
        apart = np.sqrt(np.maximum(apart, 0))
        over = np.where(apart > NEAR, 1 / np.maximum(apart, NEAR), 0)
        return Block(self.hashes, self.langs, over, self.sizes, self.at, (units * np.repeat(over, self.sizes)).astype(np.float32))


@dataclass
class Topics:
    """Spherical k-means over hashed words. ``rest``: what a language's mean alone has with each centre, which is taken off."""

    rarity: np.ndarray
    centres: np.ndarray
    rest: dict

    def of(self, texts: list[tuple[np.ndarray, np.ndarray]], langs: list[str]) -> list[str]:
        """The nearest centre of each text; texts without words are "other"."""
        sizes = np.array([len(at) for at, _ in texts], np.int64)
        if not sizes.sum():
            return ["other"] * len(texts)
        return self.named(sizes, *(np.concatenate(x) for x in zip(*texts, strict=True)), langs)

    def named(self, sizes: np.ndarray, at: np.ndarray, n: np.ndarray, langs: list[str]) -> list[str]:
        names = np.full(len(sizes), "other", object)
        some = np.flatnonzero(sizes)
        if len(some):
            block = Block.of(some, some, some, sizes[some], at.astype(np.int64), n)
            none = np.zeros(self.centres.shape[1])
            best = (_products(block, block.units(self.rarity), self.centres.T) - np.array([self.rest.get(langs[i], none) for i in some])).argmax(1)
            names[some] = [f"t{k}" for k in best]
        return names.tolist()


def _products(block: Block, values: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Inner products of each text with each centre (a row each)."""
    return np.stack([np.add.reduceat(np.ascontiguousarray(c)[block.at] * values, block.starts) for c in centres], 1)


def _whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x * WHOLE)


@dataclass
class Rows:
    """(language, buckets, counts) rows in memory, as a table of counted texts is to ``Counted``."""

    block: Block
    langs: list[str]

    @classmethod
    def of(cls, rows: list[tuple[str, list[int], list[int]]]) -> Rows:
        langs = sorted({str(lang) for lang, _, _ in rows})
        at, n = (np.concatenate([np.asarray(r[k], np.int64) for r in rows] or [np.zeros(0, np.int64)]) for k in (1, 2))
        number = np.arange(len(rows))
        return cls(Block.of(number, np.array([langs.index(str(r[0])) for r in rows], np.int64), number, np.array([len(r[1]) for r in rows], np.int64), at, n), langs)

    def sums(self, width: int, work) -> np.ndarray:
        return work(self.block).astype(np.int64) if len(self.block.sizes) else np.zeros(width, np.int64)

    def first(self, key) -> tuple:
        return _first(self.block, key)

    def moved(self, rarity: np.ndarray, means: np.ndarray) -> Rows:
        return Rows(self.block.moved(rarity, means), self.langs)


def _first(block: Block, key) -> tuple:
    """(key, hash, language, over, buckets, parts) of the text with the greatest key."""
    keys = key(block)
    return max((float(keys[i]), int(block.hashes[i]), *block.text(i)) for i in np.flatnonzero(keys == keys.max()))


def packed(at: np.ndarray, n: np.ndarray) -> bytes:
    """A text's buckets and counts, eight bytes each."""
    return (at.astype("<u8") << 48 | n.astype("<u8")).tobytes()


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the texts of a column, and the buckets and counts of all."""
    if column.null_count:
        column = column.fill_null(b"")
    column = column.cast(pa.large_binary())
    places = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, "<u8", (places[-1] - places[0]) // 8, places[0]) if places[-1] > places[0] else np.zeros(0, "<u8")
    return np.diff(places) // 8, (flat >> np.uint64(48)).astype(np.int64), (flat & np.uint64((1 << 48) - 1)).astype(np.float64)


@dataclass
class Counted:
    """All rows (h, lang, over, counts) of a stored table, or blocks of them: every pass reads it whole, task by task; only sums of fixed size leave a task."""

    table: DataFrame
    langs: list[str]
    moved_already: bool = False

    @classmethod
    def of(cls, rows: DataFrame) -> Counted:
        langs = sorted(r.lang for r in rows.select("lang").distinct().collect())  # as the targets have, and "other"
        return cls(rows.select("h", "lang", F.lit(0.0).alias("over"), "counts"), langs)

    @property
    def rows(self) -> int:
        """Rows that a worker takes in one batch: a stored block is one, and as long as many texts."""
        return 1 if self.moved_already else ROWS

    def _over(self, work, schema: str) -> DataFrame:
        """Record batches that ``work`` makes of a task's blocks."""
        langs, moved = self.langs, self.moved_already

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
            for whole in batches:
                if moved:
                    yield from (Block.reread([c[i].as_buffer() for c in whole.columns]) for i in range(whole.num_rows))
                    continue
                for a in range(0, whole.num_rows, ROWS):
                    part = whole.slice(a, ROWS)
                    numbers = np.array([langs.index(x) for x in part.column(1).to_pylist()], np.int64)
                    block = Block.of(part.column(0).to_numpy(), numbers, part.column(2).to_numpy(), *unpacked(part.column(3)))
                    if len(block.sizes):
                        yield block

        return self.table.mapInArrow(lambda batches: work(blocks(batches)), schema)

    def sums(self, width: int, work) -> np.ndarray:
        """Whole-number sums of ``work`` over all blocks."""

        def apply(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width, np.int64)
            for block in blocks:
                total += work(block).astype(np.int64)
            total = np.append(total, np.zeros(-width % SIDE, np.int64)).reshape(-1, SIDE)
            at = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(np.ascontiguousarray(x)) for x in total[at].T)], ["place", *values])

        values = [f"v{k}" for k in range(SIDE)]
        sums = self._over(apply, f"place long, {', '.join(f'{c} long' for c in values)}").groupBy("place").agg(*[F.sum(c).alias(c) for c in values])
        with at_once(self.table.sparkSession, self.rows):
            got = sums.toArrow()
        out = np.zeros((-(-width // SIDE), SIDE), np.int64)
        out[got.column("place").to_numpy()] = np.stack([got.column(c).to_numpy() for c in values], 1)
        return out.ravel()[:width]

    def first(self, key) -> tuple:
        """The text with the greatest key of all."""
        kinds = {"key": pa.float64(), "h": pa.int64(), "lang": pa.int64(), "over": pa.float64(), "at": pa.list_(pa.int64()), "n": pa.list_(pa.float64())}

        def apply(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
            best = max((_first(block, key) for block in blocks), default=None)
            if best:
                yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(best, kinds.values(), strict=True)], list(kinds))

        rows = self._over(apply, "key double, h long, lang long, over double, at array<long>, n array<double>")
        with at_once(self.table.sparkSession, self.rows):
            return tuple(rows.agg(F.max(F.struct(*kinds)).alias("x")).first().x)

    def moved(self, rarity: np.ndarray, means: np.ndarray) -> Counted:
        """The texts' vectors, stored once for all rounds, as blocks."""

        def apply(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
            for block in blocks:
                for columns in block.moved(rarity, means).stored():
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in columns], list(KINDS))

        return Counted(stage(self._over(apply, ", ".join(f"{c} binary" for c in KINDS)), self.rows, "lz4"), self.langs, True)


def _drawn(hashes: np.ndarray, turn: int, seed: int) -> np.ndarray:
    """A number in (0, 1) for each hash and turn."""
    x = hashes.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (turn + 1 + seed)) % (1 << 64))
    for by, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(by))) * np.uint64(times)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53) + 2.0**-54


def fit_topics(rows: list[tuple[str, list[int], list[int]]] | DataFrame, k: int = TOPICS, rounds: int = 25, seed: int = SEED) -> Topics:
    """Topics of (language, buckets, counts) rows, or of all rows of a stored table (h, lang, counts).

    Texts are vectors of log counts by rarity, of length 1, less the mean of their language: so the
    clusters tell subjects apart and not languages, which are a margin of their own. Rarities, means and
    the centres of every round are sums over all texts that have words; far texts, drawn by hash, make the first
    centres. Rounds end early when the texts come no closer (``HELD``).
    """
    rows = (Counted if isinstance(rows, DataFrame) else Rows).of(rows)
    many = len(rows.langs)

    def seen(block: Block) -> np.ndarray:
        return np.append(np.bincount(block.at, minlength=BUCKETS), len(block.sizes))

    count = rows.sums(BUCKETS + 1, seen)
    rarity = np.log((1 + count[-1]) / (1 + count[:-1]))
    if not count[-1]:
        return Topics(rarity, np.zeros((BUCKETS, 1)), {})

    def of_langs(block: Block) -> np.ndarray:
        own = np.repeat(block.langs, block.sizes)
        return np.append(np.bincount(own * BUCKETS + block.at, _whole(block.units(rarity)), many * BUCKETS), np.bincount(block.langs, minlength=many))

    total = rows.sums(many * BUCKETS + many, of_langs)
    means = total[: many * BUCKETS].reshape(many, BUCKETS) / np.maximum(total[many * BUCKETS :], 1)[:, None] / WHOLE
    moved = rows.moved(rarity, means)

    def near(block: Block, centres: np.ndarray, rest: np.ndarray) -> np.ndarray:
        return _products(block, block.n, centres) - block.over[:, None] * rest[block.langs]

    centres = np.zeros((0, BUCKETS))
    for turn in range(k):

        def key(block: Block, turn: int = turn, centres: np.ndarray = centres.astype(np.float32), rest: np.ndarray = means @ centres.T) -> np.ndarray:
            far = np.maximum(1 - near(block, centres, rest).max(1), 0) ** 2 + 1e-9 if len(centres) else 1.0
            return np.log(_drawn(block.hashes, turn, seed)) / far

        _, _, lang, over, at, n = moved.first(key)
        centre = -over * means[lang]
        centre[list(at)] += n
        centres = np.vstack([centres, centre])
    met = None
    for _ in range(rounds):

        def by_centre(block: Block, centres: np.ndarray = centres.astype(np.float32), rest: np.ndarray = means @ centres.T) -> np.ndarray:
            close = near(block, centres, rest)
            own = close.argmax(1)
            sums = np.bincount(np.repeat(own, block.sizes) * BUCKETS + block.at, _whole(block.n), k * BUCKETS)
            return np.concatenate([sums, np.bincount(own * many + block.langs, _whole(block.over), k * many), np.bincount(own, minlength=k), [_whole(close.max(1)).sum()]])

        total = moved.sums(k * BUCKETS + k * many + k + 1, by_centre)
        sums = total[: k * BUCKETS].reshape(k, BUCKETS) - total[k * BUCKETS : k * (BUCKETS + many)].reshape(k, many) @ means
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where((total[-k - 1 : -1] > 0)[:, None], sums / np.maximum(size, 1), centres)
        if met is not None and total[-1] - met <= HELD * abs(met):
            break
        met = total[-1]
    return Topics(rarity, centres.T.copy(), {name: centres @ mean for name, mean in zip(rows.langs, means, strict=True)})


def rake(tokens: np.ndarray, cells: list[tuple], targets: dict, fraction: float = FRACTION) -> np.ndarray:
    """Inclusion probability of each cell, so that the expected tokens meet every margin.

    ``tokens``: tokens of each cell; ``cells``: its category on each margin. Probabilities are scaled
    to one margin after the other and cut at 1, until they hold still. Margins that can't be met
    because a category has too few tokens come as near as the cut allows.
    """
    total = tokens.sum()
    if not total:
        return np.full(len(tokens), fraction)
    margins = []
    for k, shares in enumerate(targets.values()):
        names = sorted({c[k] for c in cells})
        at = np.array([names.index(c[k]) for c in cells])
        natural = np.bincount(at, tokens, len(names)) / total
        here = {n: shares[n] for n in names if n in shares and natural[names.index(n)] > 0}
        rest = 1 - sum(natural[i] for i, n in enumerate(names) if n not in shares)
        scale = rest / sum(here.values()) if here else 0
        want = np.array([here[n] * scale if n in here else natural[i] for i, n in enumerate(names)])
        margins.append((at, want * total * fraction))
    p = np.full(len(tokens), fraction)
    for _ in range(ROUNDS):
        before = p.copy()
        for at, want in margins:
            mass = np.bincount(at, p * tokens, len(want))
            p = np.minimum(1, p * np.where(mass > 0, want / np.maximum(mass, 1e-300), 1)[at])
        if np.abs(p - before).max() < TOLERANCE:
            break
    return p


def mix(docs: DataFrame, targets: dict | None = None, fraction: float = FRACTION, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None) -> DataFrame:
    """Per row: id, source, lang, topic, n_tokens, weight, prob, draw, selected.

    ``n_tokens`` counts words, or is the column ``tokens_col`` (what ``token_counts`` found, say; null: 0).
    Topics are clusters of hashed words, fitted on all rows. Token weights are raked to the source, language and topic shares of
    ``targets``; ``prob`` is the cell's calibrated probability, ``weight`` its inverse, ``draw`` a
    hash of the id in [0, 1), and a row is ``selected`` if draw < prob: the same rows at every run,
    each on its own. Values that the targets don't name, and nulls, fall under "other"; so there are
    at most (21 x 5 x 9) cells by default, however many rows or sources, and only their sums come to
    the driver. Null texts are empty (no tokens), null ids draw by the text, repeated rows draw
    alike; an empty table gives no rows. ``source`` and ``lang`` may be missing; other columns are
    not read.
    """
    rows, keys = _raked(docs, targets or TARGETS, fraction, seed, id_col, text_col, False, tokens_col)
    return rows.select(
        F.col(id_col),
        *keys,
        "n_tokens",
        F.when(F.col("prob") > 0, 1 / F.col("prob")).alias("weight"),
        "prob",
        "draw",
        (F.col("draw") < F.col("prob")).alias("selected"),
    )


def margins(mixed: DataFrame, keys: tuple[str, ...] = ("source", "lang", "topic")) -> DataFrame:
    """How well a mix meets its margins: per margin and category the share of all tokens, of the expected and of the drawn sample."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("margin"), F.col(k).alias("category")) for k in keys])).alias("m")
    drawn = F.when(F.col("selected"), F.col("n_tokens")).otherwise(0)
    sums = mixed.select(cells, "n_tokens", (F.col("n_tokens") * F.col("prob")).alias("hoped"), drawn.alias("drawn")).groupBy("m.margin", "m.category")
    sums = sums.agg(F.sum("n_tokens").alias("natural"), F.sum("hoped").alias("expected"), F.sum("drawn").alias("drawn"))
    whole = Window.partitionBy("margin")  # a row for each category
    return sums.select("margin", "category", *[F.try_divide(c, F.sum(c).over(whole)).alias(c) for c in ("natural", "expected", "drawn")])


def mixture(docs: DataFrame, targets: dict | None = None, fraction: float = FRACTION, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that ``mix`` selects; no text is shuffled."""
    rows, _ = _raked(docs, targets or TARGETS, fraction, seed, id_col, text_col, True, tokens_col)
    return rows.where(F.col("draw") < F.col("prob")).select(*[F.col(f"doc.`{c}`") for c in docs.columns])


@F.arrow_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("counts", T.BinaryType())]))
def measured(texts: pa.Array) -> pa.Array:
    """Words of each text, and its buckets and counts as ``packed`` has them."""
    n, sizes, found = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], []

    def count(held: list[bytes]) -> None:
        words, size, at, many = texts_counts(held)
        n.append(words)
        sizes.append(size)
        found.append(packed(at, many))

    held, size = [], 0
    for a in range(0, len(texts), ROWS):
        for text in texts.slice(a, ROWS).to_pylist():
            held.append(only_words(text or ""))
            size += len(held[-1])
            if size >= COUNTED:
                count(held)
                held, size = [], 0
    count(held)
    ends = 8 * np.cumsum(np.concatenate(sizes))
    counts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(found))])
    return pa.StructArray.from_arrays([pa.array(np.concatenate(n), pa.int64()), counts.cast(pa.binary())], ["n", "counts"])


def _raked(docs: DataFrame, targets: dict, fraction: float, seed: int, id_col: str, text_col: str, whole: bool, tokens_col: str | None) -> tuple[DataFrame, list[str]]:
    """Id (and, if ``whole``, the row as ``doc``), margins, n_tokens, draw and prob of each row."""

    def margin(name: str):
        value = F.col(name).cast("string") if name in docs.columns else F.lit(None).cast("string")
        return F.when(value.isin(list(targets[name])), value).otherwise("other").alias(name)

    text = F.col(text_col).cast("string")
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), name), 11) / F.lit(float(1 << 53))
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    given = [F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)).alias("given")] if tokens_col else []
    rows = docs.select(F.col(id_col), margin("source"), margin("lang"), draw.alias("draw"), F.xxhash64(name).alias("h"), measured(text).alias("of"), *given, *[doc] * whole)
    n_tokens = "given" if tokens_col else "of.n"
    rows = stage(rows.select(id_col, "source", "lang", "draw", "h", F.col(n_tokens).alias("n_tokens"), F.col("of.counts").alias("counts"), *["doc"] * whole), ROWS)
    topics = fit_topics(rows.select("h", "lang", "counts"))
    shared = docs.sparkSession.sparkContext.broadcast(topics)  # of fixed size

    @F.arrow_udf("string")
    def topic(counts: pa.Array, langs: pa.Array) -> pa.Array:
        found: list[str] = []
        for a in range(0, len(counts), ROWS):
            found += shared.value.named(*unpacked(counts.slice(a, ROWS)), langs.slice(a, ROWS).to_pylist())
        return pa.array(found, pa.string())

    rows = rows.withColumn("topic", topic("counts", "lang")).drop("counts", "h")
    rows = rows if whole else stage(rows, ROWS)  # whole rows aren't written once more; for them the topics are found twice
    keys = ["source", "lang", "topic"]
    with at_once(docs.sparkSession, ROWS):
        cells = sorted(rows.groupBy(*keys).agg(F.sum("n_tokens").alias("n")).collect())
    prob = rake(np.array([r.n for r in cells], np.float64), [tuple(r[:3]) for r in cells], {k: targets[k] for k in keys}, fraction)
    table = docs.sparkSession.createDataFrame([(*r[:3], float(p)) for r, p in zip(cells, prob, strict=True)], "source string, lang string, topic string, prob double")
    return rows.join(F.broadcast(table), keys), keys  # as many rows as the targets have cells, at most
