"""Toxicity: a small convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import sliced, stage

#: Texts that are trained on together, and characters after which a block ends; what follows makes a further block. No row is left out.
BLOCK_TEXTS, BLOCK_CHARS = 3000, 30_000_000
#: Only for fits on a sample (``per_class``): characters of each class after which no further row is taken.
SAMPLE_CHARS = 30_000_000
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
WIDTHS = (1, 2, 3)
FILTERS, DIM = 8, 8
#: A word is embedded as the sum of its own hashed vector and those of its heads of these lengths.
HEADS = (3, 4, 5, 6)
#: Bytes that the words' hashes take side by side; the rest of longer words is hashed word by word.
LONG = 32
#: Numbers that features are hashed to, so that a model's size doesn't follow the table's; those seen in fewer texts have the zero vector.
BUCKETS, LEAST_TEXTS = 1 << 18, 3
#: Sums over blocks are of whole numbers, so many to 1, and so don't depend on their order; logits are counted in steps of 1 / STEPS.
WHOLE, STEPS = 1 << 24, 256
#: Words of 64 bits that hashes of the labelled ids are noted in; they only spare texts the way to the join.
SLOTS = 1 << 16
EPOCHS, BATCH = 4, 32
#: Words that a worker remembers before it starts anew.
MEMO_WORDS = 150_000
#: New words whose vectors are summed at once.
NEW_WORDS = 20_000

WORD = re.compile(r"[^\W\d_]+")


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC = _crc_table()


def features(words: list[str]) -> np.ndarray:
    """A row for each word: hashed numbers (from 1; CRC-32) of its heads (in bytes), 0 for a head that it lacks, and of the word."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    sizes = np.array([len(b) for b in raw], np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint8)
    starts = np.cumsum(sizes) - sizes
    out = np.zeros((len(raw), len(HEADS) + 1), np.int64)
    state = np.full(len(raw), ~zlib.crc32(b"^") & 0xFFFFFFFF, np.uint32)
    at = np.arange(len(raw))
    for k in range(LONG):
        at = at[sizes[at] > k]
        if not len(at):
            break
        c = state[at]
        c = CRC[(c ^ flat[starts[at] + k]) & 255] ^ c >> 8
        state[at] = c
        if k + 1 in HEADS:
            out[at, HEADS.index(k + 1)] = ~c % BUCKETS + 1
    for i in np.flatnonzero(sizes > LONG):
        state[i] = ~zlib.crc32(raw[i][LONG:], int(~state[i])) & 0xFFFFFFFF
    out[:, -1] = ~(CRC[(state ^ ord("$")) & 255] ^ state >> 8) % BUCKETS + 1
    return out


@dataclass
class Model:
    """keys: sorted feature numbers with a vector in table[1:]; table[0] is zero, for all others."""

    keys: np.ndarray
    table: np.ndarray
    filters: list[np.ndarray]  # a width's weights: (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    shift: float
    thresholds: dict = field(default_factory=dict)

    def rows(self) -> np.ndarray:
        """Row of the table for each feature number."""
        rows = np.zeros(BUCKETS + 1, np.int64)
        rows[self.keys] = np.arange(1, len(self.keys) + 1)
        return rows

    def pooled(self, proj: np.ndarray, ids: np.ndarray, owner: np.ndarray, n: int, places: bool = False):
        """Largest response of each filter in each text, from the words' projections (a row for each column of ``columns``); ``places``: where it was, too."""
        best = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
        where = np.zeros(best.shape, np.int64)
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        sizes = np.diff(np.append(starts, len(ids)))
        ends = starts + sizes
        blanks = np.concatenate([ends - 2, ends - 1])  # filters there would see the next text
        row = 0
        for k, w in enumerate(WIDTHS):
            for f in range(k * FILTERS, (k + 1) * FILTERS):
                resp = proj[row][ids]
                for j in range(1, w):
                    resp[:-j] += proj[row + j][ids[j:]]
                row += w
                resp[blanks] = 0
                best[:, f] = np.maximum.reduceat(resp, starts)
                if places:
                    at = np.flatnonzero(resp == np.repeat(best[:, f], sizes))[::-1]
                    where[owner[at], f] = at  # the first of equal ones
        if places:
            where = np.where(where >= (ends - 2)[:, None], len(ids), where)  # nothing but blanks from there on
        return best, where

    def columns(self) -> np.ndarray:
        """Weights (DIM, n) of all places of all filters, filter by filter."""
        return np.concatenate([w.transpose(1, 2, 0).reshape(DIM, -1) for w in self.filters], 1)

    def logits(self, best: np.ndarray) -> np.ndarray:
        return np.maximum(best + self.bias, 0) @ self.out + self.shift

    def scores(self, texts: list[str]) -> np.ndarray:
        words = self.words
        if not texts:
            return np.zeros(0)
        ids, owner = words.encode(texts)
        best, _ = self.pooled(words.projections(), ids, owner, len(texts))
        return 1 / (1 + np.exp(-np.clip(self.logits(best), -30, 30)))

    @property
    def words(self) -> Words:
        """Word vectors met so far, started anew when they are too many."""
        if "_words" not in self.__dict__ or len(self._words) > MEMO_WORDS:
            self._words = Words(self)
        return self._words


class Words(dict):
    """Number of each word, and the products of its vector with the filters' columns; number 0 is the zero vector."""

    def __init__(self, model: Model) -> None:
        self.rows, self.table, self.columns = model.rows(), model.table, model.columns()
        self.new: list[str] = []
        self.proj = np.zeros((self.columns.shape[1], 1024), np.float32)

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = number = len(self) + 1
        return number

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [], []
        for text in texts:
            found = [self[w] for w in WORD.findall(text.lower())]
            ids += found
            ids += (0, 0)
            sizes.append(len(found) + 2)
        return np.array(ids, np.int64), np.repeat(np.arange(len(texts)), sizes)

    def projections(self) -> np.ndarray:
        """Products of all words met, each word's computed alone: a text's score doesn't depend on those beside it."""
        if self.proj.shape[1] <= len(self):
            more = np.zeros((len(self.proj), len(self) + 1 + len(self) // 2), np.float32)
            more[:, : self.proj.shape[1]] = self.proj
            self.proj = more
        for a in range(0, len(self.new), NEW_WORDS):
            words = self.new[a : a + NEW_WORDS]
            at = len(self) + 1 - len(self.new) + a
            vectors = self.table[self.rows[features(words)]].sum(1).T
            for out, column in zip(self.proj, self.columns.T, strict=True):
                out[at : at + len(words)] = sum(x * c for x, c in zip(vectors, column, strict=True))
        self.new = []
        return self.proj


class Numbers(dict):
    """Number of each word, from 1."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self) + 1
        return number


def encode(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, and for each place the word's number (from 1) and its text; two blanks (0) end a text."""
    known = Numbers()
    ids: list[np.ndarray] = []
    for text in texts:
        ids.append(np.array([known[w] for w in WORD.findall(text.lower())] + [0, 0], np.int64))
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in ids])
    return list(known), np.concatenate(ids) if ids else np.zeros(0, np.int64), owner


def text_counts(names: np.ndarray, ids: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Texts, and texts labelled 1, that have each feature."""
    bounds = np.searchsorted(owner, np.arange(len(labels) + 1))
    counts = np.zeros((2, BUCKETS + 1))
    place = np.zeros(max(len(names), BUCKETS) + 1, np.int64)

    def distinct(x: np.ndarray) -> np.ndarray:
        own = np.arange(len(x))
        place[x] = own
        return x[place[x] == own]

    for a, b, y in zip(bounds[:-1], bounds[1:] - 2, labels, strict=True):
        seen = distinct(names[distinct(ids[a:b]) - 1].ravel())
        counts[0, seen] += 1
        counts[1, seen] += y
    return counts


def log_odds(count: np.ndarray, toxic: np.ndarray, n: int, n1: int) -> np.ndarray:
    """Smoothed log-odds of each feature; no number where too few texts have it."""
    odds = np.log((toxic + 1) / (n1 + 2)) - np.log((count - toxic + 1) / (n - n1 + 2))
    odds[0] = np.nan
    return np.where(count >= LEAST_TEXTS, odds, np.nan).astype(np.float32)


def beginning(odds: np.ndarray, keys: np.ndarray, seed: int = 7) -> Model:
    """The model before training: the same vectors for the same features, whatever others are there."""
    rng = np.random.default_rng(seed)
    table = np.vstack([np.zeros((1, DIM), np.float32), rng.normal(0, 0.02, (BUCKETS + 1, DIM)).astype(np.float32)[keys]])
    table[1:, 0] = odds[keys] / 4
    filters = []
    for w in WIDTHS:
        x = rng.normal(0, 0.1, (w, DIM, FILTERS))
        x[:, 0, : FILTERS // 2] += 1 / w
        filters.append(x.astype(np.float32))
    out = np.full(len(WIDTHS) * FILTERS, 0.05, np.float32)
    return Model(keys, table, filters, np.zeros_like(out), out, -1.0)


def train(texts: list[str], labels: np.ndarray, odds: np.ndarray | None = None, seed: int = 7) -> Model:
    """Fit embeddings, filters and output weights by mini-batch Adagrad through the max pooling.

    The vectors' first component starts at the smoothed log-odds of the hashed feature (``odds``: those
    of all rows, where the texts are one block of them), the rest at small random numbers.
    """
    vocab, ids, owner = encode(texts)
    hashes = features(vocab)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    if odds is None:
        odds = log_odds(*text_counts(hashes, ids, owner, labels), len(labels), labels.sum())
    keys = np.unique(hashes)
    model = beginning(odds, keys[~np.isnan(odds[keys])], seed)
    rng = np.random.default_rng(seed + 1)
    rows = np.vstack([np.zeros((1, hashes.shape[1]), np.int64), model.rows()[hashes]])
    state: dict = {}

    def adagrad(name: str, x: np.ndarray, g: np.ndarray, rate: float, at=...) -> None:
        s = state.setdefault(name, np.full(x.shape, 1e-2, np.float32))
        s[at] += g * g
        x[at] -= rate * g / np.sqrt(s[at])

    shift = np.array([model.shift], np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            docs = np.sort(order[a : a + BATCH])
            at = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in docs])
            words, local = np.unique(ids[at], return_inverse=True)
            vectors = model.table[rows[words]].sum(1)
            vectors[words == 0] = 0
            own = np.repeat(np.arange(len(docs)), bounds[docs + 1] - bounds[docs])
            zero = int(np.searchsorted(words, 0))
            best, where = model.pooled(np.ascontiguousarray((vectors @ model.columns()).T), local, own, len(docs), places=True)
            hidden = np.maximum(best + model.bias, 0)
            model.shift = float(shift[0])
            p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.shift, -30, 30)))
            err = ((p - labels[docs]) / len(docs)).astype(np.float32)
            gh = err[:, None] * model.out[None] * (hidden > 0)
            pad = np.append(local, [zero] * max(WIDTHS))
            gvec = np.zeros_like(vectors)
            for k, w in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                g = gh[:, cols]
                gw = np.zeros_like(model.filters[k])
                for j in range(w):
                    v = pad[where[:, cols] + j]
                    gw[j] = np.einsum("nf,nfd->df", g, vectors[v])
                    np.add.at(gvec, v.ravel(), (g[:, :, None] * model.filters[k][j].T[None]).reshape(-1, DIM))
                adagrad(f"w{k}", model.filters[k], gw, 0.02)
            touched = np.flatnonzero(np.abs(gvec).sum(1))
            touched = touched[words[touched] > 0]
            if len(touched):
                r = rows[words[touched]]
                u, back = np.unique(r.ravel(), return_inverse=True)
                gt = np.zeros((len(u), DIM), np.float32)
                np.add.at(gt, back, np.repeat(gvec[touched], r.shape[1], 0))
                gt[u == 0] = 0
                adagrad("t", model.table, gt, 0.01, u)
            adagrad("b", model.bias, gh.sum(0), 0.02)
            adagrad("o", model.out, hidden.T @ err, 0.05)
            adagrad("s", shift, err.sum(keepdims=True), 0.05)
    model.shift = float(shift[0])
    model.__dict__.pop("_words", None)
    return model


def best_threshold(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """Middle of the widest-apart cut with the least weighted error; 0.5 where a class is missing."""
    if not len(scores) or labels.min() == labels.max():
        return 0.5
    order = np.argsort(scores)
    s, y, w = scores[order], labels[order], weights[order]
    error = np.concatenate([[((1 - y) * w).sum()], ((1 - y) * w).sum() + np.cumsum(np.where(y == 1, w, -w))])
    error[1:-1][s[1:] == s[:-1]] = np.inf  # no cut parts equal scores
    edges = np.concatenate([[0.0], (s[1:] + s[:-1]) / 2, [1.0]])
    gaps = np.concatenate([[0.0], np.diff(s), [0.0]])
    good = np.flatnonzero(error <= error.min() + 1e-12)
    return float(edges[good[gaps[good].argmax()]])


def fold(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, per_class: int | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang") -> Model | None:
    """A model from all labelled texts but those of the held-out fold; None where a class has no row.

    Rows are dealt to blocks by their id's hash. Features are counted over all rows; from these log-odds
    every block trains on its rows, and the model is the mean of the blocks' (a vector's: of those
    that moved it). One fold isn't trained on but calibrates, with all its rows: first the common cut, which is moved to
    score 0.5, then a threshold for each language. Of several texts of one id the first in order counts.
    Only sums of fixed size and counts of scores reach the driver. ``per_class``: for trials, at most so
    many rows of each class, trained on by the driver.
    """
    marks = labels.where(f"{id_col} is not null and {label_col} is not null").where(fold(id_col) != HELD_OUT)
    marks = marks.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), lang.alias("lang"))
    if per_class:
        marks = _sample(rows, marks, per_class)
    rows = stage(_labelled(rows, marks))
    n = {(r.inner, r.y): r.n for r in rows.groupBy("inner", "y").agg(F.count("*").alias("n")).collect()}
    if not all(n.get((True, y), 0) + n.get((False, y), 0) for y in (0, 1)):
        return None
    enough = min(n.get((False, y), 0) for y in (0, 1)) >= 5
    use, cal = (rows.where("inner"), rows.where("not inner")) if enough else (rows, rows)
    n1, n0 = (n.get((True, y), 0) + (0 if enough else n.get((False, y), 0)) for y in (1, 0))
    if per_class:
        got = sorted(use.collect(), key=lambda r: r.id)
        model = train([r.text for r in got], np.array([r.y for r in got], np.float64))
    else:
        model = _trained(use, _counted(use, n1 + n0, n1))
    return _calibrated(model, cal)


def _labelled(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows (block, id, y, inner, text, lang) of the labelled ids, a file for each block and by id in it."""
    blocks = max(1, -(-marks.count() // BLOCK_TEXTS))
    hashed = F.xxhash64(F.col("id").cast("string"))
    slot, bit = F.pmod(F.shiftright(hashed, 6), F.lit(SLOTS)), hashed.bitwiseAND(F.lit(63)).cast("int")
    masks = marks.select(slot.alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("one")).groupBy("slot").agg(F.bit_or("one").alias("held"))
    rows = rows.where(fold("id") != HELD_OUT).withColumn("slot", slot).withColumn("bit", bit).join(F.broadcast(masks), "slot")  # fixed size
    rows = rows.where(F.getbit("held", "bit") == 1).select("id", "text", "lang")
    rows = rows.repartition(blocks, "id").join(marks.repartition(blocks, "id"), "id").groupBy("id", "y").agg(F.min(F.struct("text", "lang")).alias("first"))
    rows = rows.select(F.spark_partition_id().alias("block"), "id", "y", (fold("id") != CALIBRATION).alias("inner"), "first.text", "first.lang")
    return rows.sortWithinPartitions("id")


def _sample(rows: DataFrame, marks: DataFrame, per_class: int) -> DataFrame:
    """The marks of least hash that have a row, until a class has ``SAMPLE_CHARS`` characters; each row is taken whole."""
    marks = marks.join(rows.groupBy("id").agg(F.max(F.length("text")).alias("n")), "id")
    chosen = [marks.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    earlier = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, -1)  # over the chosen few
    chosen = chosen[0].unionAll(chosen[1]).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return chosen.where(F.col("before") < SAMPLE_CHARS).select("id", "y")


def _counted(rows: DataFrame, n: int, n1: int) -> np.ndarray:
    """Log-odds of each feature over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS + 1))
        for batch in batches:
            texts, y = batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(np.float64)
            for part in _by_size(texts):
                vocab, ids, owner = encode([texts[i] for i in part])
                total += text_counts(features(vocab), ids, owner, y[part])
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(x[at].astype(np.int64)) for x in total)], ["key", "count", "toxic"])

    got = rows.select("text", "y").mapInArrow(count, "key long, count long, toxic long").groupBy("key").agg(F.sum("count").alias("count"), F.sum("toxic").alias("toxic")).toArrow()
    total = np.zeros((2, BUCKETS + 1))
    total[:, got.column("key").to_numpy()] = got.column("count").to_numpy(), got.column("toxic").to_numpy()
    return log_odds(*total, n, n1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(block, text, ...) rows in a row that are of one block, cut where they have too many characters."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (row[0] != held[0][0] or size >= BLOCK_CHARS):
                yield held
                held, size = [], 0
            held.append(row)
            size += len(row[1])
    if held:
        yield held


def _trained(rows: DataFrame, odds: np.ndarray) -> Model:
    """The mean of what the blocks make of the common beginning."""
    shared = rows.sparkSession.sparkContext.broadcast(odds)  # of fixed size
    places = [f"d{k}" for k in range(DIM)]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            model = train([r[1] for r in block], np.array([r[2] for r in block], np.float64), shared.value)
            first = beginning(shared.value, model.keys)
            moved = np.rint((model.table[1:].astype(np.float64) - first.table[1:]) * WHOLE).astype(np.int64)
            at = np.flatnonzero(moved.any(1))
            rest = np.rint((_flat(model) - _flat(first)) * WHOLE).astype(np.int64).reshape(-1, DIM)
            keys = np.concatenate([model.keys[at], BUCKETS + 1 + np.arange(len(rest))])
            sums = np.concatenate([moved[at], rest])
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.ascontiguousarray(x)) for x in sums.T)], ["key", *places])

    sums = rows.select("block", "text", "y").mapInArrow(apply, f"key long, {', '.join(f'{c} long' for c in places)}")
    sums = sums.groupBy("key").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in places]).orderBy("key").toArrow()
    keys, n = sums.column("key").to_numpy(), sums.column("n").to_numpy()
    mean = np.stack([sums.column(c).to_numpy() for c in places], 1) / n[:, None] / WHOLE
    model = beginning(odds, np.flatnonzero(~np.isnan(odds)))
    vectors = keys <= BUCKETS
    model.table[np.searchsorted(model.keys, keys[vectors]) + 1] += mean[vectors].astype(np.float32)
    flat, at = (_flat(model) + mean[~vectors].ravel()).astype(np.float32), 0
    for x in (*model.filters, model.bias, model.out):
        x[...] = flat[at : at + x.size].reshape(x.shape)
        at += x.size
    model.shift = float(flat[at])
    return model


def _flat(model: Model) -> np.ndarray:
    """Filters, bias, output weights and shift in a row, filled up with zeros to whole vectors."""
    flat = np.concatenate([*(w.ravel() for w in model.filters), model.bias, model.out, [model.shift]]).astype(np.float64)
    return np.append(flat, np.zeros(-len(flat) % DIM))


def _calibrated(model: Model, rows: DataFrame) -> Model:
    """The model with its cut at score 0.5 and thresholds by language, from counts of all rows' logits in steps."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.clip(_scores(shared.value, batch.column(0).to_pylist()), 1e-12, 1 - 1e-12)
            step = np.floor(np.log(score / (1 - score)) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(step), batch.column(1), batch.column(2)], ["step", "y", "lang"])

    got = rows.select("text", "y", "lang").mapInArrow(apply, "step long, y int, lang string").groupBy("step", "y", "lang").agg(F.count("*").alias("n")).orderBy("step", "y", "lang").collect()
    shared.unpersist()
    logit, y, n = (np.array([f(r) for r in got], np.float64) for f in (lambda r: (r.step + 0.5) / STEPS, lambda r: r.y, lambda r: r.n))
    cut = min(max(best_threshold(1 / (1 + np.exp(-logit)), y, n), 1e-6), 1 - 1e-6)
    model.shift -= float(np.log(cut / (1 - cut)))
    s = 1 / (1 + np.exp(-logit + np.log(cut / (1 - cut))))
    langs = np.array([str(r.lang) for r in got])
    for name in np.unique(langs):
        mine = langs == name
        if min((y * n)[mine].sum(), ((1 - y) * n)[mine].sum()) >= 5:
            t = best_threshold(s[mine], y[mine], n[mine])
            right = [(((s[mine] >= x) == y[mine]) * n[mine]).sum() for x in (0.5, t)]
            model.thresholds[str(name)] = 0.5 if right[0] >= right[1] else t
    return model


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, held_out, score (0 to 1), predicted (score >= 0.5), threshold, rejected.

    ``rejected``: the score reaches the language's calibrated threshold (0.5 where a language has
    none); the language chooses a threshold and never changes a score. Null texts count as empty,
    null ids fall in a fold like an empty id, repeated rows each give a row; without labelled rows of
    both classes every score is 0. Columns but id, text and language are not read.
    """
    spark = docs.sparkSession
    model = fit(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col)
    if model:
        model.__dict__.pop("_words", None)
    shared = spark.sparkContext.broadcast(model)  # of fixed size

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            score = _scores(shared.value, rows.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(score, pa.float64())], ["id", "lang", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    out = rows.mapInArrow(apply, f"id {kind}, lang string, score double")
    limit = F.lit(0.5)
    for name, t in (model.thresholds if model else {}).items():
        limit = F.when(F.col("lang") == name, F.lit(t)).otherwise(limit)
    return out.select(
        F.col("id").alias(id_col),
        (fold("id") == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        limit.alias("threshold"),
        (F.col("score") >= limit).alias("rejected"),
    )


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, that ``toxicity`` doesn't reject. Rows are judged where they are: nothing is joined or shuffled."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col)
    if model:
        model.__dict__.pop("_words", None)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = shared.value.thresholds if shared.value else {}
        for rows in sliced(batches):
            score = _scores(shared.value, rows.column(text_col).to_pylist())
            langs = rows.column(lang_col).to_pylist() if lang_col in rows.schema.names else [None] * len(score)
            yield rows.filter(pa.array(score < np.array([limits.get(str(x), 0.5) if x is not None else 0.5 for x in langs])))

    return docs.mapInArrow(apply, docs.schema)


def _scores(model: Model | None, texts: list[str | None]) -> np.ndarray:
    texts = [x or "" for x in texts]
    score = np.zeros(len(texts))
    for part in _by_size(texts) if model else ():
        score[part] = model.scores([texts[i] for i in part])
    return score


def _by_size(texts: list[str], most: int = 1_000_000) -> Iterator[list[int]]:
    """Numbers of the texts in groups of about ``most`` characters."""
    part, size = [], 0
    for i, text in enumerate(texts):
        part.append(i)
        size += len(text)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part
