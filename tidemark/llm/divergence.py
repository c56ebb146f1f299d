"""Source divergence audit: terms counted in byte tries that merge, then walked in UTF-8 order."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stage

#: Terms are runs of letters A-Z, a-z and bytes of other characters; every other byte becomes a space, A-Z lower case.
FOLD = np.array([c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)], dtype=np.uint8)
#: Leaves held in a task before its tries are handed on.
HELD = 300_000
#: Bytes of text whose terms are counted at once (one longer text is a block of its own).
BLOCK = 8 << 20
#: Leaves of a merged trie before all but the last are handed on.
OPEN = 20_000
#: Scale of probabilities, and what is added to every count.
SCALE, ADDED = 1_000_000_000, 2
#: Cells (terms x sources) worked on at once.
CELLS = 1 << 21


class Trie:
    """Radix trie over bytes, four at a step, with documents and counts per source at its leaves.

    A node maps four bytes to the node below them, and what is left of a term (up to three bytes) to the term's leaf:
    an index into the counters, which are kept as arrays and summed when the trie is walked or has grown.
    """

    def __init__(self) -> None:
        self.root: dict = {}
        self.size = 0
        self.held = 0  # counters held, also of equal (leaf, source)
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []
        self.counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def leaf(self, key: bytes) -> int:
        node, end = self.root, len(key) & ~3
        for at in range(0, end, 4):
            step = key[at : at + 4]
            below = node.get(step)
            if below is None:
                below = node[step] = {}
            node = below
        rest = key[end:]
        found = node.get(rest)
        if found is None:
            found = node[rest] = self.size
            self.size += 1
        return found

    def leaves(self, keys: list[bytes]) -> np.ndarray:
        leaf = self.leaf
        return np.fromiter((leaf(k) for k in keys), dtype=np.int64, count=len(keys))

    def add(self, leaves: np.ndarray, docs: np.ndarray) -> None:
        self.docs.append((leaves, docs))

    def add_counts(self, leaves: np.ndarray, sources: np.ndarray, counts: np.ndarray) -> None:
        self.held += len(leaves)
        self.counts.append((leaves, sources, counts))

    def merge(self, other: Trie) -> None:
        """Take over the leaves and counters of ``other``; sources have the same numbers in both."""
        keys, order = other.walk()
        here = np.zeros(other.size, dtype=np.int64)
        here[order] = self.leaves(keys)
        self.docs += [(here[x], n) for x, n in other.docs]
        self.counts += [(here[x], s, n) for x, s, n in other.counts]
        self.held += other.held

    def settle(self, n_sources: int) -> None:
        """Sum counters of equal (leaf, source)."""
        key, back = np.unique(np.concatenate([x * n_sources + s for x, s, _ in self.counts]), return_inverse=True)
        total = np.zeros(len(key), dtype=np.int64)
        np.add.at(total, back, np.concatenate([n for _, _, n in self.counts]))
        docs = np.zeros(self.size, dtype=np.int64)
        for x, n in self.docs:
            np.add.at(docs, x, n)
        self.counts, self.docs, self.held = [(key // n_sources, key % n_sources, total)], [(np.arange(self.size), docs)], len(key)

    def walk(self) -> tuple[list[bytes], np.ndarray]:
        """Terms and their leaves in byte order, which is the order of UTF-8."""
        keys, order, path = [], [], [(b"", self.root)]
        while path:
            prefix, node = path.pop()
            if isinstance(node, int):
                keys.append(prefix)
                order.append(node)
            elif len(node) == 1:
                ((step, below),) = node.items()
                path.append((prefix + step, below))
            else:
                path.extend((prefix + step, node[step]) for step in sorted(node, reverse=True))
        return keys, np.array(order, dtype=np.int64)

    def sums(self, n_sources: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms in byte order, their documents, where each one's counters end, and sources and counts of those."""
        keys, order = self.walk()
        rank = np.empty(self.size, dtype=np.int64)
        rank[order] = np.arange(self.size)
        docs = np.zeros(self.size, dtype=np.int64)
        for x, n in self.docs:
            np.add.at(docs, rank[x], n)
        key = np.concatenate([rank[x] * n_sources + s for x, s, _ in self.counts])
        by = np.argsort(key, kind="stable")
        key, n = key[by], np.concatenate([n for _, _, n in self.counts])[by]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key = key[first]
        return keys, docs, np.searchsorted(key // n_sources, np.arange(1, self.size + 1)), key % n_sources, np.add.reduceat(n, first)


LEAVES = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
LEAVES_DDL = "lang string, term binary, docs long, sources array<string>, counts array<long>"


class Names:
    """Numbers of names in the order they are first seen."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}

    def of(self, names: list[str]) -> np.ndarray:
        number = self.number
        return np.fromiter((number.setdefault(x, len(number)) for x in names), dtype=np.int64, count=len(names))


def _rows(lang: str, trie: Trie, sources: Names, least: int = 0) -> Iterator[pa.RecordBatch]:
    """The trie's leaves in byte order."""
    if not trie.size:
        return
    keys, docs, ends, source, count = trie.sums(len(sources.number))
    lists = [pa.array(list(sources.number)).take(pa.array(source)), pa.array(count)]
    at = pa.array(np.concatenate([[0], ends]), type=pa.int32())
    columns = [pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.binary()), pa.array(docs), *(pa.ListArray.from_arrays(at, x) for x in lists)]
    batch = pa.RecordBatch.from_arrays(columns, schema=LEAVES)
    if least:
        batch = batch.filter(pa.array(docs >= least))
    for k in range(0, batch.num_rows, 8192):
        yield batch.slice(k, 8192)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(number of each term, terms by number, place of its text) over all terms of binary ``texts``, in order."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    begin, end = int(offsets[0]), int(offsets[-1])
    if begin == end:
        return np.empty(0, dtype=np.int64), [], np.empty(0, dtype=np.int64)
    data = FOLD[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[begin:end]]
    word = data != 32
    starts = offsets[:-1] - begin
    cut = np.zeros(len(data) + 1, dtype=bool)  # a text's first byte begins a term whatever is before it
    cut[starts] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | cut[1:-1]
    at = np.flatnonzero(first)
    if not len(at):
        return np.empty(0, dtype=np.int64), [], np.empty(0, dtype=np.int64)
    size = np.add.reduceat(word, at, dtype=np.int32)
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data[word])])
    coded = terms.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist(), np.searchsorted(starts, at, side="right") - 1


def _count(held: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tries of a task's texts, one a language, as rows in byte order; handed on whenever ``held`` leaves are held."""
        tries: dict[str, Trie] = defaultdict(Trie)
        sources = Names()

        def take(lang: list[str], source: list[str], texts: pa.Array) -> None:
            code, names, text = terms_of(texts)
            langs = Names()
            of_text, from_text = langs.of(lang), sources.of(source)
            n, m = max(len(names), 1), len(sources.number)
            where, times = np.unique((of_text[text] * n + code) * m + from_text[text], return_counts=True)
            once = np.unique(text * n + code)  # a document's terms, each once
            term, docs = np.unique(of_text[once // n] * n + once % n, return_counts=True)
            for name, k in langs.number.items():
                low, high = np.searchsorted(term, [k * n, (k + 1) * n])
                if low == high:
                    continue
                trie = tries[name]
                own = term[low:high] - k * n
                leaf = np.zeros(n, dtype=np.int64)
                leaf[own] = trie.leaves([names[c] for c in own.tolist()])
                trie.add(leaf[own], docs[low:high])
                low, high = np.searchsorted(where, [k * n * m, (k + 1) * n * m])
                own = where[low:high] - k * n * m
                trie.add_counts(leaf[own // m], own % m, times[low:high])

        def hand_on() -> Iterator[pa.RecordBatch]:
            for lang, trie in tries.items():
                yield from _rows(lang, trie, sources)
            tries.clear()

        for batch in batches:
            lang, source, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
            k = 0
            while k < len(ends):  # texts up to a block's bytes, one at least
                behind = max(int(np.searchsorted(ends, (ends[k - 1] if k else 0) + block, side="right")), k + 1)
                take(lang[k:behind], source[k:behind], texts.slice(k, behind - k))
                k = behind
                if sum(t.size for t in tries.values()) >= held or sum(t.held for t in tries.values()) >= 8 * held:
                    yield from hand_on()
        yield from hand_on()

    return run


def _merge(least: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leaves of one range of (language, term), in order, merged into tries; only the last leaf can still grow."""
        lang, trie, sources, last = None, Trie(), Names(), b""
        for batch in batches:
            names = batch.column(0)
            k = 0
            while k < batch.num_rows:  # a stretch of one language
                name = names[k].as_py()
                same = np.flatnonzero(pc.not_equal(names.slice(k), name).to_numpy(zero_copy_only=False))
                part = batch.slice(k, int(same[0]) if len(same) else batch.num_rows - k)
                k += part.num_rows
                if name != lang:
                    yield from _rows(lang, trie, sources, least)
                    lang, trie = name, Trie()
                keys = part.column(1).to_pylist()
                if trie.size > most and keys[0] != last:
                    yield from _rows(lang, trie, sources, least)
                    trie = Trie()
                last = keys[-1]
                leaf = trie.leaves(keys)
                trie.add(leaf, part.column(2).to_numpy())
                width = pc.list_value_length(part.column(3)).to_numpy()
                coded = part.column(3).flatten().dictionary_encode()
                number = sources.of(coded.dictionary.to_pylist())
                trie.add_counts(np.repeat(leaf, width), number[coded.indices.to_numpy()], part.column(4).flatten().to_numpy())
                if trie.held > 100 * most:  # a very frequent term comes from every task
                    trie.settle(len(sources.number))
        yield from _rows(lang, trie, sources, least)

    return run


def term_counts(docs: DataFrame, min_docs: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, term, docs, sources, counts) of every term in at least ``min_docs`` documents of its language.

    Each task's tries leave it as rows in byte order. They are dealt by ranges of (language, term), so that a task
    merges one stretch of the tries, sorted on the way; a merged trie is handed on once it has ``OPEN`` leaves (where no leaf is still growing).
    Memory is bounded whatever the vocabulary, and a hot language or source is spread over as many ranges as its terms take.
    """
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col, text_col)]
    fields = [x.alias(n) for x, n in zip([*fields[:2], fields[2].cast("binary")], ("lang", "source", "text"))]
    tries = stage(docs.select(*fields).mapInArrow(_count(HELD, BLOCK), LEAVES_DDL))
    return stage(tries.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_merge(min_docs, OPEN), LEAVES_DDL))


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + ADDED) / total), exact for totals up to 9e15: long division, three digits at a time."""
    rest, out = counts + ADDED, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        digit = rest // total
        out, rest = out * 1000 + digit, rest - digit * total
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = p - q
    return gap * gap // (p + q)


PARTS_DDL = "lang string, source string, part string, item string, value long"
PARTS = pa.schema([(x, pa.string()) for x in ("lang", "source", "part", "item")] + [("value", pa.int64())])


def _audit(groups: dict[str, tuple[list[str], list[int], int]], top: int, cells: int):
    """Sums per pair of sources and best candidates per source over a task's share of the merged tries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, best = {}, {}

        def work(lang: str, leaves: list) -> None:
            sources, totals, _ = groups[lang]
            place = {s: k for k, s in enumerate(sources)}
            count = np.zeros((len(leaves), len(sources)), dtype=np.int64)
            for k, (_, own, n) in enumerate(leaves):
                count[k, [place[s] for s in own]] = n
            p = shares(count, np.array(totals, dtype=np.int64))
            if lang not in sums:
                sums[lang] = np.zeros((len(sources), len(sources)), dtype=np.int64)
                best[lang] = [[] for _ in sources]
            q = shares(count.sum(1), np.int64(groups[lang][2]))
            for a in range(len(sources)):
                sums[lang][a, a + 1 :] += distance(p[:, a : a + 1], p[:, a + 1 :]).sum(0)
                (rows,) = np.nonzero((count[:, a] > 0) & (p[:, a] > q))
                value = distance(p[rows, a], q[rows])
                order = np.argsort(-value, kind="stable")[:top]  # leaves come in byte order: the first of equals is the least
                best[lang][a] = sorted(best[lang][a] + [(-int(value[k]), leaves[rows[k]][0]) for k in order])[:top]

        held = defaultdict(list)
        for batch in batches:
            for lang, term, _, own, n in zip(*(batch.column(k).to_pylist() for k in range(5))):
                held[lang].append((term, own, n))
                if len(held[lang]) * len(groups[lang][0]) >= cells:
                    work(lang, held.pop(lang))
        for lang, leaves in held.items():
            work(lang, leaves)
        for lang, matrix in sums.items():
            names = groups[lang][0]
            for a, name in enumerate(names):
                # both directions of what was summed once
                rows = [(lang, name, "pair", names[b], int(matrix[min(a, b), max(a, b)])) for b in range(len(names)) if b != a]
                rows += [(lang, name, "term", term.decode("utf-8", "replace"), -value) for value, term in best[lang][a]]
                if rows:
                    yield pa.record_batch([list(c) for c in zip(*rows)], schema=PARTS)

    return run


def source_divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """How the sources of each language differ in their terms: lang, source, part, item, value, rank.

    Part ``pair``: the distance to each other source of the language, summed over all kept terms. Part ``term``: the
    ``top`` terms that the source has more of than its language, by their share of the distance. All values are exact
    integers; equal values rank by the item's UTF-8 bytes.

    Kept terms have at least ``min_docs`` documents in their language. Null texts, languages and sources are empty
    strings; a source without terms still has its pairs (and others theirs with it); with no kept term all pairs
    are 0. Repeated rows count as documents of their own. Texts are read whole, a term of any length is one leaf.
    Other columns aren't read; an empty table gives no rows. The driver holds one total for each (language, source),
    fewer rows than the report's pairs; a task holds 8 bytes for every pair of sources of its languages.
    """
    terms = term_counts(docs, min_docs, lang_col, source_col, text_col)
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    each = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    kept = terms.groupBy("lang").agg(F.count("*").alias("v"))
    totals = stage(named.join(each, ["lang", "source"], "left").join(kept, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")))
    groups: dict[str, tuple[list[str], list[int], int]] = {}
    rows = totals.orderBy("lang", "source").collect()
    for r in rows:
        names, sums, whole = groups.get(r.lang, ([], [], ADDED * r.v))
        groups[r.lang] = ([*names, r.source], [*sums, r.n + ADDED * r.v], whole + r.n)
    found = stage(terms.mapInArrow(_audit(groups, top, CELLS), PARTS_DDL))
    # every pair has its row, also where a language keeps no term
    other = totals.select("lang", F.col("source").alias("item"))
    none = totals.where("v = 0").join(other, "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).unionByName(none)
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(found.where("part = 'term'")).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
