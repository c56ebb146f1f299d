"""Benchmark decontamination by canonical templates with typed slots."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Template tokens of a window. Windows with fewer words that are no placeholder count on stricter evidence.
WINDOW = 8
LITERALS = 4
#: Words that an item with such windows needs to be found with other values, and tokens that it needs to be found at all.
SLOT_WORDS, SLOT_TOKENS = 2, 3
#: Share of an item's windows that a passage must have.
COVERAGE = 0.5
#: Bytes of benchmark text whose windows are broadcast at once; a larger benchmark is taken in blocks.
BLOCK_BYTES = 16_000_000

#: Units of measure recognised behind a number.
UNITS = frozenset(
    "mm cm m km ft yd mi mg g kg lb oz ml l sec second seconds min minute minutes h hour hours day days week weeks "
    "month months year years hz khz mhz ghz b kb mb gb tb v w kw pa bar kj cal kcal usd eur gbp dollar dollars "
    "euro euros cent cents percent meter meters metre metres kilometer kilometers gram grams kilogram kilograms liter liters mile miles".split()
)

#: Numbers in words ("one" is as often a pronoun, and stays a word).
NUMBERS = frozenset(
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
#: Words that are frequent in German and in no other language with Latin letters. A sentence with two of them writes
#: its nouns with capitals, which then are words and not names.
GERMAN = frozenset("und der das nicht ist ein eine einer eines einem einen dem mit auf von zu sich auch wird werden sind wurde nach bei aus wie wenn oder".split())

TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+")
STOP = re.compile(r"[.!?\n]")


def template(text: str, nouns: bool = True) -> tuple[list[str], list[str]]:
    """Canonical tokens and the values that they stand for.

    Numbers, in digits or words, become ``<num>``, units behind a number ``<unit>``, capitalised words
    inside a sentence ``<name>``; other words, and those all in upper case, are lower-cased. With
    ``nouns``, capitalised words of German sentences are words, too.
    """
    shape, values, end, after_number = [], [], 0, False
    begin, german = 0, 0

    def close() -> None:
        if nouns and german > 1:
            shape[begin:] = [v if k == "<name>" else k for k, v in zip(shape[begin:], values[begin:], strict=True)]

    for m in TOKEN.finditer(text):
        t = m[0]
        low = t.lower()
        first = not shape or STOP.search(text, end, m.start()) is not None
        if first:
            close()
            begin, german = len(shape), 0
        german += low in GERMAN
        if t[0].isdigit() or low in NUMBERS:
            kind = "<num>"
        elif after_number and low in UNITS:
            kind = "<unit>"
        elif t[0].isupper() and not first and not t.isupper():
            kind = "<name>"
        else:
            kind = low
        shape.append(kind)
        values.append(low)
        after_number, end = kind == "<num>", m.end()
    close()
    return shape, values


@dataclass
class Items:
    """Windows of benchmark items, and the rarest words by which texts without a chance are told apart."""

    windows: dict = field(default_factory=lambda: defaultdict(list))  # window -> [(item, place)]
    values: dict = field(default_factory=dict)
    sizes: dict = field(default_factory=dict)  # item -> windows
    anchors: dict = field(default_factory=lambda: defaultdict(Counter))  # word -> items -> windows it stands for
    widths: set = field(default_factory=set)
    slotted: set = field(default_factory=set)  # windows of few words
    whole: set = field(default_factory=set)  # items with such windows, and words enough to be found with other values


def index(items: list[tuple[object, str]]) -> Items:
    """Items of fewer than ``WINDOW`` tokens are one window; ``slotted`` ones have few words or none.

    An item with names is also held in lower case, for texts that have lost their capitals. Keys of items are (item, form).
    """
    out, shaped = Items(), []
    for item, text in items:
        shape, values = template(text, False)
        forms = [shape, *([template(text.lower())[0]] if "<name>" in shape else [])]
        for form, shape in enumerate(forms):
            shaped.append(((item, form), shape))
            out.values[item, form] = values
    often = Counter(w for _, shape in shaped for w in set(shape))
    rarity = lambda w: (often[w], -len(w), w)
    for item, shape in shaped:
        n = min(WINDOW, len(shape))
        literals = [w for w in shape if w[0] != "<"]
        enough = len(literals) >= SLOT_WORDS
        for at in range(len(shape) - n + 1 if n else 0):
            window = tuple(shape[at : at + n])
            words = [w for w in window if w[0] != "<"]
            if len(words) < min(LITERALS, max(1, n // 2)):
                if n < SLOT_TOKENS:
                    continue
                out.slotted.add(window)
                if enough:
                    out.whole.add(item)
            out.windows[window].append((item, at))
            out.sizes[item] = out.sizes.get(item, 0) + 1
            # no words: the window comes with its values, or with the whole item and so with the item's words
            for word in {min(words, key=rarity)} if words else {max(out.values[item][at : at + n], key=len), *([min(literals, key=rarity)] if enough else [])}:
                out.anchors[word][item] += 1
            out.widths.add(n)
    return out


def consistent(pairs: list[tuple[str, str]]) -> bool:
    """Each slot value of the item stands for one value in the text. Two of its values may have become equal: that is chance, no contradiction."""
    there: dict[str, str] = {}
    return all(there.setdefault(a, b) == b for a, b in pairs)


def search(text: str, items: Items, coverage: float) -> list[tuple]:
    """(item, windows found, windows, slots, same values, first token, last token) of each passage's best match."""
    chance: Counter = Counter()
    for word in items.anchors.keys() & set(TOKEN.findall(text.lower())):
        chance.update(items.anchors[word])
    able = {item for item, n in chance.items() if n >= coverage * items.sizes[item]}
    if not able:
        return []
    shape, values = template(text)
    hits: dict = defaultdict(list)
    whole: dict = defaultdict(list)  # (item, distance) -> windows
    for n in items.widths:
        for at in range(len(shape) - n + 1):
            window = tuple(shape[at : at + n])
            for item, place in items.windows.get(window, ()):
                if item not in able:
                    continue
                if window not in items.slotted or values[at : at + n] == items.values[item][place : place + n]:
                    hits[item].append((at, place, n))
                if item in items.whole:
                    whole[item, at - place].append((at, place, n))
    found = []
    for (item, _), run in whole.items():  # all windows in a row: slots may have other values everywhere
        match = _match(item, run, items, values) if len(run) == items.sizes[item] else None
        if match:
            found.append((item[0], *match[1:]))
    for item, places in hits.items():
        if len(places) < coverage * items.sizes[item]:
            continue
        # a passage's windows lie at about the same distance to the item's, whatever else is like it nearby
        places.sort(key=lambda h: h[0] - h[1])
        slack, best, run = max(2, len(items.values[item]) // 5), None, []
        for hit in [*places, None]:
            if run and (hit is None or hit[0] - hit[1] - (run[-1][0] - run[-1][1]) > slack):
                match = _match(item, chain(sorted(run, key=lambda h: (h[0], -h[1]))), items, values)
                best = max(filter(None, (best, match)), key=lambda m: (m[1], -m[5]), default=None)
                run = []
            run.append(hit)
        if best and best[1] >= coverage * items.sizes[item]:
            found.append((item[0], *best[1:]))
    names = dict.fromkeys(m[0] for m in found)
    return [max((m for m in found if m[0] == name), key=lambda m: (m[1] / m[2], m[4], -m[5])) for name in names] if len(names) < len(found) else found


def chain(hits: list[tuple]) -> list[tuple]:
    """Longest part of ``hits`` (by place in the text, then backwards by place in the item) that goes on in both."""
    ends: list[int] = []
    last: list[int] = []
    back = []
    for k, hit in enumerate(hits):
        n = bisect_left(ends, hit[1])
        back.append(last[n - 1] if n else -1)
        ends[n:] = [hit[1], *ends[n + 1 :]]
        last[n:] = [k, *last[n + 1 :]]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(hits[k])
        k = back[k]
    return out[::-1]


def _match(item: object, run: list[tuple], items: Items, values: list[str]) -> tuple | None:
    own = items.values[item]
    at = {(p + k, a + k) for a, p, n in run for k in range(n)}
    pairs = [(own[p], values[a]) for p, a in at]
    moved = [(x, y) for x, y in pairs if x != y]
    if moved and not consistent([(own[p], values[a]) for p, a in sorted(at)]):
        return None
    return (item, len({p for _, p, _ in run}), items.sizes[item], len(moved), not moved, run[0][0], run[-1][0] + run[-1][2])


def _differing(own: list[str], there: list[str]) -> int:
    """Tokens with another value, put in or left out."""
    if len(own) == len(there):
        return sum(a != b for a, b in zip(own, there, strict=True))
    steps = SequenceMatcher(None, own, there, autojunk=False).get_opcodes()
    return sum(max(b - a, d - c) for kind, a, b, c, d in steps if kind != "equal")


def _beyond(own: list[str], there: list[str]) -> int:
    """Tokens of another value where the item goes on beyond its last window found, counted outwards.

    Less than a window is compared whole: one change at an end hides all of it. More is, as far out as half of the tokens agree: the
    item may be cut off there.
    """
    differ = [a != b for a, b in zip(own, there, strict=False)]
    if len(own) < WINDOW:
        return sum(differ)
    counted = list(accumulate(differ))
    return max((n for k, n in enumerate(counted, 1) if 2 * n <= k), default=0)


def changes(text: str, name: object, items: Items, first: int, last: int) -> int | None:
    """Tokens in which the passage differs from the item, windows found or not, out to the item's ends; None if it has no such windows."""
    shape, values = template(text)
    best = None
    for form in (0, 1):
        for n in (n for n in items.widths if n <= last - first):
            starts, stops = ([p for item, p in items.windows.get(tuple(shape[at : at + n]), ()) if item == (name, form)] for at in (first, last - n))
            for a in starts:
                k = bisect_left(stops, a + last - first - n)
                for b in stops[max(0, k - 1) : k + 1]:
                    if b >= a and (best is None or abs(last - first - (b + n - a)) < best[0]):
                        best = abs(last - first - (b + n - a)), a, b + n, form
    if best is None:
        return None
    _, a, b, form = best
    own = items.values[name, form]
    return _differing(own[a:b], values[first:last]) + _beyond(own[:a][::-1], values[:first][::-1]) + _beyond(own[b:], values[last:])


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per text and benchmark item that it holds, verbatim or with other slot values.

    Returns id, item, n_matched, n_windows, coverage, n_changed (tokens with another value, put in or left out between the
    passage's ends, or beyond them as far as the item goes on: see ``_beyond``), verbatim (none), start_token, end_token. An item is held if one passage has ``coverage`` of its template
    windows and each of its slot values stands for one value there; windows of few words count where they have the
    item's own values, or as part of the whole item. The windows' hash table is broadcast in blocks of
    ``block_bytes`` of benchmark text, so a benchmark of any size is searched whole and a text never
    leaves its task. Null or wordless texts and items match nothing; repeated rows each give rows; an
    empty benchmark gives none; other columns are not read.
    """
    kept, blocks = _marks(benchmark, item_col, item_text, block_bytes)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    item_arrow = to_arrow_type(item_kind)
    names = ["id", "item", "n_matched", "n_windows", "n_changed", "verbatim", "start_token", "end_token"]
    schema = f"id {kind}, item {item_kind.simpleString()}, n_matched long, n_windows long, n_changed long, verbatim boolean, start_token long, end_token long"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def block(k: int) -> DataFrame:
        shared = kept(k)

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = index(shared.value)
            for part in batches:
                out = []
                for name, text in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                    for m in search(text or "", items, coverage):
                        n = changes(text, m[0], items, m[5], m[6])
                        n = m[3] if n is None else n
                        out.append((name.as_py(), *m[:3], n, n == 0, *m[5:]))
                cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
                kinds = [part.schema.field(0).type, item_arrow, *[pa.int64()] * 3, pa.bool_(), *[pa.int64()] * 2]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        return rows.mapInArrow(apply, schema)

    out = block(0)
    for k in range(1, blocks):
        out = out.unionAll(block(k))
    return out.select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_col),
        "n_matched",
        "n_windows",
        (F.col("n_matched") / F.col("n_windows")).alias("coverage"),
        "n_changed",
        "verbatim",
        "start_token",
        "end_token",
    )


def _marks(benchmark: DataFrame, item_col: str, item_text: str, block_bytes: int):
    """A function that broadcasts one block of the benchmark, and the number of blocks."""
    marks = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text"))
    total = marks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))

    def kept(k: int):
        got = marks.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        return benchmark.sparkSession.sparkContext.broadcast(sorted(((r.item, r.text) for r in got), key=repr))

    return kept, blocks


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, for which ``contamination`` has none. Rows are judged where they are: nothing is joined or shuffled."""
    kept, blocks = _marks(benchmark, item_col, item_text, block_bytes)

    def without(docs: DataFrame, k: int) -> DataFrame:
        shared = kept(k)

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = index(shared.value)
            for rows in batches:
                yield rows.filter(pa.array([not search(x or "", items, coverage) for x in rows.column(text_col).to_pylist()], pa.bool_()))

        return docs.mapInArrow(apply, docs.schema)

    for k in range(blocks):
        docs = without(docs, k)
    return docs
