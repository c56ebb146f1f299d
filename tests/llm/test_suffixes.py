import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm.suffixes import LENGTH, Run, _runs, anchors, collapsed, duplicate_spans, merge, windows


def brute(texts):
    """Digest columns of each text by the plain definition."""
    starts = {}
    data = [(t or "").encode() for t in texts]
    for d, t in enumerate(data):
        for o in range(len(t) - LENGTH + 1):
            starts.setdefault(t[o : o + LENGTH], []).append((d, o))
    gone = [np.zeros(len(t), bool) for t in data]
    for places in starts.values():
        if len(places) > 1:
            for d, o in places:
                gone[d][o : o + LENGTH] = True
    out = []
    for t, g in zip(data, gone, strict=True):
        edge = np.diff(np.concatenate([[0], g.astype(int), [0]]))
        out.append((len(t), int(g.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~g])).hexdigest()))
    return out


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(n))


def corpus():
    rng = random.Random(3)
    shared = [words(rng, k) for k in (30, 45, 60, 200)]
    texts = [words(rng, rng.randint(1, 120)) for _ in range(30)]
    for k in range(40):
        s = rng.choice(shared)
        a = rng.randint(0, len(s) // 3)
        b = rng.randint(2 * len(s) // 3, len(s))
        texts.append(words(rng, rng.randint(0, 20)) + s[a:b] + words(rng, rng.randint(0, 20)) + rng.choice(["", s, shared[0]]))
    base = words(rng, 150)
    for _ in range(10):  # near copies
        at = rng.randint(0, len(base))
        texts.append(base[:at] + rng.choice("xyz") + base[at + 1 :])
    line = words(rng, 20)
    texts += [line * 9, "a" * 199, "a" * 200, "a" * 700, "ab" * 400, None, "", "é" * 150, texts[0], texts[40], texts[40], words(rng, 33)]
    return texts


@pytest.mark.parametrize("hot", [100_000, 5, 1])
def test_equals_the_plain_definition(spark, hot):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, k1 string")
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in duplicate_spans(docs, hot=hot, part=50).collect()}
    assert [rows[i] for i in range(len(texts))] == brute(texts)
    assert sum(r[1] > 0 for r in rows.values()) > 30


def test_chunks_do_not_change_anchored_strings(monkeypatch):
    text = (words(random.Random(1), 700) * 2).encode()
    whole = {(int(q), int(q - a)) for h, p, near, far in anchors(text) for q, lo, hi in zip(p, near, far, strict=True) for a in range(lo, hi + 1)}
    monkeypatch.setattr("tidemark.llm.suffixes.CHUNK", 301)
    parts = {(int(q), int(q - a)) for h, p, near, far in anchors(text) for q, lo, hi in zip(p, near, far, strict=True) for a in range(lo, hi + 1)}
    assert parts == whole
    assert {s for _, s in whole} == set(range(len(text) - LENGTH + 1))


def test_merge_gives_sorted_suffixes_and_their_common_prefixes():
    rng = random.Random(5)
    for k in (1, 2, 3, 7):
        lists = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 30))) for _ in range(k)]
        runs = []
        for x in lists:
            if x:
                row = _runs({0: [(s, b"", 0, 0, 0, 0, 0) for s in x]}).to_pylist()[0]
                runs.append((Run(row["lcp"], row["sizes"], row["rest"]), x))
        got, last = [], b""
        for shared, run, at in merge([r for r, _ in runs]):
            s = runs[run][1][at]
            n = 0
            while n < min(len(s), len(last)) and s[n] == last[n]:
                n += 1
            assert shared == n
            got.append(s)
            last = s
        assert got == sorted(s for x in lists for s in x)


def test_windows_cover_every_distance_and_share_keys():
    rng = random.Random(4)
    text = words(rng, 300).encode()
    for near, far in ((0, LENGTH - 64), (5, 40), (16, 17), (136, 136)):
        at = 600
        made = list(windows(77, text[at : at + LENGTH - near], text[at - far : at][::-1], near, far))
        assert [a for *_, low, high in made for a in range(low, high + 1)] == list(range(near, far + 1))
        for key, right, left, low, high in made:
            assert right == text[at : at + LENGTH - low] and left == text[at - high : at][::-1]
            whole = text[at - high : at + LENGTH - low]  # another text with these bytes has the key
            other = dict((x[3], x[0]) for x in windows(77, (whole[high:] + b"?" * LENGTH)[: LENGTH - low], whole[:high][::-1], low, high))
            assert key == other[low]


def test_equal_surroundings_are_sent_once():
    held = {3: {(b"right", b"left", 2, 5): [(100, 1, 1), (300, 1, 1), (50, 2, 2)], (b"other", b"", 0, 0): [(7, 3, 3)]}}
    runs, spans = collapsed(held)
    assert runs == {3: [(b"right", b"left", 2, 5, 100, 1, 1), (b"other", b"", 0, 0, 7, 3, 3)]}
    assert spans == [(1, 1, 95, 298), (1, 1, 295, 498), (2, 2, 45, 248)]


def test_empty_table_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert duplicate_spans(none).collect() == []
    docs = spark.createDataFrame([(None, "q" * 300), (None, "q" * 300), (1, None)], "doc_id long, text string")
    rows = sorted((r.doc_id or 0, r.n_removed) for r in duplicate_spans(docs).collect())
    assert rows == [(0, 300), (0, 300), (1, 0)]


def test_no_table_stays_in_the_catalog(spark):
    docs = spark.createDataFrame([(1, "ab" * 300), (2, "ab" * 300)], "doc_id long, text string")
    before = {t.name for t in spark.catalog.listTables()}
    out = duplicate_spans(docs)
    assert {t.name for t in spark.catalog.listTables()} == before
    assert [r.n_removed for r in out.collect()] == [600, 600]


def suffixes_of(texts):
    """(gram, right, left, near, far) of every anchor."""
    for t in (x.encode() for x in texts):
        for hs, ps, near, far in anchors(t):
            for h, p, a, b in zip(hs.view(np.uint64).tolist(), ps.tolist(), near.tolist(), far.tolist(), strict=True):
                yield h, t[p : p + LENGTH - a], t[p - b : p][::-1], a, b


def test_a_line_of_nearly_the_length_in_many_surroundings(spark):
    """190 bytes in common, what lies around differs, but for a few: no key holds different suffixes of more than the bound."""
    rng = random.Random(9)
    for _ in range(30):
        line = words(rng, 80).encode().decode("ascii", "ignore")[:190]
        texts = [words(rng, 6) + line + words(rng, 6) for _ in range(300)]
        suffixes = list(suffixes_of(texts))
        seen = Counter(key for s in suffixes for key, *_ in windows(*s))
        if max(seen.values()) > 250:  # a line whose anchor lies such that one window has it nearly whole
            break
    assert max(seen.values()) > 250
    crowded, kinds = frozenset(k for k, n in seen.items() if n > 50), {}
    for s in suffixes:
        for key, *rest in windows(*s, crowded):
            kinds.setdefault(key, set()).add(tuple(rest))
    assert max(map(len, kinds.values())) <= 50
    assert sum(b - a + 1 for *_, a, b in suffixes) == sum(b - a + 1 for s in suffixes for *_, a, b in windows(*s, crowded))

    texts += [f"{k} qqqqqq" + line + "zzzz" + words(rng, 5) for k in range(9)] + [line, "qqqqqq" + line + "zzzz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (50, 400):
        rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in duplicate_spans(docs, hot=hot, part=50).collect()}
        assert [rows[i] for i in range(len(texts))] == brute(texts)
    assert sum(r[1] > 0 for r in rows.values()) >= 10
