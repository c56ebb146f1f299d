import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import divergence
from tidemark.llm.divergence import Trie, shares, source_divergence, terms_of

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id int, text string, lang string, source string, item int, docs int, term string"


def plain(rows, least=10, top=10):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(lower))
        groups.add((lang, source))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for g, s in groups if g == lang]

        def p(count):
            total = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 2) // total for t in kept}

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        q, own = p(whole), {s: p(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum(f(own[s][t], own[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(-f(own[s][t], q[t]), t) for t in kept if counts[lang, s][t] and own[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, k) for k, (v, item) in enumerate(items, 1)]
    return sorted(out)


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    words = ["the", "The", "THE", "x", "xa", "xab", "é", "É", "zß", "日本", "日", "a-b", "don't", "word9word", "👍", "aa", "ab"] + [f"v{c}{d}" for c in "abcdefghij" for d in "klmnop"]
    rows = []
    for k in range(n):
        text = rng.choice([None, "", *[" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(8)]])
        rows.append((k % 50, text, rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "b", "ü", "z", None, ""]), 1, 2, "t"))
    return rows + [(1, None, "fr", "a", 1, 2, "t"), (2, "seldom", "fr", "b", 1, 2, "t"), (3, "y" * 300_000 + " the", "en", "a", 1, 2, "t")]


@pytest.mark.parametrize("held", [250_000, 40])
def test_equals_plain_audit(spark, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "BLOCK", 500)
    monkeypatch.setattr(divergence, "OPEN", 7)
    monkeypatch.setattr(divergence, "CELLS", 30)
    rows = corpus()
    out = source_divergence(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in out.collect()) == plain(rows)


def test_empty_tables_and_lone_sources(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert source_divergence(empty).collect() == []
    one = [(1, "a b", "en", "s", 1, 2, "t")] * 12
    assert sorted((r.source, r.part, r.item) for r in source_divergence(spark.createDataFrame(one, SCHEMA)).collect()) == []
    assert plain(one) == []


def fill(items):
    trie = Trie()
    for key, source, n in items:
        leaf = trie.leaves([key])
        trie.add(leaf, np.array([1]))
        trie.add_counts(leaf, np.array([source]), np.array([n]))
    return trie


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.binary(min_size=1, max_size=9), st.text("ab", min_size=1, max_size=9).map(str.encode)), st.integers(0, 2), st.integers(1, 9)), min_size=1, max_size=60), st.integers(1, 60))
def test_tries_merge_and_walk_in_byte_order(items, cut):
    want = defaultdict(lambda: [0, Counter()])
    for key, source, n in items:
        want[key][0] += 1
        want[key][1][source] += n
    trie = fill(items[:cut])
    trie.merge(fill(items[cut:]))
    if cut % 2:
        trie.settle(3)
        assert trie.held == sum(len(c) for _, c in want.values())
    keys, docs, ends, sources, counts = trie.sums(3)
    assert keys == sorted(want) and trie.size == len(want)
    assert docs.tolist() == [want[k][0] for k in keys]
    for k, key in enumerate(keys):
        own = slice(ends[k - 1] if k else 0, ends[k])
        assert dict(zip(sources[own].tolist(), counts[own].tolist())) == want[key][1]


def test_a_chain_of_prefixes_is_no_recursion():
    trie = fill([(b"a" * n, 0, 1) for n in range(1, 4000)])
    assert [len(k) for k in trie.walk()[0]] == list(range(1, 4000))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB zé[`{@日\x80\n")), max_size=8), st.integers(0, 3))
def test_terms_of_whole_texts(texts, skip):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    array = pa.array([t.encode() for t in texts], pa.binary()).slice(skip)
    code, names, text = terms_of(array)
    want = [(k, t.encode()) for k, x in enumerate(texts[skip:]) for t in TERM.findall(x.translate(lower))]
    assert list(zip(text.tolist(), [names[c] for c in code])) == want


def test_shares_are_exact():
    rng = random.Random(1)
    counts = [rng.randrange(10**13) for _ in range(500)] + [0, 1, 10**13]
    total = 3 * 10**13 + 7
    got = shares(np.array(counts, dtype=np.int64), np.int64(total))
    assert got.tolist() == [1 + 10**9 * (c + 2) // total for c in counts]
