import math
import re
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import lm
from tidemark.llm.lm import groups, lm_scores, word_hashes


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def split(s):
    out, word = [], ""
    for c in lower(s or ""):
        if c == " " or "\x09" <= c <= "\x0d":
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out + ([word] if word else []) + [None]


def corpus():
    rng = random.Random(2)
    vocab = ["".join(rng.choice("abcdeÉxyZ") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    texts = []
    for i in range(120):
        if i % 3 == 0 and i:
            texts.append(texts[rng.randrange(len(texts))] + " end")
        else:
            texts.append(rng.choice(" \n\t\x0b").join(rng.choices(vocab, [1 / (k + 1) for k in range(400)], k=rng.randint(1, 90))))
    return [*texts, None, "", "   ", "one\x85two three", "Q" * 5000, "never seen words"]


@pytest.mark.parametrize("head", [1 << 20, 8, 0])
def test_exact_columns_and_better_scores(spark, head):
    texts = corpus()
    rows = list(enumerate(texts)) + [(None, "a null id learns")]
    train = [t for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in split(t))
    n, v = sum(c.values()), len(c)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in lm_scores(docs, head=head).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r, words = got[i], split(t)
        assert r.held_out == (zlib.crc32(str("" if i is None else i).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in c for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), abs=1e-6)
        assert r.score <= 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_every_count_is_in_the_model_and_probabilities_sum_to_about_one(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("text")
    model, blocks = lm.fit(docs)
    counts: list[Counter] = [Counter(), Counter(), Counter()]
    for t in texts:
        for tokens, _ in groups([t]):
            pair, _, triple = lm.ngrams(tokens, lm.START)
            for c, x in zip(counts, (tokens, pair, triple), strict=True):
                c.update(x.tolist())
    for kind, c in enumerate(counts):
        h = np.array(list(c), np.uint64)
        found = model.filter.levels(kind, h, lm.place(kind, h, model.bits))
        want = np.maximum(lm.level(np.array(list(c.values()))) - lm.LEAST[kind] + 1, 0)  # triples seen once aren't in it
        assert (found >= want).all() and (found > want).mean() < 0.04  # none is missing, few are taken for more
        other = np.random.default_rng(kind).integers(0, 1 << 63, 4000).astype(np.uint64)
        assert (model.filter.levels(kind, other, lm.place(kind, other, model.bits)) > 0).mean() < 0.04
    names = np.array(sorted(counts[0]), np.uint64)
    tokens = np.concatenate([t for t, _ in groups(texts)])
    sums = []
    for k in range(2, 300, 9):
        before = tokens[k - 2 : k]
        p = []
        for w in names:
            wanted = lm.Wanted(np.array([w]), before)
            p.append(10 ** wanted.scores(model, lm.probed(model.filter, wanted.keys, model.bits))[0][0])
        sums.append(sum(p))
    assert 0.8 < np.mean(sums) < 1.3 and 0.6 < min(sums)  # what isn't there and is found adds some


def test_a_filter_that_is_not_broadcast_gives_the_same_scores(spark, monkeypatch):
    rows = [*list(enumerate(corpus())), (None, "a null id learns"), (500, " ".join(f"w{k % 50}" for k in range(4000))), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: (str(r.doc_id), r.n_tokens, r.base_score)
    whole, apart = (sorted(lm_scores(docs, broadcast=most).collect(), key=key) for most in (1 << 30, 0))
    assert len(whole) == len(rows)
    monkeypatch.setattr(lm, "GROUP", 256)
    monkeypatch.setattr(lm, "TOKENS", 50)  # texts over many chunks
    pieces = sorted(lm_scores(docs, head=20, broadcast=0).collect(), key=key)
    for other in (apart, pieces):
        for a, b in zip(whole, other, strict=True):
            assert (a.doc_id, a.held_out, a.n_tokens, a.n_known, a.train_tokens) == (b.doc_id, b.held_out, b.n_tokens, b.n_known, b.train_tokens)
            assert a.base_score == pytest.approx(b.base_score)
    assert [r.score for r in whole] == pytest.approx([r.score for r in apart])


def test_texts_seen_twice_score_above_those_seen_once(spark):
    rng = random.Random(3)
    vocab = [f"v{k}" for k in range(300)]
    texts = [" ".join(rng.choices(vocab, k=60)) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[i]) for i in range(60)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    n = Counter(t for _, t in rows)
    got = [(n[dict(rows)[r.doc_id]], r.score / r.n_tokens) for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    twice, once = [s for k, s in got if k == 2], [s for k, s in got if k == 1]
    assert min(twice) > sorted(once)[int(0.95 * len(once))]


def test_long_texts_are_cut_at_spaces(monkeypatch):
    texts = [" ".join(f"w{k}" for k in range(500)), "x" * 900, "", None, "a b"]
    whole = [(int(a), int(b)) for t, o in groups(texts) for a, b in zip(t, o, strict=True)]
    monkeypatch.setattr(lm, "GROUP", 64)
    assert [(int(a), int(b)) for t, o in groups(texts) for a, b in zip(t, o, strict=True)] == whole
    assert len(whole) == 500 + 1 + 2 + 5
    assert (word_hashes(b"Ab aB\tab") == word_hashes(b"ab")[0]).all()


def test_empty_table(spark):
    assert lm_scores(spark.createDataFrame([], "doc_id long, text string, h long")).collect() == []


def plain_scores(texts):
    """log10 of each token's probability by the model's definition, from counts in dictionaries and with no filter."""
    end, lines = None, [[None, None, *re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for t in texts]
    counts = [Counter(), Counter(), Counter()]
    for line in lines:
        for k in range(2, len(line)):
            for kind in range(3):
                counts[kind][tuple(line[k - kind : k + 1])] += 1
    rank = lambda c: math.floor(math.log(c) / math.log(lm.STEP) + 1e-9) + 1 if c else 0
    at_level = [{}, {}, {}]
    for kind, found in enumerate(counts):
        for c in found.values():
            at_level[kind].setdefault(rank(c), []).append(c)
    rough = lambda kind, gram: sum(x := at_level[kind][rank(counts[kind][gram])]) / len(x) if counts[kind][gram] >= lm.LEAST[kind] else 0
    rests = [{}, {}]
    for kind, least in ((1, lm.LEAST[1]), (2, lm.LEAST[2])):
        taken, total = Counter(), Counter()
        for gram, c in counts[kind].items():
            total[gram[:-1]] += c
            taken[gram[:-1]] += c - lm.DISCOUNT if c >= least else 0
        for context, n in total.items():
            rests[kind - 1][context] = lm.SHARE ** round(math.log(max(1 - taken[context] / n, 0.02)) / math.log(lm.SHARE))
    mass, out = sum(counts[0].values()) + len(counts[0]) + 1, []
    for line in lines:
        for k in range(2, len(line)):
            a, b, c = line[k - 2 : k + 1]
            p = (counts[0][c,] + 1) / mass
            twice = len(texts) if b is end else rough(1, (a, b))
            triple = rough(2, (a, b, c)) if rank(counts[1][b, c]) >= lm.LEAST[2] and twice >= lm.LEAST[2] else 0
            for own, often, rest in ((rough(1, (b, c)), counts[0][b,], rests[0][b,]), (triple, twice, rests[1][a, b])):
                p = min(max(own - lm.DISCOUNT, 0) / max(often, 1), 1 - rest) + rest * p if often else p
            out.append(math.log10(min(p, 1)))
    return np.array(out)


def test_scores_against_plain_counts(spark):
    """Token by token; the filter's false positives (about one in a hundred a probe) are all that may differ."""
    texts = corpus()
    model, _ = lm.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("text"))
    tokens = np.concatenate([t for t, _ in groups(texts)])
    wanted = lm.Wanted(tokens, lm.START)
    got, exact = wanted.scores(model, lm.probed(model.filter, wanted.keys, model.bits))
    want = plain_scores(texts)
    assert len(got) == len(want) and (exact > 0).all()
    differ = np.abs(got - want)
    assert (differ < 1e-9).mean() > 0.85, (differ < 1e-9).mean()
    assert differ.mean() < 0.02, differ.mean()


def test_workers_take_few_texts_and_hand_on_counts_in_small_batches(spark, monkeypatch):
    """Counting holds no long batch of texts, and what a task held goes on kind by kind, so many n-grams at a time."""
    found = []

    class Texts:
        def mapInArrow(self, f, schema):
            found.append(f)
            return self

        select = repartition = sortWithinPartitions = lambda self, *_: self

    monkeypatch.setattr(lm, "SENT", 100)
    monkeypatch.setattr(lm, "TOKENS", 500)
    monkeypatch.setattr(lm, "HELD", 2000)
    lm.counted(Texts(), 4)
    texts = corpus()
    counts: list[Counter] = [Counter(), Counter(), Counter()]
    for tokens, _ in groups(texts):
        pair, _, triple = lm.ngrams(tokens, lm.START)
        for c, x in zip(counts, (tokens, pair, triple), strict=True):
            c.update(x.tolist())
    got: list[Counter] = [Counter(), Counter(), Counter()]
    batches = (pa.record_batch({"text": pa.array(texts[k : k + 10], pa.string())}) for k in range(0, len(texts), 10))
    for batch in found[0](batches):
        rows = batch.to_pylist()
        assert len({r["kind"] for r in rows}) == 1
        assert sum(len(r["hs"]) for r in rows) // 8 < 400  # about SENT, as blocks aren't cut
        for r in rows:
            h = np.frombuffer(r["hs"], np.uint64)
            assert (lm.place(r["kind"], h, lm.block_bits(4)) == r["block"]).all()
            for x, n in zip(h.tolist(), np.frombuffer(r["cs"], np.uint32).tolist(), strict=True):
                got[r["kind"]][x] += n
    assert got == counts

    most = []
    real = lm.stage
    monkeypatch.setattr(lm, "stage", lambda df, rows=None: (most.append(rows), real(df, rows))[1])
    assert lm_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == len(texts)
    assert all(rows and rows <= 1000 for rows in most)
