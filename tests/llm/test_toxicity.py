import pickle
import random
import zlib

import numpy as np

from tidemark.llm import toxicity as tox
from tidemark.llm.toxicity import best_threshold, clean, toxicity, train


def corpus(n=700, seed=1):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in "bcdfgh" for b in ("alo", "emi", "onu", "ira", "utex")]
    bad = ["vilest", "wretch", "scumfoo"]
    rows, marks = [], []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randint(3, 120))
        y = int(i % 4 == 0)
        if y:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randint(0, len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), rng.choice(["en", "fr"]), "s", 0))
        marks.append((i, 1, y))
    return rows, marks


def frames(spark, rows, marks):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")
    return docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_folds_and_independence_of_labels(spark):
    rows, marks = corpus()
    docs, labels = frames(spark, [*rows, (5000, None, None, None, 0), (5001, "", "en", "s", 0), (None, "null id", "en", "s", 0), (7, rows[7][1], "en", "s", 0), (5002, "wretch " * 60_000, "en", "s", 0)], marks)
    got = toxicity(docs, labels).collect()
    assert len(got) == len(rows) + 5
    y = {i: t for i, _, t in marks}
    held = [r for r in got if r.held_out and r.doc_id in y]
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.95
    # held-out labels, language and source never change a score
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in marks]
    again = toxicity(*frames(spark, [(i, t, "en", "other", 1) for i, t, *_ in rows], turned)).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in got if r.doc_id is not None and r.doc_id < 5000}


def test_clean_drops_what_is_rejected(spark):
    rows, marks = corpus()
    docs, labels = frames(spark, rows, marks)
    rejected = {r.doc_id for r in toxicity(docs, labels).collect() if r.rejected}
    kept = clean(docs, labels)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - rejected
    assert rejected


def test_memo_restart_gives_the_same_scores(monkeypatch):
    rows, marks = corpus(200)
    texts = [r[1] for r in rows]
    model = train(texts, np.array([m[2] for m in marks], float))
    first = model.scores(texts)
    monkeypatch.setattr(tox, "MEMO_WORDS", 3)
    assert np.allclose(np.concatenate([model.scores([t]) for t in texts]), first, atol=1e-5)


def test_thresholds():
    assert best_threshold(np.array([0.1, 0.2, 0.8, 0.9]), np.array([0, 0, 1, 1.0]), np.ones(4)) == 0.5
    assert best_threshold(np.array([0.1]), np.array([1.0]), np.ones(1)) == 0.5


def test_no_labels_and_empty_tables(spark):
    docs, labels = frames(spark, corpus(20)[0], [(1, 1, 0)])
    assert {r.score for r in toxicity(docs, labels).collect()} == {0.0}
    assert toxicity(docs.limit(0), labels).collect() == []
    assert clean(docs, labels.limit(0)).count() == 20


def test_sample_takes_whole_long_texts_and_no_missing_ones(spark, monkeypatch):
    rows, marks = corpus(400)
    marks += [(i, 1, i % 2) for i in range(10_000, 14_000)]  # labels without a document
    long = [(i, t + " filler" * 60_000, *x) if i % 50 == 1 else (i, t, *x) for i, t, *x in rows]
    sizes = []
    monkeypatch.setattr(tox, "train", lambda texts, y, real=tox.train: sizes.append([len(t) for t in texts]) or real(texts, y))
    tox.fit(*frames(spark, long, marks), per_class=100)
    assert len(sizes[0]) > 120 and max(sizes[0]) > 400_000
    monkeypatch.setattr(tox, "SAMPLE_CHARS", 20_000)  # no further row once a class has so many characters
    tox.fit(*frames(spark, rows, marks), per_class=100)
    assert 20_000 < sum(sizes[1]) < 2 * 21_000


def test_repeated_ids_have_one_text_whatever_the_order(spark):
    rows, marks = corpus(300)
    twice = rows + [(i, f"other words {i % 7}", "en", "s", 0) for i in range(0, 300, 3)]
    docs, labels = frames(spark, twice, marks)
    a, b = (tox.fit(docs.repartition(n), labels) for n in (1, 5))
    assert np.array_equal(a.keys, b.keys) and np.array_equal(a.table, b.table) and a.shift == b.shift


def test_features_are_crc32_of_words_and_heads():
    words = ["a", "abc", "héllo", "x" * 100, "abcdefg"]
    for word, row in zip(words, tox.features(words).tolist(), strict=True):
        b = word.encode()
        assert row == [zlib.crc32(b"^" + b[:n]) % tox.BUCKETS + 1 if len(b) >= n else 0 for n in tox.HEADS] + [zlib.crc32(b"^" + b + b"$") % tox.BUCKETS + 1]


def test_every_row_is_learned_from(spark, monkeypatch):
    """Marks that are too rare in any 1,500 rows of a class are known from all rows; blocks give the same however rows are dealt."""
    rng = random.Random(3)
    marks = ["".join(rng.choices("bcdfghjklmnpqrstvwxz", k=8)) for _ in range(1000)]
    vocab = [f"{a}{b}" for a in "bcdfgh" for b in ("alo", "emi", "onu", "ira", "utex")]
    rows, labels = [], []
    for i in range(10_000):
        y = i % 2
        words = rng.choices(vocab, k=8)
        words[3] = rng.choice(marks) if y else rng.choice(vocab)
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, y))
    docs, labels = frames(spark, rows, labels)
    got = [r for r in toxicity(docs, labels).collect() if r.held_out]
    assert np.mean([r.predicted == r.doc_id % 2 for r in got]) > 0.9
    assert tox.fit(docs.limit(0), labels) is None
    monkeypatch.setattr(tox, "BLOCK_TEXTS", 2500)
    few, few_labels = docs.where("doc_id < 4000"), labels.where("doc_id < 4000")
    a, b = (tox.fit(few.repartition(n), few_labels) for n in (1, 5))
    assert np.array_equal(a.keys, b.keys) and np.array_equal(a.table, b.table) and a.shift == b.shift and a.thresholds == b.thresholds


def test_blocks_are_averaged(spark, monkeypatch):
    """The model is the mean of what the blocks make of the counts of all rows."""
    monkeypatch.setattr(tox, "BLOCK_TEXTS", 150)
    rows, marks = corpus(500)
    docs, labels = frames(spark, rows, marks)
    held = []
    monkeypatch.setattr(tox, "_calibrated", lambda model, cal, real=tox._calibrated: held.append(pickle.loads(pickle.dumps(model))) or real(model, cal))
    monkeypatch.setattr(tox, "_trained", lambda use, odds, real=tox._trained: held.append((use.collect(), odds)) or real(use, odds))
    tox.fit(docs, labels)
    (use, odds), model = held
    assert {r.id for r in use} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 > 1}
    have = {w for r in use for w in r.text.split()}
    n1 = sum(r.y for r in use)
    word = "wretch"
    key, mine = tox.features([word])[0, -1], [r.y for r in use if word in r.text.split()]
    assert have and np.isclose(odds[key], np.log((sum(mine) + 1) / (n1 + 2)) - np.log((len(mine) - sum(mine) + 1) / (len(use) - n1 + 2)))
    blocks = [sorted((r for r in use if r.block == b), key=lambda r: r.id) for b in sorted({r.block for r in use})]
    assert len(blocks) > 1
    parts = [train([r.text for r in x], np.array([r.y for r in x], float), odds) for x in blocks]
    assert np.isclose(model.shift, np.mean([p.shift for p in parts]), atol=1e-5)
    for k, w in enumerate(model.filters):
        assert np.allclose(w, np.mean([p.filters[k] for p in parts], 0), atol=1e-5)
    moved = [p.table[1:][p.keys == key][0] for p in parts]
    assert np.allclose(model.table[1:][model.keys == key][0], np.mean(moved, 0), atol=1e-5)
