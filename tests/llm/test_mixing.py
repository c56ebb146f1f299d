import random

import numpy as np
import pytest

from tidemark.llm import mixing
from tidemark.llm.mixing import TARGETS, Buckets, fit_topics, margins, mix, mixture, rake, word_counts


def test_rake_meets_reachable_margins():
    rng = np.random.default_rng(3)
    cells = [(s, c, t) for s in "ab" for c in "xyz" for t in "pq"]
    tokens = rng.integers(1000, 9000, len(cells)).astype(float)
    targets = {"source": {"a": 0.55, "b": 0.45}, "lang": {"x": 0.4, "y": 0.3, "z": 0.3}, "topic": {"p": 0.5, "q": 0.5}}
    p = rake(tokens, cells, targets, 0.3)
    assert (p >= 0).all() and (p <= 1).all()
    total = (p * tokens).sum()
    assert total == pytest.approx(0.3 * tokens.sum(), rel=1e-4)
    for k, shares in enumerate(targets.values()):
        for name, share in shares.items():
            got = sum(p[i] * tokens[i] for i, c in enumerate(cells) if c[k] == name) / total
            assert got == pytest.approx(share, abs=1e-4)


def test_values_without_a_target_keep_their_share():
    p = rake(np.array([100.0, 100.0, 200.0]), [("a",), ("b",), ("other",)], {"source": {"a": 0.4, "b": 0.1}}, 0.5)
    got = p * [100, 100, 200]
    assert got / got.sum() == pytest.approx([0.4, 0.1, 0.5], abs=1e-4)


def test_mix_is_calibrated_and_repeatable(spark):
    rng = random.Random(5)
    vocab = ["alpha", "bravo", "candle", "delta", "elephant", "forest", "garden", "harbor", "a", "of"]
    rows = []
    for i in range(6000):
        source = "src0" if i % 3 == 0 else f"src{rng.randint(1, 19)}"
        rows.append((i, " ".join(rng.choices(vocab, k=rng.randint(5, 60))), rng.choices(["en", "de", "fr", "es"], [5, 2, 2, 1.5])[0], source, 0.5))
    rows += [(None, "null id", None, None, 0.1), (6001, None, "en", "unknown", 0.1), (6002, "", "xx", "src1", 0.1), (3, rows[3][1], *rows[3][2:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, prob double")
    targets = TARGETS | {"topic": {}}  # the topics of so few words can't be met
    got = mix(docs, targets).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.selected) for r in got} == {(r.doc_id, r.selected) for r in mix(docs.repartition(7), targets).collect()}
    assert len({r.selected for r in got if r.doc_id == 3}) == 1
    assert all(r.n_tokens == len((t or "").split()) for r, t in zip(sorted((r for r in got if (r.doc_id or 0) > 3), key=lambda r: r.doc_id), [x[1] for x in rows if (x[0] or 0) > 3], strict=True))
    assert all(r.selected == (r.draw < r.prob) for r in got)
    expected = sum(r.prob * r.n_tokens for r in got)
    for margin in ("source", "lang"):
        for name, share in TARGETS[margin].items():
            assert sum(r.prob * r.n_tokens for r in got if r[margin] == name) / expected == pytest.approx(share, abs=0.01)
    taken = [r for r in got if r.selected]
    assert sum(r.n_tokens for r in taken) == pytest.approx(expected, rel=0.05)
    kept = mixture(docs, targets)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in taken)


def test_topics_tell_subjects_apart_in_every_language():
    rng, memo = random.Random(4), Buckets()
    rows, subjects = [], []
    for _ in range(400):
        lang, subject = rng.choice("xy"), rng.randrange(3)
        own, common = [f"{lang}{subject}word{k}" for k in range(40)], [f"{lang}common{k}" for k in range(30)]
        at, n = word_counts(rng.choices(own, k=30) + rng.choices(common, k=30), memo)
        rows.append((lang, at.tolist(), n.tolist()))
        subjects.append((lang, subject))
    topics = fit_topics(rows, k=6)
    got = topics.of([(np.array(at), np.array(n)) for _, at, n in rows], [lang for lang, _, _ in rows])
    most = {t: max(subjects.count(s) and sum(g == t and x == s for g, x in zip(got, subjects, strict=True)) for s in set(subjects)) for t in set(got)}
    assert sum(most.values()) > 0.8 * len(rows)  # a third by chance
    assert topics.of([(np.zeros(0, int), np.zeros(0))], ["x"]) == ["other"]
    assert fit_topics([]).of([(np.array([3]), np.array([1.0]))], ["x"]) == ["t0"]


def test_drawn_sample_meets_the_margins_and_counts_can_be_given(spark):
    rng = random.Random(6)
    rows = [(i, "some words of a text", rng.choices(["en", "de", "fr", "es"], [5, 2, 2, 1.5])[0], f"src{rng.randint(0, 19)}", rng.choice([None, 50, 90])) for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, counted int")
    made = mix(docs, TARGETS | {"topic": {}}, tokens_col="counted")
    assert {r.n_tokens for r in made.collect()} == {0, 50, 90}
    got = {(r.margin, r.category): r for r in margins(made).collect()}
    for name, share in TARGETS["lang"].items():
        assert got["lang", name].expected == pytest.approx(share, abs=1e-3) and got["lang", name].drawn == pytest.approx(share, abs=0.03)
    assert sum(r.drawn for k, r in got.items() if k[0] == "source") == pytest.approx(1)


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000), (2, "x" * 2_000_000)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in mix(docs).collect()} == {1: 400_000, 2: 1}


def test_empty_table_and_missing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mix(none).collect() == [] and mixture(none).collect() == []
    assert mix(spark.createDataFrame([(1, "some words here")], "doc_id long, text string")).count() == 1


def test_topics_are_fitted_on_every_row(spark, monkeypatch):
    """Subjects and rarities come from all rows, however many and however they are dealt; the table is read whole."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices([f"common{k}" for k in range(20)], k=20)), "en", "src1") for i in range(6000)]
    rows += [(6000 + i, " ".join(rng.choices([f"rare{k}" for k in range(10)], k=20)), "en", "src1") for i in range(30)]
    docs, fitted = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), []
    monkeypatch.setattr(mixing, "fit_topics", lambda *a, real=mixing.fit_topics: fitted.append(real(*a)) or fitted[-1])
    got = [sorted((r.doc_id, r.topic) for r in mix(d).collect()) for d in (docs, docs.repartition(9))]
    assert got[0] == got[1] and np.array_equal(fitted[0].centres, fitted[1].centres)
    memo = Buckets()
    counted = [word_counts(t.split(), memo) for _, t, _, _ in rows]
    seen = np.bincount(np.concatenate([at for at, _ in counted]), minlength=mixing.BUCKETS)
    assert np.allclose(fitted[0].rarity, np.log((1 + len(rows)) / (1 + seen)))


def test_rounds_give_the_centres_of_plain_sums(monkeypatch):
    """One round against a plain version over dense vectors."""
    rng, memo = random.Random(9), Buckets()
    rows = [(rng.choice("xy"), *word_counts(rng.choices([f"w{k}" for k in range(60)], k=12), memo)) for _ in range(300)]
    monkeypatch.setattr(mixing, "HELD", -1)  # no early end
    a, b = fit_topics(rows, k=3, rounds=4), fit_topics(rows, k=3, rounds=5)
    x = np.zeros((len(rows), mixing.BUCKETS))
    for i, (_, at, n) in enumerate(rows):
        x[i, at] = np.log1p(n)
    x *= a.rarity
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    langs = np.array([r[0] for r in rows])
    for name in "xy":
        x[langs == name] -= x[langs == name].mean(0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ a.centres).argmax(1)
    want = np.array([x[near == j].sum(0) for j in range(3)])
    assert np.allclose(b.centres.T, want / np.linalg.norm(want, axis=1, keepdims=True), atol=1e-4)


def test_vectors_are_stored_as_blocks(spark, monkeypatch):
    """Rounds read a row for many texts, and find what plain rows in memory give."""
    rng, memo, made = random.Random(10), Buckets(), []
    rows = [(i, rng.choice("xy"), *word_counts(rng.choices([f"w{k}" for k in range(60)], k=rng.choice([0, 12])), memo)) for i in range(1300)]
    table = spark.createDataFrame([(i, lang, mixing.packed(at, n) if i % 7 else (mixing.packed(at, n) or None)) for i, lang, at, n in rows], "h long, lang string, counts binary").coalesce(1)
    monkeypatch.setattr(mixing, "stage", lambda df, real=mixing.stage: made.append(real(df)) or made[-1])
    got = fit_topics(table, k=3)
    assert made[0].count() <= 1300 / mixing.STORED + 1
    want = mixing.Rows.of([(lang, at.tolist(), n.tolist()) for _, lang, at, n in rows])
    some = [sum(len(at) > 0 for _, _, at, _ in rows[:k]) for k in (650, 1300)]
    column = made[0].toArrow()
    assert sum(len(x.as_py()) // 8 for x in column.column("hashes")) == some[1] == len(want.block.sizes)
    moved = want.moved(got.rarity, np.stack([np.bincount(want.block.at[own], want.block.units(got.rarity)[own], mixing.BUCKETS) / (want.block.langs == k).sum() for k in range(2) for own in [np.repeat(want.block.langs == k, want.block.sizes)]]))
    stored = {int(h): x for i in range(column.num_rows) for b in [mixing.Block.reread([column.column(c)[i].as_buffer() for c in mixing.KINDS])] for j, h in enumerate(b.hashes) for x in [b.text(j)]}
    for j, h in enumerate(moved.block.hashes):
        mine, theirs = moved.block.text(j), stored[int(h)]
        assert mine[0] == theirs[0] and mine[2] == theirs[2] and np.allclose(mine[3], theirs[3], atol=1e-4) and np.isclose(mine[1], theirs[1], rtol=1e-4)


def test_words_are_counted_as_the_pattern_finds_them(spark):
    rng, memo = random.Random(11), Buckets()
    letters = [*"abcXYZ019_", *" \t\n\x1c\x85\xa0.,-'", *"éßÄñ²½ªµ×÷", *"İſK“Ж中́🙂"]
    texts = ["".join(rng.choices(letters[: rng.choice([10, 20, 30, len(letters)])], k=rng.choice([0, 1, 7, 60, 900]))) for _ in range(400)]
    texts += [None, "", "x" * 31 + " " + "y" * 32 + " " + "z" * 33 + " " + "é" * 16 + " " + "é" * 40, "w" * 1_200_000, "b b a " * 200_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    got = {r.i: r.of for r in rows.select("i", mixing.measured("text").alias("of")).collect()}
    for i, text in enumerate(texts):
        words = mixing.WORD.findall((text or "").lower())
        assert (got[i].n, bytes(got[i].counts)) == (len(words), mixing.packed(*word_counts(words, memo)))


def test_topics_are_found_once(spark):
    """What ``mix`` gives is read from a table that has the topics: no worker finds them again."""
    docs = spark.createDataFrame([(i, f"some words{i % 7} here", "en", "src1") for i in range(50)], "doc_id long, text string, lang string, source string")
    made = mix(docs)
    assert made.where("topic like 't_'").count() == 50
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()


def test_sums_leave_tasks_side_by_side(spark, monkeypatch):
    """A task hands on a row for ``SIDE`` sums, not one for each, and no sum is lost or moved."""
    table = spark.createDataFrame([(i, "x", mixing.packed(np.array([i, 4000]), np.array([1, 2]))) for i in range(600)], "h long, lang string, counts binary").coalesce(1)
    made = []
    monkeypatch.setattr(mixing.Counted, "_over", lambda self, *a, real=mixing.Counted._over: made.append(real(self, *a)) or made[-1])
    width = mixing.BUCKETS + 3  # no multiple of SIDE
    got = mixing.Counted.of(table).sums(width, lambda block: np.append(np.bincount(block.at, block.n, mixing.BUCKETS), [0, -5, len(block.sizes)]))
    want = np.zeros(width, np.int64)
    want[:600], want[4000], want[-2:] = 1, 1200, (-5, 600)
    assert np.array_equal(got, want) and got.dtype == np.int64
    assert made[0].count() <= -(-width // 16)
