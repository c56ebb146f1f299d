import random

import numpy as np
import pytest
import xxhash

from tidemark.llm.components import components
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.common import stage
from tidemark.llm.setjoin import linked, parity, prefix
from tidemark.llm.simhash import GrayIndex, fingerprint, gray_rank, link_codes, one_of_each, shingles, similarity, simhash_components


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\x09\x0a\x0b\x0c\x0d" else c for c in low).split(" ") if w]
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), seed=42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(ids, prints):
    """Smallest id reachable over links of 4 bits or fewer."""
    root = list(range(len(ids)))
    for _ in ids:
        for i in range(len(ids)):
            for j in range(len(ids)):
                if bin(prints[i] ^ prints[j]).count("1") <= 4:
                    root[i] = min(root[i], root[j], key=lambda k: ids[k])
    return [ids[r] for r in root]


def corpus():
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(1, 60))) for _ in range(25)]
    base = rng.choices(vocab, k=250)
    for _ in range(12):
        copy = list(base)
        copy[rng.randrange(250)] = rng.choice(vocab)
        texts.append(" ".join(copy))
    return [*texts, texts[3], texts[3].upper(), None, "", " \t\n", "a", "A", "b c d e\x85f", "Éa é", "q " * 3000]


def test_fingerprints_and_components_equal_the_plain_definition(spark):
    texts = corpus()
    ids = [7 * (k * 31 % len(texts)) for k in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, fp int, node string")
    rows = {r.doc_id: r for r in simhash_components(docs).collect()}
    prints = [plain(t) for t in texts]
    assert [rows[i].fingerprint for i in ids] == [f"{p:016x}" for p in prints]
    assert [rows[i].component_id for i in ids] == reach(ids, prints)


def test_null_and_repeated_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (9, "A b c d")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash_components(docs).collect())
    assert got == [(0, None), (5, 5), (5, 5), (9, 5)]
    assert simhash_components(docs.limit(0)).collect() == []
    kept = sorted((r.doc_id or 0) for r in one_of_each(docs).collect())
    assert kept == [0, 5]
    assert one_of_each(docs.limit(0)).columns == docs.columns


@pytest.mark.parametrize("cell", [4, 2048])
def test_links_are_complete_in_small_and_large_cells(spark, cell):
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    near = codes[:30].copy()
    for k in range(30):
        for b in rng.choice(64, 4, replace=False):
            near[k] ^= np.uint64(1) << np.uint64(b)
    every = np.unique(np.concatenate([codes, near]))
    nodes = spark.createDataFrame([(i, int(c)) for i, c in enumerate(every.view(np.int64))], "node long, fp long")
    root = {r.node: r.root for r in components(link_codes(nodes, 4, cell)).collect()}
    got = [root.get(i, i) for i in range(len(every))]
    assert got == reach(list(range(len(every))), [int(c) for c in every])


def test_gray_neighbours_differ_in_one_bit_and_index_finds_all_pairs():
    codes = np.arange(64, dtype=np.uint64)
    order = codes[np.argsort(gray_rank(codes))]
    assert set(np.bitwise_count(order[1:] ^ order[:-1]).tolist()) == {1}
    rng = np.random.default_rng(5)
    some = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64) << np.uint64(50))
    cells = np.zeros(len(some), np.int64)
    found = {tuple(sorted(p)) for i, j in GrayIndex(cells, some).links(3) for p in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(i, j) for i in range(len(some)) for j in range(i + 1, len(some)) if bin(int(some[i] ^ some[j])).count("1") <= 3}
    assert found == want


def test_long_text():
    assert fingerprint("x y z " * 50_000) == plain("x y z " * 50_000)


def test_near_copies_of_eight_tenths_go_and_others_stay(spark):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(80, 300))) for _ in range(40)]
    originals = len(texts)
    for base in range(0, 30):
        for changes in (1, 2, 3, 25):
            words = texts[base].split()
            for at in rng.sample(range(len(words)), min(changes, len(words))):
                words[at] = rng.choice(vocab)
            texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, _row string")
    sets = [shingles(t, 5) for t in texts]
    kept = {r.doc_id for r in one_of_each(docs.drop("_row")).collect()}
    assert set(range(originals)) <= kept
    copies = [i for i in range(originals, len(texts)) if any(similarity(sets[i], sets[j]) >= 0.8 for j in range(i))]
    clean = [i for i in range(originals, len(texts)) if all(similarity(sets[i], sets[j]) < 0.8 for j in range(len(texts)) if j != i)]
    assert len(copies) > 50 and len(clean) > 20
    assert sum(i in kept for i in copies) <= 0.05 * len(copies)
    assert set(clean) <= kept


def groups_of(texts):
    """First numbers of the groups linked by 4 bits or by similarity of 0.8."""
    root = list(range(len(texts)))
    prints, sets = [fingerprint(t) for t in texts], [shingles(t, 5) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and (bin(prints[i] ^ prints[j]).count("1") <= 4 or similarity(sets[i], sets[j]) >= 0.8):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return set(root)


def crowd(rng, short):
    """Texts of one vocabulary in other orders, each with a true copy: word prints are close, texts are not."""
    vocab = [f"v{k}" for k in range(30 if short else 80)]
    texts = []
    for _ in range(60):
        words = list(vocab)
        rng.shuffle(words)
        texts.append(" ".join(words))
    return texts + [" ".join([*t.split()[:-1], "other"]) for t in texts]


@pytest.mark.parametrize("short", [True, False])
def test_copies_in_a_crowd_of_like_words_all_go(spark, short):
    texts = crowd(random.Random(21), short)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in one_of_each(docs).collect()} == groups_of(texts) == set(range(60))


@pytest.mark.parametrize("cell", [3, 2048])
def test_join_of_sets_is_exact_at_the_bound(spark, cell):
    from tidemark.llm import setjoin

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 40, n).astype(np.uint64)) for n in rng.integers(1, 60, 40)]
    for base in sets[:40]:  # sets that share 7 to 10 tenths
        for share in (0.7, 0.8, 0.88, 0.9, 1.0):
            kept = base[rng.random(len(base)) < share]
            sets.append(np.unique(np.append(kept, rng.integers(0, 1 << 40, len(base) - len(kept)).astype(np.uint64))))
    common = (np.unique(np.concatenate(sets[:5])), np.arange(len(np.unique(np.concatenate(sets[:5])))))
    rows = [(i, i, len(x), [int(v) for v in setjoin.prefix(x, common, 0.8)], bytearray(setjoin.parity(x))) for i, x in enumerate(sets)]
    items = spark.createDataFrame(rows, "node long, root long, n long, prefix array<long>, map binary")

    def check(pairs):
        good = [(r.a, r.b) for r in pairs.collect() if similarity(sets[r.a], sets[r.b]) >= 0.8]
        return spark.createDataFrame(good, "a long, b long")

    got = {r.node: r.root for r in setjoin.linked(items, check, 0.8, cell).collect()}
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert got == dict(enumerate(root))


def test_links_over_members_that_are_not_first_count(spark):
    rng = random.Random(31)
    vocab = [f"u{k}" for k in range(3000)]
    texts = []
    for _ in range(12):  # chains: each text is similar to the one before, few to the first
        words = rng.choices(vocab, k=120)
        for _ in range(7):
            texts.append(" ".join(words))
            words = list(words)
            for at in rng.sample(range(110), 2):
                words[at] = rng.choice(vocab)
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in one_of_each(docs).collect()} == groups_of(texts)


def test_a_similar_text_of_a_member_that_is_not_first_goes(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tidemark.llm import simhash

    rng = random.Random(5)
    first, member = (" ".join(rng.choices([f"z{k}" for k in range(900)], k=60)) for _ in range(2))
    copy = " ".join([*member.split()[:-1], "end"])
    codes = [int(np.uint64(fingerprint(x)).view(np.int64)) for x in (first, member)]
    # the first two texts are taken as linked by their codes
    monkeypatch.setattr(simhash, "link_codes", lambda nodes, most: nodes.where(F.col("fp").isin(codes)).agg(F.max("node").alias("a"), F.min("node").alias("b")))
    docs = spark.createDataFrame([(0, first), (1, member), (2, copy), (3, member)], "doc_id long, text string")
    assert {r.doc_id for r in one_of_each(docs).collect()} == {0}


def test_clashing_column_names_and_types_stay(spark):
    rows = [(i, "some text of words number " + "abc"[i % 3], i, [i], None if i else 1.5) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int, _fp array<int>, `doc` double").withColumns({"_wp": F.lit(5), "_map": F.lit("m"), "root": F.lit(1), "node": F.lit(2), "id": F.lit("x"), "a b.c": F.lit(3)})
    out = one_of_each(docs)
    assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
    got = sorted(out.collect(), key=lambda r: r.doc_id)
    assert [tuple(r) for r in got] == [tuple(r) for r in sorted(docs.collect(), key=lambda r: r.doc_id) if r.doc_id < 3]


@pytest.mark.parametrize("cell", [4, 2048])
def test_every_similar_pair_of_a_crowd_is_joined_in_cells_of_any_size(spark, cell):
    """One common passage puts all sets into the same cells; pairs are found whichever chunks they lie in."""
    rng = random.Random(31)
    passage = [f"common{k}" for k in range(12)]
    texts = []
    for _ in range(40):
        own = [f"w{rng.randrange(10_000)}" for _ in range(rng.randint(5, 60))]
        texts.append(" ".join(passage + own))
        for _ in range(rng.randint(0, 2)):
            copy = list(own)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(passage + copy))
    sets = [shingles(t, 5) for t in texts]
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))  # no order that keeps the passage out of the prefixes
    rows = [(i, i, len(s), prefix(s, none, 0.8).view(np.int64).tolist(), bytearray(parity(s))) for i, s in enumerate(sets)]
    items = spark.createDataFrame(rows, "node long, root long, n long, prefix array<long>, map binary")
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if similarity(sets[a], sets[b]) >= 0.8]
    good = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.root for r in linked(items, lambda found: found.join(good, ["a", "b"], "left_semi"), 0.8, cell).collect()}
    want = list(range(len(texts)))
    for a, b in sorted(pairs):
        x, y = want[a], want[b]
        want = [min(x, y) if r in (x, y) else r for r in want]
    assert len(pairs) > 10 and [got[i] for i in range(len(texts))] == want


def test_long_rows_go_to_workers_a_few_at_a_time(spark):
    """``stage`` and ``at_once`` bound a worker's batches and leave the session as it was; the near-copy stage's texts use it."""
    import pyarrow as pa

    from tidemark.llm import common

    def sizes(batches):
        for rows in batches:
            yield pa.RecordBatch.from_arrays([pa.array([rows.num_rows])], ["n"])

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    made = spark.range(100, numPartitions=1).mapInArrow(sizes, "n long")
    got = [r.n for r in common.stage(made, 7).collect()]
    assert max(got) == 7 and sum(got) == 100
    assert spark.conf.get(name) == before


def test_texts_that_are_in_no_pair_are_not_dealt_out(spark):
    """Only the texts of pairs that are checked go through a shuffle, and none goes to leave out copies."""
    rng = random.Random(7)
    texts = [[rng.randbytes(250).hex() for _ in range(40)] for _ in range(300)]
    texts += [[*t[:-1], rng.randbytes(250).hex()] for t in texts[:5]]
    rows = [*[(k, " ".join(t)) for k, t in enumerate(texts)], (None, "no id"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(k).totalShuffleWrite() for k in range(found.length()))

    docs = stage(docs)
    before = written()
    got = one_of_each(docs).select("doc_id", F.length("text").alias("n")).collect()
    assert written() - before < sum(len(t) for _, t in rows if t) / 8
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n or 0) for r in got) == sorted([*[(False, k, len(t)) for k, t in rows[:300]], (True, 0, 5)] + [(False, 7, 0)])


def test_rows_named_by_their_number_are_found_exactly(spark):
    rng = random.Random(8)
    numbers = [p << 33 | k for p in (0, 1, 5) for k in range(200)]
    for wanted in ([], [63], [0, 64, (1 << 33) + 63, (5 << 33) + 199], rng.sample(numbers, 300), numbers, [*numbers[:3], *numbers[:3], 999]):
        rows = spark.createDataFrame([(n, str(n)) for n in numbers], "_row long, text string")
        got = simhash._named(rows, spark.createDataFrame([(n,) for n in wanted], "_row long"))
        assert got.columns == ["_row", "text"]
        assert sorted((r._row, r.text) for r in got.collect()) == [(n, str(n)) for n in numbers if n in set(wanted)]
