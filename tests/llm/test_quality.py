import random
import re
from collections import Counter
from math import log2

from tidemark.llm.quality import LEAST_PRECISION, MAX_CONDITIONS, SHARES, STATS, Condition, case_when, learn, quality_rules, text_statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    again = {i + d for i, w in enumerate(windows) if times[w] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def corpus():
    rng = random.Random(4)
    bits = ["a", "b", "c", "dé", "👍x", "#|", "A<b>", "\n", "\r\n", "\t", "\x0b", "\x0c", "\xa0", " ", "\x1c", "  ", "%%", "9"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    long = " ".join(f"w{rng.randrange(3000)}" for _ in range(60_000))
    return [*texts, None, "", " \n ", "x", "a b c", "a b c a b c", "a a a a", "a a a", long, "same words here " * 50_000, "y" * 1_000_000]


def test_base_columns_equal_plain_ones(spark):
    texts = corpus()
    rows = {r.id: r for r in text_statistics(spark.createDataFrame([(i, t, "w", 0) for i, t in enumerate(texts)], "doc_id int, text string, words string, bits int")).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t), t and t[:80]


def test_places_survive_equal_hash_parts(spark):
    """Texts whose windows all differ, and one pair far apart."""
    words = [f"v{k}" for k in range(30_000)]
    far = [*words, *words[5:8]]
    got = {r.id: r.n_repeat_words for r in text_statistics(spark.createDataFrame([(1, " ".join(words)), (2, " ".join(far))], "doc_id int, text string")).collect()}
    assert got == {1: 0, 2: 6}


def plain_learn(rows, max_rules=16):
    """Sequential covering over a list of rows, every condition tried by counting the rows anew."""

    def quantile(values, share):
        values = sorted(values)
        at = share * (len(values) - 1)
        low = int(at)
        high = min(low + 1, len(values) - 1)
        return values[low] if at == low else (high - at) * values[low] + (at - low) * values[high]

    cuts = {}
    for c in STATS:
        at = sorted({quantile([r[c] for r in rows if r["bad"] == k], s) for k in (0, 1) for s in SHARES})
        cuts[c] = sorted({*at, *((a + b) / 2 for a, b in zip(at, at[1:]))})

    def holds(rule, r):
        return all(r[c.stat] > c.cut if c.above else r[c.stat] <= c.cut for c in rule)

    def tally(rule, part):
        return sum(r["bad"] for r in part if holds(rule, r)), sum(1 - r["bad"] for r in part if holds(rule, r))

    rules, left = [], rows
    while len(rules) < max_rules:
        rule, part = (), [r for r in left if not r["prune"]]
        while len(rule) < MAX_CONDITIONS:
            bad, good = tally(rule, part)
            best, found = 0.0, None
            if bad and good:
                for stat in STATS:
                    for above in (False, True):
                        seen = [(tally((*rule, Condition(stat, above, cut)), part), cut) for cut in cuts[stat]]
                        for p, n in dict.fromkeys(x for x, _ in seen):
                            gain = p * (log2(p / (p + n)) - log2(bad / (bad + good))) if p else 0.0
                            if gain > best + 1e-9:
                                same = [cut for x, cut in seen if x == (p, n)]
                                best, found = gain, Condition(stat, above, same[len(same) // 2])
            if found is None:
                break
            rule = (*rule, found)
        if not rule:
            break
        judge = [r for r in left if r["prune"]]
        counts = [tally(rule[: k + 1], judge) for k in range(len(rule))]
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in counts]
        k = worth.index(max(worth))
        if not counts[k][0] or counts[k][0] < LEAST_PRECISION * sum(counts[k]):
            break
        rules.append(rule[: k + 1])
        left = [r for r in left if not holds(rules[-1], r)]
    return rules


def test_list_equals_plain_covering(spark):
    rng = random.Random(12)
    rows = []
    for _ in range(250):
        r = {c: rng.choice([0.0, rng.random(), rng.randrange(5) / 4]) for c in STATS}
        bad = r["symbol_share"] > 0.6 and r["upper_share"] <= 0.7 or r["n_words"] < 0.1 and r["line_words"] > 0.4
        rows.append({"bad": int(bad) if rng.random() > 0.03 else int(not bad), "prune": rng.random() < 0.33, **r})
    schema = "bad int, prune boolean, " + ", ".join(f"{c} double" for c in STATS)
    got = learn(spark.createDataFrame([tuple(r.values()) for r in rows], schema))
    assert got == plain_learn(rows)
    assert len(got) >= 2 and {c.stat for c in got[0] + got[1]} & {"symbol_share", "n_words"}


def labelled_docs(n=600):
    rng = random.Random(5)
    docs, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 120))]
        bad = rng.random() < 0.2
        if bad:
            words = [w + rng.choice(["###", "|"]) for w in words] if rng.random() < 0.5 else [w.upper() + "!!" for w in words]
        docs.append((k, " ".join(words)))
        if k % 3 != 1:
            labels.append((k, int(not bad)))
    return docs, labels, {d for d, t in docs if "#" in t or "|" in t or "!!" in t}


def test_unlabelled_rows_are_judged(spark):
    docs, labels, bad = labelled_docs()
    rows, rules = quality_rules(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(labels, "doc_id int, quality int"))
    got = {r.doc_id: r for r in rows.collect()}
    rejected = {k for k, r in got.items() if not r.kept}
    assert rejected <= bad and len(bad - rejected) <= 2  # thresholds are learned from two thirds of the rows
    # the conditional expression as SQL gives the same
    assert {r.doc_id: r.v for r in rows.selectExpr("doc_id", f"{case_when(rules)} as v").collect()} == {k: r.rule for k, r in got.items()}


def test_edges(spark):
    long = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, None), (1, long), (1, long), (None, long), (2, "short text"), (3, "one two three " * 40)], "doc_id int, text string")
    none = spark.createDataFrame([(1, None), (None, 0)], "doc_id int, quality int")
    rows, rules = quality_rules(docs, none)
    assert rules == []
    assert sorted((r.doc_id or 0, r.base_failed, r.kept) for r in rows.collect()) == [(0, False, True), (1, False, True), (1, False, True), (1, True, False), (2, True, False), (3, True, False)]
    assert quality_rules(docs.limit(0), none)[0].collect() == []
    twice = spark.createDataFrame([(1, 1), (1, 0), (2, 1)], "doc_id int, quality int")
    assert quality_rules(docs, twice)[1] == []
