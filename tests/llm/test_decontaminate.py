import random

from tidemark.llm.decontaminate import WINDOW, consistent, contamination, decontaminated, template

ITEM = "A train leaves Boston at 60 km per hour and another train leaves Denver at 80 km per hour after 3 hours of waiting"


def rows(df):
    return {(r.doc_id, r.item_id): r for r in df.collect()}


def test_template_slots():
    shape, values = template("Then Anna ran 5 km. She saw 3.5 kg OF it in 1/2 day")
    assert shape == ["then", "<name>", "ran", "<num>", "<unit>", "she", "saw", "<num>", "<unit>", "of", "it", "in", "<num>", "<unit>"]
    assert values[1] == "anna" and values[7] == "3.5" and values[12] == "1/2"
    assert template("") == ([], [])


def test_numbers_in_words_and_german_nouns():
    assert template("He bought twelve kg of it and one more")[0] == ["he", "bought", "<num>", "<unit>", "of", "it", "and", "one", "more"]
    german = "Wie viele Liter passen in das Becken und die Wanne, wenn Anna 12 l nimmt?"
    assert "<name>" not in template(german)[0] and "becken" in template(german)[0]
    assert "<name>" in template(german, nouns=False)[0]
    assert template("Then Anna ran. Das ist ein Haus und der Baum")[0][1] == "<name>"  # each sentence for itself


def test_an_item_slot_has_one_value():
    assert consistent([("3", "4"), ("5", "6"), ("3", "4")])
    assert not consistent([("3", "4"), ("3", "5")])
    assert consistent([("3", "4"), ("5", "4")])  # two of the text's values are equal by chance


def test_verbatim_cased_and_reparameterised_items_are_found(spark):
    rng = random.Random(1)
    noise = lambda n: " ".join(rng.choices(["lorem", "ipsum", "dolor", "sit", "amet", "train", "leaves", "hour"], k=n))
    other = ITEM.replace("Boston", "Paris").replace("Denver", "Rome").replace("60", "45").replace("80", "90").replace("3 hours", "7 hours")
    mixed = ITEM.replace("Boston", "Paris").replace("Denver", "Paris")
    docs = [
        (1, f"{noise(60)} {ITEM} {noise(60)}"), (2, f"{noise(60)} {ITEM.upper()} {noise(9)}"), (3, f"{noise(30)}\n{ITEM.lower()}"), (4, other), (5, noise(400)), (6, None), (7, ""),
        (8, mixed), (9, " ".join(ITEM.split()[:6])), (10, f"{noise(20000)} {other} {noise(20000)}"), (11, ITEM.replace(" ", "\n  ")),
    ]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, coverage int, item string")
    bench = spark.createDataFrame([(100, ITEM, "x"), (101, None, "x"), (102, "", "x"), (103, "other words entirely without any overlap with what the texts say here", "x")], "item_id long, text string, id string")
    got = rows(contamination(df, bench))
    assert set(got) == {(k, 100) for k in (1, 2, 3, 4, 8, 10, 11)}
    assert [got[k, 100].verbatim for k in (1, 2, 3, 4, 10, 11)] == [True, True, True, False, False, True]
    assert got[1, 100].n_matched == got[1, 100].n_windows == len(template(ITEM)[0]) - WINDOW + 1
    assert got[4, 100].n_changed == 5
    assert sorted(r.doc_id for r in decontaminated(df, bench).collect()) == [5, 6, 7, 9]
    # a benchmark taken in blocks gives the same
    assert set(rows(contamination(df, bench, block_bytes=20))) == set(got)
    assert sorted(r.doc_id for r in decontaminated(df, bench, block_bytes=20).collect()) == [5, 6, 7, 9]


def test_neighbouring_and_edited_forms(spark):
    other = ITEM.replace("60", "45").replace("80", "90").replace("3 hours", "7 hours")
    words = ITEM.split()
    longer = " ".join([*words[:14], "well", "extra", "padding", *words[14:]])
    docs = spark.createDataFrame([(1, f"{other} {ITEM}"), (2, f"{ITEM}. {other}. {other}"), (3, longer)], "doc_id long, text string")
    bench = spark.createDataFrame([(100, ITEM)], "item_id long, text string")
    assert set(rows(contamination(docs, bench))) == {(1, 100), (2, 100), (3, 100)}


def test_every_embedded_item_is_found_and_no_other(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(12, 40)))) for i in range(30)]
    docs, want = [], set()
    for d in range(80):
        parts = rng.choices(vocab, k=rng.randint(0, 200))
        if d % 2:
            item = rng.choice(items)
            parts.insert(rng.randint(0, len(parts)), item[1])
            want.add((d, item[0]))
        docs.append((d, " ".join(parts)))
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert set(rows(got)) == want


def test_empty_tables_repeated_rows_null_ids(spark):
    docs = spark.createDataFrame([(None, ITEM), (1, ITEM), (1, ITEM)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id int, text string")
    assert sorted((r.doc_id or 0) for r in contamination(docs, bench).collect()) == [0, 1, 1]
    assert contamination(docs.limit(0), bench).collect() == []
    assert contamination(docs, bench.limit(0)).collect() == []
    assert decontaminated(docs, bench.limit(0)).count() == 3


def test_items_of_many_slots(spark):
    table = "Scores were 3 5 8 13 21 34 55 89 144 233 377 610 for Anna Berta Carla Dora"
    items = [(1, "What is 12 + 15 * 3 - 7?"), (2, table), (3, "4 8 15 16 23 42"), (4, "7")]
    changed = table.replace("13", "14").replace("610", "999").replace("Dora", "Emma")
    docs = [
        (1, "Some words first. What is 12 + 15 * 3 - 7? And more."), (2, "Then. What is 9 + 4 * 2 - 1?"), (3, f"some words. {table}"), (4, f"Some words. {changed}. More."),
        (5, "the numbers 4 8 15 16 23 42 again"), (6, "the numbers 1 2 3 5 6 7 again"), (7, "What is 9 + 4 * 9 - 1?"),
        (8, "Scores were 1 2 3 4 5 6 in one game"), (9, "row " + " ".join(map(str, range(400, 900)))), (10, "7 and 12 and 15"),
    ]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = rows(contamination(df, bench))
    assert set(got) == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 3), (7, 1)}
    assert [got[k].verbatim for k in sorted(got)] == [True, False, True, False, True, False]
    assert sorted(r.doc_id for r in decontaminated(df, bench).collect()) == [6, 8, 9, 10]


def test_equal_and_contradictory_values(spark):
    item = "The shop sold 12 red boxes on the first day and 7 blue boxes on the last, then 12 red boxes went back"
    equal, other = (item.replace("12", a).replace(" 7 ", f" {b} ") for a, b in (("9", "9"), ("nine", "four")))
    against = item.replace("12", "9", 1)  # the same slot has two values
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame([(1, f"Well. {equal}."), (2, f"Well. {other}."), (3, f"Well. {against.replace('12', '8')}.")], "doc_id long, text string")
    assert set(rows(contamination(df, bench))) == {(1, 1), (2, 1)}


def test_windows_against_a_plain_count(spark):
    """Items of words alone: as many windows at one distance must be found, fewer in the whole text must not be."""
    rng = random.Random(9)
    vocab = [f"w{chr(97 + k)}{chr(97 + k % 7)}" for k in range(12)]
    items = [(i, rng.choices(vocab, k=rng.randint(10, 20))) for i in range(12)]
    docs = []
    for d in range(150):
        words = rng.choices(vocab, k=rng.randint(0, 30))
        own = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = rng.choice(vocab)
        at = rng.randint(0, len(words))
        docs.append((d, words[:at] + own + words[at:]))
    got = set(rows(contamination(spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id int, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id int, text string"))))
    for d, text in docs:
        for i, item in items:
            n = len(item) - WINDOW + 1
            at = [(a, b) for a in range(len(text) - WINDOW + 1) for b in range(n) if text[a : a + WINDOW] == item[b : b + WINDOW]]
            at_one = max((len({b for a, b in at if a - b == far}) for far in {a - b for a, b in at}), default=0)
            if at_one >= 0.5 * n:
                assert (d, i) in got
            if len({b for _, b in at}) < 0.5 * n:
                assert (d, i) not in got
    assert len(got) > 50


def test_few_counted_windows_are_not_the_item(spark):
    item = "the sum of all the first few 11 12 13 14 15 16 17 18 19 20 21 22"
    clean = "we add the sum of all the first few 90 91 of them"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame([(1, clean), (2, f"here {item}"), (3, f"{item.replace('19', '77')} end")], "doc_id long, text string")
    assert set(rows(contamination(df, bench))) == {(2, 1), (3, 1)}


def test_changes_outside_of_the_windows_found_are_reported(spark):
    """A name at a sentence's start and a unit that turns into a word hide the windows that they are in; ends, insertions and cuts."""
    item = "Maria has 12 red boxes in the old shop near the river. Maria sells each of them for 3 euros to a friend who lives next door and comes by on most of the days"
    words = item.split()
    forms = {
        1: item, 2: "Anna" + item[5:], 3: item.replace("3 euros", "4 złoty"), 4: item.replace("river. Maria", "river. Anna"), 5: item.replace("days", "nights"),
        6: item.replace("old shop", "old little shop"), 7: " ".join(words[12:]), 8: item.replace("12", "9"), 9: "Anna" + item[5:].replace("12", "15").replace("3 euros", "4 złoty"),
    }
    docs = [(k, f"Some words before it here. {t}. And what comes then.") for k, t in forms.items()]
    docs += [(20, f"{item.split('. ')[1]}"), (21, None), (22, "")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = rows(contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench))
    assert {k[0]: v.n_changed for k, v in got.items()} == {1: 0, 2: 1, 3: 2, 4: 1, 5: 1, 6: 1, 7: 0, 8: 1, 9: 4, 20: 0}
    assert {k[0] for k, v in got.items() if v.verbatim} == {1, 7, 20}


def test_changes_against_a_plain_alignment(spark):
    """Items of words with single ones replaced, far from each other: each is counted, and no token around the item is."""
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]
    items, docs, want = [(i, rng.sample(vocab, 60)) for i in range(10)], [], {}
    for d in range(60):
        item, own = rng.choice(items)
        places = rng.sample([0, 25, 59], rng.randint(0, 3))
        text = ["zz" if k in places else w for k, w in enumerate(own)]
        docs.append((d, " ".join(rng.choices(vocab, k=rng.randint(0, 50)) + text + rng.choices(vocab, k=rng.randint(0, 50)))))
        want[d, item] = len(places)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    assert {k: r.n_changed for k, r in rows(contamination(df, bench)).items()} == want
