import random

import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm.token_counts import lengths, split_safely, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(4)
    words = ["the", "Hello", "été", "naïve", "日本語", "x" * 40, "a,b", "1234567", "<s>", "</s>", "▁", "👍🏽", "don't", "\t", "\n", "  ", " ", "​"]
    long = [rng.choice([" ", " ", "  ", "\n", " ▁", ""]).join(rng.choice(words) for _ in range(n)) for n in (5, 200, 9000, 30000)]
    return [*long, None, "", " ", "   lead", "trail  ", "a" * 60_000, " ".join(rng.choice(words) for _ in range(20_000)), "<unk> <s>"]


def test_equals_the_library_on_whole_texts(spark, sp):
    rows = [(i, t, "clash", i) for i, t in enumerate(texts())] + [(None, "null id", "x", 0), (0, "again", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, id int")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens), r.n_bytes, r.over_limit) for r in token_counts(docs).collect())
    want = sorted(((i is None, i or 0, len(sp.encode(t or ""))), len((t or "").encode()), len(sp.encode(t or "")) > 4096) for i, t, *_ in rows)
    assert got == want
    assert any(x[2] for x in got)


@pytest.mark.parametrize("chunk", [1, 7, 100, 3000])
def test_parts_add_up(sp, chunk):
    some = [t for t in texts() if t]
    assert lengths(some, PATH, chunk, 5000) == [len(x) for x in sp.encode(some)]
    assert max(len(split_safely(t, chunk)) for t in some) > 1


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
