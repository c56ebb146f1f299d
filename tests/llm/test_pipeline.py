"""Each stage against a plain version on its own input."""

import pytest

import corpus_pipeline
from tidemark.llm.common import stage
from tidemark.llm.decontaminate import contamination
from tidemark.llm.mixing import mix
from tidemark.llm.queries import QUERIES
from tidemark.llm.simhash import shingles, similarity, simhash_components
from tidemark.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"


def first_of_groups(docs):
    """The first of each group linked by SimHash or by sets of shingles similar by 0.8, every two texts compared."""
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    root = {r.doc_id: r.component_id for r in simhash_components(docs).collect()}
    sets = {i: shingles(t, 5) for i, t in text.items()}
    for i in sorted(text):
        for j in sorted(text):
            if j < i and root[i] != root[j] and similarity(sets[i], sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    return sorted(set(root.values()))


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    plain = [
        lambda d: sorted(r.doc_id for r in toxicity(d, labels).collect() if not r.rejected),
        first_of_groups,
        lambda d: sorted(set(ids(d)) - {r.doc_id for r in contamination(d, bench).collect()}),
        lambda d: sorted(r.doc_id for r in mix(d).collect() if r.selected),
    ]
    for (name, step), want in zip(corpus_pipeline.STAGES, plain, strict=False):
        out = stage(step(spark, docs, SF))
        assert out.columns == docs.columns, name
        assert ids(out) == want(docs), name
        assert 0 < out.count() <= docs.count()
        docs = out
    name, step = corpus_pipeline.STAGES[-1]
    assert ids(step(spark, docs, SF)) == ids(docs)
    assert ids(corpus_pipeline.run(spark, SF)) == ids(docs)


def test_stages_take_empty_and_null_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "src0", 0), (1, "", "en", "src0", 0), (2, "a few words", "de", None, 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, step in corpus_pipeline.STAGES:
            docs = stage(step(spark, docs, SF))
            docs.count()


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run_on_the_smallest_tables(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_topk_equals_its_sql(spark):
    from tests.oracle import connect, differences
    from tidemark.llm.queries import ORACLE_SQL

    assert differences(QUERIES["op9_topk"](spark, SF), ORACLE_SQL["op9_topk"], connect(SF)) == ""
