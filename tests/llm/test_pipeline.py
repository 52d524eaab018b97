"""Each stage of the pipeline against brute force on its own input."""

from collections import Counter

import pytest

import corpus_pipeline as P
from cases import SF, documents, odd_documents
from feedlake.llm import mixing, quality_rules
from feedlake.session import materialize
from test_decontaminate import brute_force as passages
from test_jaccard_join import brute_force as groups


@pytest.fixture(scope="module")
def tables(spark):
    """What every stage gets and gives, as stored."""
    out = [documents(spark)]
    for _, stage in P.STAGES:
        out.append(materialize(stage(spark, out[-1], SF)))
    return out


def rows(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_columns(tables):
    assert all(t.columns == tables[0].columns for t in tables[:-1])
    assert [name for name, _ in P.STAGES] == [
        "quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights",
        "token-ID / binary output",
    ]


def test_quality_rules(spark, tables):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = quality_rules.judge(tables[0].select("doc_id", "text"), quality_rules.train(tables[0], labels)).collect()
    assert {i for i, _ in rows(tables[1])} == {r.doc_id for r in judged if r.kept}
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert 0 < len(bad & {r.doc_id for r in judged if not r.kept})


def test_near_copies(tables):
    texts = [(r.doc_id, r.text) for r in tables[1].collect()]
    assert {i for i, _ in rows(tables[2])} == {component for _, _, component in groups(texts, P.NEAR)}


def test_benchmark(spark, tables):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = [(r.doc_id, r.text) for r in tables[2].collect() if len(r.text) < 12_000]
    found = {i for i, _ in passages(texts, items[:8])}
    assert not found & {i for i, _ in rows(tables[3])}
    gone = {i for i, _ in rows(tables[2])} - {i for i, _ in rows(tables[3])}
    whole = [(i, t) for i, t in ((r.doc_id, r.text) for r in tables[2].collect()) if i in gone]
    assert {i for i, _ in passages(whole, items)} == gone


def test_mix(tables):
    copies = {r.doc_id: r.copies for r in mixing.copy_counts(tables[3]).collect()}
    got = Counter({i: n for (i, _), n in rows(tables[4]).items()})
    assert got == +Counter(copies)


def test_tokens(spark, tables):
    assert Counter(r.doc_id for r in tables[5].collect()) == Counter({i: n for (i, _), n in rows(tables[4]).items()})
    run = P.run(spark, SF)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, tables[5].collect()))


def test_stages_take_odd_rows(spark):
    docs = odd_documents(spark)
    for _, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF))
        assert docs.columns == odd_documents(spark).columns
    assert P.STAGES[-1][1](spark, docs, SF).count() == docs.count()
