from collections import Counter

import pytest

from cases import SF, documents, no_documents, odd_documents, split
from feedlake.llm import mixing
from feedlake.llm.oracles import LLM_ORACLES
from feedlake.llm.queries import LLM_QUERIES
from oracle_check import differences, duck


def shares(sizes, cycle=(1, 2, 3), most=3):
    """Targets by sharing and sharing again, one round at a time."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    target, free = {}, set(names)
    while free:
        left = sum(sizes.values()) - sum(target.values())
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= most * sizes[s]}
        target |= {s: most * sizes[s] for s in full or free} if full else {s: level * weight[s] for s in free}
        free = free - full if full else set()
    return target


def test_query_matches_sql(spark):
    assert differences(LLM_QUERIES["op2_mix_sources"](spark, SF), duck(SF), LLM_ORACLES["op2_mix_sources"]) is None


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 7, "é": 300}, {"a": 0, "b": 0}, {"x": 4}, {"a": 0, "b": 9, "c": 9}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(shares(sizes))


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = mixing.copy_counts(docs).collect()
    assert len(rows) == docs.count()
    sizes = Counter()
    for d in docs.collect():
        sizes[d.source] += len(split(d.text))
    assert {r.source: r.source_size for r in rows} == dict(sizes)
    assert all(0 <= r.copies <= 3 for r in rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in rows:
        want[(r.doc_id, r.size)] += r.copies
    assert Counter((r.doc_id, len(split(r.text))) for r in mixed.collect()) == +want


def test_reruns_agree_and_targets_are_met(spark):
    docs = documents(spark)
    first, second = (sorted(mixing.copy_counts(docs.repartition(n)).collect()) for n in (1, 7))
    assert first == second
    taken, target = sum(r.size * r.copies for r in first), sum({r.source: r.target for r in first}.values())
    assert abs(taken / target - 1) < 0.25


def test_empty_table(spark):
    assert mixing.copy_counts(no_documents(spark)).count() == 0
    assert mixing.mix(no_documents(spark)).count() == 0
