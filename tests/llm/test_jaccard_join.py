import random
from itertools import combinations

import numpy as np
import pytest

from cases import WORDS, documents, no_documents, odd_documents, split
from feedlake.llm import jaccard_join as J

VOCABULARY = [f"{a}{b}" for a in WORDS for b in WORDS]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, size):
    w = split(lower(text))
    return frozenset(tuple(w[i:i + size]) for i in range(max(len(w) - size + 1, 1))) if w else frozenset()


def links(a, b, percent):
    return bool(a) and 100 * len(a & b) >= percent * len(a | b)


def brute_force(rows, rule):
    """(id, set size, smallest id reachable) per row, all pairs compared."""
    sets = [shingle_set(t, rule.size) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and links(sets[i], sets[j], rule.percent):
            up[find(j)] = find(i)
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        root = find(i)
        best[root] = min((x for x in (doc_id, best.get(root)) if x is not None), default=None)
    return sorted(((d, len(s), best[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def result(docs, rule):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.link_documents(docs, rule).collect()), key=str)


def near_copies(seed, n, edits, length=80):
    """Copies of one text with some words replaced: links, near misses and chains of links."""
    rng = random.Random(seed)
    text = [rng.choice(VOCABULARY) for _ in range(length)]
    out = []
    for _ in range(n):
        copy = list(text)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(length)] = rng.choice(VOCABULARY)
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("rule", [J.Rule(), J.Rule(5, 80)])
def test_documents(spark, rule):
    docs = documents(spark)
    assert result(docs, rule) == brute_force([(r.doc_id, r.text) for r in docs.collect()], rule)


def test_odd_rows_and_ties(spark):
    docs = odd_documents(spark)
    assert result(docs, J.Rule()) == brute_force([(r.doc_id, r.text) for r in docs.collect()], J.Rule())
    assert result(no_documents(spark), J.Rule()) == []


def test_large_parts_in_tiles(spark, monkeypatch):
    texts = near_copies(1, 70, 4) + near_copies(2, 40, 3) + near_copies(3, 30, 6, 300) + [" ".join(WORDS)] * 5
    rows = [*enumerate(texts), (3, texts[8]), (None, texts[9])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_force(rows, J.Rule())
    assert 3 < len({c for _, _, c in want}) < len(rows) - 20
    assert result(docs, J.Rule()) == want
    monkeypatch.setattr(J, "TILE_NODES", 8)
    assert result(docs, J.Rule()) == want


def test_bound_never_prunes_a_link():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 60)).astype(np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, max(1, len(a) - rng.integers(0, 4)), False), rng.integers(0, 1 << 63, rng.integers(0, 4)).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        assert np.minimum(J.point(a), J.point(b)).sum() >= common
        assert (100 * common >= 85 * len(np.union1d(a, b))) == (common >= J.Rule().needed(len(a), len(b)))


def test_keep_one(spark):
    docs = odd_documents(spark)
    kept = J.keep_one(docs, J.Rule(5, 80))
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    # 9, 10 and a null id share their words, 6 and 7 nearly all; rows without words stay.
    assert ids == [(False, i) for i in (1, 2, 3, 4, 5, 6, 8, 9, 11)] + [(True, 0)]
    assert J.keep_one(no_documents(spark), J.Rule()).count() == 0


def test_components_store_one_table_a_round(spark, monkeypatch):
    """A long chain: labels double their way in every round, and each round is one stored table."""
    from feedlake.llm import components as C

    stored = []
    monkeypatch.setattr(C, "materialize", lambda df, keep=C.materialize: stored.append(1) or keep(df))
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (200, 200)], "a LONG, b LONG")
    found = {r.node: r.label for r in C.components(edges).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 200: 200}
    assert len(stored) <= 2 + 8
