"""Language identification, the quality classifier and the quality rules."""

import zlib
from itertools import combinations

import numpy as np
import pytest

from cases import documents, no_documents, odd_documents, split
from feedlake.llm import language_id as L, quality_classifier as C, quality_rules as R
from feedlake.llm.common import WordHashes
from feedlake.llm.queries import LLM_QUERIES

BIGGER = "/root/testdata/sf0.01"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def segmentations(word):
    for n in range(len(word)):
        for cuts in combinations(range(1, len(word)), n):
            yield [word[a:b] for a, b in zip((0, *cuts), (*cuts, len(word)))]


@pytest.fixture(scope="module")
def pieces():
    names = ["▁", "a", "b", "ab", "▁a", "aba", "ba", "▁ab"]
    rng = np.random.default_rng(0)
    table = rng.random((len(names), 2))
    logp = np.vstack([np.log(table / table.sum(axis=0)), np.full((1, 2), L.CHARACTER), np.full((1, 2), -np.inf)])
    return L.Pieces({p: i for i, p in enumerate(names)}, 3, logp, ["x", "y"])


def weight(pieces, parts):
    known = [pieces.number.get(p, len(pieces.number) if len(p) == 1 else None) for p in parts]
    return np.zeros(2) if None in known else np.exp(pieces.logp[known].sum(axis=0))


def test_forward_sums_all_segmentations(pieces):
    words = ["▁ab", "▁aba", "▁abab", "▁zab", "▁a", "▁bbéa"]
    want = [np.log(sum(weight(pieces, s) for s in segmentations(w))) for w in words]
    assert np.allclose(pieces.word_scores(words), want)


def test_expected_uses(pieces):
    word = "▁abaz"
    total = sum(weight(pieces, s) for s in segmentations(word))
    lattice = pieces.lattice([word])
    uses = pieces.expected(lattice)[0]
    for end in range(1, len(word) + 1):
        for k in range(1, min(3, end) + 1):
            with_it = np.zeros(2)
            for s in segmentations(word):
                ends = np.cumsum([len(p) for p in s])
                if any(e == end and len(p) == k for e, p in zip(ends, s)):
                    with_it += weight(pieces, s)
            assert np.allclose(uses[end - 1, k - 1, 0], with_it / total)


@pytest.fixture(scope="module")
def languages(spark):
    return L.train(spark.read.parquet(f"{BIGGER}/documents.parquet"))


def test_language_accuracy(spark, languages):
    docs = spark.read.parquet(f"{BIGGER}/documents.parquet")
    rows = [r for r in L.identify(docs, languages).collect() if held_out(r.doc_id)]
    assert len(rows) > 100 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark, languages):
    rows = L.identify(odd_documents(spark), languages).collect()
    assert len(rows) == 14
    for r in rows:
        assert (r.lang_pred == "und") == (r.doc_id in (1, 2, 3, 11) or r.lang_pred == "und" and r.doc_id is None)
        assert 0 <= r.score <= 1
    assert L.identify(no_documents(spark), languages).count() == 0


def test_nothing_to_learn_from(spark):
    model = L.train(no_documents(spark))
    assert {r.lang_pred for r in L.identify(odd_documents(spark), model).collect()} == {"und"}
    labels = spark.createDataFrame([], "doc_id long, quality int")
    scorer = C.train(odd_documents(spark), labels)
    assert {r.score for r in C.score(odd_documents(spark), scorer).collect()} == {0.5}
    trees = R.train(odd_documents(spark), labels)
    assert {r.kept for r in R.judge(odd_documents(spark), trees).collect() if not r.base_failed} == {True}


def test_ftrl_step_by_hand():
    z, n = np.array([0.0, 2.0, -3.0]), np.array([0.0, 4.0, 1.0])
    w = [0.0 if abs(a) <= C.L1 else -(a - np.sign(a) * C.L1) / ((C.BETA + b**0.5) / C.ALPHA + C.L2) for a, b in zip(z, n)]
    assert np.allclose(C.weights_of(z, n), w)
    x, y = [0.5, 0.25], 1.0
    p = 1 / (1 + np.exp(-(w[1] * x[0] + w[2] * x[1])))
    want_z, want_n = z.copy(), n.copy()
    for i, v in zip((1, 2), x):
        g = (p - y) * v
        want_z[i] += g - ((want_n[i] + g * g) ** 0.5 - want_n[i] ** 0.5) / C.ALPHA * w[i]
        want_n[i] += g * g
    C.update(z, n, np.array([1, 2]), np.array(x), y)
    assert np.allclose(z, want_z) and np.allclose(n, want_n)


def test_scores_are_sparse_dot_products():
    hashes, model = WordHashes(), C.Model(np.random.default_rng(1).normal(size=C.BUCKETS + 1))
    texts = ["a b b c a b b", None, "", "x"]
    want = []
    for t in texts:
        found = C.ngram_buckets(t, hashes)
        margin = sum(model.weights[b] for b in found) / max(len(found), 1) ** 0.5 + model.weights[-1]
        want.append(1 / (1 + np.exp(-margin)))
    assert np.allclose(model.scores(texts, hashes), want)


def test_classifier_on_held_out_rows(spark):
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{BIGGER}/labels.parquet").collect()}
    rows = LLM_QUERIES["op4_quality_classifier"](spark, BIGGER).collect()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    known = [r for r in rows if r.held_out and r.doc_id in quality]
    assert np.mean([r.predicted == quality[r.doc_id] for r in known]) > 0.9
    again = LLM_QUERIES["op4_quality_classifier"](spark, BIGGER).collect()
    assert {r.doc_id: r.score for r in again} == pytest.approx({r.doc_id: r.score for r in rows})


def test_classifier_odd_rows(spark):
    scorer = C.Model(np.zeros(C.BUCKETS + 1))
    got = C.score(odd_documents(spark), scorer)
    assert got.count() == 14 and {r.predicted for r in got.collect()} == {1}
    assert C.score(no_documents(spark), scorer).count() == 0


def counts_by_hand(text):
    text = text or ""
    w = split(text)
    lines = [x for x in text.split("\n") if split(x)]
    seen, dup = set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    inside = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(8)} if len(w) < 3000 else set()
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_rule_counts(spark):
    docs = documents(spark).select("doc_id", "text").unionByName(odd_documents(spark).select("doc_id", "text"))
    rows = R.document_counts(docs, ["doc_id", "text"]).collect()
    assert len(rows) == 214
    for r in rows:
        if len(r.text or "") < 20_000:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts_by_hand(r.text), r.doc_id


@pytest.fixture(scope="module")
def trees(spark):
    return R.train(spark.read.parquet(f"{BIGGER}/documents.parquet"), spark.read.parquet(f"{BIGGER}/labels.parquet"))


def test_rules_tell_good_from_bad(spark, trees):
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{BIGGER}/labels.parquet").collect()}
    rows = R.judge(spark.read.parquet(f"{BIGGER}/documents.parquet"), trees).collect()
    judged = [r for r in rows if not r.base_failed and r.doc_id in quality]
    assert np.mean([r.kept == quality[r.doc_id] for r in judged]) > 0.97
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)


def test_scores_are_monotonic(trees):
    rng = np.random.default_rng(2)
    base = rng.random((200, len(R.FEATURES))) * 3
    for f, direction in enumerate(R.FEATURES.values()):
        if direction:
            steps = [trees.probability(np.column_stack([base[:, :f], np.full(200, v), base[:, f + 1:]])) for v in np.linspace(0, 2, 12)]
            assert (direction * np.diff(steps, axis=0) >= -1e-12).all()


def test_flat_trees_walk_like_nodes(trees):
    x = np.random.default_rng(3).random((50, len(R.FEATURES))) * 2
    for row, p in zip(x, trees.probability(x)):
        total = trees.start
        for root in trees.roots:
            at = root
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            total += trees.value[at]
        assert p == pytest.approx(1 / (1 + np.exp(-total)))


def test_rules_odd_rows(spark, trees):
    docs = odd_documents(spark)
    kept = R.keep_good(docs, trees)
    assert kept.columns == docs.columns
    judged = R.judge(docs.select("doc_id", "text"), trees).collect()
    assert len(judged) == 14
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.doc_id or 0 for r in judged if r.kept)
    assert R.keep_good(no_documents(spark), trees).count() == 0 and R.judge(no_documents(spark), trees).count() == 0
