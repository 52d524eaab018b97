import hashlib
from collections import Counter

import numpy as np

from cases import ODD, PASSAGE, WORDS, documents, no_documents, odd_documents, split
from feedlake.llm import substring_dedup as D
from feedlake.llm.common import word_hashes, words

SIZE = 35


def brute_force(rows):
    tokens = [(i, split(t)) for i, t in rows]
    starts = Counter(tuple(w[j:j + SIZE]) for _, w in tokens for j in range(len(w) - SIZE + 1))
    out = []
    for i, w in tokens:
        gone = [False] * len(w)
        for j in range(len(w) - SIZE + 1):
            if starts[tuple(w[j:j + SIZE])] > 1:
                gone[j:j + SIZE] = [True] * SIZE
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(docs):
    return sorted((tuple(r) for r in D.removed_digests(docs).collect()), key=str)


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_documents(spark):
    docs = documents(spark)
    assert result(docs) == brute_force(pairs(docs))


def test_odd_rows(spark):
    docs = odd_documents(spark)
    assert result(docs) == brute_force(pairs(docs))
    assert result(no_documents(spark)) == []


def overlapping(spark):
    """Repeats inside a text, at its ends, shifted, of 34, 35 and 36 words, and periodic ones."""
    w = PASSAGE.split()
    rows = [
        (0, "x x x " * 40), (1, "x x x " * 11), (2, "a " + " ".join(w[:35])), (3, " ".join(w[:35]) + " b"), (4, " ".join(w[1:35])),
        (5, " ".join(w[10:46]) + " c " + " ".join(w[11:46])), (6, " ".join(WORDS) + " ".join(w[20:])), (7, " ".join(["y", "z"] * 18)),
        (8, " ".join(w[24:59]).replace("w30", "W30")),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_overlaps(spark):
    docs = overlapping(spark)
    assert result(docs) == brute_force(pairs(docs))


def test_longer_prefixes_give_the_same(spark, monkeypatch):
    docs = odd_documents(spark).select("doc_id", "text").unionByName(overlapping(spark))
    want = brute_force(pairs(docs))
    monkeypatch.setattr(D, "GROUP_SUFFIXES", 0)
    assert result(docs) == want


def test_anchors():
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 50, 200).astype(np.uint64)
    of_window, chosen = D.anchors(blocks)
    span = SIZE - D.BLOCK + 1
    assert of_window.tolist() == [blocks[i:i + span].min() for i in range(len(blocks) - span + 1)]
    assert set(of_window) == set(chosen)


def test_texts_are_rewritten(spark):
    docs = odd_documents(spark)
    texts = {r.doc_id: r.text for r in D.remove_repeats(docs).collect() if r.doc_id}
    assert D.remove_repeats(docs).columns == docs.columns
    assert texts[6] == "start end" and texts[7] == "" and texts[1] is None
    assert texts[8] == {i: t for i, t, *_ in ODD}[8]


def test_large_ids_beside_null_ids(spark):
    big = (1 << 53) + 1
    docs = spark.createDataFrame([(big + 2 * i, "a b c") for i in range(40)] + [(None, "a")] * 40, "doc_id long, text string")
    assert {r.doc_id for r in D.removed_digests(docs).collect()} == {None, *(big + 2 * i for i in range(40))}
    assert {r.doc_id for r in D.remove_repeats(docs).collect()} == {None, *(big + 2 * i for i in range(40))}


def test_word_hashes_in_one_pass():
    texts = [" ab  cd\tab\n", None, "", "é\x1cx \x85 " + "long" * 20, "cd", *(f"w{i % 50} {i} " + "z" * (i % 40) for i in range(300))]
    split_up = [words(t) for t in texts]
    hashes, sizes = word_hashes(texts)
    assert sizes.tolist() == [len(w) for w in split_up]
    of = {}
    for word, value in zip((w for found in split_up for w in found), hashes.tolist()):
        assert of.setdefault(word, value) == value
    assert len(set(of.values())) == len(of)
    parts, counts = word_hashes(texts, 7)
    assert parts.tolist() == hashes.tolist() and counts.tolist() == sizes.tolist()
    assert [len(x) for x in word_hashes([])] == [0, 0] and [len(x) for x in word_hashes([None])] == [0, 1]


def test_tree_order():
    rows = np.random.default_rng(5).integers(0, 3, (4000, D.BLOCKS)).astype(np.uint32)
    assert rows[D.tree_order(rows)].tolist() == sorted(rows.tolist())
    loads = D.prefix_loads([np.arange(40, dtype=np.uint64)] * 3 + [np.empty(0, np.uint64)])
    assert loads.sum(axis=1).tolist() == [3 * (40 - (D.WINDOW - D.BLOCK))] * (D.BLOCKS - 1) and loads.max() >= 3
