import random
import re

import pytest

from cases import SF, WORDS, no_documents, odd_documents
from feedlake.llm import decontaminate as D
from feedlake.llm.oracles import LLM_ORACLES
from feedlake.llm.queries import LLM_QUERIES
from oracle_check import differences, duck


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute_force(docs, items):
    """(id, item) to the set of positions, every alignment compared word by word."""
    out = {}
    for doc_id, text in docs:
        w = tokens(text)
        for item_id, item in items:
            v = tokens(item)
            if len(v) < 8:
                continue
            size = min(13, len(v))
            for j in range(len(v) - size + 1):
                for i in range(len(w) - size + 1):
                    if sum(a != b for a, b in zip(w[i:i + size], v[j:j + size])) <= (2 if size == 13 else 0):
                        out.setdefault((doc_id, item_id), set()).add(i)
    return {k: (min(v), len(v)) for k, v in out.items()}


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(4)
    vocabulary = [a + b for a in WORDS for b in WORDS[:6]]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([13, 14, 30, 8, 12, 7, 40, 25])]
    items += [(8, items[2][1]), (9, None), (10, ""), (None, items[7][1])]
    docs = []
    for i, (_, item) in enumerate(items[:8] * 6):
        w = tokens(item)
        for _ in range(i // 8):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        filler = [rng.choice(vocabulary) for _ in range(rng.randint(0, 20))]
        docs.append((i, " ".join([*filler, *w, "END", *filler]).title()))
    docs += [(3, docs[3][1]), (None, docs[2][1]), (500, None), (501, " "), (502, "short")]
    return docs, items


def test_every_alignment(spark, tables):
    docs, items = tables
    found = D.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): (r.first_token, r.n_windows) for r in found.collect()}
    assert got == brute_force(docs, items)
    # Copies with two replaced words in a row of 13 are among them, and some with more are not.
    assert 30 < len(got) and len({d for d, _ in got}) < 45


def test_contaminated_rows_go(spark, tables):
    docs, items = tables
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = odd_documents(spark).select("doc_id", "text", "hit_id", "text_key", "source").unionByName(
        spark.createDataFrame(docs, "doc_id long, text string"), allowMissingColumns=True)
    bad = {t for d, t in docs for (i, _) in brute_force([(d, t)], items)}
    kept = D.drop_contaminated(frame, benchmark)
    assert kept.columns == frame.columns
    want = [(r.doc_id, r.text) for r in frame.collect() if r.text not in bad]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_empty_tables(spark, tables):
    items = spark.createDataFrame(tables[1], "item_id long, text string")
    assert D.overlaps(no_documents(spark), items).count() == 0
    assert D.overlaps(odd_documents(spark), items.where("item_id > 99")).count() == 0
    assert D.drop_contaminated(odd_documents(spark), items.where("item_id > 99")).count() == 14


def test_full_filter_changes_nothing(spark, tables, monkeypatch):
    docs, items = (spark.createDataFrame(t, f"{c} long, text string") for t, c in zip(tables, ("doc_id", "item_id")))
    want = sorted(D.overlaps(docs, items).collect(), key=str)
    monkeypatch.setattr(D, "MOST_FILTER_BITS", 64)
    monkeypatch.setattr(D, "passing", lambda keys, words: __import__("numpy").arange(len(keys)))
    assert sorted(D.overlaps(docs, items).collect(), key=str) == want


def test_query_matches_sql(spark):
    assert differences(LLM_QUERIES["op3_decontaminate"](spark, SF), duck(SF), LLM_ORACLES["op3_decontaminate"]) is None
