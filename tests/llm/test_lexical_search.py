import math
import random
import re
from collections import Counter

import numpy as np

from cases import SF, documents, no_documents, odd_documents
from feedlake.llm import lexical_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute_force(docs, items, top=20):
    own = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in own]
    n, total = sum(x > 0 for x in sizes), sum(sizes)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, c), size in zip(own, sizes):
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * (1000000000 * c[t] // (1000 * c[t] + 12 * (75 + 25 * size * n // total)))
            if score > 0:
                scored.append((-score, doc is None, doc))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, doc, -score) for r, (score, _, doc) in enumerate(scored[:top])]
    return sorted(out, key=str)


def result(docs, items):
    return sorted(map(tuple, S.search(docs, items).collect()), key=str)


def pairs(docs):
    return [tuple(r) for r in docs.collect()]


def test_documents(spark):
    docs, items = documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert result(docs, items) == brute_force(pairs(docs.select("doc_id", "text")), pairs(items))


def test_small_shards_and_blocks_give_the_same(spark, monkeypatch):
    docs, items = documents(spark).repartition(2), spark.read.parquet(f"{SF}/benchmark.parquet").limit(40)
    want = brute_force(pairs(docs.select("doc_id", "text")), pairs(items))
    monkeypatch.setattr(S, "SHARD_DOCS", 30)
    monkeypatch.setattr(S, "QUERY_BYTES", 2000)
    assert result(docs, items) == want


def test_odd_rows(spark):
    docs = odd_documents(spark)
    asked = [(1, "the QUICK brown fox"), (2, None), (3, ""), (4, "?!"), (5, "w3 w3 w4 Ünï ünï çodé"), (5, "w3 w3 w4 Ünï ünï çodé"),
             (None, "one"), (6, "not there"), (7, "the " * 5000)]
    items = spark.createDataFrame(asked, "item_id long, text string").selectExpr("*", "1 AS score", "2 AS rank", "3 AS block")
    assert result(docs, items) == brute_force(pairs(docs.select("doc_id", "text")), asked)
    assert result(no_documents(spark), items) == []
    assert result(docs, items.where("item_id > 99")) == []
    assert result(docs.where("text IS NULL"), items) == []


def test_ties_by_id(spark):
    docs = spark.createDataFrame([(i, "tie x") for i in range(60, 0, -1)] + [(None, "tie x"), (3, "tie x"), (61, "other")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "tie")], "item_id long, text string")
    assert [r.doc_id for r in S.search(docs.repartition(5), items).orderBy("rank").collect()] == [1, 2, 3, 3, *range(4, 20)]


def vectors(rng, n, width):
    """Documents of two themes over Zipf-like terms."""
    rows = []
    for i in range(n):
        theme = i % 2 * (width // 2)
        rows.append({min(int(rng.paretovariate(0.7)) + theme, width) - 1: rng.randrange(1, 1_000_000) for _ in range(12)})
    starts = np.append(0, np.cumsum([len(r) for r in rows]))
    columns = np.array([t for r in rows for t in sorted(r)], np.int64)
    impacts = np.array([r[t] for r in rows for t in sorted(r)], np.int64)
    return rows, S.Shard(np.arange(n), np.zeros(n, bool), starts, columns, impacts, width)


def test_blocks_partition_lists_and_maxima_are_exact():
    rows, shard = vectors(random.Random(2), 900, 60)
    for t in range(60):
        held = []
        for b in range(shard.block_lists[t], shard.block_lists[t + 1]):
            docs = shard.members[shard.member_starts[b]:shard.member_starts[b + 1]].tolist()
            held += docs
            low, high = shard.top_starts[b], shard.top_starts[b + 1]
            most = Counter()
            for d in docs:
                for term, impact in rows[d].items():
                    most[term] = max(most[term], impact)
            assert dict(zip(shard.top_columns[low:high].tolist(), shard.tops[low:high].tolist())) == dict(most)
        assert sorted(held) == [d for d in range(900) if t in rows[d]]


def test_blocks_are_skipped_without_loss(monkeypatch):
    rng = random.Random(3)
    rows, shard = vectors(rng, 3000, 400)
    scored, real = [], S.Shard.scores
    monkeypatch.setattr(S.Shard, "scores", lambda self, docs, w: scored.append(len(docs)) or real(self, docs, w))
    touched = 0
    for _ in range(40):
        wanted = np.array(sorted(rng.sample(range(400), 6)))
        weight = np.array([rng.randrange(1, 9000) for _ in wanted])
        best = S.Best()
        shard.search((wanted, weight), best)
        full = [(-sum(w * r.get(t, 0) for t, w in zip(wanted.tolist(), weight.tolist())), d) for d, r in enumerate(rows)]
        want = [x for x in sorted(full)[:20] if x[0]]
        assert list(zip((-best.score).tolist(), best.ids.tolist())) == want
        touched += sum(any(t in r for t in wanted.tolist()) for r in rows)
    assert sum(scored) < touched
