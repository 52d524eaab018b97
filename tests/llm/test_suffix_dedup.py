import hashlib
import random
from collections import Counter

import numpy as np

from cases import documents, no_documents, odd_documents
from feedlake.llm import suffix_dedup as D

SIZE = 400


def brute_force(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    starts = Counter(b[j:j + SIZE] for _, b in data for j in range(len(b) - SIZE + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b) + 2)
        for j in range(len(b) - SIZE + 1):
            if starts[b[j:j + SIZE]] > 1:
                gone[j + 1:j + 1 + SIZE] = b"\1" * SIZE
        spans = sum(gone[j] and not gone[j - 1] for j in range(1, len(gone)))
        kept = bytes(x for x, g in zip(b, gone[1:]) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(docs):
    return sorted((tuple(r) for r in D.removed_digests(docs).collect()), key=str)


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_documents(spark):
    docs = documents(spark)
    rows = pairs(docs)
    assert result(docs) == brute_force(rows)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    assert result(docs) == brute_force(pairs(docs))
    assert result(no_documents(spark)) == []
    assert result(docs.where("text IS NULL OR text = ''")) == brute_force([(None, None), (1, None), (2, "")])


def edited(spark):
    """Near copies, passages of 398 to 402 bytes, periodic texts, repeats inside a text and across characters."""
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = letters(1500)
    rows = [(0, passage), (1, passage[:700] + "X" + passage[701:]), (2, letters(90) + passage[300:1200] + letters(80))]
    for k, n in enumerate(range(398, 403)):
        shared = letters(n)
        rows += [(10 + 2 * k, "<" + shared + ">"), (11 + 2 * k, "(" + shared + ")" + letters(50))]
    rows += [(30, "a" * 6000), (31, "a" * 401), (32, "a" * 400), (33, "a" * 399 + "b"), (34, "ab" * 3000), (35, "xyz" * 700)]
    inside = letters(450)
    rows += [(40, inside + letters(30) + inside), (41, letters(500)), (42, "é" * 300), (43, "é" * 300 + "è"), (44, "x" + "é" * 250)]
    rows += [(50 + i, letters(20) + passage[500:910] + letters(20)) for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_edited_copies(spark):
    docs = edited(spark)
    assert result(docs) == brute_force(pairs(docs))


def test_hot_anchors_and_small_tasks_give_the_same(spark, monkeypatch):
    docs = edited(spark)
    want = brute_force(pairs(docs))
    monkeypatch.setattr(D, "HOT_REGIONS", 2)
    assert result(docs) == want
    monkeypatch.setattr(D, "HOT_REGIONS", 10_000)
    monkeypatch.setattr(D, "TASK_BYTES", 3000)
    monkeypatch.setattr(D, "REGION_WINDOWS", 50)
    monkeypatch.setattr(D, "CHUNK", 700)
    assert result(docs) == want


def test_kept_bytes_and_spans(spark):
    docs = edited(spark).selectExpr("doc_id", "text", "1 AS kept", "2 AS id", "3 AS key")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = D.remove_repeats(docs)
    assert rows.columns == ["doc_id", "kept", "id", "key", "kept_", "starts", "ends"]
    for r in rows.collect():
        left, at = b"", 0
        for a, b in zip(r.starts, r.ends):
            left += texts[r.doc_id][at:a]
            at = b
        assert bytes(r.kept_) == left + texts[r.doc_id][at:]


def test_cover_holds_every_difference():
    for period in (2, 7, 32, 64):
        cover = D.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_suffix_order():
    rng = random.Random(8)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 90))) * rng.randrange(1, 30) for _ in range(40)]
    text = b"".join(rng.choice(parts) for _ in range(60))
    at = np.arange(len(text) - D.WINDOW - 200)
    cover = D.Cover(text)
    order, _ = cover.sort(at)
    assert [text[i:i + SIZE] for i in order] == sorted(text[i:i + SIZE] for i in at)


def test_repeated_windows_by_small_blocks(monkeypatch):
    rng = random.Random(9)
    base = bytes(rng.choice(b"abc") for _ in range(2000))
    texts = [base[i:i + 700] for i in rng.sample(range(1300), 8)] + [base[:500], b"q" * 900]
    counts = np.array([1] * 8 + [2, 1])
    total = Counter(t[j:j + SIZE] for t, n in zip(texts, counts) for j in range(len(t) - SIZE + 1) for _ in range(n))
    want = [[total[t[j:j + SIZE]] > 1 for j in range(len(t) - SIZE + 1)] for t in texts]
    for size in (1 << 18, 100):
        monkeypatch.setattr(D, "BLOCK_WINDOWS", size)
        assert [m.tolist() for m in D.repeated_windows(texts, counts)] == want


def test_texts_are_shuffled_once_for_both_joins(spark):
    """Documents enter two joins dealt alike; the second takes the first one's rows."""
    piece = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(500))
    docs = spark.createDataFrame([(i, f"{i} {piece} {i * 7}") for i in range(20)], "doc_id LONG, text STRING")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = D.removed_digests(docs)
        rows = done.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(rows) == 20 and min(r.n_removed for r in rows) >= 500
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange [id" in plan, plan


def test_regions_of_hot_anchors_take_the_same_shuffle(spark, monkeypatch):
    """Three joins read the texts, and the windows of hot anchors are made once."""
    docs = edited(spark)
    want = brute_force(pairs(docs))
    monkeypatch.setattr(D, "HOT_REGIONS", 2)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = D.removed_digests(docs)
        assert sorted((tuple(r) for r in done.collect()), key=str) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    plan = done._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange [id") == 2, plan
    assert plan.count("MapInArrow _slice_windows") == 1, plan
