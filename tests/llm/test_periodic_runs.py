import hashlib
import random
import time
from zlib import crc32

from hypothesis import given, settings, strategies as st

from cases import documents, no_documents, odd_documents, split
from feedlake.llm import periodic_runs as P
from feedlake.llm.common import WordHashes

HASHES = WordHashes()


def brute_force(tokens):
    """Every maximal run, from every lag and every start."""
    n, period = len(tokens), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and tokens[i] == tokens[i + q]:
                i += 1
            length = i - start + q
            if length >= max(12, 2 * q):
                period.setdefault((start, length), q)
            i += i == start
    return sorted(((s, l, q) for (s, l), q in period.items()), key=lambda r: (r[0], r[2]))


def found(tokens):
    return [tuple(r) for r in P.find_runs(HASHES.of([t.encode() for t in tokens])).tolist()]


def tail_repeated(tokens, doc_id):
    h = crc32(str("" if doc_id is None else doc_id).encode())
    if h % 10 == 0 and tokens:
        g, n = h // 10, len(tokens)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        tokens = [tokens[i] if i < a else tokens[a + (i - a) % p] for i in range(n)]
    return tokens


def digest(doc_id, text, max_words=4000):
    tokens = tail_repeated(split(text), doc_id)
    if len(tokens) > max_words:
        return None
    runs = brute_force(tokens)
    longest = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    kept = [w for i, w in enumerate(tokens) if not any(s + q <= i < s + l for s, l, q in runs)]
    start, length, period = longest
    return (
        doc_id, len(runs), start, length, period, length and 1000 * length // period,
        hashlib.sha256("".join(f"{s},{l},{q}\n" for s, l, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(kept).encode()).hexdigest(),
    )


def check(docs):
    rows = {}
    for r in P.run_digests(P.runs_of_texts(docs.select("doc_id", "text"), P.repeat_tail)).collect():
        rows.setdefault(r.doc_id, []).append(tuple(r))
    seen = 0
    for r in docs.select("doc_id", "text").collect():
        want = digest(r.doc_id, r.text)
        if want:
            assert want in rows[r.doc_id]
            seen += 1
    assert sum(map(len, rows.values())) == docs.count()
    return seen


def test_documents(spark):
    assert check(documents(spark)) > 190


def test_odd_rows(spark):
    assert check(odd_documents(spark)) > 10
    assert P.run_digests(P.runs_of_texts(no_documents(spark))).count() == 0


def test_clashing_names_and_rows(spark):
    docs = spark.createDataFrame([(1, "x y " * 9, 5), (1, "x y " * 9, 5), (2, None, 6)], "doc_id long, text string, Starts int")
    rows = P.runs_of_texts(docs)
    assert rows.columns == ["doc_id", "Starts", "starts_", "lengths", "periods", "collapsed"]
    assert sorted(map(tuple, rows.collect()))[:2] == [(1, 5, [0], [18], [2], "x y")] * 2
    assert [r.collapsed for r in rows.where("doc_id = 2").collect()] == [""]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=90))
def test_two_words(tokens):
    assert found(tokens) == brute_force(tokens)


def test_repeated_blocks():
    rng = random.Random(5)
    for _ in range(400):
        tokens = []
        while len(tokens) < 120:
            tokens += [rng.choice("abc") for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 9)
        assert found(tokens) == brute_force(tokens)


def test_touching_stretches_of_one_period():
    for left in range(8, 40):
        for right in range(8, 40, 3):
            tokens = ["ab"[i % 2] for i in range(left)] + ["ba"[i % 2] for i in range(right)]
            assert found(tokens) == brute_force(tokens)


def test_fibonacci_and_thue_morse_words():
    a, b = "a", "ab"
    while len(b) < 600:
        a, b = b, b + a
    assert found(b) == brute_force(b)
    morse = ["ab"[bin(i).count("1") & 1] for i in range(700)]
    assert found(morse) == brute_force(morse)


def test_lengths_about_the_bar():
    for period in range(1, 9):
        for length in range(8, 20):
            tokens = ["s"] + [f"p{i % period}" for i in range(length)] + ["e"]
            assert found(tokens) == brute_force(tokens)


def test_very_long_texts_take_time_in_proportion():
    began = time.time()
    assert found(["a"] * 300_000) == [(0, 300_000, 1)]
    assert found([f"w{i % 10}" for i in range(300_000)]) == [(0, 300_000, 10)]
    assert found([f"w{i}" for i in range(150_000)] * 2) == [(0, 300_000, 150_000)]
    assert len(found((["a"] * 100 + ["b"]) * 1000)) == 1001
    assert time.time() - began < 30
