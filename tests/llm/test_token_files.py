import os
import random
import shutil
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cases import documents, no_documents, odd_documents
from feedlake.llm import token_files as T


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(T.tokenizer_path())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_parts_give_the_ids_of_the_text(tokenizer):
    rng = random.Random(3)
    alphabet = [*"ab é字1'. \n\t     -", "<|endoftext|>", "'s", " ", "\xa0", "\x00"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += ["", None, " ", "a ", " a", "  ", "<|endoftext|>", " a\n b"]
    encoder = T.Encoder(T.tokenizer_path())
    for i in range(0, len(texts), 37):
        for text, ids in zip(texts[i:i + 37], encoder.batch(texts[i:i + 37])):
            assert ids.tolist() == ids_of(tokenizer, text)


@pytest.mark.parametrize("values", [1, 2, 5, 300])
def test_shards_round_trip(values, monkeypatch):
    monkeypatch.setattr(T, "MIN_COUNT", 2)
    rng = np.random.default_rng(values)
    for longest in (0, 1, 2, 3, 40, 3000):
        docs = [rng.integers(0, values, rng.integers(0, longest + 1)).astype(np.uint32) for _ in range(6)]
        shard = T.Shard(T.write_shard(docs, 500))
        assert [d.tolist() for d in shard.documents()] == [d.tolist() for d in docs]
        assert [shard.document(i).tolist() for i in range(6)] == [d.tolist() for d in docs]


def test_rules_are_pairs_that_occur_often():
    ids = np.array([7, 8, 9, 7, 8, 7, 8, 9, 1, 7, 8, 9], np.uint32)
    sequence, rules = T.repair(ids, 100, 2)
    expanded = []

    def expand(symbol):
        if symbol < 100:
            expanded.append(symbol)
        else:
            expand(int(rules[0][symbol - 100])), expand(int(rules[1][symbol - 100]))

    for s in sequence.tolist():
        expand(s)
    assert expanded == ids.tolist() and len(sequence) + rules.size < len(ids)


def check(docs, tokenizer, digests):
    rows = digests.collect()
    want = {}
    for d in docs.collect():
        want.setdefault(d.doc_id, []).append(ids_of(tokenizer, d.text))
    assert len(rows) == docs.count()
    at, got = 0, {}
    rows.sort(key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    for doc_id, texts in want.items():
        assert sorted(got[doc_id]) == sorted((len(t), zlib.crc32(np.array(t, "<u4").tobytes())) for t in texts)


def test_documents(spark, tokenizer):
    docs = documents(spark)
    check(docs, tokenizer, T.round_trip(docs))


def test_odd_rows_in_small_shards(spark, tokenizer, tmp_path):
    docs = odd_documents(spark)
    T.write_tokens(docs, str(tmp_path / "t"), shard_ids=50)
    assert spark.read.parquet(str(tmp_path / "t")).count() > 5
    check(docs, tokenizer, T.read_digests(spark, str(tmp_path / "t")))
    ids = {(r.doc_id, tuple(r.ids)) for r in T.read_tokens(spark, str(tmp_path / "t")).collect()}
    assert ids == {(d.doc_id, tuple(ids_of(tokenizer, d.text))) for d in docs.collect()}
    assert T.round_trip(no_documents(spark)).count() == 0


def test_a_worker_keeps_its_encoder(tmp_path):
    path = str(shutil.copyfile(T.tokenizer_path(), tmp_path / "own.json"))
    first = T.process_encoder(path)
    ids = [x.tolist() for x in first.batch(["one two", " two  three", None])]
    again = T.process_encoder(path)
    assert again is first and len(again.known) > 0
    assert [x.tolist() for x in again.batch(["one two", " two  three", None])] == ids
    os.utime(path, ns=(1, 1))
    renewed = T.process_encoder(path)
    assert renewed is not first and [x.tolist() for x in renewed.batch(["one two", " two  three", None])] == ids


def test_letters_and_marks_are_cut_as_the_pre_tokenizer_does(tokenizer):
    rng = random.Random(5)
    alphabet = [*"abZÀéßøȳ×ªǅ", *'!"#$%&()*+,-./:;=>?@[\\]^_`{}~', "'", "'s", "<", "|", "\n", "\n", " ", " ", "\n\n", "7", "\xad", "word", "Word"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    encoder = T.Encoder(T.tokenizer_path())
    for i in range(0, len(texts), 100):
        for text, ids in zip(texts[i:i + 100], encoder.batch(texts[i:i + 100])):
            assert ids.tolist() == ids_of(tokenizer, text), text


def test_composed_pieces_share_their_parts():
    encoder = T.Encoder(T.tokenizer_path())
    encoder.batch(["x wordlike, wordlike.\nwordlike! andso."])
    assert "wordlike" in encoder.known and "andso" in encoder.known


def test_forgetting_keeps_what_is_asked_for_often(tokenizer, monkeypatch):
    monkeypatch.setattr(T, "KNOWN_PIECES", 8)
    encoder = T.Encoder(T.tokenizer_path())
    texts = [f"often seen. often seen, n{i} only{'abcdefghij'[i % 10]}\nonce, often" for i in range(30)]
    for text in texts:
        (ids,) = encoder.batch([text])
        assert ids.tolist() == ids_of(tokenizer, text)
    encoder.forget()
    assert "often" in encoder.known and "n3" not in encoder.known
