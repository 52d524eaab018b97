"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from feedlake.llm.common import WordHashes, fold, map_texts, mix64
from feedlake.llm.quality_rules import labelled_sample
from feedlake.session import materialize, ship

ship(__name__)

#: Bound of the labelled sample, in documents.
SAMPLE_ROWS = 12_000
BUCKETS = 1 << 18
SHARDS = 6
ROUNDS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 1.0
PREDICT_FROM = 0.3

#: Letters and digits, or a run of one kind of other character.
TOKEN = re.compile(r"\w+|([^\w\s])\1*")


def ngram_buckets(text: str | None, hashes: WordHashes, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every token and every pair of neighbouring tokens, repeats included.

    A token equal to the one before it, and three tokens that the text had before, are hashed
    as marks: repetition reads the same whatever is repeated.
    """
    ids = hashes.of([m[0] for m in TOKEN.finditer(text or "")])
    pairs = mix64(ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:])
    triples = pairs[:-1] * np.uint64(0xD6E8FEB86659FD93) + ids[2:]
    same = np.full(int((ids[:-1] == ids[1:]).sum()), hashes["<same>"], np.uint64)
    again = np.full(len(triples) - len(np.unique(triples)), hashes["<again>"], np.uint64)
    return (np.concatenate([ids, pairs, same, again]) % np.uint64(buckets)).astype(np.int64)


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FTRL-proximal weights in closed form; small ``z`` means weight 0."""
    shrunk = np.sign(z) * L1 - z
    return np.where(np.abs(z) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2))


def update(z: np.ndarray, n: np.ndarray, at: np.ndarray, x: np.ndarray, y: float) -> None:
    """One example, with values ``x`` at the distinct coordinates ``at``."""
    w = weights_of(z[at], n[at])
    g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
    sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
    z[at] += g - sigma * w
    n[at] += g * g


class Model:
    """Weights per bucket, the last one the bias."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def scores(self, texts: list[str | None], hashes: WordHashes) -> np.ndarray:
        """P(good) per text: sparse dot products of n-gram counts, scaled by the root of their number."""
        found = [ngram_buckets(t, hashes, len(self.weights) - 1) for t in texts]
        lengths = np.array([len(f) for f in found])
        sums = np.zeros(len(texts))
        full = lengths > 0
        if full.any():
            starts = np.concatenate([[0], np.cumsum(lengths[full])[:-1]])
            sums[full] = np.add.reduceat(self.weights[np.concatenate(found)], starts)
        margin = sums / np.sqrt(np.maximum(lengths, 1)) + self.weights[-1]
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30)))


def _examples(docs: DataFrame, labels: DataFrame, sample_rows: int, seed: str) -> DataFrame:
    """Sampled training documents as (shard, doc_id, label, buckets, counts), stored."""
    sample = labelled_sample(labels, "quality", seed, sample_rows, fold() != 0)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def setup():
        hashes = WordHashes()

        def work(texts):
            made = [np.unique(ngram_buckets(t, hashes), return_counts=True) for t in texts]
            return [[a for a, _ in made], [c for _, c in made]]

        return work

    made = map_texts(chosen, ["doc_id", "label"], ["text"], {"buckets": "array<bigint>", "counts": "array<bigint>"}, setup)
    return materialize(made.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS))))


def _shard_round(start, turn: int):
    """What one shard does in a round: its moves of the common state, for the buckets it saw."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        z, n = start.value[0].copy(), start.value[1].copy()
        rows = rows.sort_values("doc_id", kind="stable")
        touched = np.zeros(len(z), bool)
        for i in np.random.default_rng(turn).permutation(len(rows)):
            count = np.asarray(rows["counts"].iloc[i], float)
            at = np.append(rows["buckets"].iloc[i], BUCKETS).astype(np.int64)
            x = np.append(count / np.sqrt(max(count.sum(), 1.0)), 1.0)
            update(z, n, at, x, float(rows["label"].iloc[i]))
            touched[at] = True
        at = np.flatnonzero(touched)
        return pd.DataFrame({"bucket": at, "dz": z[at] - start.value[0][at], "dn": n[at] - start.value[1][at]})

    return run


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: str = "quality ftrl") -> Model:
    """Fit ``labels.quality`` on documents of folds 1 to 4, at most about ``sample_rows``.

    Each round, every shard runs FTRL over its examples from the common state, and the shards'
    states are averaged. A shard holds ``sample_rows / SHARDS`` examples, whatever the tables'
    sizes; the state has ``BUCKETS`` + 1 entries. Without examples all scores are 0.5.
    """
    examples = _examples(docs, labels, sample_rows, seed)
    spark = docs.sparkSession
    state = (np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1))
    for turn in range(ROUNDS):
        start = spark.sparkContext.broadcast(state)
        moves = examples.groupBy("shard").applyInPandas(_shard_round(start, turn), "bucket long, dz double, dn double")
        # A bucket moves by the mean of the shards that saw it.
        mean = moves.groupBy("bucket").agg(F.avg("dz").alias("dz"), F.avg("dn").alias("dn")).toPandas()
        at = mean["bucket"].to_numpy()
        state[0][at] += mean["dz"].to_numpy().round(9)
        state[1][at] += mean["dn"].to_numpy().round(9)
    return Model(weights_of(*state))


def score(docs: DataFrame, model: Model, text: str = "text", predict_from: float = PREDICT_FROM) -> DataFrame:
    """All columns of ``docs`` but the text, and ``score`` (0 to 1) and ``predicted`` (0 or 1).

    Whole texts are scored. Null and empty texts have no n-grams and get the bias alone.
    Columns of ``docs`` with the name of an added one are left out.
    """
    outputs = {"score": "double", "predicted": "int"}
    keep = [c for c in docs.columns if c != text and c.lower() not in outputs]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def setup():
        hashes, fitted = WordHashes(), shared.value

        def work(texts):
            p = fitted.scores(texts, hashes)
            return [p, (p >= predict_from).astype(np.int32)]

        return work

    return map_texts(docs, keep, [text], outputs, setup)
