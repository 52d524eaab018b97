"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from feedlake.llm.common import WordHashes, fresh, mix64, slices
from feedlake.session import materialize, ship

ship(__name__)

WINDOW = 13
SUBSTITUTIONS = 2
#: Shorter items are not searched for: so few words also occur by chance.
MIN_TOKENS = 8
#: Positions of a window fall into this many classes (position modulo CLASSES). A mask reads
#: all but SUBSTITUTIONS of the classes, so some mask misses every substituted position.
CLASSES = 4
FILTER_BITS_PER_KEY = 64
MOST_FILTER_BITS = 1 << 27
PROBES = 2

TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits."""
    return TOKEN.findall((text or "").lower())


def kept_classes(window: int) -> list[tuple[int, ...]]:
    """The classes of positions each mask reads. Windows of short items are read whole."""
    if window < WINDOW:
        return [tuple(range(CLASSES))]
    return list(combinations(range(CLASSES), CLASSES - SUBSTITUTIONS))


class KnownHashes(WordHashes):
    """Word hashes whose lowest bit tells whether the word may be one of the items' (never a wrong no)."""

    def __init__(self, vocabulary: bytes):
        super().__init__()
        self.vocabulary, self.mask = vocabulary, len(vocabulary) * 8 - 1

    def __missing__(self, word):
        if len(self) >= self.size:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        at = value >> 8 & self.mask
        value = self[word] = value & ~1 | (self.vocabulary[at >> 3] >> (at & 7) & 1)
        return value


def candidates(hashes: np.ndarray, window: int) -> np.ndarray:
    """Windows that can match: all of their words but those that may be substituted are words of the items."""
    if len(hashes) < window:
        return np.empty(0, np.int64)
    known = np.concatenate([np.zeros(1, np.int64), np.cumsum(hashes & np.uint64(1)).astype(np.int64)])
    allowed = SUBSTITUTIONS if window == WINDOW else 0
    return np.flatnonzero(known[window:] - known[:-window] >= window - allowed)


def seed_keys(hashes: np.ndarray, window: int, at: np.ndarray | None = None) -> list[np.ndarray]:
    """For each mask, the hash of the tokens it reads, for the windows ``at`` (default: all)."""
    at = np.arange(len(hashes) - window + 1) if at is None else at
    n = len(at)
    if not n:
        return []
    # One sum per class of positions; a mask's key is the sum of its classes' sums.
    classes = np.zeros((CLASSES, n), np.uint64)
    factor = 0x9E3779B97F4A7C15
    for i in range(window):
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        classes[i % CLASSES] += mix_token(hashes[at + i], factor)
    out = []
    for m, part in enumerate(kept_classes(window)):
        total = np.full(n, window * 64 + m, np.uint64)
        for c in part:
            total += classes[c]
        out.append(mix64(total))
    return out


def mix_token(hashes: np.ndarray, factor: int) -> np.ndarray:
    x = hashes * np.uint64(factor | 1)
    return x ^ (x >> np.uint64(32))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, window, item_tokens, key) of every window and mask of the items, stored."""
    item = benchmark.schema["item_id"]
    names = ["item_id", "window", "item_tokens", "key"]

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch, "text"):
                rows = {n: [] for n in names}
                for item_id, text in zip(part.column("item_id"), part.column("text").to_pylist()):
                    ws = tokens(text)
                    if len(ws) < MIN_TOKENS:
                        continue
                    window = min(WINDOW, len(ws))
                    for keys in seed_keys(hashes.of(ws) | np.uint64(1), window):
                        for at, key in enumerate(keys.view(np.int64).tolist()):
                            for name, value in zip(names, (item_id, window, ws[at:at + window], key)):
                                rows[name].append(value)
                ids = pa.array([x.as_py() for x in rows["item_id"]], part.schema.field("item_id").type)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(rows["window"], pa.int32()), pa.array(rows["item_tokens"], pa.list_(pa.string())),
                     pa.array(rows["key"], pa.int64())], names=names)

    kind = item.dataType.simpleString()
    schema = f"item_id {kind}, window int, item_tokens array<string>, key bigint"
    found = benchmark.select("item_id", "text").mapInArrow(run, schema)
    return materialize(found.distinct())


def _probe(keys: np.ndarray, turn: int, bits: int) -> np.ndarray:
    return mix64(keys + np.uint64(turn + 1)) & np.uint64(bits - 1)


def key_filter(windows: DataFrame) -> np.ndarray:
    """Bloom filter over the keys, as 64-bit words; never larger than ``MOST_FILTER_BITS``.

    Beyond that size more windows of documents pass it and are sorted out by the join.
    """
    n = windows.select("key").distinct().count()
    bits = 1 << 16
    while bits < min(n * FILTER_BITS_PER_KEY, MOST_FILTER_BITS):
        bits *= 2

    def run(batches):
        for rows in batches:
            keys = rows["key"].to_numpy().view(np.uint64)
            at = np.concatenate([_probe(keys, turn, bits) for turn in range(PROBES)]).view(np.int64)
            yield pd.DataFrame({"word": at >> 6, "bit": np.left_shift(np.int64(1), at & 63)})

    words = windows.select("key").mapInPandas(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit"))
    rows = words.toPandas()
    out = np.zeros(bits >> 6, np.int64)
    out[rows["word"].to_numpy()] = rows["bit"].to_numpy()
    return out


def vocabulary_of(windows: DataFrame) -> bytes:
    """A bit for the hash of every word of the items; never larger than ``MOST_FILTER_BITS``."""
    words = windows.select(F.explode("item_tokens").alias("word")).distinct()
    n, bits = words.count(), 1 << 16
    while bits < min(n * FILTER_BITS_PER_KEY, MOST_FILTER_BITS):
        bits *= 2

    def run(batches):
        for rows in batches:
            at = WordHashes().of(rows["word"].tolist()) >> np.uint64(8) & np.uint64(bits - 1)
            yield pd.DataFrame({"byte": (at >> np.uint64(3)).astype(np.int64), "bit": np.left_shift(1, (at & np.uint64(7)).astype(np.int64))})

    found = words.mapInPandas(run, "byte long, bit long").groupBy("byte").agg(F.bit_or("bit").alias("bit")).toPandas()
    out = np.zeros(bits >> 3, np.uint8)
    out[found["byte"].to_numpy()] = found["bit"].to_numpy()
    return out.tobytes()


def passing(keys: np.ndarray, filter_words: np.ndarray) -> np.ndarray:
    """Positions whose key may be in the filter."""
    at = np.arange(len(keys))
    for turn in range(PROBES):
        bit = _probe(keys[at], turn, len(filter_words) << 6).view(np.int64)
        at = at[(filter_words[bit >> 6] >> (bit & 63)) & 1 == 1]
    return at


def document_windows(
    docs: DataFrame, keep: list[str], windows: list[int], filter_words: np.ndarray, vocabulary: bytes
) -> DataFrame:
    """Columns ``keep``, and (window, at, doc_tokens, key) of every window that passes both filters.

    Most windows hold too many words that no item has, and are dropped before any mask is laid on them.
    """
    shared = docs.sparkSession.sparkContext.broadcast((filter_words, vocabulary))
    names = ["window", "at", "doc_tokens", "key"]

    def run(batches):
        words, known = shared.value
        hashes = KnownHashes(known)
        for batch in batches:
            for part in slices(batch, "text"):
                rows, row = {n: [] for n in names}, []
                split = [tokens(t) for t in part.column("text").to_pylist()]
                ends = np.cumsum([len(ws) for ws in split])
                ids = hashes.of([w for ws in split for w in ws])
                for window in windows:
                    places = candidates(ids, window)
                    owner = np.searchsorted(ends, places, "right")
                    inside = places + window <= ends[owner]
                    places, owner = places[inside], owner[inside]
                    for keys in seed_keys(ids, window, places):
                        for k in passing(keys, words).tolist():
                            i = int(owner[k])
                            at = int(places[k] - ends[i]) + len(split[i])
                            row.append(i)
                            values = (window, at, split[i][at:at + window], int(keys[k].view(np.int64)))
                            for name, value in zip(names, values):
                                rows[name].append(value)
                kept = part.select(keep).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(rows["window"], pa.int32()), pa.array(rows["at"], pa.int64()),
                     pa.array(rows["doc_tokens"], pa.list_(pa.string())), pa.array(rows["key"], pa.int64())],
                    names=[*keep, *names])

    own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{own}, window int, at bigint, doc_tokens array<string>, key bigint"
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def substituted(a: str, b: str) -> Column:
    """Number of positions in which two token arrays of one length differ."""
    differs = F.zip_with(a, b, lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.aggregate(differs, F.lit(0), lambda total, x: total + x)


def overlaps(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Documents that hold a window of a benchmark item, one row per document and item.

    A window is 13 consecutive tokens of an item that differ from the document's in at most 2
    places, at one alignment; for items of 8 to 12 tokens it is the whole item without a
    difference. Returns ``keep`` (default doc_id), item_id, first_token (of the first such
    window in the document) and n_windows (positions in the document). Null and empty
    texts hold nothing, rows with equal ``keep`` count as one document, null ids are kept, and
    other columns are not looked at.
    """
    keep = keep or ["doc_id"]
    items = benchmark_windows(benchmark)
    lengths = sorted(r[0] for r in items.select("window").distinct().collect())
    found = document_windows(docs, keep, lengths, key_filter(items), vocabulary_of(items))
    allowed = F.when(F.col("window") < WINDOW, 0).otherwise(SUBSTITUTIONS)
    hits = found.join(items, ["key", "window"]).where(substituted("doc_tokens", "item_tokens") <= allowed)
    return hits.groupBy(*keep, "item_id").agg(
        F.min("at").alias("first_token"), F.countDistinct("at").alias("n_windows")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without an overlap, all columns unchanged.

    Rows are told apart by id and text, so a clean row stays even where its id is repeated.
    The list of contaminated rows is stored first; Spark then joins it by its known size.
    """
    key, other_id, other_key = fresh(docs, "text_key", "hit_id", "hit_key")
    marked = docs.withColumn(key, F.xxhash64("text"))
    hits = overlaps(marked.select("doc_id", "text", key), benchmark, ["doc_id", key])
    bad = materialize(hits.select(F.col("doc_id").alias(other_id), F.col(key).alias(other_key)).distinct())
    same = marked["doc_id"].eqNullSafe(bad[other_id]) & (marked[key] == bad[other_key])
    return marked.join(bad, same, "left_anti").drop(key)
