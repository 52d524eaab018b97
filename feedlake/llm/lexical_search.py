"""Ranked lexical search over posting lists in geometric blocks.

Documents are kept as vectors over the terms of the queries: a term's impact in a document is its
saturated frequency. A task reads documents in shards. In a shard every term has a posting list, cut into
blocks by similarity: each document joins the nearest of some pivots of the list. A block stores the
largest impact of each term over its documents. With a query's weights these maxima bound the score of
every document of the block, so a block is skipped only if its bound lies below the score that is
already twentieth. Lists are opened from the strongest on and left as soon as all that remain
together cannot reach that score. Nothing is skipped on an estimate, so the answers are those of a full scan.

A task carries its best documents from shard to shard and sends on the best twenty per query.
Queries come in blocks of bounded size; each block is one pass over the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from feedlake.llm.common import map_texts
from feedlake.session import materialize, ship

ship(__name__)

TOP = 20
#: A block of queries has about this many bytes of text; vocabularies and queries of one block are sent to the tasks.
QUERY_BYTES = 4 << 20
#: A shard ends with the document that brings it to one of these.
SHARD_DOCS = 1 << 14
SHARD_POSTINGS = 1 << 20
BLOCK = 64
SKETCH = 64

ASCII_TERMS = frozenset(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
#: Letters A-Z in lower case, digits and all bytes beyond ASCII as they are, anything else a space.
TERM_BYTES = bytes(ord(chr(b).lower()) if b in ASCII_TERMS else b if b > 127 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case."""
    return text.encode().translate(TERM_BYTES).split() if text else []


def _rows(starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of the rows ``at`` of a compressed matrix, and where each row begins among them."""
    size = starts[at + 1] - starts[at]
    begin = np.cumsum(size) - size
    return np.repeat(starts[at] - begin, size) + np.arange(size.sum()), begin


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of runs that begin at ``begin``, empty runs included."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[np.append(begin[1:], len(values))] - total[begin]


class Shard:
    """Vectors of some documents, their posting lists in blocks and the blocks' maxima."""

    def __init__(self, ids: np.ndarray, no_id: np.ndarray, starts: np.ndarray, columns: np.ndarray, impacts: np.ndarray, n_terms: int):
        self.ids, self.no_id, self.starts, self.columns, self.impacts = ids, no_id, starts, columns, impacts
        owner = np.repeat(np.arange(len(ids)), np.diff(starts))
        order = np.argsort(columns, kind="stable")
        self.lists = np.searchsorted(columns[order], np.arange(n_terms + 1))
        self.strongest = np.zeros(n_terms, np.int64)
        np.maximum.at(self.strongest, columns, impacts)
        directions = np.random.default_rng(7).standard_normal((n_terms, SKETCH)).astype(np.float32)
        sketch = np.zeros((len(ids), SKETCH), np.float32)
        for d in range(SKETCH):
            sketch[:, d] = np.bincount(owner, directions[columns, d] * impacts, minlength=len(ids))
        sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)

        members, ends, block_lists, sizes, tops, top_columns = [], [], np.zeros(n_terms + 1, np.int64), [], [], []
        n_members = 0
        for t in range(n_terms):
            docs = owner[order[self.lists[t]:self.lists[t + 1]]]
            block_lists[t + 1] = block_lists[t]
            if not len(docs):
                continue
            docs, cuts = blocks_of(docs, sketch)
            row = np.repeat(np.arange(len(cuts)), np.diff(np.append(cuts, len(docs))))
            at, _ = _rows(starts, docs)
            # Of the same type as the impacts: only then does numpy take its fast way.
            most = np.zeros(len(cuts) * n_terms, np.int64)
            np.maximum.at(most, np.repeat(row, starts[docs + 1] - starts[docs]) * n_terms + columns[at], impacts[at])
            some = np.flatnonzero(most)
            members.append(docs)
            ends.append(n_members + np.append(cuts[1:], len(docs)))
            n_members += len(docs)
            sizes.append(np.bincount(some // n_terms, minlength=len(cuts)))
            tops.append(most[some].astype(np.int32))
            top_columns.append((some % n_terms).astype(np.int32))
            block_lists[t + 1] += len(cuts)
        join = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts])
        self.members, self.block_lists = join(members, np.int64), block_lists
        self.member_starts = np.append(0, join(ends, np.int64))
        self.top_starts = np.append(0, np.cumsum(join(sizes, np.int64)))
        self.tops, self.top_columns = join(tops, np.int32), join(top_columns, np.int32)

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        at, begin = _rows(self.starts, docs)
        return _sums(weights[self.columns[at]] * self.impacts[at], begin)

    def search(self, query: tuple[np.ndarray, np.ndarray], best: Best) -> None:
        """Offer to ``best`` all documents of the shard that can be among them."""
        wanted, weight = query
        most = weight * self.strongest[wanted]
        order = np.argsort(-most, kind="stable")
        rest = np.cumsum(most[order][::-1])[::-1]
        weights = np.zeros(len(self.strongest), np.int64)
        weights[wanted] = weight
        seen = np.zeros(len(self.ids), bool)
        for t, left in zip(wanted[order].tolist(), rest.tolist()):
            if left < best.bar or not left:
                break
            first, end = self.block_lists[t], self.block_lists[t + 1]
            low, high = self.top_starts[first], self.top_starts[end]
            bounds = _sums(weights[self.top_columns[low:high]] * self.tops[low:high], self.top_starts[first:end] - low)
            open_ = np.flatnonzero(bounds >= best.bar)
            open_ = open_[np.argsort(-bounds[open_], kind="stable")]
            take = 2
            while len(open_):
                at, _ = _rows(self.member_starts, first + open_[:take])
                docs = self.members[at]
                docs = docs[~seen[docs]]
                seen[docs] = True
                if len(docs):
                    best.offer(self.scores(docs, weights), self.ids[docs], self.no_id[docs])
                open_ = open_[take:]
                open_ = open_[bounds[open_] >= best.bar]
                take *= 2


def blocks_of(docs: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A posting list in the order of its blocks, and where each block begins.

    Every document goes to the pivot most like it; a block is at most four times the usual size.
    """
    if len(docs) <= BLOCK:
        return docs, np.zeros(1, np.int64)
    pivots = docs[::BLOCK]
    nearest = np.concatenate([
        np.argmax(sketch[docs[i:i + 4096]] @ sketch[pivots].T, axis=1) for i in range(0, len(docs), 4096)
    ])
    order = np.argsort(nearest, kind="stable")
    group = nearest[order]
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    inside = np.arange(len(group)) - np.repeat(heads, np.diff(np.append(heads, len(group))))
    return docs[order], np.flatnonzero(inside % (4 * BLOCK) == 0)


class Best:
    """The best documents of one query so far: score from above, then id from below, missing ids last."""

    def __init__(self):
        self.score, self.ids, self.no_id = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        #: Documents with a lower score are not among the best.
        self.bar = 1

    def offer(self, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        good = score >= self.bar
        if not good.any():
            return
        score, ids, no_id = (
            np.concatenate([a, b[good]]) for a, b in ((self.score, score), (self.ids, ids), (self.no_id, no_id))
        )
        order = np.lexsort((ids, no_id, -score))[:TOP]
        self.score, self.ids, self.no_id = score[order], ids[order], no_id[order]
        if len(order) == TOP:
            self.bar = int(self.score[-1])


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts): a document's number of terms, and those of the vocabulary with their frequencies."""
    width = len(vocabulary) + 1
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def setup():
        number = known.value.get

        def work(texts):
            tokens = [terms(t) for t in texts]
            sizes = np.array([len(w) for w in tokens], np.int64)
            found = np.array([number(w, width - 1) for own in tokens for w in own], np.int64)
            keys = np.repeat(np.arange(len(texts)), sizes) * width + found
            keys, counts = np.unique(keys[found < width - 1], return_counts=True)
            cuts = np.searchsorted(keys, np.arange(len(texts) + 1) * width)
            lists = [pa.ListArray.from_arrays(cuts.astype(np.int32), x.astype(np.int32)) for x in (keys % width, counts)]
            return sizes, *lists

        return work

    return map_texts(docs, ["doc_id"], ["text"], {"n": "bigint", "terms": "array<int>", "counts": "array<int>"}, setup)


def shards(frames: Iterator[pa.RecordBatch], n_docs: int, n_terms_all: int, n_terms: int) -> Iterator[Shard]:
    """Shards of bounded size from rows of ``count_terms``; documents without any term of the queries are left out."""
    parts, docs, postings = [], 0, 0

    def made():
        ids, n, starts, columns, counts = (np.concatenate(x) for x in zip(*((p[0], p[1], p[2], p[3], p[4]) for p in parts)))
        no_id = np.concatenate([p[5] for p in parts])
        scale = np.array([75 + 25 * x * n_docs // n_terms_all for x in n.tolist()], np.int64)
        impacts = 1_000_000_000 * counts // (1000 * counts + 12 * np.repeat(scale, starts))
        return Shard(ids, no_id, np.append(0, np.cumsum(starts)), columns, impacts, n_terms)

    for batch in frames:
        sizes = np.diff(batch.column("terms").offsets.to_numpy())
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            room = SHARD_POSTINGS - postings + (ends[at - 1] if at else 0)
            end = min(batch.num_rows, at + SHARD_DOCS - docs, int(np.searchsorted(ends, room)) + 1)
            part = batch.slice(at, end - at)
            own = sizes[at:end]
            flat = [part.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "counts")]
            ids = part.column("doc_id")
            some = own > 0
            parts.append((
                ids.fill_null(0).to_numpy()[some], part.column("n").to_numpy()[some], own[some], *flat,
                ids.is_null().to_numpy(zero_copy_only=False)[some],
            ))
            docs, postings, at = docs + end - at, postings + int(own.sum()), end
            if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield made()
                parts, docs, postings = [], 0, 0
    if postings:
        yield made()


def _search_block(docs: DataFrame, rows: list) -> DataFrame | None:
    """The best documents of each task for a block of queries (number, text)."""
    spark = docs.sparkSession
    asked = {r["number"]: terms(r["text"]) for r in rows}
    vocabulary = {w: i for i, w in enumerate(sorted({w for own in asked.values() for w in own}))}
    if not vocabulary:
        return None
    counted = materialize(count_terms(docs, vocabulary))
    n_docs, n_all = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not n_all:
        return None
    frequency = dict(counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    weight = np.array([
        math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency.get(i, 0) + 1))) for i in range(len(vocabulary))
    ], np.int64)
    queries = {}
    for number, own in asked.items():
        at, times = np.unique(np.array([vocabulary[w] for w in own], np.int64), return_counts=True)
        use = weight[at] > 0
        queries[number] = at[use], (weight[at] * times)[use]
    sent = spark.sparkContext.broadcast(queries)
    n_terms = len(vocabulary)

    def run(batches):
        best = {number: Best() for number in sent.value}
        for shard in shards(batches, n_docs, n_all, n_terms):
            for number, query in sent.value.items():
                shard.search(query, best[number])
        for number, b in best.items():
            if len(b.score):
                yield pa.RecordBatch.from_pandas(pd.DataFrame({
                    "number": number, "doc_id": pd.Series(b.ids, dtype="Int64").mask(pd.Series(b.no_id)), "score": b.score,
                }), preserve_index=False)

    return counted.mapInArrow(run, "number bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``TOP`` highest-scoring rows of ``docs`` for each row of ``items``.

    Only scores above 0 count, so an item without a term (null, empty) or with no document that shares one has no row.
    Equal scores go by ascending doc_id, null ids last. A repeated item gets its answers again; repeated
    documents are ranked one by one. Null texts have no terms and count for nothing; texts are read whole. An
    empty table on either side gives no row. ``doc_id`` is a bigint; other columns are not looked at.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    item, text = items.schema["item_id"], items.select("item_id", "text")
    size, n = text.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    empty = spark.createDataFrame([], f"item_id {item.dataType.simpleString()}, rank int, doc_id bigint, score bigint")
    if not size:
        return empty
    n_blocks = -(-size // QUERY_BYTES)
    numbered = materialize(
        text.withColumn("number", F.monotonically_increasing_id())
        .withColumn("block", F.pmod(F.xxhash64("number"), F.lit(n_blocks)))
    )
    found = [
        _search_block(docs, numbered.where(F.col("block") == b).select("number", "text").collect()) for b in range(n_blocks)
    ]
    found = [f for f in found if f is not None]
    if not found:
        return empty
    ranked = found[0]
    for f in found[1:]:
        ranked = ranked.unionByName(f)
    order = W.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return ranked.join(numbered.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")
