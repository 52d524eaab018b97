"""Removal of repeated passages by prefix-partitioned suffix trees.

A suffix is read to a depth of 35 words, as five blocks of seven words: only nodes of that depth
matter, and two suffixes that meet in one are a repeated window. Suffixes are dealt out by a
prefix of one block, or of more blocks where that prefix is frequent, so that a group fits into
memory; a group's suffixes in order, with the common prefix lengths of neighbours, are its
subtree.

Most windows are unique and need no tree. Every window has an anchor, its smallest seven-word
hash; equal windows have equal anchors, and a window whose anchor occurs once is left out before
suffixes are dealt. Documents are worked on in slices; a slice sends each group one compact
array, with equal suffixes merged and counted, and gets one flag back for each. So a passage in
any share of the documents is one suffix per slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feedlake.llm.common import mix64, window_hashes, word_hashes, words
from feedlake.session import materialize, ship

ship(__name__)

BLOCK = 7
BLOCKS = 5
WINDOW = BLOCK * BLOCKS
SLICE_BYTES = 12 << 20
MIN_SLICES = 32
#: Suffixes that a group may hold before its prefix is lengthened.
GROUP_SUFFIXES = 1 << 21
#: Prefixes of each length are counted in this many bins.
BINS = 1 << 16
BIN_CHUNK = 1 << 10


def block_hashes(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each text the hash of every seven words, by position; and the numbers of words."""
    hashes, sizes = word_hashes(texts)
    found = window_hashes(hashes, BLOCK)
    firsts = np.cumsum(sizes) - sizes
    return [found[a:a + max(n - BLOCK + 1, 0)] for a, n in zip(firsts.tolist(), sizes.tolist())], sizes


def _sliding(values: np.ndarray, size: int, of) -> np.ndarray:
    """``of`` (minimum or maximum) over every run of ``size`` values."""
    width = 1
    while width * 2 <= size:
        values = of(values[:-width], values[width:])
        width *= 2
    rest = size - width
    return of(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor of every window, and the block hashes at all positions that anchor some window."""
    span = WINDOW - BLOCK + 1
    if len(blocks) < span:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    of_window = _sliding(blocks, span, np.minimum)
    padded = np.concatenate([np.zeros(span - 1, np.uint64), of_window, np.zeros(span - 1, np.uint64)])
    chosen = _sliding(padded, span, np.maximum) == blocks
    return of_window, blocks[chosen]


def suffixes(blocks: np.ndarray) -> np.ndarray:
    """Each window's five blocks, 32 bits of each; equal rows are equal windows."""
    n = len(blocks) - (WINDOW - BLOCK)
    return np.stack([blocks[j * BLOCK:j * BLOCK + n] for j in range(BLOCKS)], axis=1).astype(np.uint32)


def prefix_hashes(rows: np.ndarray) -> Iterator[np.ndarray]:
    """Hash of the first one, two, ... blocks of each suffix."""
    total = np.ones(len(rows), np.uint64)
    for j in range(BLOCKS):
        total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
        yield total


def prefix_loads(blocks: list[np.ndarray]) -> np.ndarray:
    """How many windows of the documents fall into each bin, by length of the prefix."""
    loads = np.zeros((BLOCKS - 1, BINS), np.int64)
    held, size = [], 0
    for at, of_document in enumerate(blocks, 1):
        if len(of_document) >= WINDOW - BLOCK + 1:
            held.append(suffixes(of_document))
            size += len(held[-1])
        if held and (size >= BINS or at == len(blocks)):
            for load, prefix in zip(loads, prefix_hashes(np.concatenate(held))):
                load += np.bincount((prefix % np.uint64(BINS)).astype(np.int64), minlength=BINS)
            held, size = [], 0
    return loads


def tree_order(rows: np.ndarray) -> np.ndarray:
    """Order of suffixes: by two blocks at once, and by all where suffixes with these two differ further on."""
    wide = rows.astype(np.uint64)
    first, second = (wide[:, j] << np.uint64(32) | wide[:, j + 1] for j in (0, 2))
    order = np.argsort(first)
    same = first[order][1:] == first[order][:-1]
    rest = (second[order][1:] != second[order][:-1]) | (rows[order, 4][1:] != rows[order, 4][:-1])
    run = np.concatenate([[0], np.cumsum(~same)])
    parted = np.zeros(run[-1] + 1, bool)
    parted[run[1:][same & rest]] = True
    open_ = parted[run]
    if open_.any():
        part = order[open_]
        order[open_] = part[np.lexsort([rows[part, 4], second[part], first[part]])]
    return order


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct suffixes in order, the place of each row among them, and their counts.

    Sorted suffixes are the leaves of the tree from left to right; a node of full depth is a
    run of leaves whose common prefix with the next one is all five blocks.
    """
    if not len(rows):
        return rows, np.empty(0, np.int64), np.empty(0, np.int64)
    order = tree_order(rows)
    leaves = rows[order]
    common = np.cumprod(leaves[1:] == leaves[:-1], axis=1).sum(axis=1)
    starts = np.concatenate([[True], common < BLOCKS])
    place = np.empty(len(rows), np.int64)
    place[order] = np.cumsum(starts) - 1
    heads = np.flatnonzero(starts)
    return leaves[heads], place, np.diff(np.append(heads, len(rows)))


class Slice:
    """The windows of a slice's documents that have a repeated anchor."""

    def __init__(self, texts: list[str | None], n: int):
        self.n = n
        self.blocks, self.sizes = block_hashes(texts)
        found = [anchors(b) for b in self.blocks]
        self.windows = [a for a, _ in found]
        chosen = np.concatenate([np.empty(0, np.uint64), *(c for _, c in found)])
        self.keys, self.counts = np.unique(_anchor_keys(chosen, n), return_counts=True)

    def repeated(self, totals: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Suffixes at windows with a repeated anchor, and their positions in each document."""
        often = self.keys[totals > 1]
        positions, rows = [], [np.empty((0, BLOCKS), np.uint32)]
        for blocks, of_window in zip(self.blocks, self.windows):
            at = np.flatnonzero(_is_in(_anchor_keys(of_window, self.n), often))
            positions.append(at)
            if len(at):
                rows.append(suffixes(blocks)[at])
        return np.concatenate(rows), positions


def _is_in(values: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    return sorted_keys[at] == values


def _anchor_keys(values: np.ndarray, n: int) -> np.ndarray:
    """Bucket in the upper half, a key in the lower; keys that clash only keep a window for the tree."""
    mixed = mix64(values)
    return (mixed >> np.uint64(40)) % np.uint64(n) << np.uint64(32) | (mixed & np.uint64(0xFFFFFFFF))


def _split_by(group: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """Cut columns that are sorted by ``group`` into one blob per group."""
    if not len(group):
        return group, [[] for _ in columns]
    cuts = np.flatnonzero(np.diff(group)) + 1
    return group[np.concatenate([[0], cuts])], [[x.tobytes() for x in np.split(c, cuts)] for c in columns]


def _anchor_rows(rows: pd.DataFrame, n: int) -> pd.DataFrame:
    """To each bucket the anchors of a slice; with bucket -1 its counts of prefixes, in chunks of bins."""
    own = Slice(rows["text"].tolist(), n)
    bucket, (keys, counts) = _split_by(
        (own.keys >> np.uint64(32)).astype(np.int64), own.keys.astype(np.uint32), np.minimum(own.counts, 2).astype(np.uint8)
    )
    found = pd.DataFrame({"kind": 0, "bucket": bucket, "keys": keys, "counts": counts})
    chunks = prefix_loads(own.blocks).reshape(-1, BIN_CHUNK)
    used = np.flatnonzero(chunks.any(axis=1))
    sums = pd.DataFrame({
        "kind": 1, "bucket": used, "keys": [b""] * len(used), "counts": [chunks[i].astype(np.int64).tobytes() for i in used],
    })
    return pd.concat([found, sums]).assign(slice=int(rows["slice"].iloc[0]))[["kind", "bucket", "slice", "keys", "counts"]]


def _anchor_totals(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket's anchors summed over the slices (a byte each: 1 or 2 for more), or a chunk of bins summed."""
    if rows["kind"].iloc[0] == 1:
        loads = np.sum([np.frombuffer(b, np.int64) for b in rows["counts"]], axis=0)
        return pd.DataFrame({"kind": [1], "slice": [-1], "part": [rows["bucket"].iloc[0]], "flags": [loads.tobytes()]})
    keys = np.concatenate([np.frombuffer(b, np.uint32) for b in rows["keys"]])
    counts = np.concatenate([np.frombuffer(b, np.uint8) for b in rows["counts"]])
    _, where = np.unique(keys, return_inverse=True)
    totals = np.minimum(np.bincount(where, counts), 2).astype(np.uint8)[where]
    cuts = np.cumsum([len(b) // 4 for b in rows["keys"]])[:-1]
    return pd.DataFrame({
        "kind": 0, "slice": rows["slice"], "part": rows["bucket"], "flags": [t.tobytes() for t in np.split(totals, cuts)],
    })


def _flags(rows: pd.DataFrame, kind: int) -> np.ndarray:
    blobs = rows[rows["kind"] == kind].sort_values("part")["flags"]
    return np.concatenate([np.empty(0, np.uint8), *(np.frombuffer(b, np.uint8) for b in blobs)])


def groups_of(rows: np.ndarray, lengthened: np.ndarray, n_groups: int) -> np.ndarray:
    """Group of each suffix: by the shortest prefix whose bin is not marked in ``lengthened``."""
    group = np.empty(len(rows), np.uint64)
    open_ = np.ones(len(rows), bool)
    for k, prefix in enumerate(prefix_hashes(rows)):
        ends = open_.copy() if k == BLOCKS - 1 else open_ & ~lengthened[k][(prefix % np.uint64(BINS)).astype(np.int64)]
        group[ends] = prefix[ends]
        open_ &= ~ends
    return ((group >> np.uint64(20)) % np.uint64(n_groups)).astype(np.int64)


def _suffixes_by_group(texts, totals, n, lengthened):
    """Distinct suffixes of a slice sorted by group, the place of every candidate window in them, positions, numbers of words."""
    own = Slice(texts, n)
    rows, positions = own.repeated(totals)
    leaves, place, counts = distinct_rows(rows)
    group = groups_of(leaves, lengthened, n)
    order = np.argsort(group, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return group[order], leaves[order], counts[order], rank[place], positions, own.sizes


def _tree_flags(rows: pd.DataFrame) -> pd.DataFrame:
    """For each slice, which of its suffixes end in a node of full depth with two leaves or more."""
    suffix = np.concatenate([np.frombuffer(b, np.uint32).reshape(-1, BLOCKS) for b in rows["keys"]])
    counts = np.concatenate([np.frombuffer(b, np.uint8) for b in rows["counts"]])
    _, place, _ = distinct_rows(suffix)
    flags = (np.bincount(place, counts)[place] >= 2).astype(np.uint8)
    cuts = np.cumsum([len(b) for b in rows["counts"]])[:-1]
    return pd.DataFrame({
        "kind": 1, "slice": rows["slice"], "part": rows["group"], "flags": [f.tobytes() for f in np.split(flags, cuts)],
    })


def covered(n_words: int, starts: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """True for the words inside a window that begins at one of ``starts``."""
    marks = np.zeros(n_words + 1, np.int64)
    marks[starts] += 1
    ends = np.minimum(starts + size, n_words)
    np.add.at(marks, ends, -1)
    return np.cumsum(marks[:-1]) > 0


def mark_repeats(docs: DataFrame, finish, schema: str, keep: list[str]) -> DataFrame:
    """``finish(rows, texts, masks)`` for every slice; a mask is true for the words to remove.

    ``rows`` has the columns ``keep``.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(MIN_SLICES, -(-size // SLICE_BYTES))
    slice_ = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")
    # The slice comes first and the text second, so that other columns may have any name.
    others = [f"c{i}" for i in range(len(keep))]
    sliced = docs.select(slice_.alias("slice"), "text", *(F.col(c).alias(o) for c, o in zip(keep, others)))

    sent = sliced.select("slice", "text").groupBy("slice").applyInPandas(
        lambda rows: _anchor_rows(rows, n), "kind int, bucket long, slice int, keys binary, counts binary")
    flags = "kind int, slice int, part long, flags binary"
    found = materialize(sent.groupBy("kind", "bucket").applyInPandas(_anchor_totals, flags))
    chunks = found.where("kind = 1").select("part", "flags").toPandas()
    loads = np.zeros((BLOCKS - 1) * BINS, np.int64).reshape(-1, BIN_CHUNK)
    for part, blob in zip(chunks["part"], chunks["flags"]):
        loads[part] = np.frombuffer(blob, np.int64)
    lengthened = docs.sparkSession.sparkContext.broadcast(loads.reshape(BLOCKS - 1, BINS) > GROUP_SUFFIXES)
    anchor_flags = found.where("kind = 0")

    def deal(rows: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"group": [], "slice": [], "keys": [], "counts": []})
        group, leaves, counts, _, _, _ = _suffixes_by_group(rows["text"].tolist(), _flags(totals, 0), n, lengthened.value)
        heads, (keys, counts) = _split_by(group, leaves, np.minimum(counts, 2).astype(np.uint8))
        return pd.DataFrame({"group": heads, "slice": int(rows["slice"].iloc[0]), "keys": keys, "counts": counts})

    def back(rows: pa.Table, flags: pa.Table) -> pa.Table:
        texts, known = rows.column("text").to_pylist(), flags.to_pandas()
        _, _, _, place, positions, sizes = _suffixes_by_group(texts, _flags(known, 0), n, lengthened.value)
        repeated = _flags(known, 1)[place] == 1
        masks, at = [], 0
        for size, starts in zip(sizes.tolist(), positions):
            hit = repeated[at:at + len(starts)]
            at += len(starts)
            masks.append(covered(size, starts[hit]))
        return finish(rows.drop_columns(["slice", "text"]).rename_columns(keep), texts, masks)

    dealt = sliced.groupBy("slice").cogroup(anchor_flags.groupBy("slice")).applyInPandas(
        deal, "group long, slice int, keys binary, counts binary")
    ends = dealt.groupBy("group").applyInPandas(_tree_flags, flags)
    both = anchor_flags.unionByName(ends)
    return sliced.groupBy("slice").cogroup(both.groupBy("slice")).applyInArrow(back, schema)


def removed_digests(docs: DataFrame) -> DataFrame:
    """Per document doc_id, n_words, n_removed and the SHA-256 of the kept words joined by spaces.

    Windows are judged on the input: a word goes if some window of 35 words over it starts
    anywhere else too. Null, empty and shorter texts lose nothing. Repeated rows repeat each
    other's windows. Other columns are not looked at.
    """
    def finish(rows, texts, masks):
        digests = []
        for text, mask in zip(texts, masks):
            kept = [w for w, gone in zip(words(text), mask.tolist()) if not gone]
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        added = {
            "n_words": pa.array([len(m) for m in masks], pa.int64()),
            "n_removed": pa.array([int(m.sum()) for m in masks], pa.int64()), "kept_sha256": pa.array(digests, pa.string()),
        }
        return pa.table({"doc_id": rows.column("doc_id"), **added})

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string"
    return mark_repeats(docs, finish, schema, ["doc_id"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with repeated passages taken out of the text, other columns unchanged.

    Words are joined by single spaces in texts that lose some; other texts stay as they are.
    """
    def finish(rows, texts, masks):
        left = []
        for text, mask in zip(texts, masks):
            if mask.any():
                text = b" ".join(w for w, gone in zip(words(text), mask.tolist()) if not gone).decode()
            left.append(text)
        return rows.append_column("text", pa.array(left, pa.string())).select(columns)

    columns = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return mark_repeats(docs, finish, schema, [c for c in columns if c != "text"])
