"""Removal of repeated byte strings with suffix arrays built block by block over a difference cover.

Only suffixes whose first 400 bytes occur again matter. Equal strings of 400 bytes have the same
anchor, the smallest hash of 32 bytes in them, so all suffixes with one anchor form a bucket. Windows that
follow each other with one anchor are a region, the unit that is counted and sent: equal regions become one
with a count, and a region whose anchor occurs nowhere else, nor twice in itself, is unique as a whole. Texts of the
regions that meet others at their anchor, or themselves, are sent once each to the task of their bucket.

A task holds the regions of some buckets as one text. It ranks the suffixes at the positions of a difference
cover modulo 32 by doubling, from 32 bytes on until no two are equal. Then it sorts the windows block by block: by
32 bytes, and ties by the ranks at the first distance, below 32, at which both positions lie in the cover. So
no comparison reads more than 32 bytes, and memory holds one block besides the text and the cover. Neighbours in this
order that agree on 400 bytes are repeats; the agreement is checked on bytes and exact ranks, not on hashes.

Windows of an anchor with very many different regions (text around a passage that very many documents share) are
counted by 128-bit hashes instead, each on its own, so that no task has to hold them together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from feedlake.llm.common import fresh, map_texts, mix64, slices
from feedlake.session import materialize, ship

ship(__name__)

WINDOW = 400
SEED = 32
PERIOD = 32
#: Depths whose ranks are kept: together with 32 bytes before and 48 at the end they make up a window.
DEPTHS = (256, 64, 32)
#: Windows that are worked on at once, and those of a region at most.
CHUNK = 1 << 18
REGION_WINDOWS = 1 << 12
#: Bytes of regions in a task's text, windows in a block.
TASK_BYTES = 4 << 20
BLOCK_WINDOWS = 1 << 18
#: Anchors with more different regions than this are hot.
HOT_REGIONS = 2_000

BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def difference_cover(period: int) -> list[int]:
    """Residues such that every difference modulo ``period`` lies between two of them, chosen greedily."""
    cover, missing = [0], set(range(1, period))
    while missing:
        gain = lambda x: len(missing & {d % period for c in cover for d in (x - c, c - x)})
        cover.append(max(range(period), key=gain))
        missing -= {(a - b) % period for a in cover for b in cover}
    return sorted(cover)


COVER = difference_cover(PERIOD)
PLACE = np.full(PERIOD, -1, np.int64)
PLACE[COVER] = np.arange(len(COVER))
#: Smallest distance at which positions with residues a and b both lie in the cover, at a * PERIOD + b.
DISTANCE = np.array([
    next(d for d in range(PERIOD) if PLACE[(a + d) % PERIOD] >= 0 and PLACE[(b + d) % PERIOD] >= 0)
    for a in range(PERIOD) for b in range(PERIOD)
])


def ordered(keys: np.ndarray, bits: int) -> np.ndarray:
    """Order of keys of ``bits`` bits; with room for the places in 64 bits the values themselves are sorted."""
    room = int(len(keys)).bit_length()
    if bits + room > 64:
        return np.argsort(keys)
    packed = np.sort(keys.astype(np.uint64) << np.uint64(room) | np.arange(len(keys), dtype=np.uint64))
    return (packed & np.uint64((1 << room) - 1)).astype(np.int64)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of 32 bytes, by position, and the smallest one in every window of 400."""
    codes, factor = BYTE_CODES[data], 0xD6E8FEB86659FD93
    width = 1
    while width < SEED:
        codes = codes[:-width] * np.uint64(factor) + codes[width:]
        factor = factor * factor % (1 << 64)
        width *= 2
    hashes = least = mix64(codes)
    width, span = 1, WINDOW - SEED + 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = span - width
    return hashes, np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def regions(data: bytes) -> Iterator[tuple[int, int, int, int, bool]]:
    """(anchor, hash, first window, windows, is the anchor in it twice) of the regions of a text, in order."""
    view, whole = memoryview(data), np.frombuffer(data, np.uint8)
    for at in range(0, len(data) - WINDOW + 1, CHUNK):
        hashes, of_window = anchors(whole[at:at + CHUNK + WINDOW - 1])
        change = np.flatnonzero(of_window[1:] != of_window[:-1]) + 1
        cuts = np.unique(np.concatenate([change, np.arange(0, len(of_window), REGION_WINDOWS)]))
        sizes = np.diff(np.append(cuts, len(of_window))).tolist()
        for cut, size, anchor in zip(cuts.tolist(), sizes, of_window[cuts]):
            first = cut + at
            twice = np.count_nonzero(hashes[cut:cut + size + WINDOW - SEED] == anchor) > 1
            yield int(anchor.view(np.int64)), _signed(xxhash.xxh3_64_intdigest(view[first:first + size + WINDOW - 1])), first, size, twice


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


class Cover:
    """Ranks of the suffixes of a text at the cover's positions: of whole suffixes, and of their first bytes."""

    def __init__(self, text: bytes):
        n = -(-len(text) // PERIOD) * PERIOD
        padded = np.frombuffer(text + bytes(n - len(text) + 2 * SEED), np.uint8)
        #: Eight bytes from each position on, ordered like them.
        self.eight = np.zeros(n + SEED, np.uint64)
        for k in range(8):
            self.eight = self.eight << np.uint64(8) | padded[k:k + n + SEED]
        at = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)).ravel()
        order, new = self.sorted_by_bytes(at)
        depth, have = SEED, self._ranks(order, new)
        # Ranks by position in the text; places outside of the cover are never asked for.
        self.ranks, self.whole = {}, None
        wide = int(2 * len(have)).bit_length()
        # Past the end, a shorter suffix comes first.
        past = len(have) - np.arange(len(have))
        while depth < max(DEPTHS) or have.max(initial=0) < len(have):
            ahead = len(COVER) * (depth // PERIOD)
            beyond = np.concatenate([have[ahead:] + len(have), past[-ahead:]])
            if depth in DEPTHS:
                self.ranks[depth] = self._spread(have, at, n)
            key = have << wide | beyond
            order = ordered(key, 2 * wide)
            have = self._ranks(order, key[order][1:] != key[order][:-1])
            depth *= 2
        if depth in DEPTHS:
            self.ranks[depth] = self._spread(have, at, n)
        self.whole = self._spread(have, at, n)

    @staticmethod
    def _spread(ranks: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n + PERIOD, np.int32)
        out[at] = ranks
        return out

    @staticmethod
    def _ranks(order: np.ndarray, new: np.ndarray) -> np.ndarray:
        out = np.empty(len(order), np.int64)
        out[order] = np.concatenate([np.ones(min(1, len(order)), np.int64), 1 + np.cumsum(new)])
        return out

    def sorted_by_bytes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of positions by their first 32 bytes, and whether each differs from the one before it.

        Equal ones are brought together by a hash, checked on the bytes; then one of each kind is sorted.
        """
        keys = [self.eight[at + k] for k in range(0, SEED, 8)]
        code = keys[0]
        for key in keys[1:]:
            code = mix64(code) + key
        by_code = np.argsort(code)
        first = np.ones(len(at), bool)
        first[1:] = code[by_code][1:] != code[by_code][:-1]
        kind = np.cumsum(first) - 1
        heads = by_code[first]
        if any((key[by_code] != key[heads][kind]).any() for key in keys):
            order = np.lexsort(keys[::-1])
            new = np.zeros(max(len(at) - 1, 0), bool)
            for key in keys:
                new |= key[order][1:] != key[order][:-1]
            return order, new
        rank = np.empty(len(heads), np.int64)
        rank[np.lexsort([key[heads] for key in keys][::-1])] = np.arange(len(heads))
        group = np.empty(len(at), np.int64)
        group[by_code] = rank[kind]
        order = ordered(group, int(len(heads)).bit_length())
        return order, group[order][1:] != group[order][:-1]

    @staticmethod
    def distance(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return DISTANCE[(i & (PERIOD - 1)) * PERIOD + (j & (PERIOD - 1))]

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Is suffix i before suffix j, given that their first 32 bytes are equal?"""
        d = self.distance(i, j)
        return self.whole[i + d] < self.whole[j + d]

    def agree(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Are the 400 bytes at i and j equal, given that the first 32 are?"""
        d = self.distance(i, j)
        a, b = i + d, j + d
        same, skip = np.ones(len(i), bool), 0
        for depth in DEPTHS:
            ranks = self.ranks[depth]
            same &= ranks[a + skip] == ranks[b + skip]
            skip += depth
        for k in range(skip, WINDOW, 8):
            same &= self.eight[i + k] == self.eight[j + k]
        return same

    def sort(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window starts in suffix order, and whether each shares its first 32 bytes with the one before it."""
        order, new = self.sorted_by_bytes(at)
        at = at[order]
        group = np.concatenate([np.zeros(1, np.int64), np.cumsum(new)])
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if len(tied):
            at[tied] = self._by_cover(at[tied], group[tied])
        return at, np.concatenate([[False], ~new])

    def _by_cover(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Sort ties: within a residue by one rank, then residues of a group merged two and two."""
        residue = at & (PERIOD - 1)
        own = self.whole[at + self.distance(at, at)].astype(np.int64)
        wide = int(own.max()).bit_length()
        group = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
        order = ordered((group * PERIOD + residue) << wide | own, int(group[-1] * PERIOD + PERIOD).bit_length() + wide)
        at, group, residue = at[order], group[order], residue[order]
        run = np.concatenate([np.zeros(1, np.int64), np.cumsum((group[1:] != group[:-1]) | (residue[1:] != residue[:-1]))])
        while True:
            heads = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            of_group = group[heads]
            first_run = np.searchsorted(of_group, of_group)
            number = np.arange(len(heads)) - first_run
            if not number.any():
                return at
            ends = np.append(heads[1:], len(at))
            partner = np.arange(len(heads)) + np.where(number % 2 == 0, 1, -1)
            paired = (partner < len(heads)) & (of_group[np.minimum(partner, len(heads) - 1)] == of_group)
            owner = np.repeat(np.arange(len(heads)), ends - heads)
            mine = np.flatnonzero(paired[owner])
            r = owner[mine]
            low, high = heads[partner[r]], ends[partner[r]]
            base, left = low.copy(), number[r] % 2 == 0
            # How many of the partner's suffixes come first.
            while (low < high).any():
                middle = (low + high) // 2
                open_ = low < high
                first = self.before(at[np.where(open_, middle, 0)], at[mine])
                low = np.where(open_ & first, middle + 1, low)
                high = np.where(open_ & ~first, middle, high)
            place = np.arange(len(at))
            start = np.where(left, heads[r], heads[np.maximum(partner[r], 0)])
            place[mine] = start + (mine - heads[r]) + (low - base)
            moved = np.empty_like(at)
            moved[place] = at
            at = moved
            # Runs 2k and 2k + 1 of a group are one run now.
            merged = first_run + number // 2
            run = np.repeat(merged, ends - heads)


def repeated_windows(texts: list[bytes], counts: np.ndarray) -> list[np.ndarray]:
    """For each region text, which of its windows occur twice or more; a region stands for ``counts`` equal ones."""
    begins = np.cumsum([0, *map(len, texts)])[:-1]
    sizes = np.array([len(t) - WINDOW + 1 for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(sizes) - sizes
    starts = begins[owner] + np.arange(len(owner)) - first[owner]
    cover = Cover(b"".join(texts))
    out = np.zeros(len(starts), bool)
    number = np.zeros(len(cover.eight), np.int64)
    number[starts] = np.arange(len(starts))
    leading = cover.eight[starts]
    for block in blocks_of(leading):
        which = np.flatnonzero(block)
        at, tied = cover.sort(starts[which])
        window = number[at]
        same = tied.copy()
        pair = np.flatnonzero(tied)
        same[pair] = cover.agree(at[pair - 1], at[pair])
        kind = np.cumsum(~same) - 1
        out[window] = np.bincount(kind, counts[owner[window]])[kind] >= 2
    return np.split(out, first[1:])


def blocks_of(leading: np.ndarray) -> Iterator[np.ndarray]:
    """Masks of windows by ranges of their first eight bytes, about ``BLOCK_WINDOWS`` each."""
    n = -(-len(leading) // BLOCK_WINDOWS)
    step = max(1, len(leading) // (64 * n))
    cuts = np.unique(np.sort(leading[::step])[:: -(-len(leading[::step]) // n)][1:])
    block = np.searchsorted(cuts, leading, "right")
    for k in range(len(cuts) + 1):
        mask = block == k
        if mask.any():
            yield mask


def _runs(mask: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edges[::2].tolist(), edges[1::2].tolist()


KEY = ["anchor", "region", "size"]
RESULT = "anchor long, region long, size int, froms array<bigint>, tos array<bigint>"


def _sort_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """Repeated windows of the regions of some anchors."""
    rows = rows.drop_duplicates(KEY)
    found = [_runs(m) for m in repeated_windows(rows["data"].tolist(), rows["n"].to_numpy())]
    return rows[KEY].assign(froms=[f for f, _ in found], tos=[t for _, t in found])


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` regions with their bytes, each read from the document it was found in."""
    by_doc = wanted.groupBy("id", "key").agg(F.collect_list(F.struct(*KEY, "n", "first")).alias("parts"))
    held = docs.join(by_doc, docs["id"].eqNullSafe(by_doc["id"]) & (docs["key"] == by_doc["key"])).select(
        "text", *(F.col("parts")[c].alias(c) for c in ("anchor", "region", "size", "n", "first")))
    names = {"anchors": "array<bigint>", "regions": "array<bigint>", "sizes": "array<bigint>", "ns": "array<bigint>", "datas": "array<binary>"}

    def setup():
        def work(texts, anchor, region, size, n, first):
            datas = []
            for text, f, s in zip(texts, first, size):
                whole = text.encode()
                datas.append([whole[a:a + k + WINDOW - 1] for a, k in zip(f, s)])
            return anchor, region, size, n, datas

        return work

    sent = map_texts(held, [], ["text", "anchor", "region", "size", "n", "first"], names, setup)
    rows = sent.select(F.explode(F.arrays_zip("anchors", "regions", "sizes", "ns", "datas")).alias("r"))
    return rows.select(
        F.col("r.anchors").alias("anchor"), F.col("r.regions").alias("region"), F.col("r.sizes").cast("int").alias("size"),
        F.col("r.ns").alias("n"), F.col("r.datas").alias("data"))


WINDOWS = "slice bigint, hash binary, n bigint, anchors array<bigint>, regions array<bigint>, sizes array<bigint>, ats array<bigint>"


def _slice_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different windows of some regions, by hash, with the places of each."""
    for batch in batches:
        for part in slices(batch, "data"):
            rows = part.to_pylist()
            places = {}
            for r in rows:
                data, own = r["data"], (r["anchor"], r["region"], r["size"])
                for i in range(r["size"]):
                    places.setdefault(xxhash.xxh3_128_digest(data[i:i + WINDOW]), []).append((r["n"], *own, i))
            out = {"slice": [rows[0]["region"]] * len(places), "hash": list(places), "n": [sum(p[0] for p in x) for x in places.values()]}
            for k, name in enumerate(("anchors", "regions", "sizes", "ats"), 1):
                out[name] = [[p[k] for p in x] for x in places.values()]
            yield pa.RecordBatch.from_pydict(out)


def _windows_by_region(hits: pd.DataFrame) -> pd.DataFrame:
    found = {}
    for row in zip(hits["anchors"], hits["regions"], hits["sizes"], hits["ats"]):
        for anchor, region, size, at in zip(*row):
            found.setdefault((anchor, region, size), []).append(at)
    froms = [sorted(x) for x in found.values()]
    out = pd.DataFrame(list(found), columns=KEY)
    return out.assign(froms=froms, tos=[[x + 1 for x in f] for f in froms])


def _by_hash(hot: DataFrame) -> DataFrame:
    """Repeated windows of hot anchors' regions, every window counted on its own.

    Tasks merge equal windows before they are counted, so a window in a third of all documents is a row per slice
    of regions, and so is what comes back. Windows are shuffled by hash once.
    """
    windows = hot.dropDuplicates(KEY).mapInArrow(_slice_windows, WINDOWS)
    often = windows.withColumn("total", F.sum("n").over(W.partitionBy("hash"))).where("total > 1")
    return often.groupBy("slice").applyInPandas(_windows_by_region, RESULT)


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(id, key, froms, tos): ranges of window starts whose 400 bytes start elsewhere too.

    ``docs`` has id, text and key, a hash of the text; rows with equal id and key get one row.
    """
    def setup():
        def work(texts):
            found = [list(zip(*regions(t.encode()))) for t in texts]
            return [[f[k] for f in found] for k in range(5)]

        return work

    long_enough = docs.where(F.octet_length("text") >= WINDOW)
    outputs = {"anchors": "array<bigint>", "regions": "array<bigint>", "firsts": "array<bigint>", "sizes": "array<int>", "twices": "array<boolean>"}
    cut = materialize(map_texts(long_enough, ["id", "key"], ["text"], outputs, setup))
    cut = cut.select("id", "key", F.explode(F.arrays_zip(*outputs)).alias("r")).select(
        "id", "key", F.col("r.anchors").alias("anchor"), F.col("r.regions").alias("region"),
        F.col("r.firsts").alias("first"), F.col("r.sizes").alias("size"), F.col("r.twices").alias("twice"))
    counted = materialize(cut.groupBy(KEY).agg(
        F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("id", "key", "first", "twice"))))
    meeting = counted.groupBy("anchor").agg(
        F.count("*").alias("kinds"), F.sum("n").alias("total"), F.max("twice").alias("any_twice"))
    judged = materialize(counted.join(meeting.where("total > 1 OR any_twice").drop("total", "any_twice"), "anchor"))

    alone = judged.where("kinds = 1 AND n > 1").select(
        *KEY, F.array(F.lit(0).cast("long")).alias("froms"), F.array(F.col("size").cast("long")).alias("tos"))
    wanted = judged.where("kinds > 1 OR n = 1").withColumn("hot", F.col("kinds") > HOT_REGIONS)
    size, hot = wanted.agg(F.sum(F.when(~F.col("hot"), F.col("size") + WINDOW)), F.max("hot")).first()
    results = [alone]
    if size:
        n = -(-size // TASK_BYTES)
        sent = _texts_of(docs, wanted.where("NOT hot"))
        bucketed = sent.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(n)))
        results.append(bucketed.groupBy("bucket").applyInPandas(_sort_bucket, RESULT))
    if hot:
        # Not stored, so that it takes the shuffle of the texts that the other joins take.
        results.append(_by_hash(_texts_of(docs, wanted.where("hot"))))
    known = results[0]
    for r in results[1:]:
        known = known.unionByName(r)
    known = known.where(F.size("froms") > 0)
    moved = lambda column: F.transform(column, lambda x: x + F.col("first"))
    return cut.drop("twice").join(known, KEY).groupBy("id", "key").agg(
        F.flatten(F.collect_list(moved("froms"))).alias("froms"), F.flatten(F.collect_list(moved("tos"))).alias("tos"))


def covered_spans(froms: np.ndarray, tos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte ranges covered by the windows that start in the given ranges."""
    order = np.argsort(froms, kind="stable")
    begin, end = froms[order], np.maximum.accumulate(tos[order] + WINDOW - 1)
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    return begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without ``text``, plus the bytes left and the byte ranges removed.

    Added: ``kept`` (binary, UTF-8 bytes that no repeated string of 400 covers, concatenated; a cut may split a
    character), ``starts`` and ``ends`` (array<bigint>, removed ranges, ends exclusive, in order). Clashing names
    get a trailing underscore. Strings are judged on the input and never cross documents. Null and empty texts
    leave no bytes and no range; texts under 400 bytes lose nothing. Repeated rows repeat each other's strings and so lose
    them. Texts of any length are read whole. An empty table gives no row.
    """
    columns = [c for c in docs.columns if c != "text"]
    others = ["id" if c == "doc_id" else f"c{i}" for i, c in enumerate(columns)]
    # Without further columns both joins with the texts deal the same rows alike, so Spark shuffles them once.
    further = [F.col(c).alias(o) for c, o in zip(columns, others) if c != "doc_id"]
    narrow = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), "text", *further)
    starts = repeated_starts(narrow.select("id", "key", "text")).withColumnsRenamed({"id": "id2", "key": "key2"})
    joined = narrow.join(starts, F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")), "left")

    def setup():
        def work(texts, froms, tos):
            kept, begins, ends = [], [], []
            for text, f, t in zip(texts, froms, tos):
                data = (text or "").encode()
                begin, end = covered_spans(np.array(f), np.array(t)) if f else (np.empty(0, np.int64),) * 2
                begins.append(begin.tolist())
                ends.append(end.tolist())
                gaps = zip([0, *ends[-1]], [*begins[-1], len(data)])
                kept.append(b"".join(data[a:b] for a, b in gaps))
            return kept, begins, ends

        return work

    done = map_texts(joined, others, ["text", "froms", "tos"], {"kept": "binary", "starts": "array<bigint>", "ends": "array<bigint>"}, setup)
    names = fresh(docs.select(*columns), "kept", "starts", "ends")
    return done.select(
        *(F.col(o).alias(c) for c, o in zip(columns, others)), *(F.col(o).alias(c) for c, o in zip(names, ("kept", "starts", "ends"))))


def removed_digests(docs: DataFrame) -> DataFrame:
    """Per document doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes left."""
    done = remove_repeats(docs.select("doc_id", "text"))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, x: a + x)
    return done.select(
        "doc_id", (F.octet_length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
