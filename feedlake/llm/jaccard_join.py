"""Exact similarity join of shingle sets by count-vector R-trees.

Rows with equal sets are one node. A node can only link if enough of its shingles also occur
in other nodes, so document frequencies are counted first and most nodes end there. What is
left is cut into parts that no link leaves, by the rarest shingles of each set, and an R-tree
over count vectors finds the links of each part. Frequencies are counted in blocks: a slice of
nodes sends each bucket of hashes one compact array and gets the totals back, so no shingle is
a row and none gathers its documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from feedlake.llm.common import WordHashes, fresh, mix64, slices, window_hashes
from feedlake.llm.components import components
from feedlake.session import materialize, ship

ship(__name__)

#: Groups that tokens are hashed into; a node's counts in them are its point.
GROUPS = 64
LEAF = 16
FAN_OUT = 16
#: Nodes of one tile; a part with more is joined tile by tile.
TILE_NODES = 1024
SLICE_HASHES = 1 << 21
MIN_SLICES = 32
#: Share of the hash space that the first count of frequencies looks at, in all nodes. It must
#: hold more shingles than a node may have for itself, or nobody is sorted out.
FIRST_SHARE = 0.3
FILTER_BITS_PER_NODE, MOST_FILTER_BITS, PROBES = 16, 1 << 27, 3


@dataclass(frozen=True)
class Rule:
    """Sets of distinct ``size``-word shingles link at 100 * intersection >= percent * union."""

    size: int = 4
    percent: int = 85

    def own(self, n):
        """How many shingles of a set of ``n`` a linked set may lack."""
        return n - -(-self.percent * n // 100)

    def needed(self, a, b):
        """Smallest intersection with which sets of ``a`` and ``b`` shingles link."""
        return -(-self.percent * (a + b) // (100 + self.percent))


def shingles(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes: ASCII letters lower-cased, fewer words than ``size`` as one."""
    ids = hashes.of(text.encode().lower().split() if text else [])
    return np.unique(window_hashes(ids, min(size, len(ids)))) if len(ids) else np.empty(0, np.uint64)


def node_of(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _sketch(found: np.ndarray) -> np.ndarray:
    """The part of a set that the first count looks at."""
    return found[: np.searchsorted(found, np.uint64(int(FIRST_SHARE * (1 << 64))))]


def document_nodes(docs: DataFrame, rule: Rule, keep: list[str]) -> DataFrame:
    """Columns ``keep``, n_shingles, node, and the sketch where a task meets a node first."""
    own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        hashes, met = WordHashes(), set()
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingles(t, rule.size, hashes) for t in part.column("text").to_pylist()]
                nodes = [node_of(s) for s in sets]
                sketches = []
                for s, node in zip(sets, nodes):
                    new = len(s) and node not in met
                    if new:
                        met.add(node)
                    sketches.append(_sketch(s).tobytes() if new else None)
                added = [pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), *added], names=[*keep, "n_shingles", "node", "hashes"])

    columns = docs.select(*dict.fromkeys([*keep, "text"]))
    return columns.mapInArrow(run, f"{own}, n_shingles bigint, node binary, hashes binary")


# --- document frequencies, by slices of nodes and buckets of hashes ------------------


def _keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper, a 32-bit key in the lower half. Two hashes share a key about once in
    2,000 buckets' worth of hashes; that only makes a shingle look more frequent."""
    mixed = mix64(hashes)
    return (mixed >> np.uint64(40)) % np.uint64(buckets) << np.uint64(32) | (mixed & np.uint64(0xFFFFFFFF))


def _once(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.drop_duplicates("node").sort_values("node", kind="stable", ignore_index=True)


def _concat(blobs) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(b, np.uint64) for b in blobs)])


def with_frequencies(rows: DataFrame, n_hashes: int, finish, schema: str) -> DataFrame:
    """``finish(nodes, sets, frequencies)`` for every slice of the nodes.

    ``rows`` has (node, n_shingles, hashes), hashes a sorted array of 64 bits; repeated nodes
    count once. A frequency is the number of nodes that have the shingle, 255 for more.
    """
    n = max(MIN_SLICES, -(-n_hashes // SLICE_HASHES))
    sliced = rows.select(F.pmod(F.xxhash64("node"), F.lit(n)).cast("int").alias("slice"), "node", "n_shingles", "hashes")

    def up(rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = np.unique(_keys(_concat(_once(rows)["hashes"]), n), return_counts=True)
        bucket = (keys >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        ks, cs = np.split(keys.astype(np.uint32), cuts), np.split(np.minimum(counts, 65535).astype(np.uint16), cuts)
        heads = bucket[np.concatenate([[0], cuts])] if len(bucket) else bucket
        m = len(heads)
        return pd.DataFrame({
            "bucket": heads, "slice": np.full(m, int(rows["slice"].iloc[0])),
            "keys": [k.tobytes() for k in ks[:m]], "counts": [c.tobytes() for c in cs[:m]],
        })

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(b, np.uint32) for b in rows["keys"]])
        counts = np.concatenate([np.frombuffer(b, np.uint16) for b in rows["counts"]])
        _, where = np.unique(keys, return_inverse=True)
        totals = np.minimum(np.bincount(where, counts), 255).astype(np.uint8)[where]
        cuts = np.cumsum([len(b) // 4 for b in rows["keys"]])[:-1]
        return pd.DataFrame({
            "slice": rows["slice"], "bucket": rows["bucket"], "totals": [t.tobytes() for t in np.split(totals, cuts)],
        })

    def back(rows: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        rows = _once(rows)
        hashes = _concat(rows["hashes"])
        _, where = np.unique(_keys(hashes, n), return_inverse=True)
        blobs = totals.sort_values("bucket")["totals"]
        frequency = np.concatenate([np.empty(0, np.uint8), *(np.frombuffer(b, np.uint8) for b in blobs)])[where]
        cuts = np.cumsum([len(b) // 8 for b in rows["hashes"]])[:-1]
        return finish(rows, np.split(hashes, cuts), np.split(frequency, cuts))

    sent = sliced.groupBy("slice").applyInPandas(up, "bucket long, slice int, keys binary, counts binary")
    totals = sent.groupBy("bucket").applyInPandas(count, "slice int, bucket long, totals binary")
    return sliced.groupBy("slice").cogroup(totals.groupBy("slice")).applyInPandas(back, schema)


def _candidates(nodes: DataFrame, rule: Rule) -> DataFrame:
    """Nodes whose sketch has few enough shingles that no other node has, stored."""
    def finish(rows, sets, frequencies):
        own = np.array([int((f < 2).sum()) for f in frequencies])
        n = rows["n_shingles"].to_numpy()
        return rows.loc[own <= rule.own(n), ["node", "n_shingles"]]

    n_hashes = nodes.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    return materialize(with_frequencies(nodes, n_hashes // 8, finish, "node binary, n_shingles bigint"))


def _probes(nodes: list[bytes], bits: int) -> np.ndarray:
    low = np.array([int.from_bytes(b[:8], "little") for b in nodes], np.uint64)
    high = np.array([int.from_bytes(b[8:], "little") for b in nodes], np.uint64)
    return np.stack([(low + high * np.uint64(i)) & np.uint64(bits - 1) for i in range(PROBES)]).view(np.int64)


def node_filter(candidates: DataFrame) -> np.ndarray:
    """Bloom filter of the candidates, at most ``MOST_FILTER_BITS`` large.

    It spares the sets of other nodes the way through the shuffle. One that it lets through
    costs work and changes nothing.
    """
    n, bits = candidates.count(), 1 << 16
    while bits < min(n * FILTER_BITS_PER_NODE, MOST_FILTER_BITS):
        bits *= 2

    def run(batches):
        for rows in batches:
            at = _probes(rows["node"].tolist(), bits).ravel()
            yield pd.DataFrame({"word": at >> 6, "bit": np.left_shift(np.int64(1), at & 63)})

    words_ = candidates.select("node").mapInPandas(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit"))
    rows = words_.toPandas()
    out = np.zeros(bits >> 6, np.int64)
    out[rows["word"].to_numpy()] = rows["bit"].to_numpy()
    return out


def candidate_sets(docs: DataFrame, rule: Rule, filter_words: np.ndarray) -> DataFrame:
    """(node, n_shingles, hashes) with whole sets, for rows that pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_words)

    def run(batches):
        hashes, met, bits = WordHashes(), set(), shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text in part.column("text").to_pylist():
                    found = shingles(text, rule.size, hashes)
                    node = node_of(found)
                    at = _probes([node], len(bits) << 6)[:, 0]
                    if len(found) and node not in met and ((bits[at >> 6] >> (at & 63)) & 1).all():
                        met.add(node)
                        rows.append((node, len(found), found.tobytes()))
                columns = [*zip(*rows)] or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())],
                    names=["node", "n_shingles", "hashes"])

    return docs.select("text").mapInArrow(run, "node binary, n_shingles bigint, hashes binary")


def linkable(sets: DataFrame, n_hashes: int, rule: Rule) -> DataFrame:
    """Nodes that may link, with their sets and ``keys``, stored.

    Keys are the shared ones among the first ``own + 1`` shingles of a set, rarest first. Two
    sets that link lack too few of each other's shingles for these to be disjoint.
    """
    def finish(rows, sets_, frequencies):
        kept, keys = [], []
        for n, found, frequency in zip(rows["n_shingles"], sets_, frequencies):
            own = rule.own(int(n))
            kept.append(int((frequency < 2).sum()) <= own)
            order = np.lexsort([found, frequency])[: own + 1]
            keys.append(found[order[frequency[order] >= 2]].view(np.int64).tolist() if kept[-1] else [])
        return rows.assign(keys=keys).loc[kept, ["node", "n_shingles", "hashes", "keys"]]

    schema = "node binary, n_shingles bigint, hashes binary, keys array<long>"
    return materialize(with_frequencies(sets, n_hashes, finish, schema))


def parts_of(nodes: DataFrame) -> DataFrame:
    """(node, part): nodes with a common key are in one part; nodes without are left out."""
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    first = keyed.groupBy("key").agg(F.min("node").alias("first"))
    edges = keyed.join(first, "key").where(F.col("node") != F.col("first"))
    edges = edges.select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    return components(edges).withColumnRenamed("label", "part")


# --- the R-tree ----------------------------------------------------------------------


class Tree:
    """R-tree over count vectors, packed by size and then by content.

    ``highs[k]`` holds the largest coordinates and ``lows[k]`` the smallest set size below each
    entry of level k; level 0 are the points. ``spans[k]`` are the points below an entry.
    """

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        self.order = self._packed(vectors, sizes)
        self.highs, self.lows = [vectors[self.order]], [sizes[self.order]]
        self.tops, self.spans = [sizes[self.order]], [np.arange(len(sizes) + 1)]
        width = LEAF
        while len(self.highs[-1]) > 1:
            starts = np.arange(0, len(self.highs[-1]), width)
            self.highs.append(np.maximum.reduceat(self.highs[-1], starts))
            self.lows.append(np.minimum.reduceat(self.lows[-1], starts))
            self.tops.append(np.maximum.reduceat(self.tops[-1], starts))
            self.spans.append(np.append(self.spans[-1][starts], len(sizes)))
            width = FAN_OUT

    @staticmethod
    def _packed(vectors: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sort-tile order: slabs of similar size, inside a slab by the coordinate that varies most."""
        by_size = np.argsort(sizes, kind="stable")
        slab = LEAF * FAN_OUT
        out = []
        for at in range(0, len(by_size), slab):
            rows = by_size[at:at + slab]
            axis = int(np.argmax(vectors[rows].astype(float).var(axis=0)))
            out.append(rows[np.lexsort([sizes[rows], vectors[rows, axis]])])
        return np.concatenate(out) if out else by_size


def point(found: np.ndarray) -> np.ndarray:
    """How many shingles of a set fall into each group."""
    return np.bincount((mix64(found) >> np.uint64(58)).astype(np.int64), minlength=GROUPS).astype(np.int32)


class Union:
    """Disjoint sets over 0..n-1; the smallest member is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def tree_links(sets: list[np.ndarray], rule: Rule, groups: Union, sides: np.ndarray | None = None) -> Union:
    """Join in ``groups`` all points that links connect.

    Pairs of tree entries are followed down while the sum of the smaller coordinates allows
    a link and their points are not all in one group. Points that are left are compared. With
    ``sides`` only pairs from both sides are looked at.
    """
    if len(sets) < 2:
        return groups
    sizes = np.array([len(s) for s in sets])
    tree = Tree(np.stack([point(s) for s in sets]), sizes)
    order = tree.order.tolist()
    top = len(tree.highs) - 1
    stack = [(top, 0, 0)]
    while stack:
        level, a, b = stack.pop()
        if level == 1:
            _compare(tree, order, sets, rule, groups, sides, a, b)
            continue
        below = level - 1
        width = LEAF if below == 0 else FAN_OUT
        left = np.arange(a * width, min((a + 1) * width, len(tree.highs[below])))
        right = np.arange(b * width, min((b + 1) * width, len(tree.highs[below])))
        for i in left:
            js = right[right >= i]
            for j in js[_may_link(tree, below, i, js, rule)]:
                if not _settled(tree, order, groups, below, i, j):
                    stack.append((below, int(i), int(j)))
    return groups


def _may_link(tree: Tree, level: int, i: int, js: np.ndarray, rule: Rule) -> np.ndarray:
    """True where the bound on the overlap of entries ``i`` and ``js`` reaches what a link needs."""
    bound = np.minimum(tree.highs[level][i], tree.highs[level][js]).sum(axis=1)
    return bound >= rule.needed(tree.lows[level][i], tree.lows[level][js])


def _settled(tree: Tree, order: list[int], groups: Union, level: int, i: int, j: int) -> bool:
    roots = {groups.find(order[p]) for e in (i, j) for p in range(tree.spans[level][e], tree.spans[level][e + 1])}
    return len(roots) == 1


def _compare(tree, order, sets, rule, groups, sides, a, b) -> None:
    points = np.arange(b * LEAF, min((b + 1) * LEAF, len(order)))
    for i in range(a * LEAF, min((a + 1) * LEAF, len(order))):
        js = points[points > i]
        if not len(js):
            continue
        x = order[i]
        for j in js[_may_link(tree, 0, i, js, rule)].tolist():
            y = order[j]
            if sides is not None and sides[x] == sides[y] or groups.find(x) == groups.find(y):
                continue
            common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if common >= rule.needed(len(sets[x]), len(sets[y])):
                groups.join(x, y)


# --- parts, and tiles of large parts -------------------------------------------------


def _sets(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in rows["hashes"]]


def _roots(rows: pd.DataFrame, rule: Rule) -> pd.DataFrame:
    """(node, root) of the links among ``rows``."""
    rows = rows.sort_values("node", kind="stable", ignore_index=True)
    groups = tree_links(_sets(rows), rule, Union(len(rows)))
    nodes = rows["node"].tolist()
    return pd.DataFrame({"node": nodes, "root": [nodes[groups.find(i)] for i in range(len(rows))]})


def small_part_roots(rows: DataFrame, n_nodes: int, rule: Rule) -> DataFrame:
    """(node, root) for parts of at most a tile; several parts share a task's group."""
    units = max(MIN_SLICES, -(-n_nodes // TILE_NODES))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([_roots(part, rule) for _, part in rows.groupby("part", sort=True)])

    unit = F.pmod(F.xxhash64("part"), F.lit(units)).cast("int").alias("unit")
    return rows.select(unit, "part", "node", "hashes").groupBy("unit").applyInPandas(run, "node binary, root binary")


def tiled(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``tile``: runs of at most ``TILE_NODES`` rows of one part in the given order, stored.

    Rows are range-partitioned by part and order, so a part may lie in many tasks.
    """
    ranged = rows.repartitionByRange("part", *order).sortWithinPartitions("part", *order)
    ranged = ranged.withColumn("task", F.spark_partition_id().cast("long"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        number, part, count = -1, None, TILE_NODES
        for frame in batches:
            tiles = []
            for value in frame["part"]:
                if value != part or count >= TILE_NODES:
                    number, part, count = number + 1, value, 0
                count += 1
                tiles.append(number)
            yield frame.assign(tile=frame["task"] * (1 << 32) + np.array(tiles, np.int64)).drop(columns="task")

    return materialize(ranged.mapInPandas(run, f"{fields}, tile long"))


def _tile_summary(rows: pd.DataFrame) -> pd.DataFrame:
    highs = np.max([point(s) for s in _sets(rows)], axis=0)
    labels = rows["label"].unique()
    return pd.DataFrame({
        "part": [rows["part"].iloc[0]], "tile": [rows["tile"].iloc[0]], "stray": [bool(rows["stray"].any())],
        "low": [int(rows["n_shingles"].min())], "highs": [highs.tolist()],
        "only": [labels[0] if len(labels) == 1 else None],
    })


def _tile_pairs(tiles: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of tiles of one part that may hold a link between different labels: the tree's upper level."""
    left, right = (tiles.select(*(F.col(c).alias(f"{c}_{x}") for c in tiles.columns)) for x in "ab")
    bound = F.aggregate(F.zip_with("highs_a", "highs_b", lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
    sizes = F.col("low_a") + F.col("low_b")
    pairs = left.join(right, (F.col("part_a") == F.col("part_b")) & (F.col("tile_a") <= F.col("tile_b")))
    pairs = pairs.where(F.col("stray_a") | F.col("stray_b"))
    pairs = pairs.where(F.col("only_a").isNull() | F.col("only_b").isNull() | (F.col("only_a") != F.col("only_b")))
    return pairs.where(bound * (100 + rule.percent) >= sizes * rule.percent).select("tile_a", "tile_b")


def large_part_roots(rows: DataFrame, rule: Rule) -> DataFrame:
    """(node, root) for parts of more than a tile.

    First every tile is joined by itself, then one node of each group found, tiled anew. That
    merges nearly all of a large group of near copies in two linear passes. What remains are
    the nodes outside of a part's main group: their tiles are joined with all tiles of the part
    that the bound allows and that are not of the same group.
    """
    def links(rows: pd.DataFrame) -> pd.DataFrame:
        return _roots(rows, rule)

    first = tiled(rows, "n_shingles", "node")
    inside = materialize(first.groupBy("tile").applyInPandas(links, "node binary, root binary"))
    heads = first.drop("tile").join(inside.where("node = root").select("node"), "node")
    second = tiled(heads.withColumn("mixed", F.xxhash64("node")).select(*rows.columns, "mixed"), "mixed", "node")
    across = second.groupBy("tile").applyInPandas(links, "node binary, root binary")
    edges = materialize(inside.unionByName(across).select(F.col("node").alias("a"), F.col("root").alias("b")))
    labels = components(edges)

    labelled = rows.join(labels, "node")
    sizes = labelled.groupBy("part", "label").count()
    main = sizes.groupBy("part").agg(F.max(F.struct("count", "label")).alias("main")).select("part", "main.label")
    main = main.withColumnRenamed("label", "main")
    labelled = labelled.join(main, "part").withColumn("stray", F.col("label") != F.col("main")).drop("main")
    third = tiled(labelled.select("part", "stray", "n_shingles", "node", "hashes", "label"), "stray", "n_shingles", "node")
    summary = third.groupBy("tile").applyInPandas(
        _tile_summary, "part binary, tile long, stray boolean, low long, highs array<int>, only binary"
    )
    pairs = materialize(_tile_pairs(materialize(summary), rule))
    sides = pairs.select(
        "tile_a", "tile_b", F.explode(F.array_distinct(F.array("tile_a", "tile_b"))).alias("tile")
    )

    def pair_links(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["label", "node"], kind="stable", ignore_index=True)
        groups, labels = Union(len(rows)), rows["label"].tolist()
        for i in range(1, len(rows)):
            if labels[i] == labels[i - 1]:
                groups.join(i - 1, i)
        tiles = rows["tile"].to_numpy()
        tree_links(_sets(rows), rule, groups, None if len(set(tiles)) == 1 else tiles)
        found = {(labels[i], labels[groups.find(i)]) for i in range(len(rows))}
        return pd.DataFrame(sorted(found), columns=["a", "b"])

    meeting = third.join(sides, "tile").select("tile_a", "tile_b", "tile", "node", "hashes", "label")
    merged = meeting.groupBy("tile_a", "tile_b").applyInPandas(pair_links, "a binary, b binary")
    roots = components(materialize(merged)).select(F.col("node").alias("label"), F.col("label").alias("root"))
    return labels.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("root"))


# --- the operators -------------------------------------------------------------------


def _node_roots(docs: DataFrame, rows: DataFrame, rule: Rule) -> DataFrame:
    """(node, root) for nodes that may link with another, stored; all others stand alone."""
    candidates = _candidates(rows.where(F.col("hashes").isNotNull()).select("node", "n_shingles", "hashes"), rule)
    n_hashes = candidates.agg(F.sum("n_shingles")).first()[0] or 0
    near = linkable(candidate_sets(docs, rule, node_filter(candidates)), n_hashes, rule)
    parts = parts_of(near)
    sizes = parts.groupBy("part").count()
    large = materialize(sizes.where(F.col("count") > TILE_NODES).select("part"))
    members = materialize(near.join(parts, "node").select("part", "node", "n_shingles", "hashes"))
    roots = small_part_roots(members.join(large, "part", "left_anti"), members.count(), rule)
    if not large.isEmpty():
        roots = roots.unionByName(large_part_roots(materialize(members.join(large, "part", "left_semi")), rule))
    return materialize(roots)


def link_documents(docs: DataFrame, rule: Rule = Rule(), keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default doc_id), n_shingles and component_id of every row.

    Two rows link when their sets satisfy ``rule``; component_id is the smallest doc_id that
    links reach, a row's own included. Equal sets always link. Null, empty and blank texts have
    no shingles, link with nothing and have their own id. Rows with equal ids are separate;
    null ids count only where all ids of a component are null. Other columns are not looked at.
    """
    keep = keep or ["doc_id"]
    rows = materialize(document_nodes(docs, rule, keep))
    roots = _node_roots(docs, rows, rule)
    first = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    rooted = materialize(first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_node = materialize(rooted.join(smallest, "root").select("node", "root", "component_id"))
    joined = rows.drop("hashes").join(of_node, "node", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.withColumn("component_id", own).select(*keep, "n_shingles", "component_id", "root")


def keep_one(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row of each component of ``docs``, all columns unchanged: that with the smallest id.

    Rows without shingles stay. Of rows with equal id and text any one stays.
    """
    key, winner_id, winner_key, n = fresh(docs, "text_key", "winner_id", "winner_key", "n_rows")
    marked = docs.withColumn(key, F.xxhash64("text"))
    rows = materialize(link_documents(marked.select("doc_id", "text", key), rule, ["doc_id", key]))
    same = rows.groupBy("root", "doc_id", key).agg(F.count("*").alias("n"), F.max("n_shingles").alias("n_shingles"))
    # Nulls sort before ids in a struct, so they are moved behind them.
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key, "n")
    linked = same.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(rank).alias("best")).select("best.*")
    alone = same.where(F.col("root").isNull()).select("doc_id", key, F.lit(1).cast("long").alias("n"))
    winners = materialize(linked.select("doc_id", key, "n").unionByName(alone).select(
        F.col("doc_id").alias(winner_id), F.col(key).alias(winner_key), F.col("n").alias(n)))
    match = marked["doc_id"].eqNullSafe(winners[winner_id]) & (marked[key] == winners[winner_key])
    kept = marked.join(winners, match)
    once = kept.where(F.col(n) == 1)
    repeated = kept.where(F.col(n) > 1).dropDuplicates(["doc_id", key])
    return once.unionByName(repeated).select(*docs.columns)
