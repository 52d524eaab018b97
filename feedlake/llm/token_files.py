"""Token ids in binary shards, compressed by Re-Pair grammars.

A shard holds the ids of consecutive documents. Its blob is little-endian:

    magic "RPG1"
    u32 x 5      number of documents, rules, symbols, first nonterminal, bytes per symbol (2 or 4)
    u64          number of ids
    u32 x docs   ids of each document
    u32 x rules  left symbol, then u32 x rules right symbol, then u32 x rules expansion length
    symbols      the compressed sequence

Symbols below the first nonterminal are ids. Rule r is symbol first + r and stands for its left
and right symbol. Expansion lengths let a reader find the symbols of a document and expand
these alone (``Shard.document``).
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections import defaultdict
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from feedlake.llm.common import slices
from feedlake.session import checkpoint_dir, ship

ship(__name__)

END_ID = 2
SHARD_IDS = 1 << 20
#: A pair that occurs less often in a shard gets no rule.
MIN_COUNT = 128
#: A round takes all pairs at least this share as frequent as the most frequent one.
ROUND_SHARE = 0.1
#: Symbols of one shard stay below this, so that they fit into two bytes.
MOST_SYMBOLS = 1 << 16
#: Buckets that pairs are counted in fit into a core's cache.
COUNT_BITS = 17
KNOWN_PIECES = 1_000_000
MAGIC, HEADER = b"RPG1", "<4s5IQ"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Marks the first piece of a text, which has no space in front. No text holds a lone surrogate.
FIRST = "\ud800"
#: Characters that every version of Unicode takes for letters, and for neither letters nor digits nor white space.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u0233"
MARKS = re.escape('!"#$%&()*+,-./:;=>?@[\\]^_`{}~')


def byte_characters() -> np.ndarray:
    """The characters that byte-level vocabularies write for bytes: printable ones as they are, the others from 256 on."""
    out = np.arange(256, dtype="<u2")
    others = np.array([b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)])
    out[others] = 256 + np.arange(len(others))
    return out


BYTE_CHARACTERS = byte_characters()
BYTE_CHARACTERS[ord("\n")] = ord("\n")


def written(pieces: list[str]) -> list[str]:
    """Pieces without line feeds as the vocabulary writes their bytes."""
    joined = "\n".join([p[1:] if p[0] == FIRST else " " + p for p in pieces])
    return BYTE_CHARACTERS[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-16-le").split("\n")


class Encoder:
    """Ids of whole texts. Texts are cut before single spaces between other characters.

    The vocabulary's own pre-tokenizer always starts a new piece there, so the ids of the parts
    are the ids of the text. Each different part is encoded once. Parts of known letters and marks
    alone are cut where the usual byte-level pre-tokenizer cuts them, between letters and marks and around single
    line feeds; what that leaves are pieces too, and go to the vocabulary's model one by one. Other parts go through the
    whole tokenizer, many in one call: the bytes that ids stand for tell where a part ends.
    """

    CUT = re.compile(r"(?<=\S) (?=\S)")
    #: Pieces that are encoded by themselves: first ones, and those with white space at an edge or a special token.
    SPECIAL = staticmethod(re.compile(rf"^{FIRST}|^\s|\s\Z|^\Z|<\|").search)
    #: Pieces that the pre-tokenizer leaves whole, and pieces that it cuts into such ones and line feeds.
    WHOLE = staticmethod(re.compile(rf"{FIRST}?(?:[{LETTERS}]+|[{MARKS}]+)").fullmatch)
    COMPOSED = staticmethod(re.compile(rf"[{LETTERS}{MARKS}]+(?:\n[{LETTERS}{MARKS}]+)*").fullmatch)
    PARTS = staticmethod(re.compile(rf"[{LETTERS}]+|[{MARKS}]+|\n").findall)

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        cutter = self.tokenizer.pre_tokenizer
        #: Are pieces cut as ``PARTS`` does it?
        self.usual = (
            isinstance(cutter, pre_tokenizers.ByteLevel) and cutter.use_regex and not cutter.add_prefix_space
            and isinstance(self.tokenizer.model, models.BPE) and self.tokenizer.normalizer is None
            and all("<|" in t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        )
        self.size = self.tokenizer.get_vocab_size()
        self.n_bytes = np.zeros(self.size, np.int64)
        for token, number in self.tokenizer.get_vocab().items():
            self.n_bytes[number] = len(token)
        #: Piece to its number, in the order of the numbers.
        self.known = defaultdict(count().__next__)
        self.ids = np.empty(0, np.uint32)
        self.starts, self.lengths = np.empty(0, np.int64), np.empty(0, np.int64)
        self.at_space = np.empty(0, bool)
        #: How often a piece was asked for, from the last forgetting on.
        self.uses = np.empty(0, np.int64)

    def forget(self):
        """Drop the pieces that were asked for at most once, or all if that leaves many."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > KNOWN_PIECES // 2:
            keep = keep[:0]
        names = list(self.known)
        self.known = defaultdict(count(len(keep)).__next__, zip([names[i] for i in keep.tolist()], range(len(keep))))
        self.ids, self.lengths = self.gathered(keep)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.at_space, self.uses = self.at_space[keep], np.zeros(len(keep), np.int64)

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > KNOWN_PIECES:
            self.forget()
        pieces = [t.split(" ") if t else [] for t in texts]
        number, ends = self.numbers(pieces)
        # A piece with white space at an edge tells that a cut parted it from a space.
        wrong = np.concatenate([[0], np.cumsum(self.at_space[number])])[ends]
        wrong = np.flatnonzero(np.diff(wrong, prepend=0))
        if len(wrong):
            for i in wrong.tolist():
                pieces[i] = self.CUT.split(texts[i])
            number, ends = self.numbers(pieces)
        ids, lengths = self.gathered(number)
        cuts = np.concatenate([[0], np.cumsum(lengths)])[ends]
        return [np.append(x, np.uint32(END_ID)) for x in np.split(ids, cuts)[:-1]]

    def numbers(self, pieces: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """Number of every piece, and where each text's pieces end; the first of a text is marked."""
        flat = []
        for parts in pieces:
            if parts and parts[0][:1] != FIRST:
                parts[0] = FIRST + parts[0]
            flat += parts
        number = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        self.learn()
        self.uses += np.bincount(number, minlength=len(self.uses))
        return number, np.cumsum([len(p) for p in pieces])

    def learn(self):
        """Encode the pieces that are new: the last ones."""
        n_known = len(self.starts)
        new = list(islice(reversed(self.known), len(self.known) - n_known))[::-1]
        if not new:
            return
        whole, composed, part_numbers, n_parts = [], [], [], []
        if self.usual:
            for i, piece in enumerate(new):
                if self.WHOLE(piece):
                    whole.append(i)
                elif self.COMPOSED(piece):
                    composed.append(i)
                    first, *others = self.PARTS(piece)
                    part_numbers.append(self.known[first])
                    part_numbers += [self.known[FIRST + x] for x in others]
                    n_parts.append(1 + len(others))
            # Parts that were not known follow the new pieces.
            n_asked = len(new)
            new += list(islice(reversed(self.known), len(self.known) - n_known - n_asked))[::-1]
            whole += [i for i in range(n_asked, len(new)) if self.WHOLE(new[i])]
        left = np.ones(len(new), bool)
        left[whole] = left[composed] = False
        at_space = np.zeros(len(new), bool)
        starts, lengths = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        pool = [self.ids]
        end = len(self.ids)

        if whole:
            tokenize = self.tokenizer.model.tokenize
            made = [[x.id for x in tokenize(w)] for w in written([new[i] for i in whole])]
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            starts[whole], lengths[whole] = end + np.cumsum(sizes) - sizes, sizes
            pool.append(np.fromiter(chain.from_iterable(made), np.uint32, int(sizes.sum())))
            end += len(pool[-1])

        rest = np.flatnonzero(left)
        alone = np.fromiter((bool(self.SPECIAL(new[i])) for i in rest.tolist()), bool, len(rest))
        single, joint = rest[alone], rest[~alone]
        texts = []
        for i in single.tolist():
            first, piece = new[i][:1] == FIRST, new[i].removeprefix(FIRST)
            at_space[i] = not piece or piece[0].isspace() or piece[-1].isspace()
            texts.append(piece if first else " " + piece)
        for i, x in zip(single, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            starts[i], lengths[i] = end, len(x.ids)
            end += len(x.ids)
            pool.append(np.array(x.ids, np.uint32))
        if len(joint):
            joined = [" " + new[i] for i in joint.tolist()]
            (x,) = self.tokenizer.encode_batch_fast(["".join(joined)], add_special_tokens=False)
            ids = np.array(x.ids, np.uint32)
            bytes_at = np.cumsum(self.n_bytes[ids])
            ends = np.cumsum(np.fromiter(map(len, map(str.encode, joined)), np.int64, len(joined)))
            cuts = np.searchsorted(bytes_at, ends) + 1
            if not np.array_equal(bytes_at[cuts - 1], ends):
                raise ValueError("the tokenizer joins characters across a cut")
            lengths[joint] = np.diff(cuts, prepend=0)
            starts[joint] = end + cuts - lengths[joint]
            pool.append(ids)
            end += len(ids)
        self.ids = np.concatenate(pool)
        self.starts, self.lengths = np.append(self.starts, starts), np.append(self.lengths, lengths)
        self.at_space = np.append(self.at_space, at_space)
        self.uses = np.append(self.uses, np.zeros(len(new), np.int64))
        if composed:
            self.uses += np.bincount(part_numbers, minlength=len(self.uses))
            ids, sizes = self.gathered(np.array(part_numbers))
            sizes = np.add.reduceat(sizes, np.cumsum(n_parts) - n_parts)
            numbers = n_known + np.array(composed)
            self.starts[numbers], self.lengths[numbers] = len(self.ids) + np.cumsum(sizes) - sizes, sizes
            self.ids = np.append(self.ids, ids)

    def gathered(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some pieces one after another, and how many each has."""
        lengths = self.lengths[number]
        to = np.cumsum(lengths)
        return self.ids[np.arange(int(lengths.sum())) + np.repeat(self.starts[number] - (to - lengths), lengths)], lengths


def process_encoder(path: str) -> Encoder:
    """The encoder of this Python worker; Spark's workers live on from task to task, and so do the pieces they know.

    It hangs on the tokenizers module, as functions that are shipped by value have globals of their own in every task.
    """
    import tokenizers

    stat = os.stat(path)
    key = (path, stat.st_mtime_ns, stat.st_size)
    held_key, encoder = getattr(tokenizers, "_feedlake_encoder", (None, None))
    if held_key != key:
        encoder = Encoder(path)
        tokenizers._feedlake_encoder = (key, encoder)
    return encoder


def repair(ids: np.ndarray, first: int, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and rules (pairs of symbols) that expand to ``ids``.

    Each round counts all pairs of neighbours, gives the most frequent ones new symbols and
    replaces them from left to right without overlaps, until no pair is frequent.
    """
    sequence = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    n_rules = 0
    while len(sequence) > 1 and first + n_rules < MOST_SYMBOLS:
        # Only pairs in well filled buckets are counted one by one.
        bucket = sequence[:-1] * np.uint32(0x9E3779B1) + sequence[1:] * np.uint32(0x85EBCA6B)
        bucket >>= np.uint32(32 - COUNT_BITS)
        filled = np.bincount(bucket, minlength=1 << COUNT_BITS)
        # The fullest bucket bounds the count of the best pair from below.
        at = np.flatnonzero(bucket == filled.argmax())
        best = np.unique(sequence[at].astype(np.uint64) << np.uint64(32) | sequence[at + 1], return_counts=True)[1].max()
        often = filled >= max(min_count, ROUND_SHARE * best)
        at = np.flatnonzero(often[bucket])
        pairs = sequence[at].astype(np.uint64) << np.uint64(32) | sequence[at + 1]
        found, counts = np.unique(pairs, return_counts=True)
        if not len(found) or counts.max() < min_count:
            break
        order = np.argsort(-counts, kind="stable")
        order = order[counts[order] >= max(min_count, ROUND_SHARE * counts.max())]
        chosen = np.sort(found[order[: MOST_SYMBOLS - first - n_rules]])
        place = np.searchsorted(chosen, pairs)
        hit = chosen[np.minimum(place, len(chosen) - 1)] == pairs
        at, rule = at[hit], place[hit]
        # Of hits that overlap, every second one counts, from the left.
        run_start = np.concatenate([[True], np.diff(at) > 1])
        run_at = np.arange(len(at)) - np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))
        at, rule = at[run_at % 2 == 0], rule[run_at % 2 == 0]
        used = np.bincount(rule, minlength=len(chosen)) >= 2
        at, rule = at[used[rule]], rule[used[rule]]
        if not len(at):
            break
        sequence[at] = (first + n_rules + np.cumsum(used) - 1)[rule].astype(np.uint32)
        sequence = np.delete(sequence, at + 1)
        rules.append(chosen[used])
        n_rules += int(used.sum())
    pairs = np.concatenate(rules) if rules else np.empty(0, np.uint64)
    return sequence, np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)]).astype(np.uint32)


def write_shard(documents: list[np.ndarray], first: int) -> bytes:
    ids = np.concatenate(documents) if documents else np.empty(0, np.uint32)
    sequence, rules = repair(ids, first)
    lengths = np.ones(first + rules.shape[1], np.uint32)
    for r, (a, b) in enumerate(rules.T.tolist()):
        lengths[first + r] = lengths[a] + lengths[b]
    wide = 2 if len(lengths) <= MOST_SYMBOLS else 4
    header = struct.pack(HEADER, MAGIC, len(documents), rules.shape[1], len(sequence), first, wide, len(ids))
    sizes = np.array([len(d) for d in documents], "<u4")
    return b"".join([
        header, sizes.tobytes(), rules.astype("<u4").tobytes(), lengths[first:].astype("<u4").tobytes(),
        sequence.astype(f"<u{wide}").tobytes(),
    ])


class Shard:
    """Reads a shard's blob."""

    def __init__(self, blob: bytes):
        magic, n_docs, n_rules, n_symbols, self.first, wide, self.n_ids = struct.unpack_from(HEADER, blob)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.rule_ids = self.rule_starts = None
        at = struct.calcsize(HEADER)
        self.sizes = np.frombuffer(blob, "<u4", n_docs, at)
        at += 4 * n_docs
        self.left = np.frombuffer(blob, "<u4", n_rules, at).astype(np.int64)
        self.right = np.frombuffer(blob, "<u4", n_rules, at + 4 * n_rules).astype(np.int64)
        self.lengths = np.frombuffer(blob, "<u4", n_rules, at + 8 * n_rules).astype(np.int64)
        self.symbols = np.frombuffer(blob, f"<u{wide}", n_symbols, at + 12 * n_rules).astype(np.int64)

    def expansion_lengths(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        rule = symbols >= self.first
        out[rule] = self.lengths[symbols[rule] - self.first]
        return out

    def expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rules one after another, and where each rule's begin."""
        if self.rule_ids is None:
            made: list[list[int]] = []
            for sides in zip(self.left.tolist(), self.right.tolist()):
                made.append([i for s in sides for i in (made[s - self.first] if s >= self.first else (s,))])
            self.rule_ids = np.array([i for ids in made for i in ids], np.uint32)
            self.rule_starts = np.cumsum(self.lengths) - self.lengths
        return self.rule_ids, self.rule_starts

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of a sequence of symbols."""
        lengths = self.expansion_lengths(symbols)
        ids = np.repeat(symbols.astype(np.uint32), lengths)
        rule = symbols >= self.first
        if rule.any():
            rule_ids, rule_starts = self.expansions()
            sizes = lengths[rule]
            begins = (np.cumsum(lengths) - lengths)[rule]
            steps = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            ids[np.repeat(begins, sizes) + steps] = rule_ids[np.repeat(rule_starts[symbols[rule] - self.first], sizes) + steps]
        return ids

    def documents(self) -> list[np.ndarray]:
        return np.split(self.expand(self.symbols), np.cumsum(self.sizes)[:-1]) if len(self.sizes) else []

    def document(self, i: int) -> np.ndarray:
        """Ids of one document, from the symbols that cover it alone."""
        begin = int(self.sizes[:i].sum())
        end = begin + int(self.sizes[i])
        ends = np.cumsum(self.expansion_lengths(self.symbols))
        a = int(np.searchsorted(ends, begin, "right"))
        b = int(np.searchsorted(ends, end, "left")) + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(self.symbols[a:b])[begin - before:end - before]


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of all documents below ``path`` as shards, in ascending doc_id order.

    Null text counts as empty and gives the end id alone. Null ids come first; rows with equal
    ids are ordered by a hash of their text. A shard closes with the document that fills it.
    Rows are range-partitioned by id, so each task writes consecutive documents: ``part`` and
    ``shard`` give the order. Spark's committer makes the files appear once, whatever is lost.
    """
    tokenizer = tokenizer or tokenizer_path()
    names = ["shard", "doc_ids", "n_ids", "blob"]
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        encoder = process_encoder(tokenizer)
        number, ids, held, size = 0, [], [], 0

        def close():
            columns = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([size], pa.int64()),
                       pa.array([write_shard(held, encoder.size)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for part in slices(batch, "text"):
                for doc_id, made in zip(part.column("doc_id").to_pylist(), encoder.batch(part.column("text").to_pylist())):
                    ids.append(doc_id)
                    held.append(made)
                    size += len(made)
                    if size >= shard_ids:
                        yield close()
                        number, ids, held, size = number + 1, [], [], 0
        if held:
            yield close()

    text_hash = F.xxhash64("text")
    ordered = (
        docs.select("doc_id", "text", text_hash.alias("text_hash"))
        .repartitionByRange("doc_id", "text_hash")
        .sortWithinPartitions("doc_id", "text_hash")
        .select("doc_id", "text")
    )
    schema = f"shard bigint, doc_ids array<{kind.simpleString()}>, n_ids bigint, blob binary"
    ordered.mapInArrow(run, schema).select(F.spark_partition_id().alias("part"), *names).write.parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, shard, before): the ids of all shards before each one.

    Sums run inside a part; only one total per part is summed up in one place.
    """
    inside = W.partitionBy("part").orderBy("shard")
    sizes = shards.select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("part_ids")).select(
        "part", (F.sum("part_ids").over(W.orderBy("part")) - F.col("part_ids")).alias("part_start")
    )
    running = sizes.withColumn("within", F.sum("n_ids").over(inside) - F.col("n_ids"))
    return running.join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("within")).alias("before"))


def _decoded(shards: DataFrame, outputs: str, work) -> DataFrame:
    """One row per document of every shard, from (part, shard, doc_ids, blob)."""
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                shard = Shard(row.column("blob")[0].as_py())
                ids = row.column("doc_ids").flatten()
                n = len(ids)
                same = [pa.array(np.full(n, row.column(c)[0].as_py(), t)) for c, t in (("part", np.int32), ("shard", np.int64))]
                starts = np.cumsum(shard.sizes, dtype=np.int64) - shard.sizes
                made = work(shard.documents())
                columns = {"part": same[0], "shard": same[1], "doc_id": ids, "start_in_shard": pa.array(starts), **made}
                yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

    schema = f"part int, shard bigint, doc_id {kind}, start_in_shard bigint, {outputs}"
    return shards.select("part", "shard", "doc_ids", "blob").mapInArrow(run, schema)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files below ``path``."""
    def work(documents):
        return {"ids": pa.array([d.astype(np.int64) for d in documents], pa.list_(pa.int64()))}

    shards = spark.read.parquet(path)
    found = _decoded(shards, "ids array<bigint>", work).join(shard_starts(shards), ["part", "shard"])
    return found.select("doc_id", (F.col("before") + F.col("start_in_shard")).alias("start"), "ids")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files below ``path``."""
    def work(documents):
        return {
            "n_tokens": pa.array([len(d) for d in documents], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(d.astype("<u4").tobytes()) for d in documents], pa.int64()),
        }

    shards = spark.read.parquet(path)
    found = _decoded(shards, "n_tokens bigint, ids_crc32 bigint", work).join(shard_starts(shards), ["part", "shard"])
    return found.select("doc_id", (F.col("before") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write all documents to new files in the shared folder and read their digests back."""
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer)
    return read_digests(spark, path)
