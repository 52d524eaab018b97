"""Helpers shared by the operators: words, stable hashes, bounded slices of texts, column names."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from feedlake.session import ship

ship(__name__)

#: A word is a run of characters other than these six (space, tab, LF, VT, FF, CR).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

SLICE_BYTES = 4 << 20
SLICE_ROWS = 512

ARROW_TYPES = {
    "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(),
    "binary": pa.binary(), "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary()), "array<boolean>": pa.list_(pa.bool_()),
}


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; ``bytes.split`` separates at exactly the six characters above."""
    return text.encode().split() if text else []


class WordHashes(dict):
    """Word to 64-bit hash, the same in every process. Forgets all when it holds ``size`` words."""

    def __init__(self, size: int = 300_000):
        super().__init__()
        self.size = size

    def __missing__(self, word):
        if len(self) >= self.size:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, tokens: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


#: Bytes between words; bytes that are hashed at once; longer words than ``LONG_WORD`` bytes are hashed one by one.
SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
HASH_BYTES = 1 << 20
LONG_WORD = 32
_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_FACTOR = 0xE7037ED1A0B428DD


def word_hashes(texts: list[str | None], at_once: int = HASH_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one text after another, and how many words each text has.

    The words are those of ``words``. A word is a polynomial over its bytes: a difference of two running sums.
    """
    encoded = [t.encode() if t else b"" for t in texts]
    data = b" " + b"".join(x + b" " for x in encoded)
    firsts, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    at, last = 0, len(data) - 1
    while at < last:
        # Parts begin and end with a byte between words.
        end = at + at_once
        end = re.compile(rb"[\x20\x09-\x0D]").search(data, end).start() if end < last else last
        starts, values = _hash_part(data[at:end + 1])
        firsts.append(starts + at)
        hashes.append(values)
        at = end
    ends = np.cumsum([len(x) + 1 for x in encoded])
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(firsts), ends, "right"), prepend=0)


def _hash_part(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``data`` start, and their hashes."""
    held = np.frombuffer(data, np.uint8)
    gap = SPACE[held]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    powers, inverse = (np.full(len(held), f, np.uint64) for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64)))
    powers[0] = inverse[0] = 1
    sums = np.cumsum(_BYTE_CODES[held] * np.cumprod(powers), dtype=np.uint64)
    hashes = mix64((sums[ends - 1] - sums[starts - 1]) * np.cumprod(inverse)[starts])
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i]:ends[i]])
    return starts, hashes


def window_hashes(hashes: np.ndarray, size: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of every run of ``size`` words, by position of its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = total * np.uint64(base) + hashes[j:j + n]
    return mix64(total)


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows with few bytes of text, at least one row each; a text is never cut."""
    column = batch.column(text)
    sizes = np.cumsum([0, *(len(x.as_buffer()) if x.is_valid else 0 for x in column)])
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(sizes, sizes[at] + SLICE_BYTES, "right")) - 1
        end = min(max(end, at + 1), at + SLICE_ROWS, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def map_texts(
    df: DataFrame, keep: list[str], read: list[str], outputs: dict[str, str], setup: Callable[[], Callable]
) -> DataFrame:
    """Columns ``keep`` and, per row, what a task's function makes of the columns ``read``.

    ``setup()`` runs once in each task and returns the function. It gets one list per column
    of ``read`` (the first is the text) and returns one sequence per column of ``outputs``,
    a mapping of name to type.
    """
    added = T.StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in outputs.items()))
    schema = T.StructType([df.schema[c] for c in keep] + added.fields)
    types = [ARROW_TYPES[x] for x in outputs.values()]
    names = [*keep, *outputs]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup()
        for batch in batches:
            for part in slices(batch, read[0]):
                made = work(*(part.column(c).to_pylist() for c in read))
                arrays = [pa.array(x, t) for x, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *arrays], names=names)

    return df.select(*dict.fromkeys([*keep, *read])).mapInArrow(run, schema)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` does not use in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds


def by_hash(column: Column, seed: str, share: float) -> Column:
    """True for about ``share`` of the values, always the same ones."""
    value = F.pmod(F.xxhash64(F.lit(seed), column), F.lit(1 << 30))
    return value < F.lit(int(share * (1 << 30)))
