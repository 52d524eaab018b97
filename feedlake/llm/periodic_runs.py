"""Periodic runs of words: seeds on diagonals, extended to both sides.

A run of period q and length at least max(12, 2q) equals itself shifted by q over max(12 - q, q)
words or more: its guaranteed overlap. Lags are taken in classes [L, 2L), L = 6, 12, 24, ...; for a class every
L words are a seed, since no overlap of the class is shorter. Seeds that occur twice in a document at
a lag of the class are pairs on the diagonal of that lag. A pair is extended to both sides as far as the
words agree, unless the furthest point covered on its lag lies beyond it already.

Pairs stay in proportion to the text, whatever it repeats. Occurrences of a seed less than L/2
apart form a progression inside a stretch with that smaller period. Two of its members never
give a run of the class. Two progressions give one only where their first members or their last ones are
aligned, or where the stretches touch; only those pairs are made.

Every document is worked on by itself, so nothing is shuffled. Lengths of common parts come from
prefix hashes modulo two primes, 62 bits.
"""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from feedlake.llm.common import WordHashes, fresh, map_texts, window_hashes, words
from feedlake.session import ship

ship(__name__)

MIN_LENGTH = 12
SEED = MIN_LENGTH // 2
PRIMES = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 1_664_525_001))


class Powers:
    """Powers of each base and of its inverse, as many as were asked for so far."""

    def __init__(self):
        self.tables = [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in PRIMES]

    def upto(self, n: int) -> list[list[np.ndarray]]:
        for tables, (p, base) in zip(self.tables, PRIMES):
            for k, b in enumerate((base, pow(base, -1, p))):
                while len(tables[k]) < n:
                    have = tables[k]
                    tables[k] = np.concatenate([have, have * np.uint64(pow(b, len(have), p)) % np.uint64(p)])
        return self.tables


class Prefixes:
    """Compares parts of one document by hashes of its prefixes."""

    def __init__(self, hashes: np.ndarray, powers: Powers):
        self.n = len(hashes)
        self.sums, self.powers = [], powers.upto(self.n + 1)
        for (p, _), (up, _) in zip(PRIMES, self.powers):
            terms = hashes % np.uint64(p) * up[: self.n] % np.uint64(p)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms) % np.uint64(p)]))

    def grams(self, at: np.ndarray, size: int) -> np.ndarray:
        """A number for the ``size`` words at each of the positions ``at``."""
        parts = []
        for (p, _), (_, down), sums in zip(PRIMES, self.powers, self.sums):
            part = (sums[at + size] + np.uint64(p) - sums[at]) % np.uint64(p)
            parts.append(part * down[at] % np.uint64(p))
        return parts[0] << np.uint64(31) | parts[1]

    def equal(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Are the ``size`` words at ``i`` those at ``j`` (``i`` before ``j``)?"""
        same = np.ones(len(i), bool)
        for (p, _), (up, _), sums in zip(PRIMES, self.powers, self.sums):
            left = (sums[i + size] + np.uint64(p) - sums[i]) % np.uint64(p) * up[j - i] % np.uint64(p)
            same &= left == (sums[j + size] + np.uint64(p) - sums[j]) % np.uint64(p)
        return same

    def agree(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, backwards: bool = False) -> np.ndarray:
        """How many words from ``i`` and ``j`` on (or before them) agree, up to ``most``."""
        done = np.zeros(len(i), np.int64)
        step = 1 << int(max(1, most.max(initial=1))).bit_length()
        while step:
            fits = done + step <= most
            size = np.where(fits, step, 0)
            shift = -(done + size) if backwards else done
            done += np.where(fits & self.equal(i + shift, j + shift, size), step, 0)
            step >>= 1
        return done


def short_lags(hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, length, period) on the diagonals of lags below a seed's size, read from end to end."""
    out = []
    for lag in range(1, SEED):
        same = np.concatenate([[False], hashes[lag:] == hashes[:-lag], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        start, overlap = edges[::2], edges[1::2] - edges[::2]
        good = overlap >= MIN_LENGTH - lag
        out.append((start[good], overlap[good] + lag, np.full(good.sum(), lag)))
    return out


def seed_pairs(at: np.ndarray, grams: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, lag) of the pairs of equal seeds that stand for all diagonals of the class ``size``.

    ``at`` are the positions of the seeds in order.
    """
    order = np.argsort(grams, kind="stable")
    pos, value = at[order], grams[order]
    same = value[1:] == value[:-1]
    chained = same & (pos[1:] - pos[:-1] <= size // 2)
    heads = np.flatnonzero(np.concatenate([[True], ~chained]))
    tails = np.append(heads[1:], len(pos)) - 1
    first, last, count, gram = pos[heads], pos[tails], tails - heads + 1, value[heads]
    step = np.where(count > 1, (last - first) // np.maximum(count - 1, 1), 0)
    found = []
    for ahead in range(1, 5):
        a = np.flatnonzero(gram[ahead:] == gram[:-ahead])
        a = a[first[a + ahead] - last[a] < 2 * size]
        b = a + ahead
        found += [(first[a], first[b] - first[a]), (last[a], last[b] - last[a])]
        period = np.maximum(step[a], step[b])
        gap = first[b] - last[a]
        touch = (period > 0) & (gap <= size + 2 * period)
        a, b, period, gap = a[touch], b[touch], period[touch], gap[touch]
        low = np.maximum(0, -((gap - size) // period))
        high = np.minimum(count[a] + count[b] - 2, (2 * size - 1 - gap) // period)
        many = np.maximum(high - low + 1, 0)
        row = np.repeat(np.arange(len(a)), many)
        t = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        back = np.minimum(t, count[a][row] - 1)
        found.append((last[a][row] - back * period[row], gap[row] + t * period[row]))
    i, lag = (np.concatenate(x) for x in zip(*found))
    good = (lag >= size) & (lag < 2 * size)
    return i[good], lag[good]


def _uncovered(i: np.ndarray, lag: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that do not lie in what the pair before them on the same lag covers."""
    order = np.lexsort((i, lag))
    i, lag = i[order], lag[order]
    new = np.ones(len(i), bool)
    new[1:] = (lag[1:] != lag[:-1]) | (i[1:] > i[:-1] + size)
    return i[new], lag[new]


def find_runs(hashes: np.ndarray, powers: Powers | None = None) -> np.ndarray:
    """All runs of a document as rows (start, length, period), by start, then period."""
    nothing = np.empty((0, 3), np.int64)
    if len(hashes) < MIN_LENGTH:
        return nothing
    ordered = np.sort(window_hashes(hashes, SEED))
    if not (ordered[1:] == ordered[:-1]).any():
        return nothing
    text = Prefixes(hashes, powers or Powers())
    found, size, at = short_lags(hashes), SEED, np.arange(len(hashes) - SEED + 1)
    while 2 * size <= text.n and len(at):
        at = at[at <= text.n - size]
        grams = text.grams(at, size)
        _, place, count = np.unique(grams, return_inverse=True, return_counts=True)
        again = count[place] > 1
        at, grams = at[again], grams[again]
        if not len(at):
            break
        i, lag = _uncovered(*seed_pairs(at, grams, size), size)
        before = text.agree(i, i + lag, i, backwards=True)
        overlap = before + text.agree(i, i + lag, text.n - i - lag)
        good = overlap >= lag
        found.append(((i - before)[good], (overlap + lag)[good], lag[good]))
        size *= 2
    start, length, period = (np.concatenate(x).astype(np.int64) for x in zip(*found))
    # A run is met again at multiples of its period, over the same words.
    order = np.lexsort((period, length, start))
    runs = np.stack([start, length, period], axis=1)[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def first_periods(n: int, runs: np.ndarray) -> np.ndarray:
    """True for the words of ``n`` to keep: those that no run contains after its first period."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(marks[:-1]) == 0


def repeat_tail(tokens: list[bytes], doc_id) -> list[bytes]:
    """The words with those from some place on replaced by copies of the first of them.

    Done to about a tenth of the documents, by crc32 of the id as text (a null id: the empty text).
    """
    h = crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not tokens:
        return tokens
    g, n = h // 10, len(tokens)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return tokens[:a] + (tokens[a:a + p] * -(-(n - a) // p))[: n - a]


def runs_of_texts(docs: DataFrame, rewrite: Callable[[list[bytes], object], list[bytes]] | None = None) -> DataFrame:
    """``docs`` without ``text``, plus its runs and the text without their repetitions.

    Added: ``starts``, ``lengths``, ``periods`` (array<bigint>, word numbers from 0, by start, then
    period) and ``collapsed``, the words joined by single spaces without those that a run contains
    after its first period. Clashing names get a trailing underscore. ``rewrite(words, doc_id)`` may
    replace a document's words first. Null and empty texts have no runs and an empty ``collapsed``.
    Rows do not influence each other, so repeated rows get equal answers and an empty table gives no
    row. Texts of any length are read whole; work and memory are in proportion to their words.
    """
    keep = [c for c in docs.columns if c != "text"]
    names = fresh(docs.select(*keep), "starts", "lengths", "periods", "collapsed")
    kinds = ["array<bigint>"] * 3 + ["string"]
    read = ["text", "doc_id"] if rewrite else ["text"]

    def setup():
        known, powers = WordHashes(), Powers()

        def work(texts, ids=None):
            out = []
            for k, text in enumerate(texts):
                tokens = words(text)
                if rewrite:
                    tokens = rewrite(tokens, ids[k])
                runs = find_runs(known.of(tokens), powers)
                if len(runs):
                    stay = first_periods(len(tokens), runs)
                    tokens = [w for w, s in zip(tokens, stay.tolist()) if s]
                out.append((*runs.T.tolist(), b" ".join(tokens).decode()))
            return list(zip(*out)) if out else [[]] * 4

        return work

    return map_texts(docs, keep, read, dict(zip(names, kinds)), setup)


def run_digests(found: DataFrame, starts="starts", lengths="lengths", periods="periods", collapsed="collapsed") -> DataFrame:
    """Per row of ``runs_of_texts`` doc_id, the number of runs, the longest one and two SHA-256.

    Ties of the longest go to the smallest start, then period; without a run its four columns are null.
    """
    runs = F.transform(F.arrays_zip(starts, lengths, periods), lambda r: F.struct(
        (-r[lengths]).alias("less"), r[starts].alias("start"), r[periods].alias("period")))
    best: Column = F.array_min(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], -r["less"], r["period"]))
    lines = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.select("doc_id", runs.alias("runs"), F.col(collapsed).alias("text")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        (-best["less"]).alias("length"),
        best["period"].alias("period"),
        F.floor(-1000 * best["less"] / best["period"]).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )
