"""Language identification by unigram pieces, summed over all segmentations."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from feedlake.llm.common import fold, map_texts, mix64
from feedlake.session import materialize, ship

ship(__name__)

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Bound of the training sample, in documents of one language.
SAMPLE_ROWS = 3_000
ROUNDS = 3
UNKNOWN = "und"
#: Log probability of a character that no piece covers, the same in every language.
CHARACTER = -18.0
#: Occurrences added to every piece of every language.
SMOOTHING = 0.1
WORD = re.compile(r"[^\W\d_]+")
KNOWN_WORDS = 200_000


def read_pieces(path: str = VOCABULARY) -> list[str]:
    """Pieces of a public vocabulary that consist of letters, with the word mark in front kept."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not model.is_byte(i)}
    return sorted(p for p in pieces if p.replace("▁", "") == "" or WORD.fullmatch(p.replace("▁", "")))


def normal_words(text: str | None) -> list[str]:
    """Lower-case runs of letters, each with the word mark in front."""
    return ["▁" + w for w in WORD.findall((text or "").lower())]


def _codes(words: list[str]) -> np.ndarray:
    """Code points by (word, place); words have one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def _prefix_hashes(codes: np.ndarray, longest: int | None = None) -> list[np.ndarray]:
    """For each length from 1, the hash of the substring of that length by (word, start)."""
    size = codes.shape[1]
    total, out = np.zeros(codes.shape, np.uint64), []
    for length in range(1, (longest or size) + 1):
        n = size - length + 1
        total = total[:, :n] * np.uint64(0xD6E8FEB86659FD93) + codes[:, length - 1:]
        out.append(mix64(total))
    return out


@dataclass
class Pieces:
    """Piece numbers, the longest piece, and log probabilities by (piece, language).

    The row after the last piece is the uncovered character, the one after it is minus infinity.
    """

    number: dict[str, int]
    longest: int
    logp: np.ndarray
    languages: list[str]

    def __post_init__(self):
        hashes = np.array([int(_prefix_hashes(_codes([p]))[-1][0, 0]) for p in self.number] or [0], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], np.array([*self.number.values()] or [0], np.int32)[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[hashes >> np.uint64(44)] = True

    def lattice(self, words: list[str]) -> np.ndarray:
        """Piece number of ``word[end - length:end]`` by (end - 1, length - 1, word); words have one length.

        Substrings are looked up by 64-bit hashes, all words at once.
        """
        size = len(words[0])
        longest = min(self.longest, size)
        none, single = len(self.number) + 1, len(self.number)
        out = np.full((size, longest, len(words)), none, np.int32)
        for length, found in enumerate(_prefix_hashes(_codes(words), longest), 1):
            table = np.full(found.shape, single if length == 1 else none, np.int32)
            row, start = np.nonzero(self.maybe[found >> np.uint64(44)])
            values = found[row, start]
            at = np.minimum(np.searchsorted(self.hashes, values), len(self.hashes) - 1)
            known = (self.hashes[at] == values) & bool(self.number)
            table[row[known], start[known]] = self.numbers[at[known]]
            out[length - 1:, length - 1, :] = table.T
        return out

    def forward(self, lattice: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all segmentations of each prefix, (end, word, language)."""
        size, longest, n = lattice.shape
        alpha = np.full((size + 1, n, len(self.languages)), -np.inf)
        alpha[0] = 0.0
        for end in range(1, size + 1):
            reach = min(longest, end)
            steps = [alpha[end - k] + self.logp[lattice[end - 1, k - 1]] for k in range(1, reach + 1)]
            alpha[end] = np.logaddexp.reduce(steps, axis=0)
        return alpha

    def expected(self, lattice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected uses of each lattice entry (same shape, by language) and the words' log probabilities."""
        size, longest, n = lattice.shape
        alpha = self.forward(lattice)
        beta = np.full_like(alpha, -np.inf)
        beta[size] = 0.0
        uses = np.zeros((size, longest, n, len(self.languages)))
        for end in range(size, 0, -1):
            for k in range(1, min(longest, end) + 1):
                step = self.logp[lattice[end - 1, k - 1]] + beta[end]
                uses[end - 1, k - 1] = np.exp(alpha[end - k] + step - alpha[size])
                beta[end - k] = np.logaddexp(beta[end - k], step)
        return uses, alpha[size]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability by (word, language), words of any lengths."""
        out = np.zeros((len(words), len(self.languages)))
        for rows in _same_length(words):
            out[rows] = self.forward(self.lattice([words[i] for i in rows]))[-1]
        return out


def _same_length(words: list[str], cells: int = 200_000):
    """Indexes of words of equal length, in groups whose lattices stay small."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        size = len(words[order[at]])
        end = at
        while end < len(order) and len(words[order[end]]) == size and (end - at + 1) * size * 16 <= max(cells, size * 16):
            end += 1
        yield order[at:end]
        at = end


def _table(uses: np.ndarray, none: int) -> np.ndarray:
    """Log probabilities from expected uses, with the rows for a character and for nothing."""
    smooth = uses + SMOOTHING
    logp = np.log(smooth / smooth.sum(axis=0))
    return np.vstack([logp, np.full((1, uses.shape[1]), CHARACTER), np.full((1, uses.shape[1]), -np.inf)])


@dataclass
class Model:
    pieces: Pieces
    log_prior: np.ndarray

    def predict(self, texts: list[str | None], known: dict) -> tuple[list[str], list[float]]:
        """Most likely language and its posterior. ``known`` keeps word scores between calls."""
        languages = self.pieces.languages
        tokens = [normal_words(t) for t in texts]
        new = {w for ws in tokens for w in ws} - known.keys()
        if len(known) + len(new) > KNOWN_WORDS:
            known.clear()
            new = {w for ws in tokens for w in ws}
        new = sorted(new)
        known.update(zip(new, self.pieces.word_scores(new)))
        named, scores = [], []
        for ws in tokens:
            if not ws or not languages:
                named.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = self.log_prior + np.array([known[w] for w in ws]).sum(axis=0)
            best = int(np.argmax(total))
            named.append(languages[best])
            scores.append(float(1.0 / np.exp(total - total[best]).sum()))
        return named, scores


def _word_counts(docs: DataFrame, sample_rows: int, seed: str) -> DataFrame:
    """(lang, word, n) over about ``sample_rows`` training documents of each language, stored."""
    rows = docs.where(F.col("lang").isNotNull() & (fold() != 0)).select("doc_id", "lang", "text")
    # Stored, so that Spark knows its size and no text is shuffled by its language.
    sizes = materialize(rows.groupBy("lang").count().withColumn("share", F.least(F.lit(1.0), sample_rows / F.col("count"))))
    value = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30))
    chosen = rows.join(sizes.select("lang", "share"), "lang").where(value < F.col("share") * F.lit(float(1 << 30)))

    def setup():
        return lambda texts: [[normal_words(t) for t in texts]]

    words = map_texts(chosen, ["lang"], ["text"], {"words": "array<string>"}, setup)
    counted = words.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    return materialize(counted)


def _expected_uses(shared, index: dict[str, int]):
    """Expected uses of each piece in a task's words, given the current probabilities."""
    def run(batches):
        model = shared.value
        uses = np.zeros((len(model.number) + 2, len(model.languages)))
        for rows in batches:
            words, n = rows["word"].tolist(), rows["n"].to_numpy(float)
            lang = rows["lang"].map(index).to_numpy()
            for part in _same_length(words):
                lattice = model.lattice([words[i] for i in part])
                weights = model.expected(lattice)[0]
                own = weights[:, :, np.arange(len(part)), lang[part]] * n[part]
                np.add.at(uses, (lattice, np.broadcast_to(lang[part], lattice.shape)), own)
        at = np.argwhere(uses[:-2] > 0)
        yield pd.DataFrame({"piece": at[:, 0], "lang": at[:, 1], "uses": uses[at[:, 0], at[:, 1]]})

    return run


def train(
    docs: DataFrame, vocabulary: str = VOCABULARY, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS,
    seed: str = "language",
) -> Model:
    """Piece probabilities of each language by expectation maximisation over distinct words.

    Learns from text and lang of documents outside fold 0 whose lang is not null, from about
    ``sample_rows`` documents a language. The vocabulary is fixed: only its probabilities are
    fitted. What comes to the driver is one number per piece and language, bounded by the
    vocabulary.
    """
    spark = docs.sparkSession
    counts = _word_counts(docs, sample_rows, seed)
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    names = read_pieces(vocabulary)
    number = {p: i for i, p in enumerate(names)}
    pieces = Pieces(number, max(map(len, names)), _table(np.zeros((len(names), len(languages))), len(names) + 1), languages)
    index = {lang: i for i, lang in enumerate(languages)}
    # Long pieces would win every word while all are equally likely; start them lower.
    pieces.logp[: len(names)] -= np.array([len(p) for p in names])[:, None] * 2.0
    for _ in range(rounds if languages else 0):
        shared = spark.sparkContext.broadcast(pieces)
        found = counts.mapInPandas(_expected_uses(shared, index), "piece long, lang long, uses double")
        total = found.groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toPandas()
        table = np.zeros((len(names), len(languages)))
        table[total["piece"], total["lang"]] = total["uses"].round(6)
        pieces = Pieces(number, pieces.longest, _table(table, len(names) + 1), languages)
    return Model(pieces, np.zeros(len(languages)))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, and ``lang_pred`` and ``score`` (0 to 1).

    A text's probability in a language is the product over its words of the sum over all
    segmentations of the word; the score is the posterior of the best language under equal
    priors. Null texts and texts without a letter, and all texts if nothing was learned, give
    ``und`` and 0. Ties go to the first language by code point. Columns of ``docs`` with the
    name of an added one are left out.
    """
    outputs = {"lang_pred": "string", "score": "double"}
    keep = [c for c in docs.columns if c != text and c.lower() not in outputs]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def setup():
        fitted, known = shared.value, {}
        return lambda texts: fitted.predict(texts, known)

    return map_texts(docs, keep, [text], outputs, setup)
