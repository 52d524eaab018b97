"""Quality rules: gradient-boosted trees over document statistics."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from feedlake.llm.common import WordHashes, by_hash, fresh, map_texts, window_hashes, words
from feedlake.session import ship

ship(__name__)

SYMBOLS = "#*$%&|<>"
SEPARATORS = " \t\n\v\f\r"
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Bound of the labelled sample that trains the trees, in documents.
SAMPLE_ROWS = 12_000
#: A document is rejected when its probability of being good is below this.
KEEP_FROM = 0.2

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics the trees see, with the direction the score may take along them (0: any).
FEATURES = {
    "log_words": 0, "mean_word_chars": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_word_share": -1,
    "upper_share": 0, "digit_share": 0, "punctuation_share": 0, "bang_per_word": -1, "bar_per_word": -1,
    "distinct_word_share": 0, "line_words": 0, "one_char_word_share": 0, "top_word_share": 0,
}
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
DIGIT = re.compile(r"[0-9]")
PUNCTUATION = re.compile(r"[.,;:!?\"'()\[\]-]")


def text_counts(text: str | None, hashes: WordHashes) -> tuple[list[int], list[float]]:
    """The five counts of a text and its features."""
    text = text or ""
    tokens = words(text)
    n = len(tokens)
    ids = hashes.of(tokens)
    word_chars = len(text) - sum(map(text.count, SEPARATORS))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(SEPARATORS)]
    n_dup = len(lines) - len(set(lines))
    n_repeat = repeated_words(ids)
    _, counts = np.unique(ids, return_counts=True)
    words_or_1, chars_or_1 = max(n, 1), max(word_chars, 1)
    features = [
        float(np.log1p(n)), word_chars / words_or_1, n_symbols / words_or_1, n_dup / max(len(lines), 1),
        n_repeat / words_or_1, len(UPPER.findall(text)) / chars_or_1, len(DIGIT.findall(text)) / chars_or_1,
        len(PUNCTUATION.findall(text)) / chars_or_1, text.count("!") / words_or_1, text.count("|") / words_or_1,
        len(counts) / words_or_1, n / max(len(lines), 1), sum(len(t) == 1 for t in tokens) / words_or_1,
        int(counts.max(initial=0)) / words_or_1,
    ]
    return [n, word_chars, n_symbols, n_dup, n_repeat], features


def repeated_words(ids: np.ndarray, size: int = REPEAT_WINDOW) -> int:
    """Words inside windows of ``size`` words that occur twice or more; ids are 64-bit word hashes."""
    windows = window_hashes(ids, size)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    equal = windows[order][1:] == windows[order][:-1]
    if not equal.any():
        return 0
    found = np.zeros(len(windows), bool)
    found[order[1:][equal]] = True
    found[order[:-1][equal]] = True
    marks = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(found)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + size, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def base_fails(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words


@dataclass
class Trees:
    """All trees in one set of node arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        """P(good) per row of ``x``; all trees walk down together, one level at a time."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            goes_left = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(goes_left, self.left[at], self.right[at])
        return 1.0 / (1.0 + np.exp(-(self.start + self.value[at].sum(axis=1))))


def fit_trees(
    x: np.ndarray, y: np.ndarray, monotone: list[int], n_trees: int = 60, depth: int = 4, rate: float = 0.15,
    bins: int = 48, min_rows: int = 20, ridge: float = 1.0,
) -> Trees:
    """Boosted trees for log loss, grown level by level on histograms of binned features.

    A split on a constrained feature must keep its sides in order, and the middle between them
    bounds everything below, so the score is monotonic in that feature. Without rows of both
    kinds the trees are empty and the score is the share of good ones (1 without any rows).
    """
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    share = float(y.mean()) if len(y) else 1.0
    start = float(np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3))))
    both = 0 < share < 1
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])] if both else []
    binned = [np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)]
    margin = np.full(len(y), start)
    for _ in range(n_trees if both else 0):
        p = 1.0 / (1.0 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        root = len(nodes)
        roots.append(root)
        nodes.append([0, np.inf, root, root, 0.0])
        where = np.full(len(y), root)
        level = {root: (-np.inf, np.inf)}
        for at_depth in range(depth + 1):
            following = {}
            for node, (low, high) in level.items():
                rows = np.flatnonzero(where == node)
                g, h = grad[rows], hess[rows]
                nodes[node][4] = rate * float(np.clip(g.sum() / (h.sum() + ridge), low, high))
                nodes[node][2] = nodes[node][3] = node
                if at_depth == depth or len(rows) < 2 * min_rows:
                    continue
                best = _best_split(rows, g, h, binned, edges, monotone, (low, high), min_rows, ridge)
                if best is None:
                    continue
                f, cut, left_value, right_value = best
                left, right = len(nodes), len(nodes) + 1
                nodes[node][:4] = [f, float(edges[f][cut]), left, right]
                nodes += [[0, np.inf, left, left, 0.0], [0, np.inf, right, right, 0.0]]
                goes_left = binned[f][rows] <= cut
                where[rows] = np.where(goes_left, left, right)
                middle = (left_value + right_value) / 2
                lows, highs = (low, low), (high, high)
                if monotone[f] > 0:
                    highs, lows = (middle, high), (low, middle)
                elif monotone[f] < 0:
                    highs, lows = (high, middle), (middle, low)
                following[left], following[right] = (lows[0], highs[0]), (lows[1], highs[1])
            level = following
        margin += np.array([node[4] for node in nodes])[where]
    table = np.array(nodes or [[0, np.inf, 0, 0, 0.0]], float)
    whole = [table[:, i].astype(np.int64) for i in (0, 2, 3)]
    return Trees(whole[0], table[:, 1], whole[1], whole[2], table[:, 4], np.array(roots or [0]), depth, start)


def _best_split(rows, g, h, binned, edges, monotone, bounds, min_rows, ridge):
    """(feature, bin, left value, right value) of the split with the largest gain, or None."""
    best, best_gain = None, 1e-9
    whole = g.sum() ** 2 / (h.sum() + ridge)
    for f, e in enumerate(edges):
        if not len(e):
            continue
        b = binned[f][rows]
        size = len(e) + 1
        gl = np.cumsum(np.bincount(b, g, size))[:-1]
        hl = np.cumsum(np.bincount(b, h, size))[:-1]
        nl = np.cumsum(np.bincount(b, minlength=size))[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        left, right = np.clip(gl / (hl + ridge), *bounds), np.clip(gr / (hr + ridge), *bounds)
        gain = 2 * (gl * left + gr * right) - (hl + ridge) * left**2 - (hr + ridge) * right**2 - whole
        allowed = (nl >= min_rows) & (len(rows) - nl >= min_rows)
        if monotone[f]:
            allowed &= monotone[f] * (right - left) >= 0
        gain = np.where(allowed, gain, -np.inf)
        cut = int(np.argmax(gain))
        if gain[cut] > best_gain:
            best, best_gain = (f, cut, left[cut], right[cut]), gain[cut]
    return best


def labelled_sample(labels: DataFrame, label: str, seed: str, rows: int, where=None) -> DataFrame:
    """(doc_id, label) of about ``rows`` labelled documents, chosen by hash; all if there are fewer.

    Repeated labels of a document count once, as the highest. Null ids and labels are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if where is not None:
        known = known.where(where)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    n = known.count()
    return known.where(by_hash(F.col("doc_id"), seed, rows / n)) if n > rows else known


def document_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep``, the five counts, and the features as an array."""
    def setup():
        hashes = WordHashes()

        def work(texts):
            made = [text_counts(t, hashes) for t in texts]
            return [*zip(*(c for c, _ in made)), [f for _, f in made]]

        return work

    return map_texts(docs, keep, [text], {**{c: "bigint" for c in COUNTS}, "features": "array<double>"}, setup)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: str = "quality rules") -> Trees:
    """Trees fitted to ``labels.quality`` on a sample bounded by ``sample_rows`` documents.

    The sample's ids are broadcast and its statistics fitted on the driver: both are bounded
    by that parameter, at any size of the tables.
    """
    sample = labelled_sample(labels, "quality", seed, sample_rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = document_counts(chosen, ["doc_id", "label"]).select("doc_id", "label", "features").toPandas()
    rows = rows.sort_values(["doc_id"], kind="stable")
    x = np.array(rows["features"].tolist(), float).reshape(-1, len(FEATURES))
    # The order of rows must not reach the sums, so repeated ids are ordered by their features too.
    order = np.lexsort([*x.T[::-1], rows["doc_id"].to_numpy()])
    return fit_trees(x[order], rows["label"].to_numpy(float)[order], list(FEATURES.values()))


def judge(docs: DataFrame, trees: Trees, keep_from: float = KEEP_FROM, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, the five counts, base_failed, score and kept.

    ``base_failed``: fewer than 20 words, or more than 30 % of the words in repeated windows.
    ``kept``: not base_failed and a score of at least ``keep_from``. Null and empty texts have
    no words and fail. Columns of ``docs`` with the name of an added one are left out.
    """
    outputs = {**{c: "bigint" for c in COUNTS}, "base_failed": "boolean", "score": "double", "kept": "boolean"}
    keep = [c for c in docs.columns if c != text and c.lower() not in outputs]
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def setup():
        hashes, model = WordHashes(), shared.value

        def work(texts):
            made = [text_counts(t, hashes) for t in texts]
            counts = np.array([c for c, _ in made], np.int64)
            score = model.probability(np.array([f for _, f in made], float))
            failed = np.array([base_fails(c[0], c[4]) for c in counts.tolist()], bool)
            return [*counts.T, failed, score, ~failed & (score >= keep_from)]

        return work

    return map_texts(docs, keep, [text], outputs, setup)


def keep_good(docs: DataFrame, trees: Trees, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    (flag,) = fresh(docs, "kept")

    def setup():
        hashes, model = WordHashes(), shared.value

        def work(texts):
            made = [text_counts(t, hashes) for t in texts]
            score = model.probability(np.array([f for _, f in made], float))
            return [[not base_fails(c[0], c[4]) and s >= keep_from for (c, _), s in zip(made, score.tolist())]]

        return work

    return map_texts(docs, docs.columns, ["text"], {flag: "boolean"}, setup).where(F.col(flag)).drop(flag)
