"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

Trees are fitted by numpy on a bounded sample of labelled rows and flattened into arrays: of each
level, a feature and a threshold per node. Scoring walks all rows of a batch down a tree at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import slices, small_batches

#: The largest number of labelled rows that fitting uses: those of least hash.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
MARKS = "!#$%&*|.,:;-_=<>/@?()[]{}\"'"
NAMES = (
    "log_chars", "log_words", "mean_word", "longest_word", "upper_words", "title_words", "distinct_words", "top_word", "repeats",
    "digits", "spaces", "lines", "other_bytes", "controls", "mean_line", "repeated_lines", "short_words", "marked_words", *(f"mark_{ord(c)}" for c in MARKS),
)


def statistics(text: str | None) -> list[float]:
    """The numbers of ``NAMES`` for a text; null counts as empty, for which all are 0."""
    text = text or ""
    words, data = text.split(), np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if not words:
        return [np.log1p(len(text)), *[0.0] * (len(NAMES) - 1)]
    of = np.bincount(data, minlength=256)
    n, size, lines, counts = len(words), len(data), text.split("\n"), Counter(words)
    lengths = [*map(len, words)]
    marked = sum(not w[-1].isalnum() and w[-1] not in ".,;:!?" for w in counts)
    return [
        np.log1p(len(text)), np.log1p(n), sum(lengths) / n, np.log1p(max(lengths)), sum(map(str.isupper, words)) / n, sum(map(str.istitle, words)) / n,
        len(counts) / n, max(counts.values()) / n, sum(map(str.__eq__, words, words[1:])) / n,
        of[48:58].sum() / size, of[32] / size, len(lines) / n, of[128:].sum() / size, (of[:9].sum() + of[11:32].sum()) / size,
        np.log1p(len(text) / len(lines)), 1 - len(set(lines)) / len(lines), sum(x <= 2 for x in lengths) / n, marked / len(counts), *(of[ord(c)] / size for c in MARKS),
    ]


class Trees(NamedTuple):
    """Full binary trees of one depth. Node ``k`` of a tree has the children 2k+1 and 2k+2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; larger values go right
    leaf: np.ndarray  # trees x leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1, for each row."""
        total, rows, inner = np.full(len(x), self.start), np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.intp)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner] if len(node) else 0
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 5) -> Trees:
    """Boosts ``trees`` trees on the logistic loss; splits are sought over histograms of at most ``bins`` bins.

    Without rows, or with one label only, the result has no trees and scores the share of label 1,
    or one half.
    """
    inner = 2**depth - 1
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    start = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    cells, n_features = bins, x.shape[1]
    flat = binned + np.arange(n_features) * cells
    total = np.full(len(y), start)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        feature, threshold, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), np.intp)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (n_features * cells) + flat).ravel()
            hist = [np.bincount(at, np.repeat(w, n_features), width * n_features * cells).reshape(width, n_features, cells) for w in (grad, hess, np.ones(len(y)))]
            g, h, c = (np.cumsum(q, 2) for q in hist)
            gt, ht, ct = (q[:, :, -1:] for q in (g, h, c))
            gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
            gain[(c < least) | (ct - c < least)] = -1
            for k in range(width):
                f, b = np.unravel_index(np.argmax(gain[k]), gain[k].shape)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[first + k], threshold[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        g, h = np.bincount(node - inner, grad, inner + 1), np.bincount(node - inner, hess, inner + 1)
        leaf = -rate * g / (h + l2)
        total += leaf[node - inner]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), start)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether the crc32 of the id, as text, leaves ``part``; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(True))


def described(docs: DataFrame, id_col: str, text_col: str, keep: str) -> DataFrame:
    """doc_id, the column ``keep`` as long, and the statistics of each text as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([statistics(t) for t in b.column(2).to_pylist()], pa.list_(pa.float64()))], ["doc_id", "kept", "x"])

    return small_batches(docs).select(docs[id_col].cast("long"), docs[keep].cast("long"), docs[text_col].cast("string")).mapInArrow(run, "doc_id long, kept long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, parts: int = 5, part: int = 0) -> Trees:
    """Fits on at most ``sample_rows`` labelled rows that aren't held out, those whose id has the least hash.

    The sample, of ids and labels, is bounded and so is broadcast; only its documents' statistics
    reach the driver, a row per id however often it is repeated (of differing texts the one of least
    statistics). Null labels don't count; of differing labels of one id the larger holds.
    """
    sample = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), parts, part))
    sample = sample.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("long").alias("_label"))
    sample = sample.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    chosen = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_label")
    one = described(chosen, "doc_id", "text", "_label").groupBy("doc_id").agg(F.min(F.struct("kept", "x")).alias("r"))
    rows = sorted((r["doc_id"], r["r"]["kept"], r["r"]["x"]) for r in one.collect())
    return fit(np.array([r[2] for r in rows]).reshape(-1, len(NAMES)), np.array([r[1] for r in rows], float))


def score(docs: DataFrame, trees: Trees, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, a row per input row, null ids and repeated rows included. A null text counts as empty. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.array([statistics(t) for t in b.column(1).to_pylist()]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees.score(x))], ["doc_id", "score"])

    return small_batches(docs).select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, trees: Trees, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``threshold``.

    A null text is scored as an empty one; repeated rows and null ids are judged like any other. Texts are taken whole.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            x = np.array([statistics(t) for t in b.column(at).to_pylist()]).reshape(-1, len(NAMES))
            yield b.filter(pa.array(trees.score(x) >= threshold))

    return small_batches(docs).mapInArrow(run, docs.schema)
