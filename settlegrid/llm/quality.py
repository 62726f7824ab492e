"""Quality from a generalised additive model with pairwise interactions.

Features of a text are cut into quantile bins. Boosting goes through the
features in turns; each turn fits a tree of three leaves to the gradient over
one feature's bins and adds its leaves to that feature's lookup table. The pairs
of features that explain most of what is left then get coarse tables of their
own, boosted by trees that cut each of both once. A score is the sum of the
looked-up values, through the logistic function.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, labelled_sample, receive, send

#: At most so many labelled rows are used for training.
TRAINING_ROWS = 8000
THRESHOLD = 0.3
BINS, COARSE, PAIRS = 48, 8, 8

FEATURES = (
    "words", "word_length", "longest_word", "one_letter", "symbols", "digits", "upper", "not_ascii", "distinct",
    "top_word", "repeats", "lines", "line_repeats", "symbol_words", "stops", "sentence_words",
)
_KIND = np.zeros(256, np.int8)
_KIND[33:48] = _KIND[58:65] = _KIND[91:97] = _KIND[123:127] = 1
_KIND[48:58] = 2
_KIND[65:91] = 3
_KIND[128:] = 4
_KIND[[46, 44]] = 5


def features(text: str | None) -> list[float]:
    """The figures of a text, in the order of ``FEATURES``; zeros without words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=6)
    n, inked = len(words), max(1, sum(map(len, words)))
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    top = max(counts.values())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    edges = np.fromiter((w[-2:-1].isalnum() or len(w) < 2 for w in counts), bool, len(counts))
    stops = raw.count(b".")
    return [
        math.log1p(n),
        inked / n,
        math.log1p(int(lengths.max())),
        float((lengths == 1).mean()),
        float(kinds[1] / inked),
        float(kinds[2] / inked),
        float(kinds[3] / inked),
        float(kinds[4] / inked),
        len(counts) / n**0.75,
        top / n,
        sum(map(eq, words, words[1:])) / n,
        math.log1p(len(lines)),
        1 - len(set(lines)) / len(lines),
        float(1 - edges.mean()),
        stops / n,
        math.log1p(n / (1 + stops)),
    ]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _cut(g: np.ndarray, h: np.ndarray, low: int, high: int) -> tuple[float, int]:
    """Best gain of a cut of the bins ``low .. high - 1``, and the bin at which the right part starts."""
    if high - low < 2:
        return 0.0, low
    left_g, left_h = np.cumsum(g[low:high])[:-1], np.cumsum(h[low:high])[:-1]
    all_g, all_h = g[low:high].sum(), h[low:high].sum()
    gains = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
    best = int(gains.argmax())
    return float(gains[best]), low + best + 1


def _line_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Value of every bin under a tree of at most three leaves."""
    bounds = [0, len(g)]
    for _ in range(2):
        found = max((_cut(g, h, a, b) for a, b in zip(bounds, bounds[1:])), default=(0.0, 0))
        if found[0] <= 1e-9:
            break
        bounds = sorted({*bounds, found[1]})
    out = np.zeros(len(g))
    for a, b in zip(bounds, bounds[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _cross_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and table of the best tree that cuts both axes of a coarse grid once."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    best, table = 0.0, np.zeros_like(g)
    size = len(g)
    for i in range(1, size):
        for j in range(1, size):
            parts = [(slice(a, b), slice(c, d)) for a, b in ((0, i), (i, size)) for c, d in ((0, j), (j, size))]
            sums = [tuple(x[r.stop, s.stop] - x[r.start, s.stop] - x[r.stop, s.start] + x[r.start, s.start] for x in (cg, ch)) for r, s in parts]
            gain = sum(a * a / (b + 1.0) for a, b in sums) - cg[-1, -1] ** 2 / (ch[-1, -1] + 1.0)
            if gain > best:
                best = gain
                table = np.zeros_like(g)
                for (r, s), (a, b) in zip(parts, sums):
                    table[r, s] = a / (b + 1.0)
    return best, table


@dataclass
class AdditiveModel:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, values[:, f], side="right") for f, e in enumerate(self.edges)], 1)

    def coarse(self, bins: np.ndarray) -> np.ndarray:
        """Bins of the pair tables: eighths of each feature's bins."""
        return np.stack([bins[:, f] * COARSE // (len(e) + 1) for f, e in enumerate(self.edges)], 1)

    def logits(self, values: np.ndarray) -> np.ndarray:
        bins = self.bins(values)
        total = np.full(len(values), self.base)
        for f, table in enumerate(self.tables):
            total += table[bins[:, f]]
        coarse = self.coarse(bins)
        for i, j, table in self.pairs:
            total += table[coarse[:, i], coarse[:, j]]
        return total

    def score(self, values: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(values))


def fit(values: np.ndarray, labels: np.ndarray, *, rounds: int = 150, pair_rounds: int = 40, rate: float = 0.1) -> AdditiveModel:
    """Boost the tables. Without rows, or with one class, every score is that class's smoothed share."""
    labels = np.asarray(labels, np.float64)
    n, width = len(labels), values.shape[1] if values.ndim == 2 else len(FEATURES)
    share = (labels.sum() + 1) / (n + 2)
    if n == 0 or labels.min() == labels.max():
        return AdditiveModel(math.log(share / (1 - share)), [np.empty(0)] * width, [np.zeros(1)] * width)
    edges = [np.unique(np.quantile(values[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    model = AdditiveModel(math.log(share / (1 - share)), edges, [np.zeros(len(e) + 1) for e in edges])
    bins = model.bins(values)
    logits = np.full(n, model.base)
    for _ in range(rounds):
        for f in range(width):
            p = _sigmoid(logits)
            size = len(edges[f]) + 1
            step = rate * _line_tree(np.bincount(bins[:, f], labels - p, size), np.bincount(bins[:, f], p * (1 - p), size))
            model.tables[f] += step
            logits += step[bins[:, f]]
    coarse = model.coarse(bins)

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p = _sigmoid(logits)
        cell = coarse[:, i] * COARSE + coarse[:, j]
        return tuple(np.bincount(cell, x, COARSE**2).reshape(COARSE, COARSE) for x in (labels - p, p * (1 - p)))

    ranked = sorted(combinations(range(width), 2), key=lambda ij: -_cross_tree(*grid(*ij))[0])
    model.pairs = [(i, j, np.zeros((COARSE, COARSE))) for i, j in ranked[:PAIRS]]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            step = rate * _cross_tree(*grid(i, j))[1]
            table += step
            logits += step[coarse[:, i], coarse[:, j]]
    return model


def _rows(parts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in parts], np.float64).reshape(len(parts), len(FEATURES))


def train_on(docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", modulus: int, remainder: int) -> AdditiveModel:
    """Features of a bounded labelled sample are made by the tasks; only they come to the driver."""
    sample = labelled_sample(docs, labels, label, TRAINING_ROWS, id_col=id_col, text_col=text_col, modulus=modulus, remainder=remainder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.list_(pa.float64()))], ["doc_id", "label", "features"])

    made = sample.select("doc_id", "text", F.col("label").cast("int").alias("label")).mapInArrow(run, f"doc_id {id_type(docs, id_col)}, label int, features array<double>")
    rows = sorted(made.collect())
    values = np.array([r["features"] for r in rows], np.float64).reshape(len(rows), len(FEATURES))
    return fit(values, np.array([r["label"] for r in rows]))


def quality(docs: DataFrame, model: AdditiveModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``doc_id, score, predicted``.

    Defined cases: null and wordless texts have the features of an empty text;
    very long texts are read whole; repeated rows are scored each, null ids and
    ids of any type pass through; other columns play no part; an empty table gives no rows.
    """
    sent = send(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = receive(sent)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                scores = own.score(_rows(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type(docs, id_col)}, score double, predicted int")
