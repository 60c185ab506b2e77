"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is put into one of its bins, and the model is a table of one addend per bin and feature, and per
pair of bins for the feature pairs that help most. The tables are learned by cyclic boosting: round after round, each
feature in turn gets a shallow tree of four leaves on what the model so far leaves over, and a fraction of it is added
to the feature's table. Scoring looks up and adds table entries for whole columns of texts at once.

The model is fitted on a bounded sample of the labelled rows, FIT_ROWS; their features are computed by Spark and only
these go to the driver.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows to fit on, at most about this many.
FIT_ROWS = 40_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.15
#: Rows a leaf needs, and the weight that pulls a leaf to 0.
LEAF, RIDGE = 20, 5.0
SYMBOLS, PIPES = "#*$%&<>@^~=", "|"
FEATURES = [
    "words", "word_length", "symbols", "pipes", "exclamations", "upper", "digits", "distinct_words", "lines", "line_words",
    "repeated_lines", "ended_lines", "commas", "non_ascii", "repeated_triples", "longest_word",
]


def features(text: str | None) -> list[float]:
    """The features of a whole text, in the order of FEATURES; null counts as empty."""
    text = text or ""
    words, size = text.split(), max(1, len(text))
    lines = [line.strip() for line in text.split("\n")]
    lines = [line for line in lines if line]
    n, rows = max(1, len(words)), max(1, len(lines))
    letters = max(1, sum(map(str.isalpha, text)))
    triples = list(zip(words, words[1:], words[2:], strict=False))
    share = lambda chars: sum(map(text.count, chars)) / size
    return [
        np.log1p(len(words)), sum(map(len, words)) / n, share(SYMBOLS), share(PIPES), share("!"),
        sum(map(str.isupper, text)) / letters, share("0123456789"), len(set(words)) / n,
        np.log1p(len(lines)), len(words) / rows, 1 - len(set(lines)) / rows, sum(line[-1] in ".!?…" for line in lines) / rows,
        (text.count(",") + text.count(".")) / n, (len(text.encode()) - len(text)) / size,
        1 - len(set(triples)) / max(1, len(triples)), np.log1p(max(map(len, words), default=0)),
    ]


class Model(NamedTuple):
    """Bin edges per feature, tables per feature, and (feature, feature, edges, edges, table) per pair."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]


def _bins(values: np.ndarray, count: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, count + 1)[1:-1]))


def _tree(bins: np.ndarray, gradient: np.ndarray, weight: np.ndarray, size: int, leaves: int = 4) -> np.ndarray:
    """A tree over ordered bins, cut where it gains most until it has `leaves` leaves; its value for each bin."""
    g, h, n = (np.concatenate([[0], np.cumsum(np.bincount(bins, w, size))]) for w in (gradient, weight, None))
    parts, gain = [(0, size)], lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + RIDGE)
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for a, b in parts:
            for cut in range(a + 1, b):
                if n[cut] - n[a] >= LEAF and n[b] - n[cut] >= LEAF:
                    best = max(best, (gain(a, cut) + gain(cut, b) - gain(a, b), (a, b), cut), key=lambda x: x[0])
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(size)
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + RIDGE)
    return out


def _left_over(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    chance = 1 / (1 + np.exp(-score))
    return label - chance, np.maximum(chance * (1 - chance), 1e-3)


def fit(x: np.ndarray, label: np.ndarray) -> Model:
    """Learn from rows of FEATURES and labels 0 and 1. Without rows of both labels the model is a constant."""
    positive = (label.sum() + 0.5) / (len(label) + 1)
    base = float(np.log(positive / (1 - positive)))
    if len(label) == 0 or label.min() == label.max():
        return Model(base, [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [])
    edges = [_bins(x[:, f], BINS) for f in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    score = np.full(len(label), base)
    for _ in range(ROUNDS):
        for f, table in enumerate(tables):
            step = RATE * _tree(binned[f], *_left_over(score, label), len(table))
            table += step
            score += step[binned[f]]
    # Pairs: those whose cells explain most of what is left over.
    coarse = [_bins(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]
    gradient, weight = _left_over(score, label)
    found = []
    for a in range(x.shape[1]):
        for b in range(a):
            cell, size = cells[a] * (len(coarse[b]) + 1) + cells[b], (len(coarse[a]) + 1) * (len(coarse[b]) + 1)
            g, h = np.bincount(cell, gradient, size), np.bincount(cell, weight, size)
            found.append((float((g**2 / (h + RIDGE)).sum()), a, b, cell, size))
    chosen = sorted(found, key=lambda p: -p[0])[:PAIRS]
    grids = [np.zeros(p[4]) for p in chosen]
    for _ in range(PAIR_ROUNDS):
        for (_, _, _, cell, size), grid in zip(chosen, grids, strict=True):
            g, h = (np.bincount(cell, w, size) for w in _left_over(score, label))
            step = RATE * g / (h + RIDGE)
            grid += step
            score += step[cell]
    return Model(base, edges, tables, [(a, b, coarse[a], coarse[b], grid) for (_, a, b, _, _), grid in zip(chosen, grids, strict=True)])


def score(model: Model, x: np.ndarray) -> np.ndarray:
    """The chance of label 1 for rows of FEATURES, by table look-ups."""
    total = np.full(len(x), model.base)
    for f, (edges, table) in enumerate(zip(model.edges, model.tables, strict=True)):
        total += table[np.searchsorted(edges, x[:, f], "right")]
    for a, b, first, second, grid in model.pairs:
        total += grid[np.searchsorted(first, x[:, a], "right") * (len(second) + 1) + np.searchsorted(second, x[:, b], "right")]
    return 1 / (1 + np.exp(-total))


def fit_rows(labels: DataFrame, label: str, id_column: str = "doc_id") -> DataFrame:
    """(_id, _label) of about FIT_ROWS labelled documents: all, or those whose id's hash is lowest.

    Rows without id or label are left out; of several labels of one document the largest counts.
    """
    known = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull())
    rows, scale = known.count(), 1 << 30
    part = min(1.0, FIT_ROWS / max(1, rows))
    if part < 1:
        known = known.where(F.pmod(F.xxhash64(F.col(id_column), F.lit("fit")), F.lit(scale)) < int(part * scale))
    return known.groupBy(F.col(id_column).alias("_id")).agg(F.max(label).alias("_label"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Fit on the labelled documents; `labels` holds the rows that may be learned from. No labels: a constant model."""

    @F.pandas_udf("array<double>")
    def described(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    chosen = fit_rows(labels, label, id_column)
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    # fit_rows bounds the broadcast side; rows that repeat an id count once.
    joined = texts.join(F.broadcast(chosen), "_id").select("_id", "_label", described("_text").alias("_x"))
    rows = joined.groupBy("_id").agg(F.min(F.struct("_label", "_x")).alias("_r")).select("_r._label", "_r._x").collect()
    x = np.array([r[1] for r in rows], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[0] for r in rows], float))


def scored(model: Model, text: Column) -> Column:
    """The score of a text, 0 to 1; null counts as empty."""

    @F.pandas_udf(T.DoubleType())
    def chance(texts: pd.Series) -> pd.Series:
        return pd.Series(score(model, np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))))

    return chance(text)


def score_quality(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score) of each row of `docs`, from its text alone; repeated rows, null ids and an empty table as they are.

    Columns besides the two are not read, so their names don't matter.
    """
    return docs.select(F.col(id_column).alias("doc_id"), scored(model, F.col(text_column)).alias("score"))
