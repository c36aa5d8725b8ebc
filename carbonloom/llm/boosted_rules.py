"""Operator 10: quality rules, as counts with fixed bounds and boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carbonloom.llm import docstats
from carbonloom.llm.common import binary_lists, map_batches, without
from carbonloom.llm.sampling import agreed, fetch, sample, text_rows

#: The score may only fall as these grow.
FALLING = ("symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "bang_rate", "top_word_rate", "adjacent_rate")
#: Sampled labelled rows for the fit, of each label.
MOST_OF_LABEL = 8_000
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


@dataclass
class Trees:
    """Boosted trees as flat node arrays (trees x nodes): children of node k are 2k+1 and 2k+2; a leaf sends all rows left."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability for each row of x: all trees and rows step down together."""
        if not len(x):
            return np.zeros(0)
        tree = np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        return 1 / (1 + np.exp(-(self.start + self.value[tree, at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, sign: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Gradient-boosted trees for the logistic loss with histogram splits.

    sign: +1 or -1 for each feature along which the score may only rise or fall, else 0. A split on such a
    feature is taken only if its two means are in order; below it, the midpoint bounds each side.
    """
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(d)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if n else np.zeros((0, d), int)
    nodes = 2 ** (depth + 1) - 1
    base = np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3) if n else 0.5
    out = Trees(np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes)), depth, float(np.log(base / (1 - base))))
    total = np.full(n, out.start)
    for t in range(trees if n else 0):
        p = 1 / (1 + np.exp(-total))
        g, h = weight * (y - p), weight * p * (1 - p)
        at, low, high = np.zeros(n, np.int64), np.full(nodes, -np.inf), np.full(nodes, np.inf)
        mean = lambda a, b, k: np.clip(a / (b + ridge), low[k], high[k])
        for k in range(2**depth - 1):
            rows = np.flatnonzero(at == k)
            out.value[t, k] = mean(g[rows].sum(), h[rows].sum(), k)
            best = (1e-6, -1, 0, 0.0, 0.0)
            whole = g[rows].sum() ** 2 / (h[rows].sum() + ridge)
            for j in range(d):
                gs, hs, ns = (np.cumsum(np.bincount(code[rows, j], v, len(edges[j]) + 1))[:-1] for v in (g[rows], h[rows], weight[rows]))
                if not len(gs):
                    continue
                gr, hr, nr = g[rows].sum() - gs, h[rows].sum() - hs, weight[rows].sum() - ns
                left, right = mean(gs, hs, k), mean(gr, hr, k)
                gain = np.where((ns >= least) & (nr >= least) & (sign[j] * (right - left) >= 0), gs**2 / (hs + ridge) + gr**2 / (hr + ridge) - whole, -1)
                c = int(gain.argmax())
                if gain[c] > best[0]:
                    best = (gain[c], j, c, left[c], right[c])
            _, j, c, left, right = best
            for child in (2 * k + 1, 2 * k + 2):
                low[child], high[child] = low[k], high[k]
            if j < 0:  # a leaf: all rows go left
                at[rows] = 2 * k + 1
                continue
            out.feature[t, k], out.threshold[t, k] = j, edges[j][c]
            if sign[j]:
                middle = (left + right) / 2
                (high if sign[j] > 0 else low)[2 * k + 1] = middle
                (low if sign[j] > 0 else high)[2 * k + 2] = middle
            at[rows] = 2 * k + 1 + (code[rows, j] > c)
        for k in range(2**depth - 1, nodes):
            rows = np.flatnonzero(at == k)
            out.value[t, k] = rate * (mean(g[rows].sum(), h[rows].sum(), k) if len(rows) else 0.0)
            total[rows] += out.value[t, k]
    return out


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_OF_LABEL) -> Trees:
    """Trees fitted on at most `most` training rows of each label, those of lower hash; none: trees that keep all.

    A document whose labels clash is left out; each different text of a doc_id is a row.
    Each sampled row stands for count / sampled of its label, so that the labels weigh as in all training rows
    however many are sampled. Weights have mean 1: the fit's least rows and ridge count sampled rows.
    """
    known = text_rows(docs).join(agreed(labels), "doc_id")
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    x, y = fetch(docs, sample(known.where("quality = 1"), most, 10).union(sample(known.where("quality = 0"), most, 10)), "quality")
    weight = np.array([counts[v] / min(counts[v], most) for v in y.astype(int)])
    sign = np.array([-1 if name in FALLING else 0 for name in docstats.NAMES])
    return fit(x, y, weight / weight.mean() if len(weight) else weight, sign)


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = MOST_OF_LABEL, bound: float = 0.5) -> DataFrame:
    """docs with the columns ADDED: base counts, base_failed, the trees' score and kept.

    base_failed: under 20 words, or over 30 % of the words in repeated 8-word windows. kept: not base_failed
    and score >= bound. Null and empty texts have no words and fail. Only `quality` of labels is read,
    outside the held-out fold, on a sample of at most `most` rows of each label. Without labelled rows all that
    pass the base rules are kept. Rows are judged one by one: repeats get the same verdict, order is free.
    """
    docs = without(docs, *ADDED)
    trees = train(docs, labels, most)
    if not trees.value.any():
        trees.start = 10.0
    names = [*docs.columns, *ADDED]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [docstats.statistics(x) for x in binary_lists(batch, "text")]
        counts = np.array([x[0] for x in found], np.int64)
        score = trees.score(np.array([x[1] for x in found]))
        failed = (counts[:, 0] < 20) | (100 * counts[:, 4] > 30 * counts[:, 0])
        new = [*counts.T, failed, score, ~failed & (score >= bound)]
        return pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v) for v in new]], names)

    kinds = [T.LongType()] * 5 + [T.BooleanType(), T.DoubleType(), T.BooleanType()]
    return map_batches(docs, each, T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(ADDED, kinds, strict=True)]]), by="text")
