"""Operator 1: a quality classifier learnt from trusted positives and unlabelled text.

Labels that say 1 are trusted positives; everything else is unlabelled. With the class prior p, the risk of
a scorer g is p * E+[l(g)] + max(0, Eu[l(-g)] - p * E+[l(-g)]): the second part is the risk on negatives,
which no unbiased estimate may push under 0. The prior comes from a first scorer of positives against
unlabelled rows: the best bin of scores has the least share of unlabelled to positive rows above it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carbonloom.llm import docstats
from carbonloom.llm.common import binary_lists, map_batches, without
from carbonloom.llm.sampling import agreed, fetch, held_out, sample, text_rows

#: Rows sampled for the fit: of trusted positives, and of all documents outside the held-out fold.
MOST_POSITIVE, MOST_UNLABELLED = 8_000, 8_000


@dataclass
class Scorer:
    """One hidden layer over scaled statistics."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.centre) / self.scale, -6, 6) @ self.w1 + self.b1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.hidden(x) @ self.w2 + self.b2[0])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = 400, rate: float = 0.02, units: int = 12, decay: float = 1e-4, seed: int = 7) -> Scorer:
    """Non-negative PU risk with the logistic loss, by full-batch Adam; prior None: positives against unlabelled rows."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    s = Scorer(np.median(both, axis=0), both.std(axis=0) + 1e-3, rng.normal(0, 0.3, (both.shape[1], units)), np.zeros(units), rng.normal(0, 0.3, units), np.zeros(1))
    parts = [s.w1, s.b1, s.w2, s.b2]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    scaled = [np.clip((x - s.centre) / s.scale, -6, 6) for x in (positive, unlabelled)]
    for step in range(1, steps + 1):
        h = [np.tanh(x @ s.w1 + s.b1) for x in scaled]
        p, u = (_sigmoid(x @ s.w2 + s.b2[0]) for x in h)
        if prior is None:
            gp, gu = -(1 - p) / len(p), u / len(u)
        else:
            softplus = lambda q: -np.log(np.maximum(1 - q, 1e-12))  # noqa: E731  the loss of a row taken as negative
            negative = softplus(u).mean() - prior * softplus(p).mean()
            # below 0 the step undoes the negative part alone, as the non-negative estimator asks
            gp, gu = (prior * (-(1 - p) - p) / len(p), u / len(u)) if negative >= 0 else (prior * p / len(p), -u / len(u))
        grads = [0, 0, 0, 0]
        for x, hid, g in zip(scaled, h, (gp, gu), strict=True):
            back = np.outer(g, s.w2) * (1 - hid**2)
            for k, d in enumerate((x.T @ back, back.sum(axis=0), hid.T @ g, np.array([g.sum()]))):
                grads[k] = grads[k] + d
        for k, part in enumerate(parts):
            d = grads[k] + decay * part
            first[k] += 0.1 * (d - first[k])
            second[k] += 0.001 * (d * d - second[k])
            part -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return s


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among unlabelled rows, by the best bin of scores on the halves that the scorer has not seen."""
    s = fit(positive[::2], unlabelled[::2], None, steps=150)
    p, u = np.sort(s.score(positive[1::2])), np.sort(s.score(unlabelled[1::2]))
    cuts = np.unique(np.quantile(p, np.linspace(0, 0.98, 99)))
    above_p = 1 - np.searchsorted(p, cuts, side="left") / len(p)
    above_u = 1 - np.searchsorted(u, cuts, side="left") / len(u)
    slack = np.sqrt(np.log(4 / delta) / 2 / len(u)) + np.sqrt(np.log(4 / delta) / 2 / len(p))
    best = int(np.argmin((above_u + slack) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.95))


def train(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> tuple[Scorer | None, float]:
    """The scorer and the estimated prior; no scorer without positives. Held-out labels are not read; the sample is bounded.

    Trusted are documents whose labels all say 1. Each different text of a doc_id counts once.
    """
    rest = text_rows(docs.where(~held_out(F.col("doc_id")))).withColumn("part", F.lit(0))
    known = rest.join(agreed(labels).where("quality = 1").select("doc_id"), "doc_id")
    positive, _ = fetch(docs, sample(known, most_positive, 1), "part")
    unlabelled, _ = fetch(docs, sample(rest, most_unlabelled, 2), "part")
    if len(positive) < 4 or len(unlabelled) < 4:
        return None, 0.5
    prior = estimate_prior(positive, unlabelled)
    return fit(positive, unlabelled, prior), prior


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, bound: float = 0.3, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> DataFrame:
    """docs with held_out boolean, score double (0 to 1, higher: quality likelier) and predicted int (score >= bound).

    docs needs doc_id and text; its own columns of these names are replaced. Only texts are inputs of a
    score. Null text counts as empty; empty texts have a score like any other. Repeated rows get equal
    scores; null doc_id is not held out. Without positives each score is 0.5.
    """
    docs = without(docs, "held_out", "score", "predicted")
    model, _ = train(docs, labels, most_positive, most_unlabelled)
    names = [*docs.columns, "held_out", "score"]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([docstats.statistics(t)[1] for t in binary_lists(batch, "text")])
        out = model.score(x) if model else np.full(len(x), 0.5)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "score"])

    marked = docs.withColumn("held_out", held_out(F.col("doc_id")))
    out = map_batches(marked, each, T.StructType([*marked.schema.fields, T.StructField("score", T.DoubleType())]), by="text")
    return out.select(*names, (F.col("score") >= bound).cast("int").alias("predicted"))
