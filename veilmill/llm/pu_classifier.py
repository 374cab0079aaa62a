"""Quality classifier learned from trusted positives and unlabelled text.

An additive model over binned text statistics is fitted by minimising the non-negative unbiased risk

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))

over trusted positives p and unlabelled documents u. The prior, the share of positives among unlabelled text, is the
least ratio of unlabelled to positive mass over the bins of a preliminary p-against-u score. Only the fit
runs on the driver, over samples bounded by FIT_ROWS; statistics, bins and scores cover every document inside Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .textstats import FEATURES, with_features, with_stats

#: Most positives, and most unlabelled documents, that a fit looks at; those with the least hash of doc_id.
FIT_ROWS = 20_000
NAMES = [f"f_{x}" for x in FEATURES]


def held_out() -> Column:
    return F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1")


@dataclass
class Model:
    """score = sigmoid(bias + the weight of each feature's bin)."""

    cuts: list[list[float]]
    weights: list[list[float]]
    bias: float
    prior: float

    def score(self) -> Column:
        total = F.lit(self.bias)
        for name, cuts, weights in zip(NAMES, self.cuts, self.weights, strict=True):
            part = F.lit(weights[0])
            for cut, weight in zip(cuts, weights[1:], strict=True):
                part = F.when(F.col(name) >= cut, F.lit(weight)).otherwise(part)
            total = total + part
        return 1 / (1 + F.exp(-total))


def _onehot(rows: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    parts = []
    for j, c in enumerate(cuts):
        at = np.searchsorted(np.asarray(c), rows[:, j], side="right")
        parts.append(np.eye(len(c) + 1)[at])
    return np.concatenate(parts, axis=1)


def _adam(gradient, size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _logistic(xp: np.ndarray, xu: np.ndarray, steps: int = 200) -> np.ndarray:
    """p against u with equal weight, for the prior."""
    return _adam(lambda w: xu.T @ _sigmoid(xu @ w) / len(xu) - xp.T @ _sigmoid(-(xp @ w)) / len(xp) + 1e-3 * w, xp.shape[1], steps)


def estimate_prior(sp: np.ndarray, su: np.ndarray, bins: int = 20) -> float:
    """Share of positives in u: no set can hold more positives than members, so u(A) / p(A) bounds it for every A."""
    edges = np.quantile(sp, np.linspace(0, 1, bins + 1)[1:-1])
    p = np.bincount(np.searchsorted(edges, sp, side="right"), minlength=bins) / len(sp)
    u = np.bincount(np.searchsorted(edges, su, side="right"), minlength=bins) / len(su)
    # Upper tails only: what looks most like a positive.
    tail_p, tail_u = p[::-1].cumsum(), u[::-1].cumsum()
    some = tail_p >= 0.3
    slack = 1 / np.sqrt(len(su))
    return float(np.clip(((tail_u + slack)[some] / tail_p[some]).min(), 0.05, 0.95))


def _nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 600, decay: float = 2e-3) -> np.ndarray:
    """Sigmoid loss l(z) = sigmoid(-z); where the negative part turns below zero, the step undoes it."""

    def gradient(w: np.ndarray) -> np.ndarray:
        zp, zu = xp @ w, xu @ w
        lp, lu = _sigmoid(zp), _sigmoid(zu)
        slope_p, slope_u = lp * (1 - lp), lu * (1 - lu)
        g_pos = -prior * (xp.T @ slope_p) / len(xp)
        g_neg = (xu.T @ slope_u) / len(xu) - prior * (xp.T @ slope_p) / len(xp)
        negative = lu.mean() - prior * lp.mean()
        return (g_pos + g_neg if negative >= 0 else -g_neg) + decay * w

    return _adam(gradient, xp.shape[1], steps)


def _sample(rows: DataFrame) -> np.ndarray:
    """The features of the FIT_ROWS rows with the least hash of doc_id; a filter on the hash keeps what tasks send bounded."""
    share = min(1.0, 1.2 * FIT_ROWS / max(1, rows.count()))
    near = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    least = near.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id", *NAMES).select(*NAMES).limit(FIT_ROWS).collect()
    return np.array([list(r) for r in least], dtype=float).reshape(-1, len(NAMES))


def fit(stats: DataFrame, labels: DataFrame, bins: int = 10) -> Model:
    """labels: doc_id, quality; only quality = 1 outside the held-out third is learned from.

    Unlabelled documents are those outside the held-out third, whatever labels say of them. Without positives or
    without documents every score is 0.5.
    """
    pool = stats.where("doc_id is not null").where(~held_out())
    trusted = labels.where("quality = 1 and doc_id is not null").where(~held_out()).select("doc_id").distinct()
    p, u = _sample(pool.join(trusted, "doc_id", "left_semi")), _sample(pool)
    if not len(p) or not len(u):
        return Model([[] for _ in NAMES], [[0.0] for _ in NAMES], 0.0, 0.5)
    cuts = [sorted(set(np.quantile(u[:, j], np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for j in range(len(NAMES))]
    xp, xu = _onehot(p, cuts), _onehot(u, cuts)
    w = _logistic(xp, xu)
    prior = estimate_prior(xp @ w, xu @ w)
    w = _nnpu(xp, xu, prior)
    weights, at = [], 0
    for c in cuts:
        weights.append(w[at : at + len(c) + 1].tolist())
        at += len(c) + 1
    return Model(cuts, weights, 0.0, prior)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; scores rest on the text alone.

    Null texts score as empty ones; a null doc_id is not held out. Equal texts score alike. Empty docs give an empty
    result. Further columns are ignored.
    """
    stats = written(with_features(with_stats(docs.select("doc_id", "text"), ("doc_id",))), "pu-stats")
    model = fit(stats, labels)
    scored = stats.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
