"""Bounded samples of labelled documents, and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, settle

FOLDS = 5  # ids whose crc32 leaves 0 are held out


def held_out(doc_id: str = "doc_id"):
    return remainder(F.col(doc_id), FOLDS) == 0


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, *, per_class: int, doc_id: str = "doc_id", text: str = "text", name: str = "sample") -> DataFrame:
    """(text, label, half) of at most ``per_class`` labelled ids of each class, held-out ids left out.

    Ids are taken in the order of a hash, so the sample is the same at each run;
    ids with contradicting labels are left out.  ``half`` splits the sample.  The
    ids alone are broadcast, at most ``2 * per_class`` of them.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).alias("label"), F.max(label).alias("_most")).filter("label = _most")
    known = known.select("_id", "label", F.xxhash64("_id", F.lit(name)).alias("_h"))
    parts = [known.filter(F.col("label") == c).orderBy("_h", "_id").limit(per_class) for c in (0, 1)]
    ids = settle(parts[0].unionByName(parts[1]), f"{name}-ids")
    half = F.pmod(F.col("_h"), F.lit(2)).cast("int").alias("half")
    own = documents.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return settle(own.join(F.broadcast(ids), "_id").select("text", F.col("label").cast("int").alias("label"), half), name)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights (bias last) by damped Newton steps."""
    centre, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    a = np.hstack([np.clip((x - centre) / scale, -8, 8), np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    v = np.ones(len(a)) if weight is None else weight

    def loss(w: np.ndarray) -> float:
        return float((v * np.logaddexp(0, -(2 * y - 1) * (a @ w))).sum() + ridge * w @ w / 2)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (v * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, a.T @ (v * (p - y)) + ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w, before, now = w - size * step, now, loss(w - size * step)
        if before - now < 1e-9 * max(1.0, now):
            break
    return centre, scale, w


def predict_logistic(model: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    centre, scale, w = model
    z = np.clip((x - centre) / scale, -8, 8) @ w[:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
