"""What the two classifiers share: bounded samples of labelled rows and a logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lucky(doc_id: str, share: float) -> Column:
    """True for about `share` of the ids, by their hash; for all if it is 1 or more."""
    if share >= 1:
        return F.lit(True)
    return F.xxhash64(F.col(doc_id).cast("string")) / F.lit(2.0 ** 64) + 0.5 < share


def one_label(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """(doc_id, label): one 0/1 label an id; of contradicting ones the larger; others are left out."""
    rows = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label"))
    return rows.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 40) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression by Newton steps; the last one is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        slope = x.T @ (y - p) - ridge * len(x) * np.append(w[:-1], 0)
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(np.append(np.full(x.shape[1] - 1, ridge * len(x)), 1e-6))
        step = np.linalg.solve(curve, slope)
        w += step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
