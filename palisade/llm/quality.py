"""Text quality by positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import keep
from palisade.llm.fitting import lucky, one_label, sigmoid
from palisade.llm.hashing import chunks, mix, word_hashes

#: Documents whose features the fit gets at most, hidden units, steps of the descent.
SAMPLE, HIDDEN, STEPS = 24_000, 16, 500
_PUNCTUATION = np.frombuffer(b".,;:!?'\"()-", np.uint8)
N_FEATURES = 22


def features(texts: list[str]) -> np.ndarray:
    """Shape of each whole text: lengths, letter case, signs, repetition, lines."""
    out = np.zeros((len(texts), N_FEATURES))
    for part in chunks(texts):
        own = texts[part]
        words, owner = word_hashes(own)
        bounds = np.searchsorted(owner, np.arange(len(own) + 1))
        for k, t in enumerate(own):
            w = words[bounds[k]:bounds[k + 1]]
            if not len(w):
                continue
            b = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
            hist = np.bincount(b, minlength=256)
            upper, lower, digit = hist[65:91].sum(), hist[97:123].sum(), hist[48:58].sum()
            blank = hist[:33].sum()
            point = hist[_PUNCTUATION].sum()
            sign = hist[33:127].sum() - upper - lower - digit - point
            n, size, solid = len(w), len(b), max(1, len(b) - blank)
            inside = b > 32
            step = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
            start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            length = end - start
            first = b[start]
            _, tf = np.unique(w, return_counts=True)
            pairs = mix(w[:-1] * np.uint64(3) + w[1:])
            lines = [x for x in t.split("\n") if x.strip()]
            line_ends = sum(x.rstrip()[-1] in ".!?:;\"'" for x in lines)
            same = np.count_nonzero(w[1:] == w[:-1])
            out[part.start + k] = (
                np.log1p(n), np.log1p(size), length.mean(), length.std(), upper / solid, digit / solid, sign / solid,
                point / solid, hist[33] / solid, hist[128:].sum() / solid, blank / size, len(tf) / n, tf.max() / n,
                len(np.unique(pairs)) / max(1, n - 1), same / n, np.count_nonzero((first >= 65) & (first <= 90)) / n,
                np.count_nonzero(length > 15) / n, np.count_nonzero(length == 1) / n,
                len(set(lines)) / max(1, len(lines)), line_ends / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
                (hist[124] + hist[123] + hist[60] + hist[64] + hist[47]) / solid)
    return out


class QualityModel(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.clip((x - self.mean) / self.scale, -6, 6), np.ones(len(x))])
        return sigmoid(np.column_stack([np.tanh(z @ self.inner), z]) @ self.outer)


def nonnegative_fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 9) -> QualityModel:
    """Minimise prior * R+(P) + max(0, R-(U) - prior * R-(P)) of the logistic loss by full-batch Adam.

    Where the second part falls below 0 the model fits the unlabelled texts better than the prior
    allows; then only that part is climbed back, as the non-negative estimator asks.
    """
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6
    rng = np.random.default_rng(seed)
    norm = lambda x: np.column_stack([np.clip((x - mean) / scale, -6, 6), np.ones(len(x))])
    p, u = norm(positive), norm(unlabelled)
    inner = rng.normal(0, 0.3, (p.shape[1], HIDDEN))
    outer = np.zeros(HIDDEN + p.shape[1])
    outer[-1] = np.log(prior / (1 - prior))
    moments = [np.zeros_like(inner), np.zeros_like(inner), np.zeros_like(outer), np.zeros_like(outer)]

    def gradient(z: np.ndarray, pull: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(z @ inner)
        g_outer = np.column_stack([hidden, z]).T @ pull
        return z.T @ (pull[:, None] * outer[:HIDDEN] * (1 - hidden ** 2)), g_outer

    for t in range(1, STEPS + 1):
        out_p = np.column_stack([np.tanh(p @ inner), p]) @ outer
        out_u = np.column_stack([np.tanh(u @ inner), u]) @ outer
        rest = np.logaddexp(0, out_u).mean() - prior * np.logaddexp(0, out_p).mean()
        pull_u, pull_p = sigmoid(out_u) / len(u), prior * sigmoid(out_p) / len(p)
        if rest >= 0:
            a, b = gradient(p, -prior * sigmoid(-out_p) / len(p) - pull_p), gradient(u, pull_u)
        else:
            a, b = gradient(p, pull_p), gradient(u, -pull_u)
        grads = a[0] + b[0] + 1e-4 * inner, a[1] + b[1] + 1e-4 * outer
        for i, (weights, g) in enumerate(zip((inner, outer), grads, strict=True)):
            m, v = moments[2 * i], moments[2 * i + 1]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            weights -= 0.01 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
    return QualityModel(mean, scale, inner, outer, prior)


def featured(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "x": list(features([t or "" for t in batch["text"]]))})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>")


def fit_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                label: str = "quality") -> QualityModel | None:
    """Trusted positives are the rows labelled 1; all sampled documents are the unlabelled text.

    The class prior is estimated from all of `labels`. The fit itself sees the features of SAMPLE
    documents at most, chosen by a hash of the id; labelled ones have half of them where they are
    that many. None if nothing is labelled 1.
    """
    own = keep(one_label(labels, doc_id, label))
    known, good = own.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not good:
        return None
    prior = min(0.98, max(0.02, good / known))
    n = docs.count()
    some = own.where("label = 1").where(lucky("doc_id", 0.48 * SAMPLE / good)).select("doc_id")
    few = docs.where(lucky(doc_id, max(0.48 * SAMPLE / max(n, 1), 0.48 * SAMPLE / good)))
    x = featured(few, doc_id, text)
    x = keep(x.join(some.withColumn("p", F.lit(True)), "doc_id", "left").select("x", F.coalesce("p", F.lit(False)).alias("p"), (
        lucky("doc_id", 0.48 * SAMPLE / max(n, 1))).alias("u")).where("p or u"))
    rows = x.toPandas()
    if not rows["p"].any():
        return None
    values = np.stack(rows["x"].to_numpy())
    order = np.lexsort(values.T)  # the fit must not depend on the order of rows
    values, p, u = values[order], rows["p"].to_numpy(bool)[order], rows["u"].to_numpy(bool)[order]
    return nonnegative_fit(values[p], values[u if u.any() else p], prior)


def score_quality(docs: DataFrame, model: QualityModel | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score): how likely each whole text is of good quality, 0 to 1.

    Texts without words have score 0. Without a model every other text has 0.5. Repeated rows give
    repeated results; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            x = features([t or "" for t in batch["text"]])
            score = model.score(x) if model else np.full(len(x), 0.5)
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "score": np.where(x[:, 0] > 0, score, 0.0)})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
