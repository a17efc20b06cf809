"""Toxicity by two class-conditional Kneser-Ney models with a shared backoff."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import fold_of, keep
from palisade.llm.fitting import logistic, lucky, one_label, sigmoid
from palisade.llm.hashing import U, chunks, prefix_sums, substring_hashes

#: Bytes of the longest n-gram; orders up to SHARED have one count for both classes.
ORDER, SHARED = 6, 3
DISCOUNT = 0.75
#: Labelled documents on whose likelihoods the final probability is fitted at most.
SAMPLE = 20_000
_START, _END = 1, 2


def spelled(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of some texts as marked bytes, the offsets of each, and which word stands where.

    Returns (bytes, offsets, word of each occurrence, text of each occurrence). Words are runs of
    letters, lower-cased; bytes from 128 up count as letters.
    """
    coded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    step = np.diff(letter.astype(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    text = np.searchsorted(np.cumsum([len(c) + 1 for c in coded]), start, side="right")
    _, first, word = np.unique(substring_hashes(prefix_sums(data), start, end), return_index=True, return_inverse=True)
    start, size = start[first], end[first] - start[first]
    offsets = np.concatenate(([0], np.cumsum(size + 2)))
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size + 2)
    at = np.repeat(start, size + 2) + place - 1
    out = data[np.clip(at, 0, len(data) - 1)].copy()
    out[offsets[:-1]] = _START
    out[offsets[1:] - 1] = _END
    return out, offsets, word, text


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, depth, packed) of each byte after a word's start: how many bytes of the word end there,
    and the last ORDER of them in one integer."""
    size = np.diff(offsets)
    word = np.repeat(np.arange(len(size)), size)
    depth = np.arange(len(data)) - np.repeat(offsets[:-1], size) + 1
    packed = np.zeros(len(data), np.uint64)
    for j in range(ORDER):
        own = np.concatenate((np.zeros(j, np.uint64), data[:len(data) - j].astype(np.uint64)))
        packed |= np.where(depth > j, own << U(8 * j), U(0))
    later = depth > 1
    return word[later], depth[later], packed[later]


def _last(packed: np.ndarray, n: int) -> np.ndarray:
    return packed & U((1 << (8 * n)) - 1)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first, axis=0) if len(first) else values[:0]


def _find(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Rows of `values` for what is wanted, zeros where `keys`, which are in order, do not hold it."""
    if not len(keys):
        return np.zeros((len(wanted), values.shape[1]))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], 0.0)


class KneserNey:
    """Exact counts of each order's n-grams, of their contexts, and of the different bytes that
    followed a context; columns (ordinary, toxic), or one for both classes up to SHARED.

    An n-gram is its bytes in one integer, the last in the lowest place, so ordered n-grams are
    ordered by context.
    """

    def __init__(self, keys: list[np.ndarray], counts: list[np.ndarray]):
        self.keys, self.counts = keys, counts
        self.contexts, self.followed = [], []
        for key, count in zip(keys, counts, strict=True):
            context, first = np.unique(key >> U(8), return_index=True)
            self.contexts.append(context)
            self.followed.append(np.column_stack([_sums(count, first), _sums((count > 0).astype(float), first)]))

    def packed(self) -> bytes:
        """The n-grams and counts, compressed: what a broadcast carries."""
        parts = [(np.diff(k, prepend=U(0)), c.astype(np.int64)) for k, c in zip(self.keys, self.counts, strict=True)]
        return zlib.compress(pickle.dumps(parts), 3)

    @staticmethod
    @lru_cache(maxsize=1)
    def unpacked(data: bytes) -> KneserNey:
        parts = pickle.loads(zlib.decompress(data))
        return KneserNey([np.cumsum(k, dtype=np.uint64) for k, _ in parts], [c.astype(float) for _, c in parts])

    def log_ratio(self, depth: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """log P(byte | bytes before, toxic) - log P(byte | bytes before, ordinary)."""
        # words share most of their n-grams: each is looked up once
        packed, index = np.unique(packed | (np.minimum(depth, ORDER).astype(np.uint64) << U(56)), return_inverse=True)
        depth, packed = (packed >> U(56)).astype(np.int64), _last(packed, 7)
        p = np.full((len(packed), 2), 1 / 256)
        for n in range(1, ORDER + 1):
            deep = np.flatnonzero(depth >= n)
            gram = _last(packed[deep], n)
            count = _find(self.keys[n - 1], gram, self.counts[n - 1])
            total, types = np.split(_find(self.contexts[n - 1], gram >> U(8), self.followed[n - 1]), 2, axis=1)
            known = np.maximum(total, 1)
            mixed = np.maximum(count - DISCOUNT, 0) / known + DISCOUNT * types / known * p[deep]
            p[deep] = np.where(total > 0, mixed, p[deep])
        p = p[index].T
        return np.log(p[1] + 1e-12) - np.log(p[0] + 1e-12)


def count_models(docs: DataFrame, labels: DataFrame, doc_id: str, text: str) -> KneserNey:
    """Counts over all labelled documents by Spark; a word counts once a document.

    The longest n-grams have plain counts. A shorter one counts the different bytes that preceded
    it, or plainly if it starts a word, where nothing can precede. The driver gets one row a
    distinct n-gram.
    """
    labels = labels.select(F.col("doc_id").alias("_id"), "label")
    # by shuffle at every size: what Spark broadcasts of few labels it could not of many
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(labels.hint("merge"), "_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, label = [t or "" for t in batch["text"]], batch["label"].to_numpy(int)
            for part in chunks(texts):
                data, offsets, word, text = spelled(texts[part])
                if len(offsets) < 2:
                    continue
                once = np.unique(word.astype(np.int64) * len(texts) + text)
                toxic = label[part][once % len(texts)]
                n = np.stack([np.bincount(once // len(texts), weights=(toxic == c), minlength=len(offsets) - 1) for c in (0, 1)])
                owner, depth, packed = grams(data, offsets)
                order = np.minimum(depth, ORDER)
                key, index = np.unique(packed | (order.astype(np.uint64) << U(56)), return_inverse=True)
                sums = [np.bincount(index, weights=n[c][owner]).astype(np.int64) for c in (0, 1)]
                yield pd.DataFrame({"n": (key >> U(56)).astype(np.int32), "gram": _last(key, 7).view(np.int64),
                                    "k0": sums[0], "k1": sums[1]})

    counted = rows.select("text", "label").mapInPandas(run, "n int, gram long, k0 long, k1 long")
    plain = keep(counted.groupBy("n", "gram").agg(F.sum("k0").alias("k0"), F.sum("k1").alias("k1")))
    plain = plain.withColumn("k2", F.col("k0") + F.col("k1"))
    level = plain.where(F.col("n") == ORDER)
    tables = [level]
    for n in range(ORDER - 1, 0, -1):
        # a longer n-gram that starts a word has its suffix preceded by the start mark, and so counts too
        suffix = level.select(F.col("gram").bitwiseAND(F.lit((1 << (8 * n)) - 1)).alias("gram"), "k0", "k1")
        preceded = suffix.groupBy("gram").agg(
            F.count_if(F.col("k0") > 0).alias("k0"), F.count_if(F.col("k1") > 0).alias("k1"), F.count("*").alias("k2"))
        level = preceded.unionByName(plain.where(F.col("n") == n).select("gram", "k0", "k1", "k2"))
        level = level.groupBy("gram").agg(*[F.sum(k).alias(k) for k in ("k0", "k1", "k2")])
        level = keep(level.withColumn("n", F.lit(n)))
        tables.append(level)
    every = tables[0].select("n", "gram", "k0", "k1", "k2")
    for t in tables[1:]:
        every = every.unionByName(t.select("n", "gram", "k0", "k1", "k2"))

    got = every.toPandas()
    own = [part.sort_values("gram") for part in (got[got["n"] == n] for n in range(1, ORDER + 1))]
    return KneserNey([part["gram"].to_numpy(np.int64).view(np.uint64) for part in own],
                     [part[["k2"] if n <= SHARED else ["k0", "k1"]].to_numpy(float) for n, part in enumerate(own, 1)])


def evidence(model: KneserNey, texts: list[str]) -> np.ndarray:
    """Log-likelihood ratios of each text: the mean over its words, and over its most toxic words."""
    out = np.zeros((len(texts), 7))
    for part in chunks(texts):
        data, offsets, word, text = spelled(texts[part])
        if len(offsets) < 2:
            continue
        owner, depth, packed = grams(data, offsets)
        ratio = np.bincount(owner, weights=model.log_ratio(depth, packed), minlength=len(offsets) - 1)
        # a word may be said often; once is what the models know
        size = part.stop - part.start
        once = np.unique(text.astype(np.int64) * len(ratio) + word)
        value, text = np.clip(ratio[once % len(ratio)], -12, 12), once // len(ratio)
        bounds = np.searchsorted(text, np.arange(size + 1))
        for k in range(size):
            own = np.sort(value[bounds[k]:bounds[k + 1]])[::-1]
            if len(own):
                out[part.start + k] = (own.mean(), own[0], own[:2].mean(), own[:4].mean(), own[:8].mean(),
                                       np.log1p(np.count_nonzero(own > 3)), np.log1p(len(own)))
    return out


class ToxicityModel(NamedTuple):
    language: KneserNey
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(np.column_stack([x, np.ones(len(x))]) @ self.weights)


def _evident(docs: DataFrame, model: KneserNey, doc_id: str, text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model.packed())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = KneserNey.unpacked(shared.value)
        for batch in batches:
            x = evidence(model, [t or "" for t in batch["text"]])
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "x": list(x)})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>")


def fit_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 label: str = "toxic") -> ToxicityModel | None:
    """Two Kneser-Ney models and the weights that turn their likelihood ratios into a probability.

    A fourth of the labelled ids, by crc32, is kept from the counts, so that the weights are fitted
    on likelihoods of texts the models have not seen: on SAMPLE of them at most. All other labelled
    documents are counted. None if one of the classes is missing.
    """
    own = keep(one_label(labels, doc_id, label))
    if own.select("label").distinct().count() < 2:
        return None
    # both sides of a join are filtered by their ids, so that only texts that may be needed are shuffled
    aside = lambda c: fold_of(F.concat(F.lit("t"), F.col(c).cast("string")), 4) == 0
    language = count_models(docs.where(~aside(doc_id)), own.where(~aside("doc_id")), doc_id, text)
    rest = own.where(aside("doc_id"))
    share = 0.97 * SAMPLE / max(1, rest.count())
    rest = keep(rest.where(lucky("doc_id", share)).withColumnRenamed("doc_id", "_id"))
    chosen = docs.where(aside(doc_id) & lucky(doc_id, share)).select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    chosen = chosen.join(rest.hint("merge"), "_id", "left_semi")
    rows = _evident(chosen, language, "_id", "text").join(rest, F.col("doc_id") == F.col("_id")).select("x", "label").toPandas()
    if rows["label"].nunique() < 2:
        return ToxicityModel(language, np.array([1.0, 0, 0, 0, 0, 0, 0, -1.0]))
    x, y = np.stack(rows["x"].to_numpy()), rows["label"].to_numpy(float)
    order = np.lexsort((y, *x.T))
    return ToxicityModel(language, logistic(x[order], y[order]))


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score): how likely each whole text is toxic, 0 to 1.

    Texts without words, and all texts without a model, have score 0. Repeated rows give repeated
    results; other columns are ignored.
    """
    packed = docs.sparkSession.sparkContext.broadcast(model and (model.language.packed(), model.weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = packed.value and ToxicityModel(KneserNey.unpacked(packed.value[0]), packed.value[1])
        for batch in batches:
            x = evidence(model.language, [t or "" for t in batch["text"]]) if model else np.zeros((len(batch), 7))
            score = model.score(x) if model else np.zeros(len(x))
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "score": np.where(x[:, -1] > 0, score, 0.0)})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
