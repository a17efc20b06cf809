"""Language identification with hyperdimensional trigram profiles."""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import let_go

#: Width of a hypervector, symbols of the alphabet (0 is whatever is no letter), order of the n-grams.
WIDTH, SYMBOLS, ORDER, SEED = 1024, 40, 3, 8
#: A training document adds this much in all, shared among its trigrams, so that sums are whole numbers.
UNIT = 1_000_000


#: Texts that a task holds as Python strings at once.
ROWS = 500


@lru_cache(maxsize=1)
def alphabet() -> np.ndarray:
    """Symbol of each code point: a-z have one each, other letters share the rest by a hash."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        if unicodedata.category(chr(cp))[0] == "L":
            out[cp] = 27 + (cp * 2654435761 >> 9) % (SYMBOLS - 27)
    out[97:123] = np.arange(1, 27)
    out[65:91] = np.arange(1, 27)
    return out


def letter_vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random +-1 vectors of the letters, permuted by each place of a trigram."""
    letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, WIDTH))
    return np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters


@lru_cache(maxsize=1)
def ngram_vectors() -> np.ndarray:
    """A row a trigram: the product of its letters' vectors. For tasks; the driver binds a few at a time."""
    first, second, third = letter_vectors()
    bound = first[:, None, None, :] * second[None, :, None, :] * third[None, None, :, :]
    return bound.reshape(SYMBOLS ** ORDER, WIDTH)


def bundle(grams: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weighted sum of trigram vectors, in bounded memory."""
    first, second, third = letter_vectors()
    out = np.zeros(WIDTH)
    for at in range(0, len(grams), 2048):
        g = grams[at:at + 2048]
        bound = first[g // SYMBOLS ** 2] * second[g // SYMBOLS % SYMBOLS] * third[g % SYMBOLS]
        out += weights[at:at + 2048] @ bound.astype(np.float64)
    return out


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of the whole text and their counts; runs of other signs are one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = alphabet()[points]
    if not codes.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.concatenate(([0], codes[(codes != 0) | np.concatenate(([False], codes[:-1] != 0))], [0])).astype(np.int64)
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
    grams = (codes[:-2] * SYMBOLS + codes[1:-1]) * SYMBOLS + codes[2:]
    counts = np.bincount(grams, minlength=0)
    seen = np.flatnonzero(counts)
    return seen, counts[seen]


def fit_profiles(docs: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """One bundled vector a language over all of `docs` with a language and a letter.

    Trigram weights are summed by Spark as whole numbers, so the result does not depend on the
    order of rows; the driver gets languages x 64,000 sums at most, and bundles them.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(SYMBOLS ** ORDER, np.int64))
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                for name, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    grams, counts = trigrams(t)
                    if len(grams):
                        sums[name][grams] += counts * UNIT // counts.sum()
        for name, total in sums.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen.astype(np.int32)),
                                              pa.array(total[seen])], ["lang", "gram", "weight"])

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    sums = rows.mapInArrow(count, "lang string, gram int, weight long").groupBy("lang", "gram").agg(
        F.sum("weight").alias("weight")).toPandas()
    names = sorted(sums["lang"].unique())
    vectors = np.zeros((len(names), WIDTH))
    for k, name in enumerate(names):
        own = sums[sums["lang"] == name]
        vectors[k] = bundle(own["gram"].to_numpy(np.int64), own["weight"].to_numpy(float))
        vectors[k] /= np.linalg.norm(vectors[k]) or 1.0
    return names, vectors.astype(np.float32)


def nearest(text: str | None, model: tuple[list[str], np.ndarray]) -> tuple[str, float]:
    """The language whose prototype has the largest cosine with a text, and that cosine."""
    names, prototypes = model
    grams, counts = trigrams(text) if text and names else ((), ())
    if not len(grams):
        return "und", 0.0
    own = np.zeros(WIDTH, np.float32)
    for at in range(0, len(grams), 2048):
        own += counts[at:at + 2048].astype(np.float32) @ ngram_vectors()[grams[at:at + 2048]].astype(np.float32)
    near = prototypes @ (own / (np.linalg.norm(own) or 1.0))
    k = int(near.argmax())
    return names[k], float(min(1.0, max(0.0, near[k])))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the language whose prototype has the largest cosine, and that cosine.

    Every whole text counts. Null, empty and letterless texts, and all texts if no language was
    learned, are 'und' with score 0. Ties go to the first name. Negative cosines score 0. Other
    columns are ignored; repeated rows give repeated results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [nearest(t, shared.value) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "lang_pred": [name for name, _ in found],
                                "score": [score for _, score in found]})

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInPandas(run, f"doc_id {kind}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float = 0.02) -> DataFrame:
    """Documents in a recognised language: not 'und', and a cosine of `least` or more.

    Each row is judged where it lies, by its own text, so neither null nor repeated ids matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for whole in batches:
                for at in range(0, len(whole), ROWS):  # so that few texts are Python strings at once
                    batch = whole.slice(at, ROWS)
                    found = [nearest(t, shared.value) for t in batch.column("text").to_pylist()]
                    yield batch.filter(pa.array([name != "und" and score >= least for name, score in found], pa.bool_()))
        finally:
            ngram_vectors.cache_clear()  # 65 MB that a worker would hold through all later stages
            let_go()

    return docs.mapInArrow(run, docs.schema)
