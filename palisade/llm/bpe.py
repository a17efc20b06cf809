"""Byte-level BPE: ranked merges folded over the bytes of distinct words, and back."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encoded words a worker remembers; beyond it words are still encoded, only not remembered.
REMEMBERED = 250_000

RESULT = "n_tokens long, ids binary, decoded binary"


@lru_cache(maxsize=2)
def rank_table(path: str) -> dict[bytes, int]:
    """The literal rank map of a file of base64 pieces and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: merge the adjacent pair of least rank, leftmost first, until none has a rank."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    parts = [word[i:i + 1] for i in range(len(word))]
    beyond = len(ranks) + 1
    pairs = [ranks.get(a + b, beyond) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs:
        least = min(pairs)
        if least == beyond:
            break
        i = pairs.index(least)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i > 0:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], beyond)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], beyond)
    return [ranks[p] for p in parts]


class Codec:
    """Encoder and decoder of one worker, with the words it has met."""

    def __init__(self, path: str, pattern: str):
        self.ranks = rank_table(path)
        self.pieces = {v: k for k, v in self.ranks.items()}
        self.words = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def word_ids(self, word: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in fold(word.encode("utf-8", "surrogatepass"), self.ranks))

    def encode(self, text: str) -> bytes:
        """Ids of `text` as little-endian unsigned 32-bit integers."""
        words, known = self.words.findall(text), self.known
        for w in set(words).difference(known):
            if len(known) >= REMEMBERED:
                return self._encode_with(words)
            known[w] = self.word_ids(w)
        return b"".join(map(known.__getitem__, words))

    def _encode_with(self, words: list[str]) -> bytes:
        here = {w: self.known.get(w) or self.word_ids(w) for w in set(words)}
        return b"".join(map(here.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text",
                  digests: bool = False) -> DataFrame:
    """Encode each whole text and decode its ids: (doc_id, n_tokens, ids, decoded).

    `path` is a rank file, `pattern` splits a text into words; each distinct word is folded once a
    worker while its memory of words lasts, and again where met later. `ids` are little-endian
    unsigned 32-bit integers, `decoded` the concatenated pieces, equal to the text's UTF-8 bytes.
    With `digests`, `ids_sha256` and `decoded_sha256` (lowercase hex) stand in their place. Null and
    '' have no tokens. There is no shuffle; repeated rows give repeated results, other columns are
    ignored.
    """
    shape = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else RESULT
    names = [f.split()[0] for f in shape.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path, pattern)
        for batch in batches:
            out = []
            for t in batch["text"]:
                ids = c.encode(t) if t else b""
                back = c.decode(ids)
                if digests:
                    ids, back, n = hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), len(ids) // 4
                else:
                    n = len(ids) // 4
                out.append((n, ids, back))
            made = pd.DataFrame(out, columns=names)
            made.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield made

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInPandas(run, f"doc_id {kind}, {shape}")
