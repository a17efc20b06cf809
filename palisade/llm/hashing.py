"""Vectorised hashes over bytes: many words, shingles or windows at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SPREAD = np.random.default_rng(20).integers(1, 2 ** 63, 256, dtype=np.uint64) | U(1)


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)
    return run(_BASE), run(pow(_BASE, -1, 2 ** 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    return _powers(1 << max(16, int(n).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums whose differences, times a power of the base, are the hashes of substrings."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SPREAD[data] * powers(len(data))[1][:len(data)], out=out[1:])
    return out


def substring_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[0][start] + (end - start).astype(np.uint64))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of each text and the text it is in; words stand between ASCII white space."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    inside = data > 32
    step = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    text_ends = np.cumsum([len(c) + 1 for c in coded])
    return substring_hashes(prefix_sums(data), start, end), np.searchsorted(text_ends, start, side="right")


def shingles(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of `width` words of each text: (text, hash, count), ordered.

    A text with fewer words has one shingle of all of them; one without words has none.
    """
    words, owner = word_hashes(texts)
    n = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(n) - n
    span = np.minimum(n, width)
    made = np.where(n > 0, n - span + 1, 0)
    text = np.repeat(np.arange(len(texts)), made)
    at = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(made) - made, made)
    value = mix(words[at] + U(1))
    for k in range(1, width):
        here = np.minimum(at + k, len(words) - 1)
        longer = mix(value * U(_BASE) + words[here] + U(k + 1))
        value = longer if (span[text] > k).all() else np.where(span[text] > k, longer, value)
    for a, b in zip(np.cumsum(made) - made, np.cumsum(made), strict=True):
        value[a:b].sort()
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    begin = np.flatnonzero(new)
    return text[begin], value[begin], np.diff(np.append(begin, len(text)))


def chunks(texts: list[str], limit: int = 1 << 20):
    """Slices of `texts` of about `limit` characters; a longer text is alone."""
    at = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield slice(at, k)
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield slice(at, len(texts))
