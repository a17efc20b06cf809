"""Spelling variants: words one letter apart, by a bit-sliced index of letters by position."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import Scratch, join_groups, keep
from palisade.llm.scan import LOWER, gather, number, runs, text_chunks

#: Letters of a word and occurrences at least, and how much more often than a word its form occurs.
LETTERS, LEAST, TIMES = 6, 5, 5
#: One occurrence in TYPO loses a letter.
TYPO = 199
#: Words of up to PLAIN letters that one bit-sliced index holds; of longer ones as many fewer.
BLOCK, PLAIN = 1024, 16
#: Doublings of the chain of forms: each form is TIMES as frequent, so 2**5 steps go beyond any 64-bit count.
DOUBLINGS = 5

_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123)]] = True


# -- the words ----------------------------------------------------------------------------------

@lru_cache(maxsize=4096)
def _shift(length: int) -> np.ndarray:
    """Tables (4, 256) that move a crc32 past `length` bytes, a byte of it each: crc(a + b) is that of crc(a) ^ crc(b)."""
    zeros = bytes(length)
    bits = [zlib.crc32(zeros, 1 << k) ^ zlib.crc32(zeros) for k in range(32)]
    out = np.zeros((4, 256), np.uint32)
    for k, past in enumerate(bits):
        out[k // 8, np.arange(256) >> (k % 8) & 1 == 1] ^= np.uint32(past)
    return out


def crc_after(before: np.ndarray, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of texts joined from a first part of crc32 `before` and a second of `crc` and `length`."""
    out = crc.copy()
    order = np.argsort(length, kind="stable")
    ends = np.flatnonzero(np.diff(length[order], append=-1)) + 1
    at = 0
    for end in ends:
        own = order[at:end]
        table, own_before = _shift(int(length[own[0]])), before[own]
        for k in range(4):
            out[own] ^= table[k][(own_before >> np.uint32(8 * k)) & np.uint32(255)]
        at = end
    return out


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and U+00C0 to U+00FF, which are C3 and the byte after it."""
    inside = _ALPHA[data] | (data == 0xC3)
    inside[1:] |= data[:-1] == 0xC3
    return inside


def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) for each run of texts; words of LETTERS or more after the letters lost."""
    for batch in batches:
        names = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch["doc_id"].to_pylist()]
        for rows, data, ends in text_chunks(batch.append_column("_crc", pa.array(names, pa.uint32())), "text"):
            inside = _letters(data)
            start, end = runs(inside)
            data = LOWER[data]
            # a letter of two bytes starts with C3
            letters = np.cumsum(inside & (data != 0xC3), dtype=np.int32)
            long = letters[end - 1] - letters[start] + (data[start] != 0xC3) >= LETTERS
            start, end = start[long], end[long]
            if not len(start):
                continue
            size = end - start
            held = np.zeros(len(data), np.int8)
            held[start] = 1
            held[end] -= 1
            packed = data[np.cumsum(held, dtype=np.int8) > 0]
            offsets = np.concatenate(([0], np.cumsum(size)))
            which, _, own, own_offsets = number(packed, offsets)
            raw = own.tobytes()
            spelled = [raw[a:b] for a, b in zip(own_offsets[:-1].tolist(), own_offsets[1:].tolist(), strict=True)]
            crc = np.array([zlib.crc32(w) for w in spelled], np.uint32)
            before = rows["_crc"].to_numpy()[np.searchsorted(ends, start, side="right")]
            h = crc_after(before, crc[which], size)
            typo = h % np.uint32(TYPO) == 0
            n = np.bincount(which[~typo], minlength=len(spelled))
            some = np.flatnonzero(n)
            words = gather(own, own_offsets[some], own_offsets[some + 1] - own_offsets[some]).to_pylist()
            counts = n[some].tolist()
            for w, x in zip(which[typo].tolist(), h[typo].tolist(), strict=True):
                text = spelled[w].decode()
                at = x % len(text)
                if len(text) > LETTERS:
                    words.append(text[:at] + text[at + 1:])
                    counts.append(1)
            yield pa.record_batch({"word": pa.array(words, pa.string()), "n": pa.array(counts, pa.int64())})


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): distinct words of LETTERS letters or more that occur LEAST times or more."""
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(said, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


# -- words near each other ----------------------------------------------------------------------

class Slices:
    """For each (position, letter) the set of a block's words that have it there, as bits."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        """words: code points by position, 0 beyond the end."""
        self.lengths = lengths
        self.wide = -(-len(words) // 64) * 64
        self.alphabet, letter = np.unique(words, return_inverse=True)
        letter = letter.reshape(words.shape)
        planes = np.zeros((words.shape[1] + 2, len(self.alphabet) + 1, self.wide), bool)
        for p in range(words.shape[1]):
            planes[p, letter[:, p], np.arange(len(words))] = True
        planes[:, :len(self.alphabet)][:, self.alphabet == 0] = False  # no letter beyond the end
        self.bits = np.packbits(planes, axis=2, bitorder="little").view(np.uint64)

    def _set(self, chosen: np.ndarray) -> np.ndarray:
        out = np.zeros(self.wide, bool)
        out[:len(chosen)] = chosen
        return np.packbits(out, bitorder="little").view(np.uint64)

    def near(self, asked: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(asked, word) pairs of one replaced, inserted or deleted letter; all asked are of one length.

        After i letters of an asked word: `exact` has the words that began like it, and one set each
        those that did but for a letter replaced, for one more in the word (looked up a position
        later) and for one fewer (a position earlier).
        """
        at = np.searchsorted(self.alphabet, asked)
        at[(at == len(self.alphabet))] = 0
        at = np.where(self.alphabet[at] == asked, at, len(self.alphabet))  # the last plane is empty
        every = self._set(np.ones(len(self.lengths), bool))
        exact = np.repeat(every[None], len(asked), axis=0)
        swapped, more, fewer = (np.zeros_like(exact) for _ in range(3))
        for i in range(length):
            more |= exact  # the word's letter at i is one too many
            here = self.bits[i, at[:, i]]
            swapped = (swapped & here) | (exact & ~here)
            more &= self.bits[i + 1, at[:, i]]
            lost = self.bits[i - 1, at[:, i]] if i else np.zeros_like(here)
            fewer = (fewer & lost) | exact  # the asked letter at i is one too many
            exact &= here
        more |= exact
        found = (swapped & self._set(self.lengths == length)) | (more & self._set(self.lengths == length + 1)) \
            | (fewer & self._set(self.lengths == length - 1))
        q, block = np.nonzero(found)
        bits = np.unpackbits(found[q, block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        k, bit = np.nonzero(bits)
        return q[k], block[k] * 64 + bit


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in words])
    out = np.zeros((len(words), int(lengths.max(initial=0))), np.uint32)
    for w in np.unique(lengths):
        own = np.flatnonzero(lengths == w)
        out[own, :w] = np.frombuffer("".join(words[k] for k in own).encode("utf-32-le"), np.uint32).reshape(-1, w)
    return out, lengths


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """Near pairs of words of the same unit; a unit of two blocks compares one with the other."""
    words = rows["word"].tolist()
    points, lengths = _points(words)
    index = Slices(points, lengths)
    unit = rows.groupby(["m", "side", "key", "i", "j"], sort=False).ngroup().to_numpy()
    m, first, alone = rows["m"].to_numpy(), rows["block"].to_numpy() == rows["i"].to_numpy(), (rows["i"] == rows["j"]).to_numpy()
    out = []
    for length in np.unique(lengths):
        own = np.flatnonzero(lengths == length)
        q, w = index.near(points[own, :length], int(length))
        q = own[q]
        # a pair is of words of m and of m or m + 1 letters, in one unit, from both of its blocks, and asked for once
        ok = (unit[q] == unit[w]) & (np.minimum(lengths[q], lengths[w]) == m[q]) & np.where(alone[q], q < w, first[q] & ~first[w])
        q, w = q[ok], w[ok]
        if len(q) and (rows["side"].iloc[q] == "e").any():  # pairs of equal beginnings were found by these
            half = m[q] // 2
            fresh = np.array([s == "b" or words[a][:h] != words[b][:h]
                              for s, a, b, h in zip(rows["side"].iloc[q], q, w, half, strict=True)], bool)
            q, w = q[fresh], w[fresh]
        out.append((q, w))
    q, w = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 2
    n, word = rows["n"].to_numpy(), np.array(words, object)
    return pd.DataFrame({"word": np.append(word[q], word[w]), "near": np.append(word[w], word[q]), "near_n": np.append(n[w], n[q])})


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Small units of a partition share an index; rows are ordered by unit."""
    keys, held, size = ["m", "side", "key", "i", "j"], [], 0
    for batch in batches:
        while len(batch):
            if held and size >= BLOCK * PLAIN:
                # up to the end of the last unit held
                last = held[-1].iloc[-1]
                same = (batch[keys] == last[keys]).all(axis=1).to_numpy()
                stop = len(batch) if same.all() else int(np.argmin(same))
                if stop:
                    held.append(batch.iloc[:stop])
                    batch = batch.iloc[stop:]
                if len(batch):
                    yield _compare(pd.concat(held, ignore_index=True))
                    held, size = [], 0
                continue
            letters = np.cumsum(np.maximum(batch["m"].to_numpy(), PLAIN))
            stop = max(1, int(np.searchsorted(letters, BLOCK * PLAIN, side="right")))
            held.append(batch.iloc[:stop])
            size += int(letters[stop - 1])
            batch = batch.iloc[stop:]
    if held:
        yield _compare(pd.concat(held, ignore_index=True))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all pairs of words one inserted, deleted or replaced letter apart, both ways.

    One letter leaves the first or the second half of a pair's shorter word as it was. So each word
    goes to its beginning and its end of half its length and of half of one less; only words that
    share one meet. A beginning or end of many words is cut into blocks, and blocks meet two by two,
    so that no task holds more than a few blocks at once. Within a unit the bit-sliced index
    compares each word with all others at once.
    """
    size = F.length("word")
    placed = words.select("word", "n", F.explode(F.expr(
        "flatten(transform(array(length(word) - 1, length(word)), m -> array("
        "struct(m, 'b' AS side, left(word, m div 2) AS key), struct(m, 'e' AS side, right(word, m - m div 2) AS key))))")).alias("p"))
    placed = placed.select("word", "n", "p.*").where((F.col("m") >= LETTERS) & (size >= F.col("m")))
    crowds = keep(placed.groupBy("m", "side", "key").agg(F.count("*").alias("size")).where("size > 1"))
    placed = join_groups(placed, crowds, ["m", "side", "key"], "size").where("size is not null")
    blocks = F.ceil(F.col("size") * F.greatest(F.col("m"), F.lit(PLAIN)) / (BLOCK * PLAIN)).cast("int")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("word"), blocks).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "m", "side", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "word", "n")
    dealt = dealt.repartition("m", "side", "key", "i", "j").sortWithinPartitions("m", "side", "key", "i", "j", "block", "word")
    return dealt.mapInPandas(_units, "word string, near string, near_n long")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word, the word it is a variant of, and where that chain ends.

    Words are runs of letters up to U+00FF with A-Z lower-cased; one in TYPO, by crc32 of
    `doc_id:word`, has lost a letter. Those of LETTERS or more letters that occur LEAST times are
    compared. The form is the most frequent near word (ties: the least), if TIMES as frequent.

    Null texts have no words; a null id counts as ''. Repeated rows count each. Empty input gives no
    rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    words = scratch.write(vocabulary(docs, doc_id, text), "words")
    best = F.struct((-F.col("near_n")).alias("x"), F.col("near").alias("near"))
    found = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(best).alias("best"))
    known = words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.x") >= TIMES * F.col("n"), F.col("best.near")).alias("form"), (-F.col("best.x")).alias("form_n"))
    known = scratch.write(known.withColumn("form_n", F.when(F.col("form").isNotNull(), F.col("form_n"))), "known")
    # words without a form are their own root; each doubling follows the rest twice as far
    links = known.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        uses = links.groupBy("root").agg(F.count("*").alias("uses"))
        ahead = keep(uses.join(ahead, "root"))
        if ahead.isEmpty():
            break
        links = keep(join_groups(links, ahead, ["root"], "uses").select("word", F.coalesce("beyond", "root").alias("root")))
    result = keep(known.join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
    scratch.drop()
    return result
