"""Packing by lexical retrieval: BM25 neighbours of a seed document fill its window."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import keep, let_go

#: Window, tokens of a shard of the inverted index, terms of a seed's query.
WINDOW, SHARD, TERMS = 4096, 1 << 20, 16
K1, B = 1.2, 0.75
#: Words a worker remembers the ids of; further ones are encoded where they are met.
REMEMBERED = 250_000
#: Bytes of text whose words, or of ids that, are counted together, and texts at most.
TOGETHER, TEXTS = 1 << 22, 2000

PIECE = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
COLUMNS = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


class Encoder:
    """Ids of texts as 16-bit integers.

    The tokenizer never joins what white space parts, nor a letter and a stop after it, and
    lower-cases; so words are looked up without case and stops, and each is encoded once while the
    memory lasts. Words to encode are joined, and parted again at the ids that end a word. Texts
    beyond Latin-1 are parted at white space only, and all but plain words encoded one by one.
    Columns of texts are parted and numbered by Arrow, so Python meets distinct words only.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary does not fit 16 bits")
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    def _encode_all(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spell(self, words: list[str]) -> dict[str, bytes]:
        out = {}
        groups = [words[k:k + 500] for k in range(0, len(words), 500)]
        for group, ids in zip(groups, self._encode_all([" ".join(g) for g in groups]), strict=True):
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(group) and cuts[-1] == len(ids):
                raw = ids.tobytes()
                for w, x, y in zip(group, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
                    out[w] = raw[2 * x:2 * y]
            else:
                out.update((w, i.tobytes()) for w, i in zip(group, self._encode_all(group), strict=True))
        return out

    def _fresh(self, words: list[str]) -> dict[str, bytes]:
        plain = [w for w in words if w.isalpha()]
        odd = [w for w in words if not w.isalpha()]
        found = self._spell(plain)
        found.update((w, i.tobytes()) for w, i in zip(odd, self._encode_all(odd), strict=True))
        return found

    @staticmethod
    def _words(texts: pa.Array) -> pa.ListArray:
        # as the tokenizer would: lower case, and a stop between a letter and a blank is a piece
        plain = pc.replace_substring_regex(pc.utf8_lower(texts), r"([a-zà-öø-ÿ])([.,;:])([ \n])", r"\1 \2\3")
        beyond = pc.match_substring_regex(texts, r"[^\x00-\x{ff}]")
        return pc.split_pattern(pc.replace_substring(pc.if_else(beyond, texts, plain), "\n", " "), " ")

    def encode(self, texts: pa.Array, end: int) -> pa.Array:
        """The ids of each text and `end` as bytes; null counts as ''."""
        words = self._words(pc.fill_null(texts.cast(pa.large_string()), ""))
        numbered = words.flatten().dictionary_encode()
        every = numbered.dictionary.to_pylist()
        raw = [*map(self.known.get, every)]
        new = [k for k, r in enumerate(raw) if r is None]
        found = self._fresh([every[k] for k in new])
        for k in new:
            raw[k] = found[every[k]]
        if len(self.known) + len(found) <= REMEMBERED:
            self.known.update(found)
        # a text's last word is followed by the end, which is a word of its own here
        pool = np.frombuffer(b"".join(raw) + np.uint16(end).tobytes(), np.uint16)
        sizes = np.array([*map(len, raw), 2], np.int64) // 2
        starts = np.cumsum(sizes) - sizes
        ends = words.offsets.to_numpy()[1:] - words.offsets[0].as_py()
        order = np.insert(numbered.indices.to_numpy().astype(np.int64), ends, len(raw))
        size = sizes[order]
        upto = np.cumsum(size)
        ids = pool[np.repeat(starts[order] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]
        offsets = 2 * np.concatenate(([0], upto[ends + np.arange(len(ends))])).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]).cast(pa.binary())


def _together(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """A batch in slices of up to TEXTS rows and, but for single rows, TOGETHER bytes of a column."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto, at = np.cumsum(size), 0
    while at < len(size):
        held = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + TOGETHER, side="right"))
        n = min(max(held - at, 1), TEXTS)
        yield batch.slice(at, n)
        at += n


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenize(docs: DataFrame, path: str, end: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): 16-bit ids of each whole text, then `end`; null counts as ''."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        try:
            for batch in batches:
                for part in _together(batch):
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), coder.encode(part.column("text"), end)], ["doc_id", "ids"])
        finally:
            let_go()

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, ids binary")


def _occurrences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id, its number there) of the ids of some documents, in this order."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    ids = np.frombuffer(column.buffers()[2], np.uint8)[at[0]:at[-1]].view(np.uint16)
    pair = (np.repeat(np.arange(len(column), dtype=np.uint32), np.diff(at) // 2) << np.uint32(16)) | ids
    pair.sort()
    first = np.flatnonzero(np.concatenate((np.ones(min(len(pair), 1), bool), pair[1:] != pair[:-1])))
    return (pair[first] >> np.uint32(16)).astype(np.int64), pair[first] & np.uint32(0xFFFF), np.diff(np.append(first, len(pair)))


def most_telling(column: pa.Array, weight: np.ndarray) -> np.ndarray:
    """Of each document the id with the largest count x weight, ties to the least; a document has an id at least."""
    doc, ids, tf = _occurrences(column)
    score = tf * weight[ids]
    best = np.maximum.reduceat(score, np.searchsorted(doc, np.arange(len(column))))
    hit = np.flatnonzero(score == best[doc])
    return ids[hit[np.searchsorted(doc[hit], np.arange(len(column)))]].astype(np.int32)


def document_frequencies(tokens: DataFrame) -> tuple[np.ndarray, int, int]:
    """Documents with each id, documents and tokens in all; the vocabulary bounds what the driver gets."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs, total = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            for part in _together(batch, "ids"):
                _, ids, tf = _occurrences(part.column("ids"))
                seen += np.bincount(ids, minlength=1 << 16)
                docs, total = docs + len(part), total + int(tf.sum())
        own = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(own, [-1, -2]).astype(np.int32)),
                                          pa.array(np.append(seen[own], [docs, total]))], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    sums = dict(zip(rows["id"], rows["n"], strict=True))
    n, total = int(sums.pop(-1, 0)), int(sums.pop(-2, 0))
    out = np.zeros(1 << 16, np.int64)
    out[np.array(list(sums), int)] = np.array(list(sums.values()), np.int64)
    return out, n, total


class Shard:
    """Inverted index of the documents' rests in one shard, with those still unused."""

    def __init__(self, rests: list[tuple[int, np.ndarray]], idf: np.ndarray, mean: float):
        self.size = np.array([len(ids) for _, ids in rests], np.int64)
        self.left = self.size.copy()
        doc = np.repeat(np.arange(len(rests)), self.size)
        ids = np.concatenate([ids for _, ids in rests]).astype(np.int64)
        pair, tf = np.unique((ids << 32) | doc, return_counts=True)
        token, self.doc = pair >> 32, (pair & 0xFFFFFFFF).astype(np.int64)
        norm = K1 * (1 - B + B * self.size[self.doc] / mean)
        self.weight = idf[token] * tf * (K1 + 1) / (tf + norm)
        bounds = np.searchsorted(token, np.arange((1 << 16) + 1))
        self.begin, self.end = bounds[:-1], bounds[1:]
        order = np.argsort(-self.weight, kind="stable")
        order = order[np.argsort(self.doc[order], kind="stable")]
        starts = np.searchsorted(self.doc[order], np.arange(len(rests)))
        self.terms = [token[order[s:s + min(TERMS, n)]] for s, n in
                      zip(starts, np.bincount(self.doc, minlength=len(rests)), strict=True)]

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused documents that share a term of the seed's query, best first, ties in order."""
        score = np.zeros(len(self.size))
        for t in self.terms[seed]:
            own = slice(self.begin[t], self.end[t])
            score[self.doc[own]] += self.weight[own]
        score[(self.left == 0)] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(docs: list[tuple[object, np.ndarray]], idf: np.ndarray, mean: float, window: int) -> Iterator[list[tuple]]:
    """Sequences of one shard, each a list of (document, start, length).

    Whole windows of a long document stand alone; its rest and the short documents are packed. The
    longest unused rest is the seed; its neighbours follow while whole ones fit, then the first that
    does not fit is cut, so a window is full. What remains when no window can be filled any more is
    laid into sequences whose lengths are powers of two.
    """
    rests = []
    for d, (_, ids) in enumerate(docs):
        whole = len(ids) // window * window
        for s in range(0, whole, window):
            yield [(d, s, window)]
        if whole < len(ids):
            rests.append((d, ids[whole:]))
    if not rests:
        return
    shard = Shard(rests, idf, mean)
    first = np.array([len(docs[d][1]) - len(r) for d, r in rests])
    left = shard.left
    order = np.argsort(-shard.size, kind="stable")
    at, total = 0, int(left.sum())
    while total:
        room = window if total >= window else 1 << (total.bit_length() - 1)
        total -= room
        while left[order[at]] == 0:
            at += 1
        seed, row = int(order[at]), []

        def take(k: int, most: int, row=row) -> int:
            n = int(min(left[k], most))
            row.append((rests[k][0], int(first[k] + shard.size[k] - left[k]), n))
            left[k] -= n
            return most - n

        room = take(seed, room)
        if room:
            near = shard.neighbours(seed)
            near = near[near != seed]
            # whole documents in order of score, as long as they fit
            for k in near.tolist():
                if room == 0:
                    break
                if left[k] <= room:
                    room = take(k, room)
            rest = iter(near.tolist())
            k = next((k for k in rest if left[k]), None)
            if room and k is not None:
                room = take(k, room)
            later = at
            while room:
                k = int(order[later])
                if left[k]:
                    room = take(k, room)
                later += 1
        yield row


def pack(docs: DataFrame, path: str, end: int = 2, window: int = WINDOW, shard: int = SHARD,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of sequences of at most `window` tokens: (doc_id, start, length, doc_tokens, sequence_id, offset, ids).

    Each document's ids, `end` included, lie in exactly one piece each; `start` counts its ids before
    the piece, `offset` those before it in the sequence; `ids` are little-endian unsigned 32-bit.
    Documents are ordered by their most telling id (largest tf x idf over all documents) and then by
    doc_id, so like ones share a shard while no id, however common, holds a shard together: shards
    are runs of at most about `shard` tokens of that order. Each shard is an inverted index of its
    own in one task. idf and mean length count all documents.

    Null and empty texts are documents of one id. A null doc_id is packed like others; repeated rows
    are packed each. Other columns are ignored.
    """
    spark = docs.sparkSession
    tokens = keep(tokenize(docs, path, end, doc_id, text))
    seen, n, total = document_frequencies(tokens)
    idf = np.log1p((n - seen + 0.5) / (seen + 0.5)).astype(np.float64)
    shared = spark.sparkContext.broadcast((idf, total / max(n, 1)))
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value[0]
        for batch in batches:
            for part in _together(batch, "ids"):
                yield part.append_column("topic", pa.array(most_telling(part.column("ids"), weight)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder.cache_clear()  # words are encoded by now, and a worker would hold them through later work
        weight, mean = shared.value
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple[object, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal sequence, held, size
            out = []
            for row in pack_shard(held, weight, mean, window):
                offset = 0
                for d, start, length in row:
                    name, ids = held[d]
                    out.append((name, start, length, len(ids), sequence, offset,
                                ids[start:start + length].astype("<u4").tobytes()))
                    offset += length
                sequence += 1
            held, size = [], 0
            yield pd.DataFrame(out, columns=COLUMNS)

        for batch in batches:
            for name, raw in zip(batch["doc_id"], batch["ids"], strict=True):
                held.append((name, np.frombuffer(raw, np.uint16)))
                size += len(raw) // 2
                if size >= shard:
                    yield from flush()
        if held:
            yield from flush()

    keyed = tokens.mapInArrow(key, f"doc_id {kind}, ids binary, topic int")
    dealt = keyed.repartitionByRange("topic", "doc_id", F.xxhash64("ids")).sortWithinPartitions("topic", "doc_id", "ids")
    return dealt.mapInPandas(run, f"doc_id {kind}, {PIECE}")
