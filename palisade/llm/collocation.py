"""Phrases of two to four words that belong together, counted in stripes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.llm.common import Scratch, join_groups, keep
from palisade.llm.hashing import U, mix, prefix_sums, substring_hashes
from palisade.llm.scan import LOWER, gather, number, runs, text_chunks

#: Least occurrences of a phrase, words of the longest, share in percent that makes a longer phrase swallow it, results a language.
LEAST, LONGEST, SWALLOWED, TOP = 30, 4, 80, 2000
#: Bits of the sieve of frequent phrases that a scan carries: 8 MB, whatever the corpus.
SIEVE = 26
#: A word with more than this share of all words is hot, so at most its inverse are; stripes of hot words are split in PARTS.
HOT_SHARE, PARTS = 1 / 1000, 64
#: Parts of a language that are ranked apart before the last ranking.
LANES = 16

_BLANK, _BREAK = 1, 2
#: Kind of each byte: part of a word, blank, or a stop that ends a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = _BREAK

#: A stripe: `language<tab>prefix<tab>part`, and each next word with `<tab>count` if said more than once, with a blank after it.
STRIPE = "head string, body string"


class Words:
    """Words of a run of texts: their bytes with a blank after each, numbers, hashes and neighbours."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        data = LOWER[data]
        kind = _KIND[data]
        start, end = runs(kind == 0)
        self.text = np.searchsorted(ends, start, side="right")
        breaks = np.cumsum(kind == _BREAK, dtype=np.int32)[start]
        #: does the word follow the one before in the same piece? Every text ends with a break
        self.follows = np.zeros(len(start), bool)
        self.follows[1:] = breaks[1:] == breaks[:-1]
        data[end] = 32
        held = kind == 0
        held[end] = True
        self.bytes = data[held]
        size = end - start
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        self.which, first, own, offsets = number(self.bytes, np.append(self.start, len(self.bytes)))
        self.distinct = len(first)
        self.hash = substring_hashes(prefix_sums(own), offsets[:-1], offsets[1:] - 1)[self.which]

    def __len__(self) -> int:
        return len(self.which)

    def phrase_hash(self, before: np.ndarray | None, k: int) -> np.ndarray:
        """Hash of the k words from each word on, from those of the k - 1 words from it on."""
        if k == 1:
            return mix(self.hash + U(1))
        last = np.zeros(len(self), np.uint64)
        last[:len(self) - k + 1] = self.hash[k - 1:]
        return mix(before * U(0x9E3779B97F4A7C15) + last + U(k))


def _salt(hashes: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return mix(hashes ^ lang)


def _lang_hashes(langs: list[str]) -> np.ndarray:
    """Hash of each language's name."""
    raw = [s.encode("utf-8", "surrogatepass") for s in langs]
    data = np.frombuffer(b"".join(raw) + b" ", np.uint8)
    end = np.cumsum([len(r) for r in raw])
    return substring_hashes(prefix_sums(data), end - [len(r) for r in raw], end)


class Sieve:
    """Bits by hash of (language, phrase): frequent phrases always pass, others seldom."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> U(64 - SIEVE)).astype(np.int64)
        return (self.bits[at >> 6] >> (at & 63).astype(np.uint64)) & U(1) > 0

    @staticmethod
    def of(phrases: DataFrame) -> Sieve:
        """Of (lang, phrase) rows, by Spark; the driver gets 2**(SIEVE - 6) numbers at most."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lang, code = _lang_codes(batch["lang"])
                for rows, data, ends in text_chunks(batch.append_column("_code", pa.array(code)), "phrase"):
                    words = Words(data, ends)
                    _, first, count = np.unique(words.text, return_index=True, return_counts=True)
                    h = mix(words.hash[first] + U(1))
                    for k in range(2, LONGEST + 1):
                        last = words.hash[np.minimum(first + k - 1, len(words) - 1)]
                        h = np.where(count >= k, mix(h * U(0x9E3779B97F4A7C15) + last + U(k)), h)
                    h = _salt(h, _lang_hashes(lang)[rows["_code"].to_numpy()[words.text[first]]])
                    at = (h >> U(64 - SIEVE)).astype(np.int64)
                    yield pa.record_batch({"block": pa.array(at >> 6, pa.int64()), "bit": pa.array((at & 63).astype(np.int32))})

        blocks = phrases.select("lang", "phrase").mapInArrow(run, "block long, bit int").groupBy("block").agg(
            F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toPandas()
        bits = np.zeros(1 << (SIEVE - 6), np.uint64)
        bits[blocks["block"].to_numpy(np.int64)] = blocks["bits"].to_numpy(np.int64).view(np.uint64)
        return Sieve(bits)


def _lang_codes(column: pa.Array) -> tuple[list[str], np.ndarray]:
    coded = column.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]):
    """(languages, language of each word, its hash, words) of runs of texts."""
    for batch in batches:
        langs, code = _lang_codes(batch["lang"])
        for rows, data, ends in text_chunks(batch.append_column("_code", pa.array(code)), "text"):
            words = Words(data, ends)
            if len(words):
                lang = rows["_code"].to_numpy()[words.text]
                yield langs, lang, _lang_hashes(langs)[lang], words


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, phrase, n) of all words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, lang, _, words in _chunks(batches):
            key, first, n = np.unique(lang * words.distinct + words.which, return_index=True, return_counts=True)
            yield pa.record_batch({
                "lang": pa.array(langs, pa.string()).take(pa.array(key // words.distinct)),
                "phrase": gather(words.bytes, words.start[first], words.end[first] - words.start[first]),
                "n": pa.array(n.astype(np.int64))})

    return rows.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _pasted(data: np.ndarray, start: np.ndarray, length: np.ndarray, more: np.ndarray, more_start: np.ndarray, more_length: np.ndarray) -> pa.Array:
    """Strings of two pieces each, from two buffers."""
    out = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length + more_length, out=out[1:])
    starts, lengths = np.empty(2 * len(start), np.int64), np.empty(2 * len(start), np.int64)
    starts[0::2], starts[1::2], lengths[0::2], lengths[1::2] = start, more_start + len(data), length, more_length
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)
    return pa.LargeStringArray.from_buffers(
        len(start), pa.py_buffer(out), pa.py_buffer(np.concatenate([data, more])[at])).cast(pa.string())


def _joined(data: np.ndarray, start: np.ndarray, length: np.ndarray, which: np.ndarray, ends: list[str]) -> tuple:
    """(bytes, starts, lengths) of strings of `data`, each followed by one of `ends`."""
    raw = [e.encode() for e in ends]
    sizes = np.array([len(e) for e in raw], np.int64)
    made = _pasted(data, start, length, np.frombuffer(b"".join(raw), np.uint8), (np.cumsum(sizes) - sizes)[which], sizes[which])
    offsets = np.frombuffer(made.buffers()[1], np.int32)[:len(made) + 1].astype(np.int64)
    own = np.frombuffer(made.buffers()[2], np.uint8) if len(made) else np.zeros(0, np.uint8)
    return own, offsets[:-1], np.diff(offsets)


def _lines(words: Words, last: np.ndarray, n: np.ndarray, cut: np.ndarray) -> pa.Array:
    """The bodies of stripes that begin at `cut`: words `last`, their counts `n`."""
    counts, which = np.unique(n, return_inverse=True)
    data, start, length = _joined(words.bytes, words.start[last], words.end[last] - words.start[last], which,
                                  [" " if c == 1 else f"\t{c} " for c in counts.tolist()])
    offsets = np.append(start[cut], len(data) if not len(start) else start[-1] + length[-1])
    return pa.LargeStringArray.from_buffers(len(cut), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def stripes(rows: DataFrame, k: int, sieves: list[Sieve], hot: np.ndarray) -> DataFrame:
    """Stripes of phrases of k words: for each prefix of k - 1 words the next words and their counts.

    Phrases whose first or last k - 1 words no sieve holds are infrequent and left out. A stripe
    covers one run of texts; `part` splits those of prefixes of hot words by the next word.
    """
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast(([s.bits for s in sieves], hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot = shared.value
        sieves = [Sieve(b) for b in bits]
        for langs, lang, salt, words in _chunks(batches):
            if len(words) < k:
                continue
            # alive[i]: may the j words from word i on be frequent?
            h = words.phrase_hash(None, 1)
            alive = sieves[0].has(_salt(h, salt))
            warm = np.isin(_salt(h, salt), hot)
            for j in range(2, k + 1):
                both = alive[:-1] & alive[1:] & words.follows[j - 1:]
                alive = np.append(both, False)[:len(words) - j + 1]
                if j < k:
                    h = words.phrase_hash(h, j)
                    alive &= sieves[j - 1].has(_salt(h, salt)[:len(alive)])
            at = np.flatnonzero(alive)
            if not len(at):
                continue
            size = words.distinct
            prefix = lang[at] * size + words.which[at]
            split = warm[at]
            for j in range(1, k - 1):
                _, prefix = np.unique(prefix, return_inverse=True)
                prefix = prefix * size + words.which[at + j]
                split = split & warm[at + j]
            _, prefix = np.unique(prefix, return_inverse=True)
            key, first, n = np.unique(prefix * size + words.which[at + k - 1], return_index=True, return_counts=True)
            prefix, place = key // size, at[first]
            last = place + k - 1
            part = np.where(split[first], (mix(words.hash[last]) % U(PARTS)).astype(np.int64), 0)
            if part.any():
                order = np.lexsort((part, prefix))
                prefix, place, last, part, n = prefix[order], place[order], last[order], part[order], n[order]
            cut = np.flatnonzero(np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1]))))
            head = place[cut]
            size = words.end[head + k - 2] - words.start[head]
            first = _joined(words.bytes, words.start[head], size, part[cut], [f"\t{p}" for p in range(PARTS)])
            names = [f"{name}\t".encode("utf-8", "surrogatepass") for name in langs]
            long = np.array([len(x) for x in names])
            front = lang[head]
            yield pa.record_batch({
                "head": _pasted(np.frombuffer(b"".join(names), np.uint8), (np.cumsum(long) - long)[front], long[front], *first),
                "body": _lines(words, last, n, cut)})

    return rows.mapInArrow(run, STRIPE)


def merged(found: DataFrame, least: int) -> DataFrame:
    """(lang, prefix, next, phrase, n): stripes added element by element, entries of `least` or more.

    Stripes travel whole to their head; there they are added entry by entry by a hash aggregate,
    which spills, so no stripe is held in one piece.
    """
    entries = found.repartition("head").select("head", F.explode(F.split("body", " ")).alias("e")).where("e <> ''")
    many = F.instr("e", "\t") > 0
    sums = entries.groupBy("head", F.when(many, F.substring_index("e", "\t", 1)).otherwise(F.col("e")).alias("next")).agg(
        F.sum(F.when(many, F.substring_index("e", "\t", -1).cast("bigint")).otherwise(F.lit(1))).alias("n"))
    tail = F.substring_index("head", "\t", -2)
    prefix = F.substring_index(tail, "\t", 1)
    return sums.where(F.col("n") >= least).select(
        F.expr("left(head, length(head) - length(substring_index(head, '\t', -2)) - 1)").alias("lang"), prefix.alias("prefix"), "next",
        F.concat_ws(" ", prefix, "next").alias("phrase"), "n")


def _tail(phrase: str) -> Column:
    """A phrase without its first word."""
    return F.expr(f"substring({phrase}, instr({phrase}, ' ') + 1)")


def _swallowed(shorter: DataFrame, longer: DataFrame) -> DataFrame:
    """`shorter` with whether its most frequent extension by a word is nearly as frequent.

    The right extension is the greatest entry of the phrase's own stripe, the left one that of the
    stripes it ends. A phrase that some longer one swallows is swallowed by an extension by one
    word too, which is at least as frequent.
    """
    grown = longer.select("lang", F.explode(F.array("prefix", _tail("phrase"))).alias("phrase"), F.col("n").alias("most"))
    most = grown.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    return shorter.join(most, ["lang", "phrase"], "left").withColumn(
        "swallowed", F.coalesce(F.col("most").cast("decimal(20,0)") * 100 >= F.col("n").cast("decimal(20,0)") * SWALLOWED, F.lit(False)))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of two to four words.

    Words are runs of other bytes than blanks and tabs in pieces between `.,;:!?` and line ends,
    with A-Z lower-cased. `n` counts the language's words, `a` the phrase, `l` and `r` the parts of
    its weakest cut; the score is floor(2000000 a / (l + r)). Phrases that occur in a longer one at
    least SWALLOWED percent as often, as they do themselves, are dropped.

    One scan for each length. A scan counts only phrases whose beginning and end passed before,
    which it learns from sieves of fixed size: what passes by accident is counted as well and falls
    below `least`. Counts cover all texts and are exact.

    Null texts are empty; a null language is `und`. Empty input gives no rows, repeated rows count
    each, ids are not looked at, other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    words = scratch.write(word_counts(rows), "words")
    totals = keep(words.groupBy("lang").agg(F.sum("n").alias("total")))
    every = totals.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()["n"]
    counts = [scratch.write(words.where(F.col("n") >= least), "frequent1")]
    hot = np.unique(_hot_hashes(counts[0].where(F.col("n") > max(1000, int(every * HOT_SHARE)))))
    sieves: list[Sieve] = []
    for k in range(2, LONGEST + 1):
        sieves.append(Sieve.of(counts[-1]))
        counts.append(scratch.write(merged(stripes(rows, k, sieves, hot), least), f"frequent{k}"))

    found = []
    for k in range(2, LONGEST + 1):
        own = counts[k - 1].select("lang", "phrase", "n")
        own = _swallowed(own, counts[k]).where("not swallowed") if k < LONGEST else own
        # a cut after each word but the last
        word = F.split("phrase", " ")
        cuts = own.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.transform(
            F.sequence(F.lit(1), F.lit(k - 1)), lambda j: F.struct(
                j.alias("k"), F.array_join(F.slice(word, F.lit(1), j), " ").alias("first"),
                F.array_join(F.slice(word, j + 1, F.lit(k) - j), " ").alias("rest")))).alias("cut"))
        found.append(cuts.select("lang", "phrase", "a", "cut.*"))
    cuts = scratch.write(found[0].unionByName(found[1]).unionByName(found[2]), "cuts")
    sums = counts[0].select("lang", "phrase", "n")
    for c in counts[1:-1]:
        sums = sums.unionByName(c.select("lang", "phrase", "n"))
    for side, name in (("first", "l"), ("rest", "r")):
        uses = cuts.groupBy("lang", side).agg(F.count("*").alias("uses"))
        known = keep(uses.join(sums.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side]))
        cuts = scratch.write(join_groups(cuts, known, ["lang", side], "uses").drop("uses"), f"cuts_{side}")
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    ranked = weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    lane = F.pmod(F.xxhash64("phrase"), F.lit(LANES))
    few = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", lane).orderBy(*best))).where(F.col("rank") <= top)
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    result = keep(few.join(F.broadcast(totals) if totals.count() < 10_000 else totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score"))
    scratch.drop()
    return result


def _hot_hashes(words: DataFrame) -> np.ndarray:
    """Hashes of at most 1 / HOT_SHARE words."""
    rows = words.select("lang", "phrase").toPandas()
    if not len(rows):
        return np.zeros(0, np.uint64)
    data = ("\n".join(rows["phrase"]) + "\n").encode("utf-8", "surrogatepass")
    own = Words(np.frombuffer(data, np.uint8), np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1)
    return _salt(mix(own.hash + U(1)), _lang_hashes(rows["lang"].tolist()))
