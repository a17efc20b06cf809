"""Repeated passages by a logarithmic family of sampled suffix arrays.

A passage of LENGTH bytes that starts at two places is found through one of its own suffixes. Every
window of LENGTH bytes names the leftmost of its SEED-byte strings with the least hash, its anchor;
equal windows name the same anchor, so only suffixes at anchors, about one in 140, are indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import Scratch, join_groups, keep, release, row_key
from palisade.llm.hashing import U, mix, powers, prefix_sums

#: Length that counts as repeated, length of the indexed start of a suffix, windows refined as one.
LENGTH, SEED, BLOCK = 400, 128, 16
#: The same of passages that a corpus stage removes: a passage of 50 words has 250 bytes or more.
PASSAGE, PASSAGE_SEED = 240, 48
#: Bytes of a text looked at together; windows of a longer one are dealt out without overlap.
SEGMENT = 1 << 20
#: Anchors, and bytes of contexts, that a task hands on at once.
ANCHORS, HANDED = 20_000, 1 << 22

ANCHOR = "row binary, place long, low long, high long, head long, seed long, whole long"
SUFFIX = ["head", "seed", "whole"]


def anchors_of(data: bytes, length: int, seed: int) -> list[tuple]:
    """(place, low, high, head, seed, whole) for each run of windows that start in [low, high] and
    name the suffix at `place`: its first 8 bytes, the hash of its first `seed` bytes, and a hash of
    all that the windows of the run cover."""
    out = []
    span = length - seed + 1
    for base in range(0, len(data) - length + 1, SEGMENT - length + 1):
        part = data[base:base + SEGMENT]
        if len(part) < length:
            break
        sums = prefix_sums(np.frombuffer(part, np.uint8))
        n = len(part) - seed + 1
        hashes = mix((sums[seed:] - sums[:-seed]) * powers(len(sums))[0][:n])
        packed = (hashes & ~U(SEGMENT - 1)) | np.arange(n, dtype=np.uint64)
        rows = np.concatenate([packed, np.full(-n % span, 2 ** 64 - 1, np.uint64)]).reshape(-1, span)
        before = np.minimum.accumulate(rows, axis=1).ravel()
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(after[:n - span + 1], before[span - 1:n])
        low = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        high = np.append(low[1:], len(least)) - 1
        place = (least[low] & U(SEGMENT - 1)).astype(np.int64)
        view = memoryview(part)
        for p, a, b, h in zip(place.tolist(), low.tolist(), high.tolist(), hashes[place].view(np.int64).tolist(), strict=True):
            head = int.from_bytes(view[p:p + 8], "big") - (1 << 63)
            whole = xxhash.xxh3_64_intdigest(view[a:b + length], p - a) - (1 << 63)
            out.append((base + p, base + a, base + b, head, h, whole))
    return out


def anchor_table(rows: DataFrame, length: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row, body in zip(batch["row"], batch["body"], strict=True):
                found += [(row, *a) for a in anchors_of(bytes(body), length, seed)]
                if len(found) > ANCHORS:
                    yield pd.DataFrame(found, columns=["row", "place", "low", "high", *SUFFIX])
                    found = []
            yield pd.DataFrame(found, columns=["row", "place", "low", "high", *SUFFIX])

    return rows.select("row", "body").mapInPandas(run, ANCHOR)


class SuffixFamily:
    """Suffix arrays of geometrically growing sizes, as tables sorted by suffix.

    `add` merges levels of equal size, so a suffix is rewritten once a doubling, builds the array of
    a batch and merge-scans it against every level. Levels merge when a batch is to meet them, so the
    last ones do not. An entry is a distinct (first bytes, hash
    of the seed, hash of the run's cover) with its number of places; a passage with thousands of
    copies is one entry.
    """

    def __init__(self, scratch: Scratch):
        self.scratch, self.levels, self.scans, self.made = scratch, [], [], 0

    def _store(self, entries: DataFrame) -> tuple[str, DataFrame]:
        self.made += 1
        name = f"level{self.made}"
        ordered = entries.repartitionByRange(*SUFFIX).sortWithinPartitions(*SUFFIX)
        return name, self.scratch.write(ordered, name)

    def _merge(self) -> None:
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, name, rows), (_, older, before) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * size, *self._store(
                before.unionByName(rows).groupBy(*SUFFIX).agg(F.sum("places").alias("places")))))
            self.scratch.drop(older)
            self.scratch.drop(name)

    def add(self, anchors: DataFrame) -> None:
        self._merge()
        name, new = self._store(anchors.groupBy(*SUFFIX).agg(F.count("*").alias("places")))
        met = new
        if self.levels:
            starts = new.select("head", "seed").distinct()
            for _, _, old in self.levels:
                met = met.unionByName(old.join(starts, ["head", "seed"], "left_semi"))
        # long matches: a seed with two places, in the batch or between it and a level
        entries = met.groupBy(*SUFFIX).agg(F.sum("places").alias("places")) if self.levels else new
        starts = entries.groupBy("head", "seed").agg(F.sum("places").alias("n"), F.count("*").alias("forms"))
        starts = starts.where("n > 1")
        self.scans.append(self.scratch.write(
            entries.join(starts.select("head", "seed"), ["head", "seed"], "left_semi")
            .select(*SUFFIX, "places"), f"scan{self.made}"))
        self.levels.append((1, name, new))
        release(anchors.sparkSession)

    def matches(self) -> DataFrame:
        """Entries whose seed occurs elsewhere: the places of their whole run, and how many forms the seed has."""
        all_scans = self.scans[0]
        for s in self.scans[1:]:
            all_scans = all_scans.unionByName(s)
        # places only grow from scan to scan, and the last scan that met an entry counted all of them
        entries = all_scans.groupBy(*SUFFIX).agg(F.max("places").alias("places"))
        forms = entries.groupBy("head", "seed").agg(F.count("*").alias("forms"))
        return entries.join(forms, ["head", "seed"])


def _digest(view: memoryview) -> bytes:
    return xxhash.xxh3_128_digest(view)


def _contexts(rows: DataFrame, entries: DataFrame, length: int) -> DataFrame:
    """The bytes under each entry's windows: (row, place, low, high, context)."""
    wanted = entries.groupBy("row").agg(F.collect_list(F.struct("place", "low", "high")).alias("runs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, size = [], 0
            for row, body, runs in zip(batch["row"], batch["body"], batch["runs"], strict=True):
                body = bytes(body)
                for r in runs:
                    out.append((row, r["place"], r["low"], r["high"], body[r["low"]:r["high"] + length]))
                    size += len(out[-1][-1])
                    if size > HANDED:
                        yield pd.DataFrame(out, columns=["row", "place", "low", "high", "context"])
                        out, size = [], 0
            yield pd.DataFrame(out, columns=["row", "place", "low", "high", "context"])

    return rows.select("row", "body").dropDuplicates(["row"]).join(wanted, "row").mapInPandas(
        run, "row binary, place long, low long, high long, context binary")


def _blocks(contexts: DataFrame, length: int) -> DataFrame:
    """Windows by BLOCKs of their anchor's offset: (row, low, first, last, core, cover).

    `core` digests the bytes that all windows of a full block share, `cover` those that any covers.
    If a core occurs once, none of its windows is repeated; if a cover occurs twice, all are.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, place, low, high, context in zip(*(batch[c] for c in ("row", "place", "low", "high", "context")), strict=True):
                view, anchor = memoryview(bytes(context)), place - low
                for k in range((place - high) // BLOCK, (place - low) // BLOCK + 1):
                    # offsets of the anchor in its window, from and up to
                    a, b = max(k * BLOCK, place - high), min(k * BLOCK + BLOCK - 1, place - low)
                    core = view[anchor - k * BLOCK:anchor - k * BLOCK - BLOCK + 1 + length]
                    full = b - a + 1 == BLOCK
                    cover = _digest(view[anchor - b:anchor - a + length]) if full else None
                    out.append((row, low, place - b, place - a, _digest(core), cover))
            yield pd.DataFrame(out, columns=["row", "low", "first", "last", "core", "cover"])

    return contexts.mapInPandas(run, "row binary, low long, first long, last long, core binary, cover binary")


def _windows(contexts: DataFrame, blocks: DataFrame, length: int) -> DataFrame:
    """(row, start, window): a digest of each single window of `blocks`."""
    wanted = blocks.groupBy("row", "low").agg(F.collect_list(F.struct("first", "last")).alias("parts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, low, context, parts in zip(*(batch[c] for c in ("row", "low", "context", "parts")), strict=True):
                view = memoryview(bytes(context))
                for p in parts:
                    out += [(row, s, _digest(view[s - low:s - low + length])) for s in range(p["first"], p["last"] + 1)]
            yield pd.DataFrame(out, columns=["row", "start", "window"])

    return contexts.select("row", "low", "context").join(wanted, ["row", "low"]).mapInPandas(
        run, "row binary, start long, window binary")


def _twice(rows: DataFrame, key: str, name: str) -> DataFrame:
    """`rows` with a flag `name`: does their non-null `key` occur more than once?"""
    n = f"_n_{name}"
    counts = keep(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(n)).where(F.col(n) > 1))
    return join_groups(rows, counts, [key], n).withColumn(name, F.col(n).isNotNull()).drop(n)


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                   seed: int = SEED, batches: int = 4) -> DataFrame:
    """(row, spans): [start, end) byte ranges, not merged, that windows found elsewhere cover.

    The documents enter a SuffixFamily in `batches` hash-dealt batches. Runs whose whole cover is
    repeated are settled there. Where a seed has several forms, one place of each form is refined:
    blocks of windows first, then single windows of blocks that are neither all new nor all
    repeated. Each step counts 128-bit digests by partial aggregation and joins the counts back, so
    no group of copies is gathered and no pairs are made. Long and short texts alike are read whole.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(row_key(doc_id, text).alias("row"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    long_rows = rows.where(F.octet_length("body") >= length)
    anchors = scratch.write(anchor_table(long_rows, length, seed).withColumn(
        "batch", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int")), "anchors")
    family = SuffixFamily(Scratch(spark))
    for k in range(batches):
        family.add(anchors.where(F.col("batch") == k))
    matches = scratch.write(family.matches(), "matches")

    # the runs whose whole cover is repeated, and one place of each form of a seed with several
    groups = scratch.write(join_groups(anchors, matches, SUFFIX, "places").where("places is not null"), "groups")
    family.scratch.drop()
    for name in ("anchors", "matches"):
        scratch.drop(name)
    release(spark)
    settled = groups.where("places > 1").select("row", F.struct(
        F.col("low").alias("start"), (F.col("high") + length).alias("end")).alias("span"))
    forms = groups.where("forms > 1").groupBy(*SUFFIX).agg(F.min(F.struct("row", "place", "low", "high")).alias("at"))
    contexts = scratch.write(_contexts(rows, forms.select("at.*"), length), "contexts")
    release(spark)
    blocks = scratch.write(_blocks(contexts, length), "blocks")
    known = keep(_twice(_twice(blocks, "core", "maybe").where("maybe"), "cover", "all"))
    by_block = known.where("all").select("row", F.struct(
        F.col("first").alias("start"), (F.col("last") + length).alias("end")).alias("span"))
    # a settled block stands in once for its copies where another form of its core is still open
    unsettled = known.where("not all")
    standing = known.where("all").groupBy("cover").agg(F.min(F.struct("row", "low", "first", "last", "core")).alias("at"))
    standing = standing.select("at.*").join(unsettled.select("core").distinct(), "core", "left_semi")
    columns = ["row", "low", "first", "last"]
    windows = scratch.write(
        _windows(contexts, unsettled.select(*columns).unionByName(standing.select(*columns)), length), "windows")
    for name in ("contexts", "blocks"):
        scratch.drop(name)
    release(spark)
    by_window = _twice(windows, "window", "again").where("again").select("row", F.struct(
        F.col("start"), (F.col("start") + length).alias("end")).alias("span"))
    spans = keep(settled.unionByName(by_block).unionByName(by_window).groupBy("row").agg(
        F.collect_set("span").alias("spans")))
    scratch.drop()
    release(spark)
    return spans


def without(body: bytes, spans) -> tuple[int, int, int, bytes]:
    """Length of `body`, bytes and runs that `spans` (or None) cover, and what they leave."""
    if spans is None:
        return len(body), 0, 0, body
    edges = np.zeros(len(body) + 1, np.int64)
    np.add.at(edges, [s["start"] for s in spans], 1)
    np.add.at(edges, [s["end"] for s in spans], -1)
    gone = np.cumsum(edges[:-1]) > 0
    runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=np.int8(0)) == 1))
    return len(body), int(gone.sum()), runs, np.frombuffer(body, np.uint8)[~gone].tobytes()


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                   batches: int = 4) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each whole text without the bytes that a string of
    `length` bytes covers that also starts anywhere else, in this document or another.

    Strings are judged on the input; overlapping ones count. `kept` has the remaining bytes, `n_spans`
    counts maximal removed runs. Null counts as ''. Repeated rows are copies of each other, so long
    ones are removed entirely. Null ids are allowed, other columns ignored; matches never cross texts.
    """
    spans = repeated_spans(docs, doc_id, text, length, batches=batches)
    rows = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row"),
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))

    def run(batches_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches_:
            made = pd.DataFrame([without(bytes(body), own) for body, own in zip(batch["body"], batch["spans"], strict=True)],
                                columns=["n_bytes", "n_removed", "n_spans", "kept"])
            made.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield made

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.join(spans, "row", "left").select("doc_id", "body", "spans").mapInPandas(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def drop_repeats(docs: DataFrame, length: int = PASSAGE, seed: int = PASSAGE_SEED) -> DataFrame:
    """The documents with their columns; `text` without repeated passages, `n_chars` to match.

    Every copy of a passage of `length` bytes goes, the first one too, so that no text keeps what
    others share and the outcome does not depend on an order of documents. A character of which a cut leaves only some bytes goes. All rows stay, if need be with ''.
    """
    spans = repeated_spans(docs, length=length, seed=seed)

    @F.pandas_udf("string")
    def shortened(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if own is None or t is None else without(t.encode("utf-8", "surrogatepass"), own)[3].decode("utf-8", "ignore")
                          for t, own in zip(text, spans, strict=True)], dtype=object)

    found = docs.join(spans, row_key("doc_id", "text") == spans["row"], "left")
    new = found.select(*[docs[c] for c in docs.columns if c not in ("text", "n_chars")], shortened(docs["text"], spans["spans"]).alias("text"))
    return new.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
