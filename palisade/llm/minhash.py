"""Near duplicates with DartMinHash signatures, banded joining and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import join_groups, keep, release, row_key
from palisade.llm.hashing import U, chunks, mix, shingles
from palisade.operators.components import connected_components

#: Signature length and rows a band: 32 bands of 5 miss a pair of similarity 0.8 about three times in a million.
COORDINATES, BAND = 160, 5
#: Rank height of the lowest cells; each further cell doubles what lies below it.
LOWEST = 2.0 ** -7
#: Members of a bucket that one unit of comparison holds, of sets of up to ELEMENTS shingles; of larger ones fewer.
BLOCK, ELEMENTS = 512, 4096
#: Texts that a task lower-cases, and rows that it hands on, at once.
ROWS = 500
#: Columns of a member of a unit.
UNIT_SCHEMA = ("bucket long, vb int, qb int, kind int, band int, doc long, class long, largest long, mark binary, "
               "earlier array<bigint>")
UNIT = [c.split()[0] for c in UNIT_SCHEMA.split(", ")]


@lru_cache(maxsize=64)
def _poisson(mean: float) -> np.ndarray:
    """Distribution function of a Poisson count, as far as a double can tell it from 1."""
    k = np.arange(int(mean + 12 * math.sqrt(mean) + 30))
    logs = k * math.log(mean) - mean - np.array([math.lgamma(x + 1) for x in k])
    return np.cumsum(np.exp(logs))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> U(11)).astype(np.float64) * 2.0 ** -53


def _throw(element: np.ndarray, column: int, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Darts in one cell of each element's (weight, rank) plane: their element's index, id, weight and rank.

    Column 0 covers weights [0, 1) and column c [2^(c-1), 2^c), rows likewise in ranks with LOWEST
    for 1. Number and places depend on the element and cell alone, so equal elements of different
    documents have the same darts.
    """
    left, wide = (0.0, 1.0) if column == 0 else (2.0 ** (column - 1), 2.0 ** (column - 1))
    low, high = (0.0, LOWEST) if row == 0 else (LOWEST * 2.0 ** (row - 1), LOWEST * 2.0 ** (row - 1))
    seed = mix(element ^ mix(np.array([column * 64 + row + 1], np.uint64)))
    count = np.searchsorted(_poisson(COORDINATES * wide * high), _unit(seed), side="right")
    index = np.repeat(np.arange(len(element)), count)
    nth = np.arange(len(index)) - np.repeat(np.cumsum(count) - count, count)
    dart = mix(seed[index] + (nth.astype(np.uint64) + U(1)) * U(0xD1B54A32D192ED03))
    weight, rank = mix(dart ^ U(0x5851F42D4C957F2D)), mix(dart ^ U(0x14057B7EF767814F))
    return index, dart, left + wide * _unit(weight), low + high * _unit(rank)


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int) -> np.ndarray:
    """DartMinHash: for each text and coordinate the id of its earliest dart; (n_texts, COORDINATES).

    Two weighted sets agree on a coordinate with a probability of their weighted Jaccard similarity.
    Only darts below a rank that likely fills all coordinates are looked at; texts with a coordinate
    still empty are thrown again with twice that rank. Texts without elements keep zeros.
    """
    out = np.zeros((n_texts, COORDINATES), np.uint64)
    total = np.bincount(text, weights=weight, minlength=n_texts)
    reach = np.full(n_texts, math.log(COORDINATES) + 3.0)
    todo = total > 0
    while todo.any():
        limit = np.where(todo, reach / np.maximum(total, 1e-300), 0.0)
        parts = []
        column, base = 0, 0.0
        while (some := np.flatnonzero(todo[text] & (weight > base))).size:
            row, floor = 0, 0.0
            while (own := some[limit[text[some]] > floor]).size:
                index, dart, w, rank = _throw(element[own], column, row)
                index = own[index]
                ok = (w < weight[index]) & (rank < limit[text[index]])
                parts.append((text[index[ok]], dart[ok], rank[ok]))
                floor = LOWEST * 2.0 ** row
                row += 1
            base = 2.0 ** column
            column += 1
        owner, dart, rank = (np.concatenate(x) for x in zip(*parts, strict=True))
        slot = owner * COORDINATES + (mix(dart ^ U(0x2545F4914F6CDD1D)) % U(COORDINATES)).astype(np.int64)
        earliest = np.full(out.size, np.inf)
        np.minimum.at(earliest, slot, rank)
        won = rank == earliest[slot]
        out.reshape(-1)[slot[won]] = dart[won]
        filled = np.isfinite(earliest).reshape(n_texts, COORDINATES).sum(axis=1)
        todo &= filled < COORDINATES
        out[todo] = 0
        reach[todo] *= 2
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(len(signature), -1, BAND)
    key = np.zeros(rows.shape[:2], np.uint64)
    for k in range(BAND):
        key = mix(key * U(0x9E3779B97F4A7C15) + rows[:, :, k])
    return mix(key + np.arange(key.shape[1], dtype=np.uint64)).view(np.int64)


def _weights(counts: np.ndarray, counted: bool) -> np.ndarray:
    return counts.astype(np.float64) if counted else np.ones(len(counts))


def _few(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of ROWS rows at most, so that few texts are held twice and few results at once."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.iloc[at:at + ROWS]


def _sign(docs: DataFrame, width: int, counted: bool) -> DataFrame:
    """(row, doc_id, set_key, bulk, bands, mark): a digest of the shingle set and its size, the band keys, a byte of
    each coordinate; null where there are no words."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _few(batches):
            texts = [t.lower() if t else "" for t in batch["text"]]
            digests, bulk, bands, marks = [], [], [], []
            for part in chunks(texts):
                own = texts[part]
                text, element, count = shingles(own, width)
                w = _weights(count, counted)
                signature = signatures(text, element, w, len(own))
                keys, short = band_keys(signature), signature.astype(np.uint8)
                ends = np.searchsorted(text, np.arange(len(own) + 1))
                for k in range(len(own)):
                    a, b = ends[k], ends[k + 1]
                    digests.append(xxhash.xxh3_128_digest(
                        element[a:b].tobytes() + w[a:b].tobytes()) if b > a else None)
                    bulk.append(b - a)
                    bands.append(keys[k] if b > a else None)
                    marks.append(short[k].tobytes() if b > a else None)
            yield pd.DataFrame({"row": batch["row"].to_numpy(), "name": batch["name"].to_numpy(), "set_key": digests, "bulk": bulk,
                                "bands": bands, "mark": marks})

    # as text, since pandas would round large ids beside nulls
    signed = docs.select("row", F.col("doc_id").cast("string").alias("name"), "text").mapInPandas(
        run, "row binary, name string, set_key binary, bulk long, bands array<bigint>, mark binary")
    return signed.withColumn("doc_id", F.col("name").cast(docs.schema["doc_id"].dataType)).drop("name")


def _sets(docs: DataFrame, width: int, counted: bool) -> DataFrame:
    """(doc, elements, weights) of (doc, text): the ordered 32-bit shingle hashes as bytes, and weights where they are counts.

    Half the bytes of 64-bit ones to shuffle; two of n shingles share one with a chance of n * n / 2**33.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _few(batches):
            texts = [t.lower() if t else "" for t in batch["text"]]
            rows = []
            for part in chunks(texts):
                text, element, count = shingles(texts[part], width)
                ends = np.searchsorted(text, np.arange(part.stop - part.start + 1))
                short = (element >> U(32)).astype(np.uint32)
                for a, b in zip(ends, ends[1:], strict=False):
                    own = short[a:b]
                    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if b > a else np.zeros(0, np.int64)
                    tf = np.add.reduceat(count[a:b], first).astype(np.uint32).tobytes() if counted and b > a else None
                    rows.append((own[first].tobytes(), tf))
            made = pd.DataFrame(rows, columns=["elements", "weights"])
            made.insert(0, "doc", batch["doc"].to_numpy())
            yield made

    return docs.select("doc", "text").mapInPandas(run, "doc long, elements binary, weights binary")


def _similarity(xe: bytes, ye: bytes, xw: bytes | None, yw: bytes | None) -> float:
    x, y = np.frombuffer(xe, np.uint32), np.frombuffer(ye, np.uint32)
    if xw is None:
        common = len(np.intersect1d(x, y, assume_unique=True))
        return common / (len(x) + len(y) - common)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    a, b = np.frombuffer(xw, np.uint32), np.frombuffer(yw, np.uint32)
    common = int(np.minimum(a[i], b[j]).sum())
    return common / (int(a.sum()) + int(b.sum()) - common)


def _verify(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (doc, center) whose exact similarity is `least` or more."""
    own = sets.select("doc", F.col("elements").alias("xe"), F.col("weights").alias("xw"))
    other = sets.select(F.col("doc").alias("center"), F.col("elements").alias("ye"), F.col("weights").alias("yw"))
    both = pairs.join(own, "doc").join(other, "center")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [_similarity(*v) >= least for v in zip(b["xe"], b["ye"], b["xw"], b["yw"], strict=True)]
            yield b.loc[ok, ["doc", "center"]]

    return both.select("doc", "center", "xe", "ye", "xw", "yw").mapInPandas(run, "doc long, center long")


class Linker:
    """Classes of shingle sets that grow as members of shared buckets are compared exactly.

    A set has a number of its own (`doc`); ids of documents play no part.
    """

    def __init__(self, documents: DataFrame, marks: DataFrame, sets: DataFrame, least: float):
        self.documents, self.marks, self.sets, self.least = documents, marks, sets, least
        self.classes = documents.select("doc", F.col("doc").alias("class"))

    def link(self, found: DataFrame) -> None:
        """Merge the classes of (doc, center) pairs that are similar enough."""
        found = keep(found)
        if found.isEmpty():
            return
        # a star of each class stands for the links so far
        stars = self.classes.where(F.col("doc") != F.col("class")).select("doc", F.col("class").alias("center"))
        links = found.unionByName(stars)
        merged = connected_components(
            self.documents.select(F.col("doc").alias("id")),
            links.select(F.col("doc").alias("src"), F.col("center").alias("dst")))
        self.classes = keep(merged.select(F.col("id").alias("doc"), F.col("component").alias("class")))
        release(self.classes.sparkSession)

    def stars(self, members: DataFrame) -> None:
        """Compare each bucket's members with its least; the bands of a group mostly agree on that one."""
        centers = keep(members.groupBy("bucket").agg(F.min("doc").alias("center"), F.count("*").alias("n")))
        pairs = join_groups(members.select("bucket", "doc"), centers, ["bucket"], "n").where("doc <> center")
        # kept, so that no task runs both comparisons at once, each in a Python worker of its own
        near = keep(_hopeful(pairs.select("doc", "center").distinct(), self.marks, _bar(self.least)))
        self.link(_verify(near, self.sets, self.least))

    def across(self, members: DataFrame) -> None:
        """Compare all pairs of a bucket's members that are of different classes and may be similar enough.

        Where a bucket holds several classes, the members outside its largest meet all others in
        blocks of BLOCK by BLOCK, so that a crowded bucket is many units of work. A unit first looks
        at signatures and keeps the members that agree with another on a share within four standard
        deviations of `least`, for each pair in the first band it shares by its whole key, for which
        rows carry the keys of the bands before theirs; what it leaves out has a chance of three in a
        hundred thousand to be similar enough after all. The members kept then bring their sets,
        once a unit, are compared there exactly, and only links that join two classes leave the
        unit: fewer than it has members, however many pairs it looked at.
        """
        placed = members.select("bucket", "band", "bulk", "doc").join(self.classes, "doc")
        sizes = placed.groupBy("bucket", "class").agg(F.count("*").alias("n"), F.sum("bulk").alias("bulk"))
        live = sizes.groupBy("bucket").agg(
            F.count("*").alias("classes"), F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("bulk").alias("all_bulk"),
            F.max(F.struct("n", "class"))["class"].alias("largest")).where("classes > 1")
        rows = join_groups(placed, keep(live), ["bucket"], "n").where("n is not null").join(self.marks, "doc")
        rows = rows.withColumn("earlier", F.slice("bands", 1, F.col("band"))).drop("bands")
        # as many blocks as members need, and more where sets are large
        grain = F.greatest(F.lit(1.0), F.col("all_bulk") / F.col("n") / ELEMENTS)
        blocks = lambda c: F.ceil(c * grain / BLOCK).cast("int")
        rows = rows.withColumns({"vs": blocks(F.col("n")), "qs": blocks(F.col("n") - F.col("most"))})
        everyone = rows.select("*", F.lit(0).alias("kind"), F.pmod(F.xxhash64("doc"), F.col("vs")).cast("int").alias("vb"),
                               F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qb"))
        asking = rows.where(F.col("class") != F.col("largest")).select(
            "*", F.lit(1).alias("kind"), F.explode(F.sequence(F.lit(0), F.col("vs") - 1)).alias("vb"),
            F.pmod(F.xxhash64("doc"), F.col("qs")).cast("int").alias("qb"))
        order = ["bucket", "vb", "qb", "kind", "doc"]
        dealt = everyone.select(*UNIT).unionByName(asking.select(*UNIT)).repartition("bucket", "vb", "qb").sortWithinPartitions(*order)
        bar = _bar(self.least)
        hopeful = keep(dealt.mapInPandas(_hopeful_members(bar), UNIT_SCHEMA))
        release(hopeful.sparkSession)
        brought = hopeful.join(self.sets, "doc").select(*UNIT, "elements", "weights")
        brought = brought.repartition("bucket", "vb", "qb").sortWithinPartitions(*order)
        self.link(brought.mapInPandas(_unit_links(bar, self.least), "doc long, center long"))


def _bar(least: float) -> float:
    """Agreeing coordinates that a pair of similarity `least` has but for four standard deviations."""
    return COORDINATES * (least - 4 * math.sqrt(least * (1 - least) / COORDINATES))


def _hopeful(pairs: DataFrame, marks: DataFrame, bar: float) -> DataFrame:
    """Pairs whose signatures agree on `bar` coordinates or more."""
    own, other = (marks.select(F.col("doc").alias(a), F.col("mark").alias(b)) for a, b in (("doc", "x"), ("center", "y")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, y = (np.frombuffer(b"".join(b[c]), np.uint8).reshape(len(b), -1) for c in ("x", "y"))
                yield b.loc[(x == y).sum(axis=1) >= bar, ["doc", "center"]]

    return pairs.join(own, "doc").join(other, "center").select("doc", "center", "x", "y").mapInPandas(
        run, "doc long, center long")


class _Side:
    """Rows of one side of a unit as arrays."""

    def __init__(self, rows: pd.DataFrame):
        self.rows = rows
        self.marks = np.frombuffer(b"".join(rows["mark"]), np.uint8).reshape(len(rows), COORDINATES)
        self.earlier = np.stack(rows["earlier"].to_numpy())
        self.classes = rows["class"].to_numpy(object)

    def hopeful(self, asking: _Side, k: int, bar: float) -> np.ndarray:
        """Members that row `k` of the other side may be similar to and first meets here."""
        mine, largest = asking.classes[k], asking.rows["largest"].iloc[k]
        ok = (self.marks == asking.marks[k]).sum(axis=1) >= bar
        at = np.flatnonzero(ok)
        if not len(at):
            return at
        # of two members that both ask, the one with the smaller class does
        own = self.classes[at]
        at = at[(own != mine) & ((own == largest) | (own > mine))]
        return at[~(self.earlier[at] == asking.earlier[k]).any(axis=1)]


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[_Side, pd.DataFrame, bool]]:
    """(members, some that ask, are these the last of the unit?) of the units of a partition ordered by unit."""
    unit, members, side, waiting = None, None, None, None
    for batch in batches:
        keys = batch[["bucket", "vb", "qb", "kind"]].to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1), [True]))) if len(batch) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            at, part = tuple(keys[a, :3]), batch.iloc[a:b]
            if at != unit and waiting is not None:
                yield side, waiting, True
                waiting = None
            if keys[a, 3] == 0:
                members = part if at != unit else pd.concat([members, part])
                unit, side = at, None
            elif at == unit:  # else nobody to ask
                if waiting is not None:
                    yield side, waiting, False
                side = side or _Side(members)
                waiting = part
    if waiting is not None:
        yield side, waiting, True


def _hopeful_members(bar: float):
    """Rows of a unit that have a hopeful partner in it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met = None
        for side, part, last in _units(batches):
            asking = _Side(part)
            met = np.zeros(len(side.rows), bool) if met is None else met
            asks = np.zeros(len(part), bool)
            for k in range(len(part)):
                found = side.hopeful(asking, k, bar)
                asks[k] = len(found) > 0
                met[found] = True
            if asks.any():
                yield part[asks][UNIT]
            if last:
                if met.any():
                    yield side.rows[met][UNIT]
                met = None

    return run


class _Sets:
    """Element sets of some rows, to be compared with one at a time."""

    def __init__(self, rows: pd.DataFrame):
        self.parts = [np.frombuffer(e, np.uint32) for e in rows["elements"]]
        self.weights = [None if w is None else np.frombuffer(w, np.uint32).astype(np.int64) for w in rows["weights"]]
        self.total = np.array([len(e) if w is None else w.sum() for e, w in zip(self.parts, self.weights, strict=True)], np.int64)

    def similarity(self, at: np.ndarray, other: _Sets, k: int) -> np.ndarray:
        """Similarity of rows `at` with row `k` of other sets."""
        mine, own = other.parts[k], [self.parts[i] for i in at]
        sizes = np.array([len(e) for e in own])
        every = np.concatenate(own)
        place = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
        same = mine[place] == every
        if other.weights[k] is not None:
            same = np.where(same, np.minimum(other.weights[k][place], np.concatenate([self.weights[i] for i in at])), 0)
        common = np.add.reduceat(same.astype(np.int64), np.cumsum(sizes) - sizes)
        return common / (self.total[at] + other.total[k] - common)


def _unit_links(bar: float, least: float):
    """Exact links of a unit that join two of its classes: a spanning forest of all of them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}
        sets = None

        def root(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = parent.get(up, up)
                c = up
            return c

        for side, part, last in _units(batches):
            asking = _Side(part)
            sets = sets or _Sets(side.rows)
            own, doc, links = _Sets(part), side.rows["doc"].to_numpy(object), []
            for k, (name, mine) in enumerate(zip(part["doc"], part["class"], strict=True)):
                found = side.hopeful(asking, k, bar)
                found = found[[root(side.classes[i]) != root(mine) for i in found]] if len(found) else found
                if not len(found):
                    continue
                for i in found[sets.similarity(found, own, k) >= least]:
                    x, y = root(side.classes[i]), root(mine)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        links.append((doc[i], name))
            yield pd.DataFrame(links, columns=["doc", "center"])
            if last:
                parent, sets = {}, None

    return run


def _classes(docs: DataFrame, doc_id: str, text: str, width: int, least: float, counted: bool) -> tuple[DataFrame, DataFrame]:
    """(signed rows, sets): rows (row, doc_id, set_key), and for each set (set_key, copies, class) with the class's
    size, its least id `class_id` and the row `stays` that stands for it."""
    rows = docs.select(row_key(doc_id, text).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = keep(_sign(rows, width, counted))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    distinct = keep(signed.where("set_key is not null").groupBy("set_key").agg(
        F.min(first).alias("first"), F.count("*").alias("copies"), F.first("bulk").alias("bulk"), F.first("bands").alias("bands"),
        F.first("mark").alias("mark")).withColumn("doc", F.monotonically_increasing_id()))  # fixed by the checkpoint

    # a bucket of one set can link nothing
    places = distinct.select("doc", "bulk", F.posexplode("bands").alias("band", "bucket"))
    shared = places.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = keep(join_groups(places, keep(shared), ["bucket"], "size").where("size is not null").drop("size"))
    used = keep(members.select("doc").distinct().join(distinct, "doc").select("doc", "mark", "bands", F.col("first.row").alias("row")))
    texts = rows.select("row", "text").join(used.select("row", "doc"), "row").dropDuplicates(["row"])
    sets = keep(_sets(texts, width, counted))
    release(docs.sparkSession)
    linker = Linker(used.select("doc"), used.select("doc", "mark", "bands"), sets, least)
    linker.stars(members)
    linker.across(members)

    named = distinct.select("doc", "set_key", "copies", "first").join(linker.classes, "doc", "left").withColumn(
        "class", F.coalesce("class", "doc"))
    totals = named.groupBy("class").agg(F.sum("copies").alias("class_size"), F.min("first").alias("best"))
    totals = totals.select("class", "class_size", F.col("best.doc_id").alias("class_id"), F.col("best.row").alias("stays"))
    named = join_groups(named.drop("first"), keep(totals), ["class"], "class_size")
    return signed.select("row", "doc_id", "set_key"), keep(named.select("set_key", "copies", "class_size", "class_id", "stays"))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, least: float = 0.8,
                counted: bool = False) -> DataFrame:
    """(doc_id, class_id, class_size): groups linked by a similarity of `least` or more.

    Elements are shingles of `width` lower-cased words between ASCII white space, with weight 1 or,
    if `counted`, with their counts; the similarity is their (weighted) Jaccard similarity, decided
    on whole sets. A class is a connected part of the links and named by its least id.

    1. Equal sets collapse before anything is joined, by partial aggregation.
    2. Sets that share a band key share a bucket. Each is compared with its bucket's least; classes
       form.
    3. In buckets that still hold several classes, all pairs across classes are compared, first by
       signature, then exactly, in blocks that hand on spanning links only.

    A pair is missed only if no bucket holds it (three times in a million at a similarity of 0.8)
    or its signatures differ far more than its sets do (three in a hundred thousand at 0.8); both
    vanish quickly above. No bucket is capped and no member left out.

    Classes are of texts: neither null nor repeated ids link or part them. A null id is larger than
    any; a class of null ids only has a null name. A text without words (null, empty, blank) is alone
    in its class. Rows that repeat a text count as copies. Other columns are ignored.
    """
    signed, named = _classes(docs, doc_id, text, width, least, counted)
    worded = signed.where("set_key is not null")
    alone = signed.where("set_key is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return join_groups(worded, named, ["set_key"], "copies").select("doc_id", "class_id", "class_size").unionByName(alone)


def drop_near(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: of each class the one with the least id, nulls last.

    Each row is judged by its own text: a repeated or null id takes no other text along. Rows equal
    in id and text stay or go together; texts without words stay.
    """
    signed, named = _classes(docs, "doc_id", "text", 5, 0.8, False)
    worded = signed.where("set_key is not null")
    gone = join_groups(worded, named, ["set_key"], "copies").where(
        F.col("row") != F.col("stays")).select(F.col("row").alias("_gone"))
    return docs.join(gone, row_key("doc_id", "text") == gone["_gone"], "left_anti")
