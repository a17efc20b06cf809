"""Approximate nearest neighbours over balanced posting lists, largest inner product first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import keep

#: Vectors the lists are fitted on at most, lists at most, and vectors a list is meant to hold.
SAMPLE, LISTS, PER_LIST = 32_768, 4096, 256
#: A boundary vector is stored in up to COPIES lists that are at most STORE times as far as its nearest;
#: a query reads all lists that are at most PROBE times as far as its nearest.
COPIES, STORE, PROBE = 4, 1.05, 1.15
#: Links of a centroid in the graph; rows of a block of a list.
LINKS, ROWS = 16, 4096


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 2) -> np.ndarray:
    """Centres of equal parts of `x`: each part is halved at the median between two local means."""
    rng = np.random.default_rng(seed)
    parts = [np.arange(len(x))]
    while len(parts) < lists:
        halves = []
        for part in parts:
            own = x[part]
            a, b = own[rng.choice(len(part), 2, replace=False)] if len(part) > 1 else (own[0], own[0])
            for _ in range(6):
                side = own @ (b - a)
                order = np.argsort(side, kind="stable")
                half = len(part) // 2
                a, b = own[order[:half]].mean(axis=0) if half else own[0], own[order[half:]].mean(axis=0)
            order = np.argsort(own @ (b - a), kind="stable")
            halves += [part[order[:len(part) // 2]], part[order[len(part) // 2:]]]
        parts = [p for p in halves if len(p)]
        if all(len(p) == 1 for p in parts):
            break
    return np.array([x[p].mean(axis=0) for p in parts])


class CentroidGraph:
    """Centroids with links to their nearest and to one another in a ring, searched from a few starts."""

    def __init__(self, centroids: np.ndarray):
        self.points = centroids
        self.norms = (centroids ** 2).sum(axis=1)
        n = len(centroids)
        near = np.empty((n, min(LINKS, n)), np.int64)
        for at in range(0, n, 1024):
            d = self.norms[None, :] - 2 * centroids[at:at + 1024] @ centroids.T
            near[at:at + 1024] = np.argsort(d, axis=1, kind="stable")[:, :near.shape[1]]
        ring = np.arange(n)
        self.links = np.column_stack([near, (ring + 1) % n, (ring - 1) % n])
        self.starts = np.unique(np.linspace(0, n - 1, 8).astype(np.int64))

    def within(self, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of each list at most `ratio` times as far as a row's nearest, nearest first.

        Best-first walk for all rows together: the nearest reached centroid not yet expanded has its
        links measured, until what is left to expand is farther than that bound.
        """
        n = len(x)
        rows = np.arange(n)
        square = (x ** 2).sum(axis=1)
        far = np.full((n, len(self.points)), np.inf)
        todo = far.copy()

        def measure(who: np.ndarray, nodes: np.ndarray) -> None:
            new = np.isinf(far[who[:, None], nodes])
            who, nodes = np.broadcast_to(who[:, None], nodes.shape)[new], nodes[new]
            d = square[who] + self.norms[nodes] - 2 * np.einsum("ij,ij->i", x[who], self.points[nodes])
            far[who, nodes] = todo[who, nodes] = np.sqrt(np.maximum(d, 0)) + 1e-12

        measure(rows, np.broadcast_to(self.starts, (n, len(self.starts))))
        live = rows
        while len(live):
            node = todo[live].argmin(axis=1)
            open_ = todo[live, node] <= ratio * far[live].min(axis=1)
            live, node = live[open_], node[open_]
            if len(live):
                todo[live, node] = np.inf
                measure(live, self.links[node])
        row, node = np.nonzero(far <= ratio * far.min(axis=1, keepdims=True))
        order = np.lexsort((node, far[row, node], row))
        return row[order], node[order]


def _stack(values: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float64) for v in values])


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    """One more coordinate makes all stored vectors `top` long, so the nearest has the largest inner product."""
    return np.column_stack([x, np.sqrt(np.maximum(0, top * top - (x ** 2).sum(axis=1)))])


def _aimed(x: np.ndarray, top: float) -> np.ndarray:
    return np.column_stack([x * (top / np.sqrt((x ** 2).sum(axis=1, keepdims=True))), np.zeros(len(x))])


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v): the vectors that take part, as double arrays, of the commonest length."""
    v = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.where(v.isNotNull() & F.col("vec_id").isNotNull() & sound & F.exists(v, lambda c: c != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (sizes["d"] if sizes else 0))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
            probe: float = PROBE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the `k` other rows of largest inner product found.

    `is_query` is a condition on vec_id. Lists are fitted on SAMPLE vectors at most, by a hash of the
    id; every vector is then stored in its nearest list and, near a boundary, in up to COPIES; a list
    is meant to hold PER_LIST vectors, up to LISTS lists. Queries read the lists that the distance
    ratio leaves. Lists are cut into blocks of about ROWS vectors and queries, so a list with many rows is many
    units of work. Scores are summed in double precision on the vectors as given; ties go to the
    smaller id. Vectors that are null, zero, of another length, or hold null or non-finite
    components take no part; an id given twice counts once (the vector whose text is least). Other
    columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, vector).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = keep(rows)
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    n, top = rows.agg(F.count("*"), F.sqrt(F.max(square))).first()
    shape = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], shape)
    share = min(1.0, SAMPLE / n)
    lucky = F.xxhash64("vec_id") / F.lit(2.0 ** 64) + 0.5 < share * 0.97 if share < 1 else F.lit(True)
    sample = np.array([r["v"] for r in rows.where(lucky).select("v").limit(SAMPLE).collect()])
    graph = CentroidGraph(balanced_centroids(_lifted(sample, top), int(min(LISTS, max(1, n // PER_LIST)))))
    shared = spark.sparkContext.broadcast((graph, float(top)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, top = shared.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at:at + 256]
                x = np.stack(part["v"].to_numpy()).astype(np.float64)
                ids, raw, out = part["vec_id"].to_numpy(), [v.tobytes() for v in x], []
                asks = part["asks"].to_numpy()
                row, node = graph.within(_lifted(x, top), STORE)
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                out += [(int(node[i]), 0, ids[row[i]], raw[row[i]]) for i in np.flatnonzero(nth < COPIES)]
                if asks.any():
                    own = np.flatnonzero(asks)
                    row, node = graph.within(_aimed(x[own], top), probe)
                    out += [(int(b), 1, ids[own[a]], raw[own[a]]) for a, b in zip(row, node, strict=True)]
                yield pd.DataFrame(out, columns=["list", "kind", "id", "v"])

    placed = keep(rows.select("vec_id", "v", is_query.alias("asks")).mapInPandas(
        place, "list int, kind int, id long, v binary"))
    # blocks of a list: every block of vectors meets every block of queries
    sizes = placed.groupBy("list").agg(
        F.ceil(F.sum(1 - F.col("kind")) / ROWS).cast("int").alias("vs"), F.ceil(F.sum("kind") / ROWS).cast("int").alias("qs"))
    sizes = F.broadcast(sizes.where("vs > 0 and qs > 0"))  # LISTS rows at most
    own = F.when(F.col("kind") == 0, F.pmod(F.xxhash64("id"), F.col("vs"))).otherwise(F.pmod(F.xxhash64("id"), F.col("qs")))
    others = F.sequence(F.lit(0), F.when(F.col("kind") == 0, F.col("qs")).otherwise(F.col("vs")) - 1)
    units = placed.join(sizes, "list").select("list", "kind", "id", "v", own.cast("int").alias("own"), F.explode(others).alias("other"))
    units = units.select("list", F.when(F.col("kind") == 0, F.col("own")).otherwise(F.col("other")).alias("vb"),
                         F.when(F.col("kind") == 0, F.col("other")).otherwise(F.col("own")).alias("qb"), "kind", "id", "v")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, dict[int, float]] = {}
        unit, ids, stored, pending = None, np.zeros(0, np.int64), None, []

        def answer(queries: list[tuple[int, bytes]]) -> None:
            if not queries or not len(ids):
                return
            q = np.stack([np.frombuffer(v, np.float64) for _, v in queries])
            rough = q @ stored.T
            for (name, _), vector, near in zip(queries, q, rough, strict=True):
                some = near
                if len(near) > k + 1:
                    # one more for the query itself, and all that rounding could put in their place
                    bar = np.partition(near, len(near) - k - 1)[len(near) - k - 1]
                    some = near - bar + 1e-9 * (1 + abs(bar)) >= 0
                    own, theirs = ids[some], stored[some]
                else:
                    own, theirs = ids, stored
                score = (theirs * vector).sum(axis=1)
                kept = best.setdefault(name, {})
                kept.update((int(i), float(s)) for i, s in zip(own, score, strict=True) if i != name)
                if len(kept) > 8 * k:
                    best[name] = dict(sorted(kept.items(), key=lambda p: (-p[1], p[0]))[:k])

        def told() -> pd.DataFrame:
            out = [(name, i, s) for name, kept in best.items()
                   for i, s in sorted(kept.items(), key=lambda p: (-p[1], p[0]))[:k]]
            best.clear()
            return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

        for batch in batches:
            keys = batch[["list", "vb", "qb", "kind"]].to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1), [True])))
            for a, b in zip(cuts, cuts[1:], strict=False):
                at, kind = tuple(keys[a, :3]), keys[a, 3]
                part = batch.iloc[a:b]
                if at != unit:
                    unit, ids, stored = at, np.zeros(0, np.int64), None
                if kind == 0:
                    own = _stack(part["v"])
                    ids = np.concatenate([ids, part["id"].to_numpy()])
                    stored = own if stored is None else np.concatenate([stored, own])
                else:
                    pending = list(zip(part["id"].tolist(), part["v"], strict=True))
                    for s in range(0, len(pending), 512):
                        answer(pending[s:s + 512])
            if len(best) > 20_000:
                yield told()
        yield told()

    dealt = units.repartition("list", "vb", "qb").sortWithinPartitions("list", "vb", "qb", "kind", "id")
    found = dealt.mapInPandas(search, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i"))))
    ranked = found.groupBy("query_id").agg(F.slice(order, 1, k).alias("top"))
    return ranked.select("query_id", F.posexplode("top").alias("p", "t")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("t.i").alias("vec_id"), (-F.col("t.s")).alias("score"))
