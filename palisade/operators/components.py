"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.skew import join_groups
from palisade.functions.state import checkpointed

#: So few edges are one task's work; shuffling them would cost more than it saves.
ONE_TASK = 50_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Point every larger neighbour of a node at the least node it can see.

    A node's least neighbour is found by partial aggregation; it is brought back to the neighbours
    of hubs, nodes with a notable share of all edges, by a bounded broadcast.
    """
    sides = _both_ways(edges)
    least = sides.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("root"), F.count(F.lit(1)).alias("degree"))
    larger = sides.where(F.col("dst") > F.col("src"))
    met = larger.join(least, "src") if total <= ONE_TASK else join_groups(larger, checkpointed(least), ["src"], "degree", 2 * total)
    return met.select(F.col("dst").alias("src"), F.col("root").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Point a node and its smaller neighbours at the least of them."""
    least = edges.groupBy("src").agg(F.min("dst").alias("root"))
    joined = edges.join(least, "src")
    hops = joined.where(F.col("dst") != F.col("root")).select(
        F.col("dst").alias("src"), F.col("root").alias("dst"))
    return hops.unionByName(least.select("src", F.col("root").alias("dst"))).distinct()


def _state(edges: DataFrame) -> tuple:
    mark = F.xxhash64("src", "dst").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mark)).first())


def connected_components(
    vertices: DataFrame, edges: DataFrame
) -> DataFrame:
    """(id, component) for every vertex; a component is named by its least id.

    `vertices`: id. `edges`: src, dst. Alternates the two star steps, so long
    chains shrink geometrically; each round is written to the checkpoint folder
    and only its row count and checksum come to the driver. Hubs are split. A
    round of up to ONE_TASK edges is one task, without a shuffle.
    """
    e = edges.select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")
    ).where(F.col("src") != F.col("dst")).distinct()
    e = checkpointed(e)
    before = _state(e)
    while before[0]:
        few = e.coalesce(1) if before[0] <= ONE_TASK else e
        e = checkpointed(_small_star(_large_star(few, before[0])))
        after = _state(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("src").alias("id"), F.col("dst").alias("root"))
    return vertices.select("id").join(roots, "id", "left").select(
        "id", F.coalesce("root", "id").alias("component"))
