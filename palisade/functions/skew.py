"""Joins of rows with one row a group, where a group may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups of more than this share of all rows are hot, so at most its inverse are.
HOT_SHARE = 1 / 500


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """`rows` inner join `groups`, which has one row a key and its number of rows in `size`, `total` in all.

    Hot groups are few, so they are broadcast and their rows stay where they are; all other rows are
    shuffled by key. Null keys match null keys.
    """
    least = max(1000, int(total * HOT_SHARE))
    g = groups.withColumnsRenamed({k: f"_g_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys]
    hot, cold = F.broadcast(g.where(F.col(size) > least)), g.where(F.col(size) <= least)
    drop = [f"_g_{k}" for k in keys]
    rest = rows.join(hot.select(*drop), same, "left_anti")
    return rows.join(hot, same).drop(*drop).unionByName(rest.join(cold, same).drop(*drop))
