"""Ordered, stateful steps over keys that may hold a large share of all rows.

Nothing here sends a whole key to one task. Rows are numbered within ranges of
(key, time, id) and shifted by the counts of earlier ranges; the reset-after-firing
step works on (key, row-number chunk) groups of bounded size whose effects are
then chained.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions.state import pin, stored


class Fold(NamedTuple):
    """What a scan carries along a key: the `sum` or `max` of a value, or the `last` one that is not null."""

    kind: str
    value: Column
    down: bool = False  # from the end of the key towards its start
    own: bool = True  # does the row itself count?


_AGGREGATE = {"sum": F.sum, "max": F.max}


def prefix_scan(rows: DataFrame, keys: list[str], order: list[str], folds: dict[str, Fold]) -> DataFrame:
    """Add one column a fold: its value over the rows of the key up to each row.

    Rows are dealt by ranges of (keys, order), so neither a key nor an instant is one task. Each
    range is folded on its own; what earlier ranges of a key hand on is folded over their totals, of
    which there are few, since at most one key reaches over each border between two ranges. Those are
    broadcast, at most two rows a range. Ranges are stored in the checkpoint folder, as totals and
    rows must see the same ones. All kinds are associative, so the result does not depend on where
    ranges end.
    """
    dealt = stored(rows.withColumns({f"_v_{n}": f.value for n, f in folds.items()}).repartitionByRange(
        *keys, *order).withColumn("_range", F.spark_partition_id()))
    at = F.struct(*order)

    def total(name: str, fold: Fold) -> Column:
        v = F.col(f"_v_{name}")
        if fold.kind != "last":
            return _AGGREGATE[fold.kind](v)
        return (F.min_by if fold.down else F.max_by)(v, F.when(v.isNotNull(), at))

    def over(fold: Fold, value: Column, window, ordering: list, own: bool) -> Column:
        ordering = [F.desc(c) for c in ordering] if fold.down else [F.col(c) for c in ordering]
        span = window.orderBy(*ordering).rowsBetween(W.unboundedPreceding, 0 if own else -1)
        return (F.last(value, ignorenulls=True) if fold.kind == "last" else _AGGREGATE[fold.kind](value)).over(span)

    per_range = dealt.groupBy(*keys, "_range").agg(*[total(n, f).alias(f"_t_{n}") for n, f in folds.items()])
    of_key = W.partitionBy(*keys)
    split = per_range.withColumn("_ranges", F.count(F.lit(1)).over(of_key)).where("_ranges > 1")
    carried = split.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"),
        *[over(f, F.col(f"_t_{n}"), of_key, ["_range"], own=False).alias(f"_c_{n}") for n, f in folds.items()])
    inside = W.partitionBy(*keys, "_range")
    scanned = dealt.withColumns({f"_i_{n}": over(f, F.col(f"_v_{n}"), inside, order, f.own) for n, f in folds.items()})
    same = (F.col("_range") == F.col("_r"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = scanned.join(F.broadcast(carried), same, "left")

    def whole(name: str, fold: Fold) -> Column:
        mine, before = F.col(f"_i_{name}"), F.col(f"_c_{name}")
        if fold.kind == "sum":
            return F.coalesce(mine, F.lit(0)) + F.coalesce(before, F.lit(0))
        return F.greatest(mine, before) if fold.kind == "max" else F.coalesce(mine, before)

    return joined.select(*rows.columns, *[whole(n, f).alias(n) for n, f in folds.items()])


def number_rows(rows: DataFrame, keys: list[str], name: str = "rn") -> DataFrame:
    """Add the 1-based position of each row within its key by (ts_us, event_id)."""
    return pin(prefix_scan(rows, keys, ["ts_us", "event_id"], {name: Fold("sum", F.lit(1).cast("bigint"))}))


def lagged_micros(numbered: DataFrame, keys: list[str], back: int, chunk_rows: int) -> DataFrame:
    """Add `_prev_us`, the time of the row `back` positions earlier, and its chunk.

    A chunk borrows the last `back` rows of the one before it, so each task sees
    chunk_rows + back rows at most.
    """
    place = (F.col("rn") - 1) % F.lit(chunk_rows)
    own = F.floor((F.col("rn") - 1) / F.lit(chunk_rows))
    borrowed = F.when(place >= chunk_rows - back, F.array(own, own + 1)).otherwise(F.array(own))
    both = numbered.withColumn("_own", own).withColumn("_chunk", F.explode(borrowed))
    w = W.partitionBy(*keys, "_chunk").orderBy("rn")
    return (
        both.withColumn("_prev_us", F.lag("ts_us", back).over(w))
        .where(F.col("_own") == F.col("_chunk")).drop("_own")
    )


@F.pandas_udf(T.ArrayType(T.LongType()))
def _spaced(candidates: pd.Series, entry: pd.Series, need: pd.Series) -> pd.Series:
    """Keep candidates from `entry` on, each at least `need` positions after the last kept."""
    out = []
    for rns, start, gap in zip(candidates, entry, need):
        rns = np.asarray(rns)
        kept, i = [], int(np.searchsorted(rns, start))
        while i < len(rns):
            kept.append(int(rns[i]))
            i = int(np.searchsorted(rns, rns[i] + gap))
        out.append(kept)
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _exits(candidates: pd.Series, first: pd.Series, rows: pd.Series, need: pd.Series) -> pd.Series:
    """For each number of blocked leading rows (0..need-1), how many rows of the
    next chunk are blocked once this chunk has fired."""
    out = []
    for rns, lo, size, gap in zip(candidates, first, rows, need):
        rns = np.asarray(rns)
        after = np.zeros(len(rns) + 1, dtype=np.int64)
        step = np.searchsorted(rns, rns + gap)
        for i in range(len(rns) - 1, -1, -1):
            j = step[i]
            after[i] = after[j] if j < len(rns) else max(0, rns[i] + gap - (lo + size))
        out.append(after[np.searchsorted(rns, lo + np.arange(gap))].astype(int).tolist())
    return pd.Series(out)


def _chain(keys: list[str], key_types: list[str]):
    schema = ", ".join(f"`{k}` {t}" for k, t in zip(keys, key_types))
    schema += ", _chunk bigint, _blocked int"

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_chunk")
        blocked, last, out = 0, None, []
        for chunk, exits in zip(group["_chunk"], group["_exits"]):
            if last is not None and chunk != last + 1:
                blocked = 0
            out.append(blocked)
            blocked, last = int(exits[blocked]), chunk
        return group[[*keys, "_chunk"]].assign(_blocked=np.array(out, dtype="int32"))

    return walk, schema


def fire_with_reset(
    numbered: DataFrame, keys: list[str], need: int, window_us: int, *, closed: bool,
    chunk_rows: int,
) -> DataFrame:
    """Rows at which `need` rows of the key fit the window, restarting after each.

    `closed` keeps a row exactly one window old inside the window.
    """
    if need > chunk_rows:
        raise ValueError("chunk_rows must be at least the firing count")
    lagged = lagged_micros(numbered, keys, need - 1, chunk_rows)
    age = F.col("ts_us") - F.col("_prev_us")
    hit = age <= window_us if closed else age < window_us
    grouped = pin(
        lagged.where(hit).groupBy(*keys, "_chunk")
        .agg(F.array_sort(F.collect_list("rn")).alias("_cands"))
    )
    first = F.col("_chunk") * chunk_rows + 1
    # Only keys longer than one chunk need their chunks chained.
    long_keys = numbered.groupBy(*keys).agg(F.max("rn").alias("_len")).where(
        F.col("_len") > chunk_rows
    ).select(*keys)
    tables = grouped.join(long_keys, keys, "left_semi").select(
        *keys, "_chunk", _exits("_cands", first, F.lit(chunk_rows), F.lit(need)).alias("_exits")
    )
    types = [numbered.schema[k].dataType.simpleString() for k in keys]
    walk, schema = _chain(keys, types)
    blocked = tables.groupBy(*keys).applyInPandas(walk, schema)
    start = first + F.coalesce(F.col("_blocked"), F.lit(0))
    kept = grouped.join(blocked, [*keys, "_chunk"], "left").select(
        *keys, F.explode(_spaced("_cands", start, F.lit(need))).alias("rn")
    )
    return pin(kept)


def rows_before(numbered: DataFrame, fired: DataFrame, keys: list[str], need: int) -> DataFrame:
    """The `need` rows ending at each fired row, tagged with `fired_rn`."""
    wanted = fired.select(
        *keys, F.col("rn").alias("fired_rn"),
        F.explode(F.sequence(F.col("rn") - (need - 1), F.col("rn"))).alias("rn"),
    )
    return numbered.join(wanted, [*keys, "rn"])
