"""Exact order statistics of groups of any size, by refining histograms over the digits of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from palisade.functions.skew import join_groups
from palisade.functions.state import checkpointed

#: Rows of a group, or of a bucket of it, that one task orders.
SMALL = 4096
#: After the exponent a double is four digits of 13 bits.
DIGITS, WIDTH = 5, 13


def _digits(value: str) -> list[Column]:
    """Digits whose order is the order of doubles: the exponent with the sign, then the mantissa's.

    Built by arithmetic that is exact for powers of two; -0.0 counts as 0.0, infinities have
    exponents of their own, NaN comes last.
    """
    v = F.col(value).cast("double")
    size = F.abs(v)
    plain = (size > 0) & (size < F.lit(float("inf")))
    guess = F.floor(F.log2(F.when(plain, size).otherwise(1.0)))
    exponent = F.when(size < F.pow(F.lit(2.0), guess), guess - 1).when(
        size >= F.pow(F.lit(2.0), guess + 1), guess + 1).otherwise(guess)
    # numbers below the least normal one share its exponent, so that the scale stays finite
    exponent = F.greatest(exponent, F.lit(-1022))
    mantissa = (size / F.pow(F.lit(2.0), exponent) * F.lit(2.0 ** 51)).cast("bigint")
    sign = F.when(v < 0, -1).otherwise(1)
    first = F.when(F.isnan(v), 9000).when(size == 0, 0).when(plain, sign * (exponent + 2000)).otherwise(sign * 8000)
    # a negative number is larger the smaller its size
    rest = F.when(plain & (v < 0), F.lit((1 << 52) - 1) - mantissa).when(plain, mantissa).otherwise(F.lit(0))
    return [first.cast("bigint")] + [
        F.shiftright(rest, 39 - WIDTH * k).bitwiseAND(F.lit((1 << WIDTH) - 1)) for k in range(DIGITS - 1)]


def order_statistics(rows: DataFrame, keys: list[str], value: str, rank: Column) -> DataFrame:
    """(keys, n, rank, lower, upper): the value at `rank` (from 0, a column of the group's `n`) and the next one.

    Null values do not count; `upper` is null after the last value. Groups of up to SMALL rows are
    ordered where they meet. Of larger ones each round counts rows by the next digit, a count that
    is added up before it is shuffled, and keeps the one bucket that holds the rank, until SMALL rows
    or equal ones are left. So no task orders or holds a large group, however its values lie.
    """
    if not keys:
        return order_statistics(rows.withColumn("_all", F.lit(0)), ["_all"], value, rank).drop("_all")
    digits = [f"_d{k}" for k in range(DIGITS)]
    base = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    base = base.withColumns(dict(zip(digits, _digits("_v"), strict=True)))
    state = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 0").withColumn("rank", rank)
    state = checkpointed(state.select(
        *keys, "n", F.col("rank").cast("bigint").alias("rank"), F.col("rank").cast("bigint").alias("_rank"), F.col("n").alias("_left"),
        F.lit(None).cast("double").alias("_beyond"), F.lit(0).alias("_depth"), *[F.lit(None).cast("bigint").alias(c) for c in digits]))
    total = state.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    total = rows.sparkSession.range(1).select(total.alias("t")).first()["t"]

    for k in range(DIGITS):
        open_ = state.where((F.col("_left") > SMALL) & (F.col("_depth") == k))
        if open_.isEmpty():
            break
        own = [*keys, *digits[:k]]
        met = join_groups(base, open_.select(*own, "_left"), own, "_left", total)
        found = met.groupBy(*own, digits[k]).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"))
        # at most 2 ** WIDTH buckets a group
        order = W.partitionBy(*own).orderBy(digits[k])
        found = found.withColumns({
            "_upto": F.sum("_c").over(order), "_next": F.lead("_least").over(order)})
        found = found.withColumnsRenamed({c: f"_f_{c}" for c in (*own, digits[k])})
        same = [F.col(f"_f_{c}").eqNullSafe(F.col(c)) for c in own]
        chosen = open_.drop(digits[k]).join(found, same).where(
            (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c"))).select(
            *keys, "n", "rank", (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank"), F.col("_c").alias("_left"),
            F.coalesce("_next", "_beyond").alias("_beyond"), F.lit(k + 1).alias("_depth"), *digits[:k],
            F.col(f"_f_{digits[k]}").alias(digits[k]), *digits[k + 1:])
        state = checkpointed(state.where(~((F.col("_left") > SMALL) & (F.col("_depth") == k))).unionByName(chosen))

    out = None
    for depth in [r["_depth"] for r in state.select("_depth").distinct().collect()]:
        own = [*keys, *digits[:depth]]
        part = state.where(F.col("_depth") == depth)
        met = join_groups(base, part.select(*own, "_rank", "_left", "_beyond", "n", "rank"), own, "_left", total)
        few = met.where(F.col("_left") <= SMALL)
        place = F.row_number().over(W.partitionBy(*own).orderBy("_v")) - 1 - F.col("_rank")
        few = few.withColumn("_place", place).where("_place in (0, 1)").groupBy(*keys, "n", "rank").agg(
            F.max(F.when(F.col("_place") == 0, F.col("_v"))).alias("lower"),
            F.coalesce(F.max(F.when(F.col("_place") == 1, F.col("_v"))), F.first("_beyond")).alias("upper"))
        out = few if out is None else out.unionByName(few)
        if depth == DIGITS:  # many equal values
            alike = met.where(F.col("_left") > SMALL).groupBy(*keys, "n", "rank", "_rank", "_left", "_beyond").agg(
                F.min("_v").alias("lower")).select(
                *keys, "n", "rank", "lower",
                F.when(F.col("_rank") + 1 < F.col("_left"), F.col("lower")).otherwise(F.col("_beyond")).alias("upper"))
            out = out.unionByName(alike)
    if out is None:
        return state.select(*keys, "n", "rank", F.col("_beyond").alias("lower"), F.col("_beyond").alias("upper"))
    return out


def quantile(rows: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """(keys, n, lower, upper, fraction, quantile): the exact quantile, between two values by straight line."""
    place = lambda n: (n - 1) * F.lit(float(share))
    found = order_statistics(rows, keys, value, F.floor(place(F.col("n"))))
    fraction = place(F.col("n")) - F.col("rank")
    return found.select(*keys, "n", "lower", "upper", fraction.alias("fraction"), F.when(
        fraction > 0, F.col("lower") + (F.col("upper") - F.col("lower")) * fraction).otherwise(F.col("lower")).alias("quantile"))
