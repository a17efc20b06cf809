"""Column expressions used across operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(ts) -> Column:
    """Microseconds since the epoch of a naive-UTC time, whatever the session zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), c)
    return F.unix_micros(local.cast("timestamp"))


def from_micros(us) -> Column:
    c = F.col(us) if isinstance(us, str) else us
    return F.timestamp_add("MICROSECOND", c, F.expr(EPOCH))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Name-based UUID (version 5) of `name` under a namespace given as 32 hex digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "utf-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"),
        F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3),
        F.lit("-"), F.substring(h, 21, 12),
    )


def basename(path) -> Column:
    """Last component of a Windows or POSIX path, lower-cased; '' when absent."""
    c = F.col(path) if isinstance(path, str) else path
    unified = F.rtrim(F.translate(F.coalesce(c, F.lit("")), "\\", "/"), F.lit("/"))
    return F.lower(F.substring_index(unified, "/", -1))


def array_median(values: Column) -> Column:
    """Median of a numeric array; NULL when empty."""
    s = F.array_sort(values)
    n = F.size(values)
    mid = F.floor(n / 2).cast("int")
    odd = F.get(s, mid)
    even = (F.get(s, mid - 1) + F.get(s, mid)) / 2
    return F.when(n == 0, F.lit(None)).when(n % 2 == 1, odd.cast("double")).otherwise(even)


def blank(c) -> Column:
    """True where a text value is NULL or empty."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (c == "")


def nz(c, default=0):
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(default))


def clip01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def exact_mean(c) -> Column:
    """Mean of values of at most six decimals, whose sum is taken in whole numbers: the order of rows plays no part."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(F.round(c * 1_000_000).cast("bigint")) / (F.count(c) * 1_000_000)


def two_decimals(c: Column, digits: int = 3) -> Column:
    """A value from 0 to 1 of at most `digits` decimals as text with two, ties by its binary value."""
    unit = 10 ** digits
    step = unit // 100
    whole = F.round(c * unit).cast("int")
    down = [k for k in range(step // 2, unit + 1, step) if f"{k / unit:.2f}" == f"{k // step / 100:.2f}"]
    return F.format_string("%.2f", F.when(whole.isin(*down), whole - 1).otherwise(whole) / unit)


def doublings(value: Column, base: int | Column) -> Column:
    """How often value/base can be halved and stay >= 1, by integer arithmetic."""
    base = F.lit(base) if isinstance(base, int) else base
    whole = ((value - value % base) / base).cast("bigint")
    return F.greatest(F.length(F.bin(whole)) - 1, F.lit(0))
