"""Rounding and sums that give the same answer on every run and every cluster size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "decimal(38,9)"


def round_half_away(x: Column, digits: int) -> Column:
    """Round a double in binary, as ``round(x * 10^n) / 10^n``: 1.005 to 2 digits is 1.0."""
    scale = float(10 ** digits)
    return F.round(x * F.lit(scale)) / F.lit(scale)


def exact_sum(x: Column) -> Column:
    """Sum money as a decimal with nine fraction digits: addition order cannot change it. An amount that
    is no such number does not count, and a total that does not fit is NULL rather than an error."""
    return F.try_sum(x.try_cast(EXACT))


def full_sum(x: Column) -> Column:
    """Sum doubles of any size as a double. Values that nine fraction digits write exactly, under 1e15,
    are added as decimals, so their order cannot change the sum; tiny, huge and non-finite ones, and
    those with more digits, are added as doubles."""
    d = x.try_cast(EXACT)
    plain = F.coalesce((F.abs(x) < 1e15) & (d.cast("double") == x), F.lit(False))
    some, rest = F.try_sum(F.when(plain, d)).cast("double"), F.sum(F.when(~plain, x.cast("double")))
    return F.when(some.isNull(), rest).when(rest.isNull(), some).otherwise(some + rest)


def whole_sum(x: Column) -> Column:
    """Sum whole numbers in 128 bits, as a bigint; NULL where the total is beyond one."""
    return F.try_sum(x.try_cast("decimal(20,0)")).try_cast("bigint")


def money(total: Column) -> Column:
    """An exact sum as dollars with four digits."""
    return F.round(total, 4).cast("double")
