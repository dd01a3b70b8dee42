"""Rounding, capping and hashing expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(value: Column, digits: int) -> Column:
    """Round a row value half up on its decimal reading (to eight places), in plain double arithmetic.

    The small lift stands for the eighth place, so binary noise just under a half
    still rounds up.  No decimal object is made per row.
    """
    scale = float(10**digits)
    lift = 0.5 + 5.0 * 10.0 ** (digits - 9)
    size = F.floor(F.abs(value) * scale + lift) / scale
    return F.when(value < 0, -size).otherwise(size)


def rnd_array(values: np.ndarray, digits: int) -> np.ndarray:
    """``rnd`` for an array."""
    scale = float(10**digits)
    lift = 0.5 + 5.0 * 10.0 ** (digits - 9)
    return np.copysign(np.floor(np.abs(values) * scale + lift) / scale, values)


def rnd_total(value: Column, digits: int) -> Column:
    """The same rounding for totals, which may be decimals too long for a double."""
    return F.round(value.cast("decimal(28,8)"), digits).cast("double")


def money_sum(value: Column) -> Column:
    """Sum as decimal: the total does not depend on the order of the shuffle."""
    return F.sum(value.cast("decimal(18,4)"))


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(condition, 1).otherwise(0)


def lookup(key: Column, table: dict, other=None) -> Column:
    """Value of a small literal dictionary; ``other`` for unknown keys."""
    expr = None
    for name, value in table.items():
        expr = F.when(key == name, F.lit(value)) if expr is None else expr.when(key == name, F.lit(value))
    return expr.otherwise(F.lit(other)) if other is not None else expr


def hash52(*parts) -> Column:
    """A 52-bit number that depends on the key alone, for repeatable sampling and splitting."""
    text = F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
