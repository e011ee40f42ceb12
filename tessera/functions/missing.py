"""Arithmetic in which a missing value is NULL, never NaN, and nothing raises.

Conditions are doubles: 1 true, 0 false, NULL missing.
"""

from __future__ import annotations

from functools import reduce
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Per90 = Literal["missing", "zero", "twenty"]


def present(c: Column) -> Column:
    """``c`` where it is a finite number."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def clean(df: DataFrame) -> DataFrame:
    """Turn NaN and infinities of all floating columns into NULL."""
    return df.withColumns({c: present(F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend; of zero missing."""
    return F.when(b != 0, a % F.when(b != 0, b))


def power(a: Column, b: Column) -> Column:
    return present(F.pow(a, b))


def truth(condition: Column) -> Column:
    """A condition as 1, 0 or missing."""
    return condition.cast("int").cast("double")


def both(a: Column, b: Column) -> Column:
    """Logical and; a missing side counts as true."""
    return truth(F.coalesce(a != 0, F.lit(True)) & F.coalesce(b != 0, F.lit(True)))


def either(a: Column, b: Column) -> Column:
    """Logical or; a missing side counts as true."""
    return truth(F.coalesce(a != 0, F.lit(True)) | F.coalesce(b != 0, F.lit(True)))


def negate(a: Column) -> Column:
    return truth(a == 0)


def choose(test: Column, yes: Column, no: Column) -> Column:
    """``yes`` or ``no``; missing where the test is."""
    return F.when(test != 0, yes).when(test == 0, no)


def holds(test: Column) -> Column:
    """A row filter: missing is false."""
    return F.coalesce(test != 0, F.lit(False))


def ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def log(x: Column, base: float = 10.0) -> Column:
    return F.when(x > 0, F.ln(x) / F.ln(F.lit(base)))


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def round_up(x: Column, places: int = 0) -> Column:
    """Round half towards positive infinity."""
    by = float(10**places)
    return F.floor(x * by + 0.5).cast("double") / by


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.when(x.isNotNull() & low.isNotNull() & high.isNotNull(), F.least(F.greatest(x, low), high))


def per90(total: Column, minutes: Column, policy: Per90 = "missing") -> Column:
    """Rate for ninety minutes: without minutes missing, or zero, or missing below twenty."""
    rate = F.when(minutes > 0, total * 90.0 / minutes)
    if policy == "zero":
        return F.when(minutes > 0, rate).otherwise(0.0)
    return F.when(minutes >= 20, rate) if policy == "twenty" else rate


def total(*parts: Column) -> Column:
    """Sum that reads missing parts as nought."""
    return reduce(lambda a, b: a + b, (F.coalesce(p.cast("double"), F.lit(0.0)) for p in parts))
