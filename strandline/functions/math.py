"""Arithmetic on columns.

Integer division truncates, float division by zero gives an infinity or NaN, logarithms of zero and of negative
numbers give -inf and NaN. Integer overflow raises, as Spark's ANSI mode has it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def add(a: Column, b: Column) -> Column:
    return a + b


def subtract(a: Column, b: Column) -> Column:
    return a - b


def multiply(a: Column, b: Column) -> Column:
    return a * b


def divide(a: Column, b: Column) -> Column:
    """Float division with IEEE results for a zero divisor."""
    x, y = a.cast("double"), b.cast("double")
    zero = F.when(F.isnan(x) | (x == 0), NAN).when(x > 0, INF).otherwise(-INF)
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(y == 0, zero).otherwise(F.try_divide(x, y))


def divide_int(a: Column, b: Column) -> Column:
    """Integer division, truncated toward zero; a zero divisor raises."""
    a, b = a.cast("long"), b.cast("long")
    return F.call_function("try_divide", (a - a % b).cast("decimal(38,0)"), b.cast("decimal(38,0)")).cast("long")


def negate(a: Column) -> Column:
    return -a


def sign(a: Column) -> Column:
    return F.signum(a)


def _log(c: Column, f) -> Column:
    d = c.cast("double")
    return F.when(d == 0, -INF).when(d < 0, NAN).otherwise(f(d))


def ln(c: Column) -> Column:
    return _log(c, F.ln)


def log10(c: Column) -> Column:
    return _log(c, F.log10)


def log2(c: Column) -> Column:
    return _log(c, F.log2)


def log1p(c: Column) -> Column:
    d = c.cast("double")
    return F.when(d == -1, -INF).when(d < -1, NAN).otherwise(F.log1p(d))


def logb(c: Column, base: Column | float) -> Column:
    b = base if isinstance(base, Column) else F.lit(float(base))
    return ln(c) / ln(b)


def power(a: Column, b: Column | float) -> Column:
    return F.pow(a, b)


def shift_left(a: Column, n: Column | int) -> Column:
    return F.call_function("shiftleft", a, n if isinstance(n, Column) else F.lit(n))


def shift_right(a: Column, n: Column | int) -> Column:
    return F.call_function("shiftright", a, n if isinstance(n, Column) else F.lit(n))


def bit_and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def bit_or(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def bit_xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def bit_not(a: Column) -> Column:
    return F.bitwise_not(a)


def trunc(c: Column) -> Column:
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("double")


ROUNDING = ("down", "up", "towards_zero", "towards_infinity", "half_down", "half_up", "half_towards_zero", "half_towards_infinity", "half_to_even", "half_to_odd")


def round_mode(c: Column, digits: int = 0, mode: str = "half_to_even") -> Column:
    """Round to `digits` decimals by one of ROUNDING: the directed modes, and the halves that they name."""
    if mode not in ROUNDING:
        raise ValueError(f"unknown rounding mode {mode!r}")
    scale = F.lit(10.0**digits)
    x = c.cast("double") * scale
    low = F.floor(x).cast("double")
    high = F.ceil(x).cast("double")
    part = x - low
    toward0 = F.when(x < 0, high).otherwise(low)
    away = F.when(x < 0, low).otherwise(high)
    even = F.when(low % 2 == 0, low).otherwise(high)
    pick = {"down": low, "up": high, "towards_zero": toward0, "towards_infinity": away}
    tie = {"half_down": low, "half_up": high, "half_towards_zero": toward0, "half_towards_infinity": away, "half_to_even": even, "half_to_odd": low + high - even}
    y = pick[mode] if mode in pick else F.when(part < 0.5, low).when(part > 0.5, high).otherwise(tie[mode])
    finite = F.abs(x) < F.lit(2.0**52)
    return F.when(x.isNull(), None).when(finite & ~F.isnan(x), y / scale).otherwise(c.cast("double"))


def round_binary(c: Column, digits: Column, mode: str = "half_to_even") -> Column:
    """Round by a per-row number of decimals."""
    scale = F.pow(F.lit(10.0), digits)
    return round_mode(c.cast("double") * scale, 0, mode) / scale


def round_to_multiple(c: Column, multiple: float, mode: str = "half_to_even") -> Column:
    return round_mode(c.cast("double") / F.lit(float(multiple)), 0, mode) * F.lit(float(multiple))
