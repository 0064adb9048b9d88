"""Predicates and logic with the reference semantics for nulls: any null in, null out, unless named Kleene."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _null_if_any(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(value)


def and_(a: Column, b: Column) -> Column:
    return _null_if_any(a, b, a & b)


def or_(a: Column, b: Column) -> Column:
    return _null_if_any(a, b, a | b)


def xor(a: Column, b: Column) -> Column:
    return a != b


def and_not(a: Column, b: Column) -> Column:
    return _null_if_any(a, b, a & ~b)


def and_kleene(a: Column, b: Column) -> Column:
    return a & b


def or_kleene(a: Column, b: Column) -> Column:
    return a | b


def and_not_kleene(a: Column, b: Column) -> Column:
    return a & ~b


def invert(a: Column) -> Column:
    return ~a


def _number(c: Column) -> Column:
    return c.cast("double")


def equal(a: Column, b: Column) -> Column:
    """a = b, but never true for NaN."""
    return (a == b) & ~(F.isnan(_number(a)) & F.isnan(_number(b)))


def is_null(c: Column, nan_is_null: bool = False) -> Column:
    return c.isNull() | F.isnan(c) if nan_is_null else c.isNull()


def is_valid(c: Column) -> Column:
    return c.isNotNull()


def true_unless_null(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit(True))


def is_finite(c: Column) -> Column:
    d = _number(c)
    return ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))


def is_inf(c: Column) -> Column:
    return F.abs(_number(c)) == F.lit(float("inf"))


def is_nan(c: Column) -> Column:
    return F.when(c.isNotNull(), F.isnan(_number(c)))


def isin(c: Column, values: Iterable[Any]) -> Column:
    """Membership; a null is in the set exactly when the set holds one."""
    values = list(values)
    known = [v for v in values if v is not None]
    inside = F.coalesce(c.isin(known), F.lit(False)) if known else F.lit(False)
    return (inside | c.isNull()) if len(known) < len(values) else inside & c.isNotNull()


def index_in(c: Column, values: Iterable[Any]) -> Column:
    """Place of the value in the list, from 0; null where it isn't there."""
    out = F.lit(None).cast("int")
    for k, v in reversed(list(enumerate(values))):
        out = F.when(c.isNull() if v is None else c == F.lit(v), F.lit(k)).otherwise(out)
    return out


def where(cond: Column, value: Column, other: Column) -> Column:
    """value where cond, other where not, null where cond is null."""
    return F.when(cond.isNull(), F.lit(None)).when(cond, value).otherwise(other)
