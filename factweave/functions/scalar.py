"""Conditions over several values, where only null and false count as untrue."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARE = {"<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "=": operator.eq, "!=": operator.ne}


def truthy(value: Column, boolean: bool = False) -> Column:
    """Whether a value counts as true: everything but null, and false where the value is boolean."""
    return F.coalesce(value, F.lit(False)) if boolean else value.isNotNull()


def chain(op: str, *values: Column) -> Column:
    """Whether op holds between each value and the next."""
    return reduce(operator.and_, [COMPARE[op](a, b) for a, b in zip(values, values[1:], strict=False)], F.lit(True))


def every(*conditions: Column) -> Column:
    return reduce(operator.and_, [truthy(c, True) for c in conditions], F.lit(True))


def some(*conditions: Column) -> Column:
    return reduce(operator.or_, [truthy(c, True) for c in conditions], F.lit(False))


def negated(condition: Column) -> Column:
    return ~truthy(condition, True)


def choose(condition: Column, then: Column, other: Column | None = None) -> Column:
    """then where the condition is true, else other; null without an other."""
    out = F.when(truthy(condition, True), then)
    return out if other is None else out.otherwise(other)
