"""Small helpers over higher-order functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def case(pairs: list[tuple[Column, Column]], default: Column) -> Column:
    """First pair whose condition holds; a null condition does not."""
    return reduce(lambda rest, p: F.when(F.coalesce(p[0], F.lit(False)), p[1]).otherwise(rest), reversed(pairs), default)


def all_of(conditions: list[Column]) -> Column:
    """AND of all, true if there are none."""
    return reduce(Column.__and__, conditions, F.lit(True))
