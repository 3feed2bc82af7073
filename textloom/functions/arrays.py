"""Running values over array columns within the row, without copying the array for each element."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """What op gives for all elements up to each one, itself included; op(earlier, later) must be associative.

    By doubling: each round combines every element with the one 1, 2, 4, ... places before it, so an array of n elements takes log2(n) rounds
    over it. Empty arrays stay empty.
    """
    steps = F.array(*[F.lit(1 << k) for k in range(31)])

    def doubled(x: Column) -> Column:
        rounds = F.filter(steps, lambda step: step < F.size(x))
        return F.aggregate(rounds, x, lambda done, step: F.transform(done, lambda v, i: F.when(i >= step, op(F.get(done, i - step), v)).otherwise(v)))

    return let(values, doubled)


def sums(values: Column) -> Column:
    """Running sums of an array of longs."""
    return running(values, lambda a, b: a + b)


def before(values: Column, first) -> Column:
    """The array moved on by one place: `first`, then all values but the last."""
    return let(values, lambda x: F.transform(x, lambda _, i: F.when(i == 0, first).otherwise(F.get(x, i - 1))))
