"""Constructs of programming languages as columns: loops, switches, comprehensions, recursion (FN-01, AGT-15)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def comprehension(start: Column, stop: Column, of: Callable, where: Callable) -> Column:
    """[of(i) for i from start to stop, both included, if where(i)]; empty if stop is before start."""
    run = F.sequence(start.cast("long"), F.greatest(stop.cast("long"), start.cast("long")))
    return F.transform(F.filter(run, lambda i: (i <= stop) & where(i)), of)


def loop_sum(start: Column, stop: Column, step: int = 1) -> Column:
    """Sum of what a loop from start to stop, both included, counts through."""
    run = F.sequence(start.cast("long"), F.greatest(stop.cast("long"), start.cast("long")), F.lit(step).cast("long"))
    return F.aggregate(F.filter(run, lambda i: i <= stop), F.lit(0).cast("long"), lambda s, i: s + i)


def switch(value: Column, cases: dict, default: str) -> Column:
    out = F.lit(default)
    for case, result in cases.items():
        out = F.when(value == case, result).otherwise(out)
    return out


def bounded(value: Column, most: int) -> Column:
    """A value that never exceeds ``most``."""
    return F.least(value.cast("long"), F.lit(most).cast("long"))


def halvings(value: Column) -> Column:
    """How often a loop halves a whole number until it is 1."""
    return F.greatest(F.length(F.bin(value.cast("long"))) - 1, F.lit(0)).cast("long")


def fibonacci(n: Column) -> Column:
    """The n-th Fibonacci number, from 0."""
    zero = F.struct(F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b"))
    steps = F.filter(F.sequence(F.lit(1).cast("long"), F.greatest(n.cast("long"), F.lit(1).cast("long"))), lambda i: i <= n)
    return F.aggregate(steps, zero, lambda s, i: F.struct(s["b"].alias("a"), (s["a"] + s["b"]).alias("b")), lambda s: s["a"])
