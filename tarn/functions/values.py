"""Column helpers: missing values, safe division and a portable hash."""

from __future__ import annotations

import time
from contextlib import AbstractContextManager

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 4294967295


def known(v: Column) -> Column:
    """NaN becomes NULL, so that comparisons and sums leave it out."""
    return F.when(~F.isnan(v), v)


def nan_if_null(v: Column) -> Column:
    return F.coalesce(v, F.lit(float("nan")))


def over(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(a, b)


def norm2(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def uniform(n: Column, seed: int = 0) -> Column:
    """A number in [0, 1) of each integer n, the same in any engine with 64-bit integers; equal for n that are equal
    modulo 2 ** 32. The product is made of halves, as the whole one passes 64 bits beyond 3e9."""
    n, half = n.cast("long"), F.lit(65535)
    low, high = n.bitwiseAND(half) * 2654435761, (F.shiftright(n, 16).bitwiseAND(half) * 2654435761).bitwiseAND(half)
    x = (low + high * 65536 + seed * 40503).bitwiseAND(F.lit(MASK))
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftright(x, 16)) * 73244475).bitwiseAND(F.lit(MASK))
    return x.bitwiseXOR(F.shiftright(x, 16)) / F.lit(4294967296.0)


def uniform_sql(n: str, seed: int = 0) -> str:
    x = f"(({n} * 2654435761 + {seed * 40503}) & {MASK})"
    for _ in range(2):
        x = f"((xor({x}, {x} >> 16) * 73244475) & {MASK})"
    return f"(xor({x}, {x} >> 16) / 4294967296.0::DOUBLE)"


class Timer(AbstractContextManager):
    """`with Timer("ms") as t: ...`, then t.count: whole units of s, ms, us or ns."""

    units = {"s": 10**9, "ms": 10**6, "us": 10**3, "ns": 1}

    def __init__(self, unit: str = "ms"):
        if unit not in self.units:
            raise ValueError(f"unknown unit {unit!r}")
        self.unit, self.count = unit, 0

    def __enter__(self) -> Timer:
        self._began = time.perf_counter_ns()
        return self

    def __exit__(self, *exc) -> None:
        self.count = (time.perf_counter_ns() - self._began) // self.units[self.unit]
