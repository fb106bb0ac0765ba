"""Declared partitions as derived columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def range_partition(c: Column, bounds: list[tuple[str, object]]) -> Column:
    """The first partition whose upper bound (exclusive; None: no bound) lies above the value; NULL is in the first, as MySQL has it."""
    out = None
    for name, bound in bounds:
        cond = F.lit(True) if bound is None else c.isNull() | (c < F.lit(bound))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def list_partition(c: Column, lists: list[tuple[str, list]], default: str | None = None) -> Column:
    out = None
    for name, values in lists:
        cond = c.isin(*[v for v in values if v is not None])
        if None in values:
            cond = cond | c.isNull()
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(F.lit(default)) if default is not None else out


def hash_partition(c: Column, n: int, modulo: bool = False) -> Column:
    """0 .. n-1. modulo: of an integer, as MySQL's PARTITION BY HASH places it; else by xxhash64, not as the source places rows."""
    return (F.abs(c) % n if modulo else F.pmod(F.xxhash64(c), F.lit(n))).cast("int")


def interval_partition(c: Column, unit: str) -> Column:
    """Oracle's INTERVAL partitions: the start of the value's month, day, ..."""
    return F.date_trunc(unit, c)
