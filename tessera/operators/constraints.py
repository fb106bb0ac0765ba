"""Constraints as queries for the rows that break them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_violations(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which a CHECK is false; NULL passes."""
    return df.where(f"NOT ({condition})")


def key_violations(df: DataFrame, keys: list[str], primary: bool = True) -> DataFrame:
    """(keys, n): keys that occur more than once, and for a primary key those with a NULL. A unique key lets NULLs repeat."""
    has_null = F.lit(False)
    for k in keys:
        has_null = has_null | F.col(k).isNull()
    counted = (df if primary else df.where(~has_null)).groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.where((F.col("n") > 1) | has_null if primary else F.col("n") > 1)


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of child whose foreign key (without NULLs) is not in parent."""
    own = child
    for c in columns:
        own = own.where(F.col(c).isNotNull())
    refs = parent.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    cond = F.lit(True)
    for i, c in enumerate(columns):
        cond = cond & (F.col(c) == F.col(f"_k{i}"))
    return own.join(refs, cond, "left_anti")


def enum_violations(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return df.where(~F.col(column).isin(*allowed))


def subset_violations(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose array holds something that is not allowed."""
    return df.where(F.size(F.array_except(F.col(column), F.array(*map(F.lit, allowed)))) > 0)
