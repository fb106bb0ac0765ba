"""How a table is cut for copying."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

WIDTH = 10_000


@dataclass(frozen=True)
class Range:
    """Keys from `low` on and below `high` (None: without an end): half open, so that fractional keys are never between two ranges."""

    index: int
    low: int | None
    high: int | None

    def holds(self, key):
        cond = F.lit(True)
        if self.low is not None:
            cond = cond & (key >= self.low)
        if self.high is not None:
            cond = cond & (key < self.high)
        return cond

    def predicate(self, key: str) -> str:
        """The condition as SQL, for a JDBC source."""
        parts = []
        if self.low is not None:
            parts.append(f"{key} >= {self.low}")
        if self.high is not None:
            parts.append(f"{key} < {self.high}")
        return " AND ".join(parts) or "1 = 1"


#: Ranges of a table at most.
MOST = 10_000


def wide_enough(low, high, width: int = WIDTH, most: int = MOST) -> int:
    """A width from `width` on that cuts [low, high] into at most `most` ranges numbered by batch_of()."""
    if low is None or high is None:
        return width
    low, high = int(low // 1), int(high // 1)
    while high // width - low // width >= most:
        width = max(width + 1, -(-(high - low + 1) // (most - 1)))
    return width


def batches_together(low, high, width: int = WIDTH, most: int = MOST) -> int:
    """How many neighbouring batches of a width lie together, so that [low, high] has at most `most` such groups."""
    if low is None or high is None:
        return 1
    low, high = int(low // 1), int(high // 1)
    many = max(1, -(-wide_enough(low, high, width, most) // width))
    while high // (width * many) - low // (width * many) >= most:
        many += 1
    return many


def key_ranges(low, high, width: int = WIDTH, most: int = MOST) -> list[Range]:
    """Ranges over [low, high]; at most `most`, so a sparse key does not give more ranges than a cluster can use. The outer ones are open."""
    if low is None or high is None:
        return [Range(0, None, None)]
    low, high = int(low // 1), int(high // 1)
    width = max(width, -(-(high - low + 1) // most))
    cuts = list(range(low + width, high + 1, width))
    edges = [None, *cuts, None]
    return [Range(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]))]


def plan_ranges(df: DataFrame, key: str | None, width: int = WIDTH) -> list[Range]:
    """By a single numeric key: ranges from its smallest and largest value. Else one range: Spark's own partitions split the scan."""
    if key is None or not isinstance(df.schema[key].dataType, NumericType):
        return [Range(0, None, None)]
    r = df.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
    return key_ranges(r.a, r.b, width)


def batch_of(key, width: int = WIDTH):
    """The number of a key's range, counted from key 0 so that it never depends on the other keys, as a column: all ranges of a table in one job."""
    return F.floor(key / width).cast("long")
