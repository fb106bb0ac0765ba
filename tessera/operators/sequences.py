"""Sequences and identity columns for batches of rows.

A batch takes a whole stretch of numbers: partitions are counted first, each
gets its start, and rows are numbered inside it.  So numbering needs no shuffle
and no single task.  Gaps are allowed, as in the sources.
"""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass
class Sequence:
    """State of a sequence; next: the number that it gives next."""

    name: str
    start: int = 1
    step: int = 1
    low: int | None = None
    high: int | None = None
    cycle: bool = False
    next: int | None = None
    last: int | None = None

    def take(self, n: int) -> int:
        """Sets n numbers apart and returns the first."""
        first = self.start if self.next is None else self.next
        end = first + self.step * (n - 1)
        if n and (self.high is not None and end > self.high or self.low is not None and end < self.low):
            if not self.cycle:
                raise OverflowError(f"sequence {self.name} ends")
            first = (self.low if self.low is not None else self.start) if self.step > 0 else (self.high if self.high is not None else self.start)
            end = first + self.step * (n - 1)
        if n:
            self.next, self.last = end + self.step, end
        return first

    def currval(self) -> int:
        if self.last is None:
            raise ValueError(f"sequence {self.name} has given no number yet")
        return self.last

    def numbered(self, df: DataFrame, column: str) -> DataFrame:
        """df with the next numbers; df must give the same rows when it is read again."""
        part = df.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
        counts = part.groupBy("_part").count().collect()  # one row a partition
        at, starts = 0, {}
        for r in sorted(counts, key=lambda r: r["_part"]):
            starts[r["_part"]] = at
            at += r["count"]
        first = self.take(at)
        if not starts:
            return df.withColumn(column, F.lit(first).cast("long"))
        table = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])
        inside = F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33)
        return part.withColumn(column, (F.lit(first) + self.step * (F.element_at(table, F.col("_part")) + inside)).cast("long")).drop("_part", "_at")


class SequenceStore:
    """Sequences in a file on the driver."""

    def __init__(self, path: str):
        self.path = path
        self.all: dict[str, Sequence] = {}
        if os.path.exists(path):
            with open(path) as f:
                self.all = {k: Sequence(**v) for k, v in json.load(f).items()}

    def create(self, name: str, **options) -> Sequence:
        return self.all.setdefault(name.lower(), Sequence(name, **options))

    def save(self) -> None:
        with open(self.path + ".new", "w") as f:
            json.dump({k: asdict(v) for k, v in self.all.items()}, f)
        os.replace(self.path + ".new", self.path)


def dense_row_number(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """df with 1, 2, ... in a total order. A window without a partition: for small results alone."""
    return df.withColumn(column, F.row_number().over(W.orderBy(*order)))
