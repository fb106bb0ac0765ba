"""Versions of the session's tables: what each data change leaves, as plans over written rows, to read, to return to and to commit."""

from __future__ import annotations

import datetime as dt
import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..shared import shared_dir

#: Plans that stand on one another before a table is written whole.
CHAIN = 10


@dataclass
class Version:
    number: int  # one count for all tables of the session
    at: dt.datetime
    frame: DataFrame
    base: DataFrame  # what appended rows stand on
    added: tuple[str, ...] = ()  # folders of appended rows
    depth: int = 0  # plans over the last written version


@dataclass
class Versions:
    """A log of versions by table; a table's latest is the temporary view of its name.

    An insert writes its own rows and adds their folder to the version; other
    changes are plans over the version before.  Nothing rewrites a table but
    COMMIT, a change whose statement gives other values each time, and the
    tenth plan in a row.  Versions are kept until the session ends.
    """

    spark: SparkSession
    log: dict[str, list[Version]] = field(default_factory=dict)
    number: int = 0
    committed: dict[str, Version] = field(default_factory=dict)
    points: dict[str, dict[str, Version]] = field(default_factory=dict)

    def _last(self, table: str) -> Version:
        key = table.lower()
        if key not in self.log:
            frame = self.spark.table(table)
            first = Version(0, dt.datetime.min, frame, frame)
            self.log[key] = [first]
            self.committed.setdefault(key, first)
        return self.log[key][-1]

    def _write(self, frame: DataFrame) -> tuple[str, DataFrame]:
        path = os.path.join(shared_dir(self.spark), f"version-{uuid.uuid4().hex}")
        frame.write.parquet(path)
        return path, self.spark.read.schema(frame.schema).parquet(path)

    def _show(self, table: str, v: Version) -> None:
        v.frame.createOrReplaceTempView(table)

    def _put(self, table: str, frame: DataFrame, base: DataFrame, added: tuple[str, ...], depth: int) -> None:
        self.number += 1
        v = Version(self.number, dt.datetime.now(), frame, base, added, depth)
        self.log[table.lower()].append(v)
        self._show(table, v)

    def appended(self, table: str, rows: DataFrame) -> None:
        """The table and more rows, which are written; folders of appended rows are read as one."""
        last = self._last(table)
        path, _ = self._write(rows.select(*last.frame.columns))
        added = (*last.added, path)
        frame = last.base.unionByName(self.spark.read.schema(last.frame.schema).parquet(*added))
        self._put(table, frame, last.base, added, last.depth)

    def replaced(self, table: str, frame: DataFrame, fixed: bool) -> None:
        """The table as a plan over its last version; written where that gives other values each time or stands on ten others."""
        last = self._last(table)
        depth = last.depth + 1
        if fixed or depth >= CHAIN:
            frame, depth = self._write(frame)[1], 0
        self._put(table, frame, frame, (), depth)

    def at(self, table: str, when, by_number: bool) -> DataFrame:
        """The version that was the latest at a number of the log or at a time; KeyError where there was none."""
        self._last(table)
        past = [v for v in self.log[table.lower()] if (v.number <= int(when) if by_number else v.at <= _time(when))]
        if not past:
            raise KeyError(table)
        return past[-1].frame

    def commit(self) -> None:
        """Writes whole what plans and appended rows make up; forgets savepoints."""
        for key, log in self.log.items():
            v = log[-1]
            if v is not self.committed.get(key) and (v.depth or v.added):
                v.frame = v.base = self._write(v.frame)[1]
                v.added, v.depth = (), 0
                self._show(key, v)
            self.committed[key] = v
        self.points.clear()

    def savepoint(self, name: str) -> None:
        self.points.pop(name, None)
        self.points[name] = {key: log[-1] for key, log in self.log.items()}

    def rollback(self, name: str | None = None) -> None:
        """Back to a savepoint (later ones are forgotten) or to the last COMMIT; what was undone stays in the log as numbers that are not the latest."""
        to = self.points[name] if name is not None else self.committed
        for key, log in self.log.items():
            v = to.get(key, log[0])
            if v is not log[-1]:
                self._put(key, v.frame, v.base, v.added, v.depth)
        names = list(self.points)
        for later in names[names.index(name) + 1 :] if name is not None else names:
            del self.points[later]


def _time(when) -> dt.datetime:
    if isinstance(when, dt.datetime):
        return when.replace(tzinfo=None)
    return dt.datetime.fromisoformat(str(when))
