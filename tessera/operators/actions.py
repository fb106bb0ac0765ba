"""Deletes with the actions of foreign keys: CASCADE and SET NULL as a closure over the graph of tables, one plan a level."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dialects.ddl import ForeignKey
from ..shared import shared_dir


class Restricted(ValueError):
    """A row that is to go is referred to by a key without an action."""


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = os.path.join(shared_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _met(child: DataFrame, key: ForeignKey, gone: DataFrame, how: str) -> DataFrame:
    refs = gone.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key.keys)]).distinct()
    cond = F.lit(True)
    for i, c in enumerate(key.columns):
        cond = cond & (F.col(c) == F.col(f"_k{i}"))
    return child.join(refs, cond, how)


def delete_with_actions(tables: dict[str, DataFrame], foreign: dict[str, list[ForeignKey]], table: str, condition: str) -> dict[str, DataFrame]:
    """Every table after rows of one that meet a condition go, and what refers to them.

    foreign: by child table.  A level deletes, in each child, the rows that
    refer by CASCADE to rows that the level before deleted, until a level
    deletes none (a key of a table to itself goes as deep as its rows do).
    Then SET NULL and SET DEFAULT clear what refers to any deleted row, and a
    key without an action that refers to one is an error.  Each level is one
    semi-join a key, over keys alone; its rows are written once.  Rows that
    are equal in all columns go together.  A NULL in a key refers to nothing.
    """
    gone: dict[str, list[DataFrame]] = {t: [] for t in tables}
    left = dict(tables)

    def take(t: str, rows: DataFrame) -> DataFrame | None:
        rows = _stored(rows.distinct(), f"gone-{t}")
        if rows.isEmpty():
            return None
        gone[t].append(rows)
        same = [left[t][c].eqNullSafe(rows[c]) for c in rows.columns]
        left[t] = left[t].join(rows, same, "left_anti")
        return rows

    first = take(table, left[table].where(condition))
    level = {table: first} if first is not None else {}
    while level:
        reached: dict[str, DataFrame] = {}
        for child, keys in foreign.items():
            for key in keys:
                parent = key.table[-1].lower()
                if key.on_delete.upper() == "CASCADE" and parent in level:
                    hit = _met(left[child], key, level[parent], "left_semi")
                    reached[child] = hit if child not in reached else reached[child].unionByName(hit)
        level = {t: rows for t, hit in reached.items() if (rows := take(t, hit)) is not None}
    for child, keys in foreign.items():
        for key in keys:
            for rows in gone.get(key.table[-1].lower(), []):
                action = key.on_delete.upper()
                if action == "CASCADE":
                    continue
                if action not in ("SET NULL", "SET DEFAULT"):
                    if not _met(left[child], key, rows, "left_semi").isEmpty():
                        raise Restricted(f"rows of {child} refer to rows of {key.table[-1]} that are to be deleted")
                    continue
                met = _met(left[child], key, rows, "left")
                hit = F.col("_k0").isNotNull()
                left[child] = met.select(*[F.when(hit, F.lit(None)).otherwise(F.col(c)).cast(left[child].schema[c].dataType).alias(c) if c in key.columns else F.col(c) for c in left[child].columns])
    return left
