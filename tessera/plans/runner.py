"""Runs a migration: one Spark job a table, independent steps side by side, state in a file."""

from __future__ import annotations

import json
import os
import random
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..dialects.ddl import Script, parse_ddl
from ..dialects.procedural import create_function
from ..operators.copy import copy_table, read_copy, validate
from ..schema.plan import SchemaPlan, _Planner
from .dag import Step, levels, migration_steps

ATTEMPTS = 3


class Blocked(Exception):
    """Prerequisites that have not been acknowledged."""

    def __init__(self, entries):
        super().__init__("; ".join(f"{e.object}: {e.reason}" for e in entries))
        self.entries = entries


class ValidationError(Exception):
    """Source and target differ, or rows break a key."""


def backoff(attempt: int, rng=random) -> float:
    """Seconds before the next attempt: doubling, 60 at most, a fifth up or down."""
    return min(60.0, 2.0**attempt) * rng.uniform(0.8, 1.2)


@dataclass
class State:
    """Status of each step: waiting, running, done, failed, skipped or cancelled; kept in a file if it has a path."""

    path: str | None = None
    status: dict[str, str] = field(default_factory=dict)
    attempts: dict[str, int] = field(default_factory=dict)
    info: dict[str, object] = field(default_factory=dict)

    def load(self) -> None:
        if self.path and os.path.exists(self.path):
            with open(self.path) as f:
                got = json.load(f)
            self.status, self.attempts, self.info = got["status"], got["attempts"], got["info"]
            for k, v in self.status.items():  # a run that died left them behind
                if v == "running":
                    self.status[k] = "waiting"

    def save(self) -> None:
        if self.path:
            with open(self.path + ".new", "w") as f:
                json.dump({"status": self.status, "attempts": self.attempts, "info": self.info}, f, default=str)
            os.replace(self.path + ".new", self.path)


class Migration:
    """A DDL script, sources of its tables, and a folder for the targets."""

    def __init__(self, spark: SparkSession, ddl: str, dialect: str, source: Callable[[str], DataFrame], target: str, *, state: str | None = None, skip_data: bool = False, threads: int = 4, on_event: Callable[[str, str], None] | None = None, sleep=time.sleep):
        self.spark, self.source, self.target, self.threads, self.sleep = spark, source, target, threads, sleep
        self.script: Script = parse_ddl(ddl, dialect)
        self.dialect = dialect
        self.plan: SchemaPlan = _Planner(self.script).all()
        self.steps = migration_steps(self.plan, self.script, skip_data)
        self.state = State(state)
        self.state.load()
        for s in self.steps:
            self.state.status.setdefault(s.id, "waiting")
        self.on_event = on_event or (lambda step, status: None)
        self.cancelled = False
        self.lock = threading.Lock()

    def path(self, table: str) -> str:
        return os.path.join(self.target, table)

    def table(self, name: str) -> DataFrame:
        return read_copy(self.spark, self.path(name))

    def progress(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for v in self.state.status.values():
            out[v] = out.get(v, 0) + 1
        return out

    def cancel(self) -> None:
        """Steps that have not begun do not begin."""
        self.cancelled = True

    def replay(self, step: str) -> None:
        """A step, and all that wait for it, run again with the next run()."""
        again = {step}
        while more := {s.id for s in self.steps if s.needs & again} - again:
            again |= more
        for i in again:
            self.state.status[i], self.state.attempts[i] = "waiting", 0
        self.state.save()

    def replay_level(self, level: int) -> None:
        for s in levels(self.steps)[level]:
            self.replay(s.id)

    def run(self, acknowledged: set[str] | str = frozenset()) -> dict[str, int]:
        """Runs what is waiting; acknowledged: objects whose prerequisites are accepted, or 'all'. Ends with the counts of each status."""
        open_ = [e for e in self.plan.prerequisites if acknowledged != "all" and e.object not in acknowledged]
        if open_:
            raise Blocked(open_)
        for level in levels(self.steps):
            todo = []
            for s in level:
                if self.state.status[s.id] in ("done", "skipped"):
                    continue
                if self.cancelled or any(self.state.status[n] not in ("done", "skipped") for n in s.needs):
                    self.state.status[s.id] = "cancelled"
                    continue
                todo.append(s)
            with ThreadPoolExecutor(self.threads) as pool:
                list(pool.map(self._attempt, todo))
            self.state.save()
        return self.progress()

    def _set(self, step: Step, status: str) -> None:
        with self.lock:  # each change is kept, so that a run that dies forgets no finished copy
            self.state.status[step.id] = status
            self.state.save()
        self.on_event(step.id, status)

    def _attempt(self, step: Step) -> None:
        while True:
            self._set(step, "running")
            n = self.state.attempts[step.id] = self.state.attempts.get(step.id, 0) + 1
            try:
                got = getattr(self, step.kind)(step.object)
                if got is not None:
                    self.state.info[step.id] = got
                self._set(step, "done")
                return
            except ValidationError as e:  # trying again would find the same
                self.state.info[step.id] = str(e)
                self._set(step, "failed")
                return
            except Exception as e:
                self.state.info[step.id] = str(e)[:2_000]
                if n >= ATTEMPTS:
                    self._set(step, "failed")
                    return
                self.sleep(backoff(n))

    # --- kinds of steps ---------------------------------------------------

    def create_database(self, _: str) -> None:
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{os.path.basename(self.target)}`")

    def create_table(self, name: str) -> None:
        """Parquet needs no table before its rows; an empty one gives views something to read."""
        p = self.plan.tables[name]
        self.spark.createDataFrame([], p.schema()).write.mode("ignore").parquet(self.path(name))

    def copy_table(self, name: str):
        p = self.plan.tables[name]
        key = p.primary[0] if len(p.primary) == 1 else None
        src = self.source(name)
        if key is not None:
            key = next((c for c in src.columns if c.lower() == key.lower()), None)
            if key is not None and src.schema[key].dataType.typeName() not in ("long", "integer", "short", "byte", "decimal", "double", "float"):
                key = None
        from ..schema.plan import storage

        got = copy_table(src, self.path(name), {c: storage(t) for c, t in p.targets().items()}, key)
        return {"rows": got.rows, "lost": got.lost}

    def check_keys(self, name: str) -> None:
        bad = {k: n for k, v in self.plan.tables[name].violations(self.table(name)).items() if not k.startswith("foreign") and (n := v.limit(1).count())}
        if bad:
            raise ValidationError(f"{name}: rows break {', '.join(sorted(bad))}")

    def check_foreign_keys(self, name: str) -> None:
        p = self.plan.tables[name]
        parents = {f.table[-1].lower(): self.table(f.table[-1].lower()) for f in p.foreign}
        bad = [k for k, v in p.violations(self.table(name), parents).items() if k.startswith("foreign") and not v.isEmpty()]
        if bad:
            raise ValidationError(f"{name}: rows break {', '.join(bad)}")

    def create_view(self, name: str) -> None:
        for t in self.plan.tables:
            self.table(t).createOrReplaceTempView(t)
        text = self.plan.views[name]
        if name in self.plan.materialized:
            self.spark.sql(text).write.mode("overwrite").parquet(self.path(name))
            self.spark.read.parquet(self.path(name)).createOrReplaceTempView(name)
        else:
            self.spark.sql(text.replace("CREATE OR REPLACE VIEW", "CREATE OR REPLACE TEMPORARY VIEW", 1))

    def create_routine(self, name: str) -> str | None:
        text = self.plan.routines[name]
        if text.upper().startswith("CREATE FUNCTION"):
            try:
                create_function(self.spark, text, self.dialect)
                return None
            except ValueError as e:
                return f"kept as text: {e}"
        return "kept as text"

    def validate(self, _: str):
        out = {}
        for t in self.plan.tables:
            r = validate(self.source(t), self.table(t)).first()
            out[t] = r.source_rows
            if not r.same_rows:
                raise ValidationError(f"{t}: {r.source_rows} rows in the source, {r.target_rows} in the target")
        return out
