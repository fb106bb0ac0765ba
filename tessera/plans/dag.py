"""The steps of a migration and what each waits for."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..dialects import nodes as N
from ..dialects.ddl import Script
from ..schema.plan import SchemaPlan


@dataclass
class Step:
    """kind: create_database, create_table, copy_table, check_keys, check_foreign_keys, create_view, create_routine or validate."""

    id: str
    kind: str
    object: str = ""
    needs: set[str] = field(default_factory=set)


class CycleError(ValueError):
    """Steps wait for each other."""


def levels(steps: list[Step]) -> list[list[Step]]:
    """Steps in levels: those of a level wait only for earlier ones and may run together."""
    left, done, out = {s.id: s for s in steps}, set(), []
    unknown = {n for s in steps for n in s.needs} - set(left)
    if unknown:
        raise ValueError(f"unknown steps: {sorted(unknown)}")
    while left:
        ready = [s for s in left.values() if s.needs <= done]
        if not ready:
            raise CycleError(f"steps wait for each other: {sorted(left)}")
        out.append(ready)
        done |= {s.id for s in ready}
        for s in ready:
            del left[s.id]
    return out


def view_needs(script: Script) -> dict[str, set[str]]:
    """For each view, the other views that its query reads: from the tree, not from the text."""
    names = set(script.views)
    out = {}
    for v, d in script.views.items():
        ctes = {c.name.lower() for c in N.every(d.query) if isinstance(c, N.Cte)}
        out[v] = {n.name[-1].lower() for n in N.every(d.query) if isinstance(n, N.Table)} & names - ctes - {v}
    return out


def migration_steps(plan: SchemaPlan, script: Script, skip_data: bool = False, create_database: bool = False) -> list[Step]:
    """Create, copy, check, then views in the order of their dependencies, then validate."""
    steps: list[Step] = []
    base: set[str] = set()
    if create_database:
        steps.append(Step("create_database", "create_database"))
        base = {"create_database"}
    for t in plan.tables:
        steps.append(Step(f"create_table:{t}", "create_table", t, set(base)))
        if not skip_data:
            steps.append(Step(f"copy_table:{t}", "copy_table", t, {f"create_table:{t}"}))
    loaded = lambda t: f"create_table:{t}" if skip_data else f"copy_table:{t}"
    for t, p in plan.tables.items():
        steps.append(Step(f"check_keys:{t}", "check_keys", t, {loaded(t)}))
        if p.foreign:
            steps.append(Step(f"check_foreign_keys:{t}", "check_foreign_keys", t, {f"check_keys:{t}"} | {f"check_keys:{f.table[-1].lower()}" for f in p.foreign}))
    needs = view_needs(script)
    for v in plan.views:
        steps.append(Step(f"create_view:{v}", "create_view", v, {loaded(t) for t in plan.tables} | {f"create_view:{n}" for n in needs.get(v, ()) if n in plan.views}))
    for r in plan.routines:
        steps.append(Step(f"create_routine:{r}", "create_routine", r, {loaded(t) for t in plan.tables}))
    if not skip_data:
        steps.append(Step("validate", "validate", "", {f"check_keys:{t}" for t in plan.tables}))
    return steps
