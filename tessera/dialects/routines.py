"""Stored routines with data changes: blocks, procedures, functions, cursors, collections, handlers, packages and row triggers.

Control flow runs on the driver, as it would in a database's own interpreter;
every query and every data change in it is one Spark plan.  A data change
writes the rows that it changes to the shared folder, and the table's next
version is a plan over the last one; a log keeps the versions, for AS OF,
savepoints and ROLLBACK, and COMMIT writes a table whole again.  FORALL and
triggers are set-based: one plan for all rows.  A function over columns becomes
an expression in its query's plan (tessera.dialects.inline).  Cursors stream their rows; BULK COLLECT keeps rows as a table and brings them
to the driver only where single elements are asked for.
"""

from __future__ import annotations

import datetime as dt
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dml
from ..operators.sequences import Sequence
from ..operators.versions import Versions
from ..shared import shared_dir
from . import inline
from . import nodes as N
from .emit import Emitter
from .lexer import SqlError
from .parser import Parser
from .rewrite import _children, rewritten


class Raised(Exception):
    """A condition that a handler may take: its name, code and text."""

    def __init__(self, name: str, code: int = 0, text: str = ""):
        super().__init__(text or name)
        self.name, self.code, self.text = name.lower(), code, text or name


class _Leave(Exception):
    def __init__(self, label: str | None, again: bool = False):
        self.label, self.again = label, again


class _Return(Exception):
    def __init__(self, value):
        self.value = value


# Codes of conditions that have names.
_CODES = {"no_data_found": 100, "too_many_rows": -1422, "zero_divide": -1476, "dup_val_on_index": -1, "value_error": -6502, "invalid_number": -1722, "invalid_cursor": -1001, "bulk_errors": -24381}


_AGGREGATES = frozenset("SUM COUNT MIN MAX AVG".split())
#: Functions that give another value each time: what they write is stored at once.
_CHANGING = frozenset("RAND RANDOM UUID SYS_GUID GENERATE_UNIQUE NOW SYSDATE SYSTIMESTAMP CURRENT_TIMESTAMP CURRENT_DATE CURDATE CURTIME LOCALTIMESTAMP LOCALTIME UTC_TIMESTAMP UTC_DATE VALUE NORMAL".split())


class Bulk:
    """What BULK COLLECT fetched: rows numbered from 1 in a stored table, one column of it."""

    def __init__(self, frame: DataFrame, column: str):
        self.frame, self.column, self._values = frame, column, None
        self._count, self._block = None, (-1, {})

    def values(self) -> list:
        if self._values is None:
            self._values = [r[0] for r in self.frame.orderBy("i").select(self.column).collect()]
        return self._values

    def at(self, i: int):
        """One element; the driver holds the 1,000 around the last that was asked for."""
        k = (i - 1) // 1_000
        if self._block[0] != k:
            rows = self.frame.where(F.col("i").between(k * 1_000 + 1, (k + 1) * 1_000)).select("i", self.column).collect()
            self._block = (k, {r[0]: r[1] for r in rows})
        return self._block[1].get(i)

    def __len__(self) -> int:
        if self._count is None:
            self._count = self.frame.count()
        return self._count


@dataclass
class Cursor:
    query: N.Node | None = None
    rows: object = None
    found: bool | None = None
    fetched: int = 0

    @property
    def is_open(self) -> bool:
        return self.rows is not None


class Frame:
    """Variables of a block, under those of the blocks around it."""

    def __init__(self, up: Frame | None = None):
        self.up, self.own, self.codes = up, {}, {}

    def holder(self, name: str) -> Frame | None:
        f = self
        while f is not None:
            if name in f.own:
                return f
            f = f.up
        return None

    def get(self, name: str):
        return self.holder(name).own[name]

    def set(self, name: str, value) -> None:
        at = self.holder(name)
        if at is None:
            raise SqlError(f"{name} is not declared")
        at.own[name] = value

    def code(self, number: int) -> str | None:
        f = self
        while f is not None:
            if number in f.codes:
                return f.codes[number]
            f = f.up
        return None


@dataclass
class Param:
    name: str
    mode: str = "IN"
    default: N.Node | None = None


@dataclass
class Routine:
    name: str
    params: list[Param]
    run: Callable[[Frame], None]
    returns: bool = False
    scope: Frame | None = None  # a package's variables
    text: str = ""  # of a function


@dataclass
class Trigger:
    name: str
    table: str
    when: str  # BEFORE, AFTER
    events: set[str]
    sets: list[tuple[str, N.Node | None, N.Node]] = field(default_factory=list)  # column, condition, value
    inserts: list[tuple[N.Insert, N.Node | None]] = field(default_factory=list)  # with their conditions
    columns: tuple[str, ...] = ()  # UPDATE OF: one of them must be set
    begun: list[Callable] = field(default_factory=list)  # BEFORE STATEMENT
    ended: list[Callable] = field(default_factory=list)  # AFTER STATEMENT
    sums: list[tuple[str, N.Node, N.Node | None]] = field(default_factory=list)  # variables that rows add to: name, value, condition
    declared: list[Callable] = field(default_factory=list)  # variables of a compound trigger, new for each statement


def literal(v) -> N.Node:
    if v is None:
        return N.Lit("null")
    if isinstance(v, bool):
        return N.Lit("bool", v)
    if isinstance(v, (int, Decimal, float)):
        text = format(abs(v), "f") if isinstance(v, Decimal) else repr(abs(v))
        return N.Lit("number", text) if v >= 0 else N.Unary("-", N.Lit("number", text))
    if isinstance(v, dt.datetime):
        return N.Lit("timestamp", v.isoformat(" "))
    if isinstance(v, dt.date):
        return N.Lit("date", v.isoformat())
    if isinstance(v, (list, Bulk)):
        return N.Func(("array",), tuple(map(literal, v if isinstance(v, list) else v.values())))
    return N.Lit("string", str(v))


class Routines:
    """A session's routines, triggers and packages over the temporary views of a Spark session. keys: unique columns by table."""

    def __init__(self, spark: SparkSession, dialect: str, keys: dict[str, list[str]] | None = None):
        self.spark, self.dialect = spark, dialect
        self.keys = {k.lower(): v for k, v in (keys or {}).items()}
        self.known: dict[str, Routine] = {}
        self.triggers: list[Trigger] = []
        self.globals = Frame()
        self.output: list[str] = []
        self.notes: list[str] = []
        self.rowcount = 0
        self.bulk_errors: list[tuple[int, int]] = []
        self.versions = Versions(spark)
        self._inlined: dict[str, inline.Function] = {}

    # --- definitions and calls -------------------------------------------

    def create(self, sql: str) -> None:
        """CREATE PROCEDURE, FUNCTION, TRIGGER or PACKAGE [BODY], one or more."""
        p = _Compiler(sql, self)
        while p.tok.kind != "end":
            if not (p.take(";") or p.take("/")):
                p.definition()

    def run(self, sql: str) -> dict[str, object]:
        """Runs an anonymous block; returns the values of its variables."""
        p = _Compiler(sql, self)
        p.take("DECLARE") if p.oracle else None
        frame = Frame(self.globals)
        p.block(own=False)(frame)
        return {k: v.values() if isinstance(v, Bulk) else v for k, v in frame.own.items() if not isinstance(v, Cursor)}

    def query(self, sql: str) -> DataFrame:
        """Runs a query; its calls of own functions over columns are part of its plan, and AS OF reads earlier versions."""
        p = _Compiler(sql, self)
        return self.rows(p.query(), Frame(self.globals))

    def function(self, r: Routine) -> inline.Function:
        """A function as an expression."""
        if r.name not in self._inlined:
            self._inlined[r.name] = inline.function(r.text, self.dialect)
        return self._inlined[r.name]

    def call(self, name: str, *args):
        """Calls a routine with Python values; a function's value, or a dict of a procedure's OUT and INOUT parameters."""
        r = self.known[name.lower()]
        frame = Frame(r.scope or self.globals)
        for p, a in zip(r.params, [*args, *[None] * (len(r.params) - len(args))]):
            frame.own[p.name] = a if a is not None or p.default is None else self.value(p.default, frame)
        try:
            r.run(frame)
        except _Return as got:
            if r.returns:
                return got.value
        if r.returns:
            raise Raised("function_returned_nothing", -6503)
        return {p.name: frame.own[p.name] for p in r.params if p.mode != "IN"}

    # --- expressions ---------------------------------------------------------

    def told(self, e, frame: Frame, columns: frozenset[str] = frozenset()):
        """A tree with variables, elements, attributes and calls of own functions replaced by values; columns: names that stay."""

        def turn(n):
            if isinstance(n, N.Binary) and n.op == "%" and isinstance(n.left, N.Name):
                got = self.attribute(n, frame)
                if got is not None:
                    return literal(got[0])
            if isinstance(n, N.Name):
                parts = [p.lower() for p in n.parts]
                if len(parts) == 1 and parts[0] not in columns and frame.holder(parts[0]) is not None:
                    return literal(frame.get(parts[0]))
                if len(parts) == 2 and (at := frame.holder(parts[0])) is not None:
                    v = at.own[parts[0]]
                    if isinstance(v, dict):
                        return literal(v.get(parts[1]))
                    if isinstance(v, (list, Bulk)):
                        return literal({"count": lambda: len(v), "first": lambda: 1 if len(v) else None, "last": lambda: len(v) or None}[parts[1]]())
                scope = getattr(self, "_scopes", {}).get(parts[0])
                if len(parts) == 2 and scope is not None and parts[1] in scope.own and not isinstance(scope.own[parts[1]], Routine):
                    return literal(scope.own[parts[1]])
                if len(parts) == 2 and (at := self.globals.holder(".".join(parts))) is not None:
                    return literal(at.own[".".join(parts)])
                return n
            if isinstance(n, N.Func) and n.over is None:
                name = [p.lower() for p in n.name]
                if len(name) == 1 and (at := frame.holder(name[0])) is not None and isinstance(at.own[name[0]], (list, Bulk)) and len(n.args) == 1:
                    v, i = at.own[name[0]], int(self.value(n.args[0], frame))
                    if not 1 <= i <= len(v):
                        raise Raised("subscript_beyond_count", -6533)
                    return literal(v[i - 1] if isinstance(v, list) else v.at(i))
                if len(name) == 2 and name[1] in ("exists", "next", "prior", "count", "first", "last") and (at := frame.holder(name[0])) is not None and isinstance(at.own[name[0]], (list, Bulk)):
                    size = len(at.own[name[0]])
                    i = int(self.value(n.args[0], frame)) if n.args else 0
                    return literal({"exists": 1 <= i <= size, "next": i + 1 if i < size else None, "prior": i - 1 if i > 1 else None, "count": size, "first": 1 if size else None, "last": size or None}[name[1]])
                r = self.known.get(".".join(name))
                if r is not None and r.returns:
                    args = tuple(turn(a) for a in n.args)
                    if any(isinstance(x, (N.Name, N.Star)) or isinstance(x, N.Func) and x.upper in _AGGREGATES for a in args for x in N.every(a)):  # over rows
                        return turn(self.function(r).applied(args))
                    return literal(self.call(r.name, *[self.value(a, frame) for a in args]))
                if name == ["sqlerrm"] or name == ["sqlcode"]:
                    return literal(frame.get(name[0]) if frame.holder(name[0]) else None)
            return _children(n, turn)

        return turn(e)

    def attribute(self, n: N.Binary, frame: Frame):
        left = n.left.parts[-1].lower()
        if left == "sql":
            if isinstance(n.right, N.Func) and n.right.upper == "FIELD":
                inner, what = n.right.args[0], n.right.args[1].value.lower()
                if isinstance(inner, N.Func) and inner.upper == "BULK_EXCEPTIONS":
                    index, code = self.bulk_errors[int(self.value(inner.args[0], frame)) - 1]
                    return (index if what == "error_index" else code,)
            if isinstance(n.right, N.Name):
                parts = [p.lower() for p in n.right.parts]
                if parts == ["bulk_exceptions", "count"]:
                    return (len(self.bulk_errors),)
                return {"rowcount": (self.rowcount,), "found": (self.rowcount > 0,), "notfound": (self.rowcount == 0,), "isopen": (False,)}.get(parts[0])
            return None
        at = frame.holder(left)
        if at is None or not isinstance(at.own[left], Cursor) or not isinstance(n.right, N.Name):
            return None
        c = at.own[left]
        return {"found": (c.found,), "notfound": (None if c.found is None else not c.found,), "isopen": (c.is_open,), "rowcount": (c.fetched,)}.get(n.right.parts[-1].lower())

    def value(self, e, frame: Frame):
        """The value of an expression; constants without a job."""
        e = self.told(e, frame)
        if isinstance(e, N.Lit) and e.kind in ("null", "string", "bool", "number"):
            return None if e.kind == "null" else e.value if e.kind != "number" else int(e.value) if e.value.isdigit() else Decimal(e.value) if "e" not in e.value.lower() else float(e.value)
        if isinstance(e, N.Sub):
            return self.rows(e.query, frame).first()[0]
        return self.guarded(lambda: self.spark.sql("SELECT " + Emitter(self.dialect).expr(rewritten(e, self.dialect))).first()[0])

    def guarded(self, act):
        """act(), with Spark's errors as the conditions that the dialects know."""
        try:
            return act()
        except PySparkException as e:
            kind = e.getCondition() or ""
            name = {"DIVIDE_BY_ZERO": "zero_divide", "CAST_INVALID_INPUT": "value_error", "CAST_OVERFLOW": "value_error", "NUMERIC_VALUE_OUT_OF_RANGE": "value_error", "ARITHMETIC_OVERFLOW": "value_error", "SCALAR_SUBQUERY_TOO_MANY_ROWS": "too_many_rows"}.get(kind.split(".")[0])
            if name is None:
                raise
            raise Raised(name, _CODES[name], str(e).split("\n")[0]) from e

    def columns_of(self, tree) -> frozenset[str]:
        out = set()
        for t in N.every(tree):
            if isinstance(t, N.Table) and self.spark.catalog.tableExists(".".join(t.name)):
                out |= {c.lower() for c in self.spark.table(".".join(t.name)).columns}
        return frozenset(out)

    def rows(self, query, frame: Frame) -> DataFrame:
        tree = N.walk(self.told(query, frame, self.columns_of(query)), lambda n: self.earlier(n, frame) if isinstance(n, N.Table) and n.as_of is not None else n)
        return self.spark.sql(Emitter(self.dialect).query(rewritten(tree, self.dialect)))

    def earlier(self, t: N.Table, frame: Frame) -> N.Table:
        """A table AS OF a number of the log or a time, as a view of that version."""
        at = self.value(t.as_of[1], frame)
        view = f"_version_{uuid.uuid4().hex}"
        try:
            self.versions.at(".".join(t.name), at, t.as_of[0] == "SCN").createOrReplaceTempView(view)
        except KeyError:
            raise Raised("snapshot_too_old", -1555, f"no version of {t.name[-1]} is as old as {at}") from None
        return N.replace(t, name=(view,), alias=t.alias or t.name[-1], as_of=None)

    # --- data changes ----------------------------------------------------------

    def stored(self, df: DataFrame) -> DataFrame:
        path = os.path.join(shared_dir(self.spark), f"routine-{uuid.uuid4().hex}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def change(self, tree, frame: Frame) -> dml.Change:
        """Runs a data change with its triggers; the table's next version takes its name."""
        target = tree.table if isinstance(tree, N.Insert) else (dml._tables(tree.source)[0].name if isinstance(tree, (N.Update, N.Delete)) else tree.target.name)
        name = target[-1].lower()
        event = {N.Insert: "INSERT", N.Update: "UPDATE", N.Delete: "DELETE", N.Merge: "MERGE"}[type(tree)]
        tree = self.told(tree, frame, self.columns_of(tree) | {c.lower() for c in self.spark.table(".".join(target)).columns})
        for t in self.triggers:
            if t.table == name and t.sets and event in t.events:
                tree = self.before(tree, t)
        keys = self.keys.get(name)
        act = {N.Insert: lambda: dml.insert(self.spark, tree, self.dialect, keys), N.Update: lambda: dml.update(self.spark, tree, self.dialect), N.Delete: lambda: dml.delete(self.spark, tree, self.dialect), N.Merge: lambda: dml.merge(self.spark, tree, self.dialect)}[type(tree)]
        assigned = {c.parts[-1].lower() for x in getattr(tree, "assigns", ()) for c in x.columns} | {c.parts[-1].lower() for w in getattr(tree, "whens", ()) for x in w.assigns for c in x.columns}
        fired = [t for t in self.triggers if t.table == name and (event in t.events or event == "MERGE" and t.events) and not (event == "UPDATE" and t.events == {"UPDATE"} and t.columns and not assigned & set(t.columns))]
        frames = {id(t): Frame(self.globals) for t in fired}
        for t in fired:
            for act_ in [*t.declared, *t.begun]:
                act_(frames[id(t)])
        plain = isinstance(tree, N.Insert) and not (tree.ignore or tree.replace or tree.on_duplicate)
        got = self.guarded(act)
        pairs = self.guarded(lambda: self.stored(got.pairs))
        changed = pairs.select(F.coalesce("new", "old").alias("_r")).select("_r.*")
        if plain and keys:
            old = self.spark.table(".".join(target))
            if not changed.join(old, keys, "left_semi").isEmpty() or not changed.groupBy(*keys).count().where("count > 1").isEmpty():
                raise Raised("dup_val_on_index", _CODES["dup_val_on_index"], f"unique key of {name} violated")
        if plain:
            self.versions.appended(".".join(target), changed)
        else:
            fixed = any(isinstance(n, N.Func) and n.upper.split(".")[-1] in _CHANGING for n in N.every(tree))
            self.guarded(lambda: self.versions.replaced(".".join(target), got.table, fixed))
        self.rowcount = pairs.count()
        for t in fired:
            self.after(pairs, t, event, assigned, frames[id(t)])
        return dml.Change(self.spark.table(".".join(target)), changed, pairs)

    def before(self, tree, t: Trigger):
        """BEFORE ... FOR EACH ROW: what it sets becomes part of the values that are written."""
        new = lambda e, of: N.walk(e, lambda n: of(n.parts[-1].lower()) if isinstance(n, N.Name) and n.parts[0].lower() == "new" else N.Name((n.parts[-1],)) if isinstance(n, N.Name) and n.parts[0].lower() == "old" else n)
        if isinstance(tree, N.Insert):
            columns = [c.lower() for c in tree.columns] or [c.lower() for c in self.spark.table(".".join(tree.table)).columns]
            source = tree.source
            if isinstance(source, N.Values):
                source = N.Values(tuple(tuple(N.Lit("null") if isinstance(v, N.Default) else v for v in r) for r in source.rows))
            have = {c: N.Name(("_new", c)) for c in columns}
            for col, cond, value in t.sets:
                old = have.get(col, N.Lit("null"))
                of = lambda c: have.get(c, N.Lit("null"))
                value = new(value, of)
                have[col] = value if cond is None else N.Case(None, ((new(cond, of), value),), old)
            query = N.Select(tuple(N.Item(e, c) for c, e in have.items()), N.Derived(N.Select((N.Item(N.Star()),), N.Derived(source, "_v")) if isinstance(source, N.Values) else source, "_new", tuple(columns)))
            return N.replace(tree, columns=tuple(have), source=query)
        sets = {a.columns[0].parts[-1].lower(): a.value for a in tree.assigns}
        for col, cond, value in t.sets:
            of = lambda c: sets.get(c, N.Name((c,)))
            value, old = new(value, of), of(col)
            sets[col] = value if cond is None else N.Case(None, ((new(cond, of), value),), old)
        return N.replace(tree, assigns=tuple(N.Assign((N.Name((c,)),), v) for c, v in sets.items()))

    def after(self, pairs: DataFrame, t: Trigger, event: str, assigned: set[str], frame: Frame) -> None:
        """AFTER triggers: the inserts of row triggers, one plan for all changed rows, sums over them, then what runs once a statement."""
        count = self.rowcount
        if t.inserts or t.sums:
            view = f"_changed_{uuid.uuid4().hex}"
            pairs.createOrReplaceTempView(view)
            is_null = lambda side, no=False: N.Is(N.Name(("_row", side)), "NULL", None, no)
            events = {"inserting": is_null("old"), "deleting": is_null("new"), "updating": N.Binary("AND", is_null("old", True), is_null("new", True))}

            def seen(n):
                if isinstance(n, N.Name) and len(n.parts) == 2 and n.parts[0].lower() in ("new", "old"):
                    return N.Name(("_row", n.parts[0].lower(), n.parts[1]))
                if isinstance(n, N.Name) and len(n.parts) == 1 and n.parts[0].lower() in events:
                    return events[n.parts[0].lower()]
                if isinstance(n, N.Func) and n.upper == "UPDATING" and len(n.args) == 1 and isinstance(n.args[0], N.Lit):
                    return events["updating"] if n.args[0].value.lower() in assigned else N.Lit("bool", False)
                return n

            own = [e for e in ("INSERT", "UPDATE", "DELETE") if e in t.events]
            about = [N.Name(({"INSERT": "inserting", "UPDATE": "updating", "DELETE": "deleting"}[e],)) for e in own]
            rows = N.walk(about[0] if len(about) == 1 else N.Binary("OR", about[0], about[1]) if len(about) == 2 else N.Lit("bool", True), seen)
            for name, value, cond in t.sums:
                where = rows if cond is None else N.Binary("AND", rows, N.walk(cond, seen))
                query = N.Select((N.Item(N.Func(("sum",), (N.walk(value, seen),)), "s"),), N.Table((view,), "_row"), where)
                more = self.rows(query, frame).first()[0]
                frame.set(name, (frame.get(name) or 0) + (more or 0))
            for ins, cond in t.inserts:
                where = rows if cond is None else N.Binary("AND", rows, N.walk(cond, seen))
                query = N.Select(tuple(N.Item(N.walk(e, seen), f"c{i}") for i, e in enumerate(ins.source.rows[0])), N.Table((view,), "_row"), where)
                self.change(N.replace(ins, source=query), frame)
            self.spark.catalog.dropTempView(view)
        for act in t.ended:
            act(frame)
        self.rowcount = count

    def forall(self, index: str, low: int, high: int, tree, frame: Frame, save: bool) -> None:
        """FORALL: one plan over the collections' rows."""
        used = {n.name[0].lower() for n in N.every(tree) if isinstance(n, N.Func) and len(n.name) == 1 and (at := frame.holder(n.name[0].lower())) is not None and isinstance(at.own[n.name[0].lower()], (list, Bulk))}
        values = {c: frame.get(c) for c in sorted(used)}
        frames = {id(v.frame): v.frame for v in values.values() if isinstance(v, Bulk)}
        if len(frames) == 1 and all(isinstance(v, Bulk) for v in values.values()):
            rows = next(iter(frames.values())).select("i", *[F.col(v.column).alias(f"v_{c}") for c, v in values.items()])
        else:
            plain = {c: v if isinstance(v, list) else v.values() for c, v in values.items()}
            size = min((len(v) for v in plain.values()), default=high)
            rows = self.spark.createDataFrame([(i + 1, *(v[i] for v in plain.values())) for i in range(size)], ["i", *(f"v_{c}" for c in plain)]) if size else None
        if rows is None or high < low:
            self.rowcount = 0
            return
        view = f"_forall_{uuid.uuid4().hex}"
        rows.where(F.col("i").between(low, high)).createOrReplaceTempView(view)

        def turn(n):
            if isinstance(n, N.Func) and len(n.name) == 1 and n.name[0].lower() in used and len(n.args) == 1:
                return N.Name(("_f", f"v_{n.name[0].lower()}"))
            if isinstance(n, N.Name) and len(n.parts) == 1 and n.parts[0].lower() == index:
                return N.Name(("_f", "i"))
            return _children(n, turn)

        over = N.Table((view,), "_f")
        self.bulk_errors = []
        if isinstance(tree, N.Insert):
            (row,) = tree.source.rows
            query = N.Select(tuple(N.Item(turn(v), f"c{i}") for i, v in enumerate(row)), over)
            tree = N.replace(tree, source=query)
            if save:
                tree = self.accepted(tree, query, frame)
        elif isinstance(tree, N.Update):
            tree = N.replace(tree, source=N.Join(tree.source, over, "CROSS"), assigns=tuple(N.replace(a, value=turn(a.value)) for a in tree.assigns), where=turn(tree.where) if tree.where is not None else None)
        elif isinstance(tree, N.Delete):
            tree = N.replace(tree, where=N.Exists(N.Select((N.Item(N.Lit("number", "1")),), over, turn(tree.where))))
        else:
            raise SqlError("FORALL takes INSERT, UPDATE and DELETE")
        if isinstance(tree, (N.Update, N.Delete)):
            tied = [c for c in N.conjuncts(tree.where.query.where if isinstance(tree, N.Delete) else tree.where) if isinstance(c, N.Binary) and c.op == "=" and any(isinstance(n, N.Name) and n.parts[0] == "_f" for n in N.every(c))]
            if not tied:
                self.notes.append("FORALL without an equality with an element compares every row with every element")
        self.change(tree, frame)
        self.spark.catalog.dropTempView(view)
        if self.bulk_errors:
            raise Raised("bulk_errors", _CODES["bulk_errors"], "errors in array DML")

    def accepted(self, tree: N.Insert, query: N.Select, frame: Frame) -> N.Insert:
        """SAVE EXCEPTIONS: the rows that break no unique key; the others are kept as errors by their number."""
        name = ".".join(tree.table)
        keys = self.keys.get(tree.table[-1].lower())
        if not keys:
            raise SqlError(f"SAVE EXCEPTIONS needs the unique key of {name}")
        target = self.spark.table(name)
        columns = list(tree.columns) or target.columns
        numbered = N.replace(query, items=(*query.items, N.Item(N.Name(("_f", "i")), "_i")))
        rows = self.stored(self.rows(numbered, frame).toDF(*columns, "_i"))
        first = rows.groupBy(*keys).agg(F.min("_i").alias("_i")).join(target.select(*keys), keys, "left_anti").select("_i")
        good = self.stored(rows.join(first, "_i", "left_semi"))
        self.bulk_errors = [(r[0], 1) for r in rows.join(first, "_i", "left_anti").orderBy("_i").select("_i").collect()]  # as many as errors are kept
        view = f"_good_{uuid.uuid4().hex}"
        good.select(*columns).createOrReplaceTempView(view)
        return N.replace(tree, source=N.Select((N.Item(N.Star()),), N.Table((view,))))


class _Compiler(Parser):
    """Statements as functions of a frame."""

    def __init__(self, sql: str, session: Routines):
        super().__init__(sql, session.dialect)
        self.s = session
        self.package: str | None = None

    # --- definitions ------------------------------------------------------------

    def definition(self) -> None:
        if self.package is None:
            self.need("CREATE")
            self.take("OR", "REPLACE")
        if self.take("TRIGGER"):
            return self.trigger()
        if self.take("PACKAGE"):
            return self.package_body() if self.take("BODY") else self.package_head()
        kind = self.take_any("PROCEDURE", "FUNCTION") or self.fail("PROCEDURE, FUNCTION, TRIGGER or PACKAGE")
        begun = self.tok.at
        name = self.path()[-1].lower()
        full = f"{self.package}.{name}" if self.package else name
        params: list[Param] = []
        if self.take("("):
            while not self.take(")"):
                mode = self.take_any("INOUT", "OUT") or ("INOUT" if self.take("IN", "OUT") else "IN" if self.take("IN") else None)
                arg = self.ident().lower()
                mode = mode or self.take_any("INOUT", "OUT") or ("INOUT" if self.take("IN", "OUT") else "IN" if self.take("IN") else "IN")
                self.take("NOCOPY")
                self.anchored()
                params.append(Param(arg, mode, self.expr() if self.take(":=") or self.take("DEFAULT") else None))
                self.take(",")
        if kind == "FUNCTION":
            self.take("RETURN") or self.need("RETURNS")
            self.anchored()
        if self.package and self.take(";"):
            return None  # a declaration
        while w := self.take_any("DETERMINISTIC", "IS", "AS", "NO", "READS", "MODIFIES", "CONTAINS", "SQL", "DATA", "LANGUAGE", "EXTERNAL", "ACTION", "PARALLEL_ENABLE", "NOT"):
            if w in ("IS", "AS"):
                break
        body = self.block()
        self.s.known[full] = Routine(full, params, body, kind == "FUNCTION", None, f"CREATE {kind} " + self.sql[begun : self.toks[self.i].at])
        self.s._inlined.pop(full, None)
        return None

    def package_head(self) -> None:
        name = self.path()[-1].lower()
        self.take("IS") or self.need("AS")
        self.members(name, True)

    def package_body(self) -> None:
        name = self.path()[-1].lower()
        self.take("IS") or self.need("AS")
        self.members(name, False)

    def members(self, name: str, head: bool) -> None:
        """Variables are the session's, named package.variable; routines are named package.routine and see the variables plainly."""
        scope = getattr(self.s, "_scopes", {}).get(name) or Frame(self.s.globals)
        self.s._scopes = getattr(self.s, "_scopes", {}) | {name: scope}
        self.package = name
        before = set(self.s.known)
        while not self.at("END") and not self.at("BEGIN"):
            if self.at("PROCEDURE") or self.at("FUNCTION"):
                self.definition()
            else:
                self.variable()(scope)
        if self.take("BEGIN"):
            for act in self.statements("END"):
                act(scope)
        self.need("END")
        self._name()
        for k in set(self.s.known) - before | {k for k in self.s.known if k.startswith(name + ".")}:
            self.s.known[k].scope = scope
        # routines of a package call each other without its name
        for k in [k for k in self.s.known if k.startswith(name + ".")]:
            scope.own.setdefault(k[len(name) + 1 :], self.s.known[k])
        self.package = None

    def trigger(self) -> None:
        name = self.path()[-1].lower()
        compound = self.take("FOR")
        when = "AFTER" if compound else self.take_any("BEFORE", "AFTER") or self.fail("BEFORE or AFTER")
        events, columns = set(), []
        while e := self.take_any("INSERT", "UPDATE", "DELETE"):
            events.add(e)
            if e == "UPDATE" and self.take("OF"):
                columns += [c.lower() for c in self.listed(self.ident)]
            if not self.take("OR"):
                break
        self.need("ON")
        table = self.path()[-1].lower()
        t = Trigger(name, table, when, events, columns=tuple(columns))
        if self.take("COMPOUND", "TRIGGER"):
            self.compound(t)
            self.s.triggers.append(t)
            return
        while self.take("REFERENCING"):
            while w := self.take_any("NEW", "OLD"):
                self.take("AS")
                if self.ident().lower() != w.lower():
                    raise SqlError("REFERENCING other names than NEW and OLD is not supported")
        rows = self.take("FOR", "EACH", "ROW")
        rows or self.take("FOR", "EACH", "STATEMENT")
        cond = None
        if self.take("WHEN"):
            self.need("(")
            cond = self.expr()
            self.need(")")
        if not rows:
            acts = [self.block()]
            if when == "BEFORE":
                t.begun = acts
            else:
                t.ended = acts
            self.s.triggers.append(t)
            return
        begun = self.take("BEGIN")
        while not self.at("END") and self.tok.kind != "end":
            self.trigger_statement(t, cond, when)
            if not begun:
                break
        if begun:
            self.need("END")
            self._name()
        self.s.triggers.append(t)

    def compound(self, t: Trigger) -> None:
        """Sections of a compound trigger: once before and once after the statement, and for each row; they share variables that are new for each statement."""
        while not (self.at("BEFORE") or self.at("AFTER")):
            t.declared.append(self.variable())
        while not self.take("END"):
            side = self.take_any("BEFORE", "AFTER") or self.fail("BEFORE or AFTER")
            rows = self.take("EACH", "ROW")
            rows or self.need("STATEMENT")
            self.need("IS", "BEGIN")
            if rows:
                while not self.at("END"):
                    self.trigger_statement(t, None, side)
            elif side == "BEFORE":
                t.begun += self.statements("END")
            else:
                t.ended += self.statements("END")
            self.need("END", side)
            self.take("EACH", "ROW") or self.need("STATEMENT")
            self.need(";")
        self._name()

    def trigger_statement(self, t: Trigger, cond, side: str) -> None:
        if self.take("IF"):
            before: N.Node | None = None  # no earlier arm holds
            c = self.expr()
            self.need("THEN")
            while True:
                own = c if before is None else N.Binary("AND", before, c)
                both = own if cond is None else N.Binary("AND", cond, own)
                while not (self.at("END") or self.at("ELSE") or self.at("ELSIF") or self.at("ELSEIF")):
                    self.trigger_statement(t, both, side)
                fails = N.Unary("NOT", N.Func(("coalesce",), (c, N.Lit("bool", False))))
                before = fails if before is None else N.Binary("AND", before, fails)
                if self.take_any("ELSIF", "ELSEIF"):
                    c = self.expr()
                    self.need("THEN")
                elif self.take("ELSE"):
                    c = N.Lit("bool", True)
                else:
                    break
            self.need("END", "IF")
            self.take(";")
            return
        if self.take("NULL", ";"):
            return
        if self.at("INSERT"):
            ins = self.insert()
            if side != "AFTER" or not isinstance(ins.source, N.Values):
                raise SqlError("a row trigger's INSERT stands in an AFTER trigger and inserts VALUES")
            t.inserts += [(N.replace(ins, source=N.Values((r,))), cond) for r in ins.source.rows]
            self.take(";")
            return
        self.take("SET")
        if self.tok.kind == "word" and self.ahead().text in (":=", "=") and side == "AFTER":  # a sum over rows
            name = self.ident().lower()
            self.i += 1
            e = self.expr()
            self.need(";")
            if not (isinstance(e, N.Binary) and e.op in "+-" and isinstance(e.left, N.Name) and e.left.parts[-1].lower() == name):
                raise SqlError(f"a row section adds to a variable ({name} := {name} + ...), as rows have no order")
            t.sums.append((name, e.right if e.op == "+" else N.Unary("-", e.right), cond))
            return
        if self.at(":"):
            self.i += 1
        at = self.row_name()
        if side != "BEFORE" or at[0] != "new":
            raise SqlError("a trigger sets columns of the new row, before it is written")
        self.take(":=") or self.need("=")
        t.sets.append((at[1], cond, self.expr()))
        self.take(";")

    def row_name(self) -> tuple[str, str]:
        if self.tok.kind == "param":
            first = self.tok.text.lstrip(":").lower()
            self.i += 1
        else:
            first = self.ident().lower()
        self.need(".")
        return first, self.ident().lower()

    def primary(self) -> N.Node:
        if self.tok.kind == "param" and self.tok.text.lower() in (":new", ":old") and self.ahead().text == ".":
            return N.Name(self.row_name())
        return super().primary()

    # --- blocks --------------------------------------------------------------------

    def anchored(self) -> None:
        """A type; values keep their own."""
        self.type()
        while self.take("."):
            self.ident()
        while self.take("%"):
            self.ident()

    def variable(self) -> Callable[[Frame], None]:
        if self.take("PRAGMA"):
            what = self.ident().lower()
            if what != "exception_init":
                self._skip_parens()
                self.need(";")
                return lambda f: None
            self.need("(")
            name = self.ident().lower()
            self.need(",")
            code = -1 if self.take("-") else 1
            code *= int(self.primary().value)
            self.need(")")
            self.need(";")
            return lambda f: f.codes.__setitem__(code, name)
        if self.take("TYPE") or self.take("SUBTYPE"):
            while not self.take(";"):
                self.i += 1
            return lambda f: None
        if self.take("CURSOR"):
            return self.cursor(self.ident().lower())
        names = [self.ident().lower()]
        while self.take(","):
            names.append(self.ident().lower())
        if self.take("CURSOR"):  # MySQL, DB2
            self.i -= 1
            return self.cursor(names[0])
        self.take("CONSTANT")
        if self.take("EXCEPTION"):
            self.need(";")
            return lambda f: None
        start = self.tok.upper
        self.anchored()
        self.take("NOT", "NULL")
        value = self.expr() if self.take(":=") or self.take("DEFAULT") else None
        self.need(";")

        def act(f):
            for n in names:
                f.own[n] = Cursor() if start in ("SYS_REFCURSOR",) else self.evaluated(value, f)

        return act

    def evaluated(self, e, f: Frame):
        """A value; a collection's constructor gives a list."""
        if e is None:
            return None
        if isinstance(e, N.Func) and len(e.name) == 1 and e.over is None and (e.upper not in _SCALARS and self.s.known.get(e.name[0].lower()) is None and f.holder(e.name[0].lower()) is None and _is_type_name(e.name[0])):
            return [self.s.value(a, f) for a in e.args]
        return self.s.value(e, f)

    def cursor(self, name: str) -> Callable[[Frame], None]:
        self.take("CURSOR")
        if self.at("("):
            raise SqlError("cursors with parameters are not supported")
        self.take("IS") or self.take("WITH", "HOLD", "FOR") or self.need("FOR")
        q = self.query()
        self.need(";")
        return lambda f: f.own.__setitem__(name, Cursor(q))

    def block(self, own: bool = True) -> Callable[[Frame], None]:
        """own: the block's variables are its own; else the frame's, which shows them to the caller."""
        begin: list[Callable] = []
        if not self.oracle and not self.at("BEGIN"):  # a body of one statement
            return self.one()
        while not self.at("BEGIN"):
            self.take("DECLARE")
            begin.append(self.variable())
        self.need("BEGIN")
        self.take("ATOMIC") or self.take("NOT", "ATOMIC")
        handlers: list[tuple[str, list[str], list[Callable]]] = []
        while not self.oracle and self.at("DECLARE"):
            self.need("DECLARE")
            if how := self.take_any("EXIT", "CONTINUE", "UNDO"):
                self.need("HANDLER", "FOR")
                names = self.listed(self.condition_name)
                handlers.append((how, list(names), [self.one()]))
            elif self.ahead().upper == "CONDITION":
                name = self.ident().lower()
                self.need("CONDITION", "FOR")
                self.condition_name()
                self.need(";")
                del name
            else:
                begin.append(self.variable())
        body = self.statements("END", "EXCEPTION")
        if self.take("EXCEPTION"):
            while self.take("WHEN"):
                names = [self.ident().lower()]
                while self.take("OR"):
                    names.append(self.ident().lower())
                self.need("THEN")
                handlers.append(("EXIT", names, self.statements("WHEN", "END")))
        self.need("END")
        self._name()

        def run(up: Frame) -> None:
            f = Frame(up) if own else up
            for act in begin:
                act(f)
            keep_on = [h for h in handlers if h[0] == "CONTINUE"]
            try:
                for act in body:
                    try:
                        act(f)
                    except Raised as e:
                        if not self.handled(e, keep_on, f):
                            raise
            except Raised as e:
                if not self.handled(e, [h for h in handlers if h[0] != "CONTINUE"], f):
                    raise

        return run

    def handled(self, e: Raised, handlers, f: Frame) -> bool:
        names = {e.name, f.code(e.code) or e.name}
        general = {"others"} if e.name != "no_data_found" or self.oracle else set()
        general |= {"not found"} if e.name == "no_data_found" else {"sqlexception"}
        general |= {f"sqlstate {e.code}", str(e.code)}
        for _, wanted, acts in sorted(handlers, key=lambda h: bool({"others", "sqlexception"} & set(h[1]))):
            if names & set(wanted) or general & set(wanted):
                inner = Frame(f)
                inner.own |= {"sqlerrm": e.text, "sqlcode": e.code, "_raised": e}
                for act in acts:
                    act(inner)
                return True
        return False

    def condition_name(self) -> str:
        if self.take("NOT", "FOUND"):
            return "not found"
        if self.take("SQLSTATE"):
            self.take("VALUE")
            return f"sqlstate {self.primary().value}"
        if self.tok.kind == "number":
            return self.primary().value
        return self.ident().lower()

    def _name(self) -> None:
        if self.tok.kind in ("word", "quoted") and not self.at("WHEN") and self.tok.upper not in ("PROCEDURE", "FUNCTION", "CREATE"):
            self.i += 1
        self.take(";")

    def statements(self, *ends: str) -> list[Callable]:
        out = []
        while not any(self.at(e) for e in ends):
            if self.tok.kind == "end":
                self.fail(" or ".join(ends))
            out.append(self.one())
        return out

    # --- statements ------------------------------------------------------------------

    def one(self) -> Callable[[Frame], None]:
        label = None
        if self.at("<<"):
            self.i += 1
            label = self.ident().lower()
            self.need(">>")
        elif self.ahead().text == ":" and self.tok.kind == "word":
            label = self.ident().lower()
            self.need(":")
        if self.take("NULL", ";"):
            return lambda f: None
        if self.take("IF"):
            return self.if_()
        if self.at("CASE"):
            return self.case_()
        if self.take("WHILE"):
            cond = self.expr()
            self.take("LOOP") or self.need("DO")
            return self.looped(label, self.body("END"), before=cond)
        if self.take("REPEAT"):
            acts = self.statements("UNTIL")
            self.need("UNTIL")
            cond = self.expr()
            self.need("END", "REPEAT")
            self._name()
            return self.looped(label, acts, after=cond)
        if self.take("LOOP"):
            return self.looped(label, self.body("END"))
        if self.take("FOR"):
            return self.for_(label)
        if self.take("FORALL"):
            return self.forall()
        if w := self.take_any("EXIT", "LEAVE", "CONTINUE", "ITERATE"):
            to = self.ident().lower() if self.tok.kind in ("word", "quoted") and not self.at("WHEN") else None
            cond = self.expr() if self.take("WHEN") else None
            self.need(";")

            def leave(f, again=w in ("CONTINUE", "ITERATE")):
                if cond is None or self.s.value(cond, f):
                    raise _Leave(to, again)

            return leave
        if self.at("BEGIN") or self.at("DECLARE"):
            self.take("DECLARE") if self.oracle else None
            return self.block()
        if self.at("SELECT") or self.at("WITH"):
            return self.select_into()
        if self.tok.upper in ("INSERT", "UPDATE", "DELETE", "MERGE", "REPLACE"):
            return self.data_change()
        if self.take("EXECUTE", "IMMEDIATE"):
            return self.dynamic()
        if self.take("OPEN"):
            name = self.ident().lower()
            q = self.query() if self.take("FOR") else None
            self.need(";")

            def open_(f):
                c = f.get(name)
                c = c if isinstance(c, Cursor) else Cursor()
                f.set(name, c)
                c.query = q or c.query
                c.rows, c.found, c.fetched = self.s.rows(c.query, f).toLocalIterator(), None, 0

            return open_
        if self.take("CLOSE"):
            name = self.ident().lower()
            self.need(";")
            return lambda f: setattr(f.get(name), "rows", None)
        if self.take("FETCH"):
            return self.fetch()
        if self.take("RETURN"):
            e = None if self.at(";") else self.expr()
            self.need(";")

            def give(f):
                raise _Return(None if e is None else self.evaluated(e, f))

            return give
        if self.take("RAISE"):
            name = self.ident().lower() if self.tok.kind == "word" else None
            self.need(";")

            def raise_(f):
                raise f.get("_raised") if name is None else Raised(name, _CODES.get(name, 1), name)

            return raise_
        if self.take("RAISE_APPLICATION_ERROR", "("):
            args = self.listed(self.expr)
            self.need(")")
            self.need(";")

            def error(f):
                code = int(self.s.value(args[0], f))
                raise Raised(f.code(code) or "application_error", code, str(self.s.value(args[1], f)))

            return error
        if w := self.take_any("SIGNAL", "RESIGNAL"):
            state = "45000"
            if self.take("SQLSTATE"):
                self.take("VALUE")
                state = self.primary().value
            text = None
            if self.take("SET", "MESSAGE_TEXT"):
                self.need("=")
                text = self.expr()
            self.need(";")

            def signal(f):
                if w == "RESIGNAL" and text is None:
                    raise f.get("_raised")
                raise Raised(f"sqlstate {state}", int(state) if state.isdigit() else 1, str(self.s.value(text, f)) if text is not None else state)

            return signal
        if w := self.take_any("COMMIT", "ROLLBACK", "SAVEPOINT"):
            self.take("WORK")
            name = None
            if w == "SAVEPOINT":
                name = self.ident().lower()
            elif w == "ROLLBACK" and self.take("TO"):
                self.take("SAVEPOINT")
                name = self.ident().lower()
            while not self.take(";"):
                self.i += 1
            if w == "COMMIT":
                return lambda f: self.s.versions.commit()
            if w == "SAVEPOINT":
                return lambda f: self.s.versions.savepoint(name)

            def undo(f):
                try:
                    self.s.versions.rollback(name)
                except KeyError:
                    raise Raised("no_such_savepoint", -1086, f"savepoint {name} was never set") from None

            return undo
        if self.take("SET"):
            acts = [self.assign_one()]
            while self.take(","):
                acts.append(self.assign_one())
            self.need(";")
            return lambda f: [a(f) for a in acts] and None
        self.take("CALL")
        return self.call_or_assign()

    def assign_one(self):
        name = self.ident().lower()
        self.take("=") or self.need(":=")
        e = self.expr()
        return lambda f: f.set(name, self.evaluated(e, f))

    def call_or_assign(self):
        path = tuple(p.lower() for p in self.path())
        args: tuple = ()
        if self.take("("):
            args = self.listed(self.argument) if not self.at(")") else ()
            self.need(")")
        if self.take(":="):
            e = self.expr()
            self.need(";")

            def put(f):
                v = self.evaluated(e, f)
                if args:  # an element of a collection
                    own, i = f.get(path[0]), self.s.value(args[0], f)
                    if isinstance(i, str) and not i.lstrip("-").isdigit():
                        raise SqlError(f"{path[0]}('{i}'): collections are indexed by numbers here")
                    i = int(i)
                    own = own if isinstance(own, list) else list(own.values()) if own is not None else []
                    own += [None] * (i - len(own))
                    own[i - 1] = v
                    f.set(path[0], own)
                elif len(path) == 2 and f.holder(path[0]) is None:
                    self.package_variable(path, f).own[path[1]] = v
                elif len(path) == 2:
                    f.get(path[0])[path[1]] = v
                else:
                    f.set(path[0], v)

            return put
        self.need(";")
        if path[0] == "dbms_output":
            return lambda f: self.s.output.append(str(self.s.value(args[0], f))) if args and path[-1].startswith("put") else None
        if len(path) == 2 and path[1] in ("extend", "trim", "delete"):

            def resize(f):
                own = f.get(path[0])
                own = list(own if isinstance(own, list) else own.values() if own is not None else [])
                n = int(self.s.value(args[0], f)) if args else 1
                f.set(path[0], own + [None] * n if path[1] == "extend" else own[: len(own) - n] if path[1] == "trim" else [] if not args else [x for i, x in enumerate(own, 1) if i != n])

            return resize

        def call(f):
            r = self.s.known.get(".".join(path))
            if r is None and len(path) == 1 and (at := f.holder(path[0])) is not None and isinstance(at.own[path[0]], Routine):
                r = at.own[path[0]]
            if r is None:
                raise SqlError(f"{'.'.join(path)} is not a known procedure")
            named = {a[0]: a[1] for a in args if isinstance(a, tuple)}
            given = dict(zip([p.name for p in r.params], [a for a in args if not isinstance(a, tuple)])) | named
            values = [self.s.value(given[p.name], f) if p.name in given and p.mode != "OUT" else None for p in r.params]
            out = self.s.call(r.name, *values)
            for p in r.params:
                if p.mode != "IN" and p.name in given:
                    f.set(given[p.name].parts[-1].lower() if isinstance(given[p.name], N.Name) else given[p.name].name.lower(), out[p.name])

        return call

    def package_variable(self, path, f: Frame) -> Frame:
        scope = getattr(self.s, "_scopes", {}).get(path[0])
        if scope is None:
            raise SqlError(f"{'.'.join(path)} is not declared")
        return scope

    def argument(self):
        if self.tok.kind == "word" and self.ahead().text == "=>":
            name = self.ident().lower()
            self.i += 1
            return (name, self.expr())
        return self.expr()

    def body(self, end: str) -> list[Callable]:
        acts = self.statements(end)
        self.need(end)
        self.take_any("LOOP", "WHILE", "FOR")
        self._name()
        return acts

    def looped(self, label, acts, before=None, after=None):
        def run(f):
            while before is None or self.s.value(before, f):
                if self.turn(label, acts, f):
                    break
                if after is not None and self.s.value(after, f):
                    break

        return run

    def turn(self, label, acts, f) -> bool:
        """One turn of a loop; True where it ends the loop."""
        try:
            for act in acts:
                act(f)
        except _Leave as e:
            if e.label not in (None, label):
                raise
            return not e.again
        return False

    def if_(self):
        parts = []
        cond = self.expr()
        self.need("THEN")
        parts.append((cond, self.statements("ELSIF", "ELSEIF", "ELSE", "END")))
        while self.take_any("ELSIF", "ELSEIF"):
            cond = self.expr()
            self.need("THEN")
            parts.append((cond, self.statements("ELSIF", "ELSEIF", "ELSE", "END")))
        rest = self.statements("END") if self.take("ELSE") else []
        self.need("END", "IF")
        self.need(";")

        def run(f):
            acts = next((a for c, a in parts if self.s.value(c, f)), rest)
            for act in acts:
                act(f)

        return run

    def case_(self):
        self.need("CASE")
        arg = None if self.at("WHEN") else self.expr()
        parts = []
        while self.take("WHEN"):
            c = self.expr()
            self.need("THEN")
            parts.append((c if arg is None else N.Binary("=", arg, c), self.statements("WHEN", "ELSE", "END")))
        rest = self.statements("END") if self.take("ELSE") else None
        self.need("END", "CASE")
        self.need(";")

        def run(f):
            acts = next((a for c, a in parts if self.s.value(c, f)), rest)
            if acts is None:
                raise Raised("case_not_found", -6592)
            for act in acts:
                act(f)

        return run

    def for_(self, label):
        name = self.ident().lower()
        if self.take("AS"):  # DB2
            q = self.query()
            self.need("DO")
        else:
            self.need("IN")
            reverse = self.take("REVERSE")
            if self.at("(", "SELECT") or self.at("(", "WITH"):
                self.need("(")
                q = self.query()
                self.need(")")
            elif self.ahead().upper == "LOOP" and self.tok.kind == "word":
                q = self.ident().lower()
            else:
                low = self.sum()
                self.need("..")
                high = self.sum()
                self.need("LOOP")
                acts = self.body("END")

                def count(f):
                    a, b = int(self.s.value(low, f)), int(self.s.value(high, f))
                    for i in range(b, a - 1, -1) if reverse else range(a, b + 1):
                        own = Frame(f)
                        own.own[name] = i
                        if self.turn(label, acts, own):
                            break

                return count
            self.need("LOOP")
        acts = self.body("END")

        def run(f):
            query = f.get(q).query if isinstance(q, str) else q
            for r in self.s.rows(query, f).toLocalIterator():
                own = Frame(f)
                own.own[name] = {k.lower(): v for k, v in r.asDict().items()}
                if self.turn(label, acts, own):
                    break

        return run

    def targets(self) -> tuple[str, ...]:
        return self.listed(lambda: self.ident().lower() if self.tok.kind != "param" else self.param())

    def param(self) -> str:
        t = self.tok.text.lstrip(":@").lower()
        self.i += 1
        return t

    def select_into(self):
        """SELECT ... [BULK COLLECT] INTO ...: found at its depth, then read as a query without it."""
        start, depth, at, bulk = self.i, 0, None, False
        while not (self.at(";") and not depth) and self.tok.kind != "end":
            depth += self.at("(") - self.at(")")
            if not depth and at is None and (self.at("INTO") or self.at("BULK", "COLLECT", "INTO")):
                at, bulk = self.i, self.at("BULK")
            self.i += 1
        if at is None:
            self.i = start
            q = self.query()
            self.need(";")
            return lambda f: None if self.s.rows(q, f).isEmpty() else None
        self.i = at + (3 if bulk else 1)
        names = self.targets()
        self.toks = self.toks[:at] + self.toks[self.i :]
        self.i = start
        q = self.query()
        self.need(";")

        def run(f):
            if bulk:
                return self.bulk(self.s.rows(q, f), names, f)
            got = self.s.guarded(lambda: self.s.rows(q, f).limit(2).collect())
            if not got:
                raise Raised("no_data_found", 100, "no data found")
            if len(got) > 1:
                raise Raised("too_many_rows", -1422, "more than one row")
            self.put(names, got[0], f)

        return run

    def put(self, names, row, f) -> None:
        if len(names) == 1 and len(row) > 1:
            f.set(names[0], {k.lower(): v for k, v in row.asDict().items()})
            return
        for n, v in zip(names, row):
            f.set(n, v)

    def bulk(self, rows: DataFrame, names, f) -> None:
        cols = [f"c{i}" for i in range(len(names))]
        held = self.s.stored(rows.toDF(*cols))
        held = self.s.stored(Sequence("bulk").numbered(held, "i"))
        for n, c in zip(names, cols):
            f.set(n, Bulk(held, c))

    def fetch(self):
        name = self.ident().lower()
        bulk = self.take("BULK", "COLLECT")
        self.need("INTO")
        names = self.targets()
        limit = self.expr() if self.take("LIMIT") else None
        self.need(";")

        def run(f):
            c = f.get(name)
            if not c.is_open:
                raise Raised("invalid_cursor", -1001)
            if bulk:
                n = int(self.s.value(limit, f)) if limit is not None else None
                got = []
                for r in c.rows:
                    got.append(r)
                    if n is not None and len(got) >= n:
                        break
                c.found, c.fetched = len(got) == n if n is not None else bool(got), c.fetched + len(got)
                for k, v in enumerate(names):
                    f.set(v, [r[k] for r in got])
                return
            row = next(c.rows, None)
            c.found = row is not None
            if row is None:
                if not self.oracle:
                    raise Raised("no_data_found", 100, "no data")
                return
            c.fetched += 1
            self.put(names, row, f)

        return run

    def data_change(self):
        tree = {"INSERT": self.insert, "REPLACE": self.insert, "UPDATE": self.update, "DELETE": self.delete, "MERGE": self.merge}[self.tok.upper]()
        given, names = (), ()
        if self.take("RETURNING") or self.take("RETURN"):
            given = self.listed(self.expr)
            self.take("BULK", "COLLECT")
            self.need("INTO")
            names = self.targets()
        self.need(";")

        def run(f):
            got = self.s.change(tree, f)
            if names:
                rows = got.changed.select(*[F.expr(Emitter(self.dialect).expr(rewritten(e, self.dialect))).alias(f"c{i}") for i, e in enumerate(given)]).limit(2).collect()
                if rows:
                    self.put(names, rows[0], f)

        return run

    def forall(self):
        index = self.ident().lower()
        self.need("IN")
        low = self.sum()
        self.need("..")
        high = self.sum()
        save = self.take("SAVE", "EXCEPTIONS")
        tree = {"INSERT": self.insert, "UPDATE": self.update, "DELETE": self.delete}.get(self.tok.upper, lambda: self.fail("INSERT, UPDATE or DELETE"))()
        self.need(";")
        return lambda f: self.s.forall(index, int(self.s.value(low, f) or 1), int(self.s.value(high, f) or 0), tree, f, save)

    def dynamic(self):
        text = self.expr()
        names = self.targets() if self.take("INTO") else ()
        using = self.listed(lambda: (self.take("IN"), self.expr())[1]) if self.take("USING") else ()
        self.need(";")

        def run(f):
            own = Frame(f)
            inner = _Compiler(str(self.s.value(text, f)).rstrip().rstrip(";") + ";", self.s)
            values = iter([self.s.value(u, f) for u in using])
            bound: dict[str, object] = {}
            tree = inner.query() if inner.at("SELECT") or inner.at("WITH") else None
            if tree is None:
                if inner.tok.upper not in ("INSERT", "UPDATE", "DELETE", "MERGE"):
                    inner.one()(own)
                    return
                tree = {"INSERT": inner.insert, "UPDATE": inner.update, "DELETE": inner.delete, "MERGE": inner.merge}[inner.tok.upper]()

            def bind(n):
                if isinstance(n, N.Param):
                    if n.name not in bound:
                        bound[n.name] = next(values)
                    return literal(bound[n.name])
                return _children(n, bind)

            tree = bind(tree)
            if isinstance(tree, (N.Insert, N.Update, N.Delete, N.Merge)):
                self.s.change(tree, own)
                return
            got = self.s.rows(tree, own).limit(2).collect()
            if names:
                if not got:
                    raise Raised("no_data_found", 100, "no data found")
                self.put(names, got[0], f)

        return run


_SCALARS = frozenset("UPPER LOWER SUBSTR NVL COALESCE ROUND TRUNC MOD ABS LENGTH CONCAT REPLACE TO_CHAR TO_NUMBER TO_DATE DECODE GREATEST LEAST SIGN POWER SQRT TRIM INSTR SYSDATE FLOOR CEIL IFNULL NOW".split())


def _is_type_name(name: str) -> bool:
    """A constructor's name: no function of Spark has it."""
    from .emit import known_functions

    return name.lower() not in known_functions()
