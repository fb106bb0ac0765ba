"""Parts of a query that need a job before its plan: shares of an ordered result, row numbers, and numbers of sequences.

Spark SQL says these by a window over everything, which is one task.  Here the
part is run to a written table whose rows know their place in the order
(tessera.operators.ordering), and the query reads that.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordering
from ..operators.sequences import Sequence
from . import nodes as N
from .emit import Emitter
from .lexer import SqlError, is_mysql
from .rewrite import rewritten


def _view(df: DataFrame) -> str:
    name = f"_staged_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    return name


def _run(spark: SparkSession, q, dialect: str, options: dict) -> DataFrame:
    return spark.sql(Emitter(dialect, **options).query(rewritten(q, dialect)))


def _sorted(s, dialect: str) -> list:
    high = not is_mysql(dialect) and dialect != "spark"
    out = []
    for i, o in enumerate(s.order):
        last = (o.nulls or ("LAST" if high != o.desc else "FIRST")) == "LAST"
        c = F.col(f"_o{i}")
        out.append((c.desc_nulls_last() if last else c.desc_nulls_first()) if o.desc else (c.asc_nulls_last() if last else c.asc_nulls_first()))
    return out


def percent(spark: SparkSession, s, dialect: str, options: dict):
    """FETCH FIRST n PERCENT ROWS ONLY, by the places of the sort. Rows that tie with the last are WITH TIES' matter, which is a rank."""
    if s.limit is None or not s.limit.percent or s.limit.ties:
        return s
    if isinstance(s, N.SetOp):
        s = N.Select((N.Item(N.Star()),), N.Derived(replace(s, order=(), limit=None), "_s"), order=s.order, limit=s.limit)
    numbers = [s.limit.count, s.limit.offset or N.Lit("number", "0")]
    if not all(isinstance(v, N.Lit) and v.kind == "number" for v in numbers):
        return s
    share, skip = (float(v.value) for v in numbers)
    sort = tuple(N.Item(o.expr, f"_o{i}") for i, o in enumerate(s.order))
    if s.distinct:
        return s
    whole = _run(spark, replace(s, items=s.items + sort, order=(), limit=None), dialect, options)
    names = whole.columns[: len(whole.columns) - len(sort)]
    if len(set(names)) < len(names):
        return s
    rows, total = ordering.placed(whole, _sorted(s, dialect))
    most = math.ceil(total * share / 100)
    kept = rows.where((F.col("_place") >= int(skip)) & (F.col("_place") < int(skip) + most))
    return N.Select(tuple(N.Item(N.Name((n,))) for n in names), N.Table((_view(kept),)), order=(N.Order(N.Name(("_place",))),))


def _calls(e) -> list[N.Func]:
    return [n for n in N.every(e) if isinstance(n, N.Func) and n.upper in ("NEXTVAL", "CURRVAL") and len(n.args) == 1]


def numbers(spark: SparkSession, s, dialect: str, sequences: dict[str, Sequence], options: dict):
    """seq.NEXTVAL in a select list: a stretch of numbers is set apart for all rows, and each takes the one of its place. Every mention of a sequence in a row is the same number."""
    if not isinstance(s, N.Select) or not _calls(s.items):
        return s
    if s.distinct or s.group or s.having is not None:
        raise SqlError("NEXTVAL stands in a query of plain rows")
    if _calls((s.where, s.order)):
        raise SqlError("NEXTVAL stands in a select list")
    known = {k.lower(): v for k, v in sequences.items()}
    for c in _calls(s.items):
        if c.args[0].value.lower() not in known:
            raise SqlError(f"sequence {c.args[0].value} is not known")
    next_ = {c.args[0].value.lower() for c in _calls(s.items) if c.upper == "NEXTVAL"}

    def current(n):  # CURRVAL without NEXTVAL in the row is the session's last number
        if isinstance(n, N.Func) and n.upper == "CURRVAL" and n.args[0].value.lower() not in next_:
            return N.Lit("number", str(known[n.args[0].value.lower()].currval()))
        return n

    s = N.walk(s, current)
    if not next_:
        return s
    inner: dict[N.Node, str] = {}

    def lifted(e):
        if isinstance(e, N.Func) and e.upper in ("NEXTVAL", "CURRVAL"):
            return N.Name((f"_n_{e.args[0].value.lower()}",))
        if not _calls(e):
            return N.Name((inner.setdefault(e, f"_x{len(inner)}"),)) if any(isinstance(x, (N.Name, N.Func, N.Sub)) for x in N.every(e)) else e
        return N.children(e, lifted)

    if any(isinstance(i.expr, N.Star) for i in s.items):
        raise SqlError("NEXTVAL beside * is not supported: name the columns")
    items = tuple(N.Item(lifted(i.expr), i.alias or (i.expr.parts[-1] if isinstance(i.expr, N.Name) else f"_c{k}" if not _calls(i.expr) else "nextval")) for k, i in enumerate(s.items))
    below = replace(s, items=tuple(N.Item(e, n) for e, n in inner.items()) or (N.Item(N.Lit("number", "1"), "_one"),), order=tuple(s.order))
    rows = _run(spark, replace(below, order=()), dialect, options) if s.limit is None and not s.order else _run(spark, below, dialect, options)
    rows, total = ordering.placed(rows, [])
    for name in sorted(next_):
        seq = known[name]
        first = seq.take(total)
        rows = rows.withColumn(f"_n_{name}", F.lit(first).cast("long") + F.lit(seq.step) * F.col("_place"))
    return N.Select(items, N.Table((_view(rows),)))


def row_numbers(spark: SparkSession, tree, dialect: str, options: dict):
    """After all rewrites: queries that number their rows (ROWNUM in a list), where they can run by themselves."""

    def each(n):
        if not isinstance(n, N.Select):
            return n
        at = [i for i in n.items if isinstance(i.expr, N.Func) and i.expr.upper == "MONOTONIC_ROW_NUMBER"]
        if len(at) != 1 or n.order:
            return n
        try:
            rows = spark.sql(Emitter(dialect, **options).query(replace(n, items=tuple(i for i in n.items if i is not at[0]))))
        except AnalysisException:  # it reads a CTE or columns of a query around it
            return n
        if len(set(rows.columns)) < len(rows.columns):
            return n
        numbered, _ = ordering.placed(rows, [])
        return N.Select((N.Item(N.Star()),), N.Table((_view(numbered.withColumn(at[0].alias, F.col("_place") + 1).drop("_place")),)))

    return N.walk(tree, each)


def before(spark: SparkSession, tree, dialect: str, sequences: dict[str, Sequence], options: dict):
    """Before the rewrites: the query itself and derived tables that stand alone."""
    if getattr(tree, "ctes", ()) or not isinstance(tree, (N.Select, N.SetOp)):
        return tree

    def each(n):
        if isinstance(n, N.Derived) and not n.lateral and isinstance(n.query, (N.Select, N.SetOp)) and getattr(n.query, "limit", None) is not None and n.query.limit.percent:
            return replace(n, query=percent(spark, n.query, dialect, options))
        return n

    tree = N.walk(tree, each)
    return percent(spark, numbers(spark, tree, dialect, sequences, options), dialect, options)
