"""INSERT, UPDATE, DELETE and MERGE as plans that give a table's next version.

Parquet tables take no changes in place.  Each function returns the DataFrame
of the table after the statement (and, in `changed`, the rows that it wrote),
to be written to a new path and swapped in.  Keys for upserts come from the
caller, who knows the table's constraints.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..dialects import nodes as N
from ..dialects.emit import Emitter
from ..dialects.lexer import SqlError
from ..dialects.parser import parse
from ..dialects.rewrite import rewritten
from ..shared import shared_dir


@dataclass
class Change:
    """The table after a statement, the rows that the statement wrote or removed (RETURNING), and each of these as it was and as it is now.

    pairs: (old, new), two structs of the table's columns; old is null for a
    row that is new, new for one that is gone.
    """

    table: DataFrame
    changed: DataFrame
    pairs: DataFrame | None = None


def _row(df: DataFrame, target: DataFrame, prefix: str = "") -> F.Column:
    """A row of the target's columns as a struct."""
    return F.struct(*[F.col(f"{prefix}`{f.name}`").cast(f.dataType).alias(f.name) for f in target.schema.fields])


def _none(target: DataFrame) -> F.Column:
    return F.lit(None).cast(target.schema)


def _added(rows: DataFrame, target: DataFrame) -> DataFrame:
    return rows.select(_none(target).alias("old"), _row(rows, target).alias("new"))


def _gone(rows: DataFrame, target: DataFrame) -> DataFrame:
    return rows.select(_row(rows, target).alias("old"), _none(target).alias("new"))


def _emit(node, dialect: str) -> str:
    return Emitter(dialect).expr(rewritten(node, dialect))


def _select(spark: SparkSession, q, dialect: str) -> DataFrame:
    return spark.sql(Emitter(dialect).query(rewritten(q, dialect)))


def execute(spark: SparkSession, sql: str, dialect: str, keys: list[str] | None = None) -> Change:
    """Plans one statement over the session's tables and views; keys: the columns whose values are unique, for upserts and IGNORE."""
    tree, _ = parse(sql, dialect)
    if isinstance(tree, N.Insert):
        return insert(spark, tree, dialect, keys)
    if isinstance(tree, N.Update):
        return update(spark, tree, dialect)
    if isinstance(tree, N.Delete):
        return delete(spark, tree, dialect)
    if isinstance(tree, N.Merge):
        return merge(spark, tree, dialect)
    raise SqlError("a data change is expected")


def _rows(spark, tree: N.Insert, target: DataFrame, dialect: str, ordered: bool = False) -> DataFrame:
    """The statement's rows in the target's columns and types; left out and DEFAULT columns are NULL. ordered: also `_at`, a row's place in VALUES."""
    columns = list(tree.columns) or target.columns
    source = tree.source
    if isinstance(source, N.Values):
        listed = tuple(tuple(N.Lit("null") if isinstance(v, N.Default) else v for v in r) for r in source.rows)
        listed = tuple((*r, N.Lit("number", str(i))) for i, r in enumerate(listed)) if ordered else listed
        source = N.Select((N.Item(N.Star()),), N.Derived(N.Values(listed), "_v"))
    rows = _select(spark, source, dialect)
    if len(rows.columns) != len(columns) + (ordered and isinstance(tree.source, N.Values)):
        raise SqlError(f"{len(columns)} columns, but {len(rows.columns)} values")
    rows = rows.toDF(*[f"_c{i}" for i in range(len(rows.columns))])
    place = {c.lower(): i for i, c in enumerate(columns)}
    out = [(F.col(f"_c{place[f.name.lower()]}") if f.name.lower() in place else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema.fields]
    return rows.select(*out, *([F.col(f"_c{len(columns)}").alias("_at")] if len(rows.columns) > len(columns) else []))


def _by_key(rows: DataFrame, keys: list[str], first: bool, told: bool) -> tuple[DataFrame, DataFrame]:
    """(one row a key, rows with a NULL in a key: they equal nothing). Of rows that share a key the first or the last of VALUES stays.

    Without places any one stays, or, with `told`, more than one is an error
    when the plan runs.
    """
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    cols = [c for c in rows.columns if c != "_at"]
    if "_at" in rows.columns:
        pick = (F.min_by if first else F.max_by)(F.struct(*cols), F.col("_at"))
    else:
        pick = F.first(F.struct(*cols))
        if told:
            pick = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"several rows of the source share a key ({', '.join(keys)}); their order, which would decide, is not known"))).otherwise(pick)
    one = rows.where(whole).groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(pick.alias("_row")).select("_row.*")
    return one, rows.where(~whole).select(*cols)


def insert(spark: SparkSession, tree: N.Insert, dialect: str, keys: list[str] | None = None) -> Change:
    """Appends; with IGNORE, REPLACE or ON DUPLICATE KEY UPDATE by `keys`.

    Of rows of VALUES that share a key IGNORE keeps the first and REPLACE the
    last; ON DUPLICATE KEY UPDATE takes them one after the other.  Rows of a
    query have no order: IGNORE and REPLACE keep any of them, and ON DUPLICATE
    KEY UPDATE raises when the plan runs.  Keys with a NULL equal nothing.
    """
    target = spark.table(".".join(tree.table))
    if not (tree.ignore or tree.replace or tree.on_duplicate):
        rows = _rows(spark, tree, target, dialect)
        return Change(target.unionByName(rows), rows, _added(rows, target))
    if not keys:
        raise SqlError("an upsert needs the table's unique key")
    rows = _rows(spark, tree, target, dialect, ordered=True)
    if tree.ignore:
        one, nulls = _by_key(rows, keys, True, False)
        new = one.join(target.select(*keys), keys, "left_anti").select(*target.columns).unionByName(nulls)
        return Change(target.unionByName(new), new, _added(new, target))
    if tree.replace:
        one, nulls = _by_key(rows, keys, False, False)
        new = one.unionByName(nulls)
        replaced = target.join(one.select(*keys), keys, "left_semi").select(*target.columns)
        pairs = _gone(replaced, target).unionByName(_added(new, target))
        return Change(target.join(one.select(*keys), keys, "left_anti").select(*target.columns).unionByName(new), new, pairs)
    if "_at" in rows.columns:  # a turn for each row that shares its key with earlier ones; VALUES is as long as the statement
        turns = rows.withColumn("_turn", F.row_number().over(W.partitionBy(*keys).orderBy("_at")))
        last = turns.agg(F.max("_turn")).first()[0] or 1
        if last > 1:
            whole = F.lit(True)
            for k in keys:
                whole = whole & F.col(k).isNotNull()
            turns = turns.withColumn("_turn", F.when(whole, F.col("_turn")).otherwise(1)).drop("_at")
            change = None
            for t in range(1, last + 1):
                now = _upserted(target if change is None else change.table, turns.where(F.col("_turn") == t).drop("_turn"), tree, dialect, keys)
                change = now if change is None else Change(now.table, change.changed.unionByName(now.changed), change.pairs.unionByName(now.pairs))
            return change
        return _upserted(target, rows.drop("_at"), tree, dialect, keys)
    one, nulls = _by_key(rows, keys, True, True)
    return _upserted(target, one.unionByName(nulls), tree, dialect, keys)


def _upserted(target: DataFrame, rows: DataFrame, tree: N.Insert, dialect: str, keys: list[str]) -> Change:
    """ON DUPLICATE KEY UPDATE with rows that share no key."""
    # VALUES(c) and EXCLUDED are the new row.
    old, new = target.alias("t"), rows.alias("s")
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"t.`{k}`") == F.col(f"s.`{k}`"))

    def told(n):
        if isinstance(n, N.Func) and n.upper == "VALUES" and len(n.args) == 1:
            return N.Name(("s", n.args[0].parts[-1]))
        return n

    def own(n):  # plain names are the old row's
        if isinstance(n, N.Name):
            return N.Name(("t", n.parts[-1])) if n.parts[0] != "s" else n
        return n

    sets = {}
    for a in tree.on_duplicate:
        sets[a.columns[0].parts[-1].lower()] = F.expr(_emit(N.walk(N.walk(a.value, told), own), dialect))
    mark = F.col("s._there").isNotNull()
    joined = old.join(rows.withColumn("_there", F.lit(1)).alias("s"), cond, "left")
    values = [F.when(mark, sets[c.lower()]).otherwise(F.col(f"t.`{c}`")).cast(target.schema[c].dataType).alias(c) if c.lower() in sets else F.col(f"t.`{c}`").alias(c) for c in target.columns]
    updated = joined.select(*values)
    fresh = new.join(old, cond, "left_anti").select("s.*")
    pairs = joined.where(mark).select(_row(target, target, "t.").alias("old"), F.struct(*values).alias("new")).unionByName(_added(fresh, target))
    return Change(updated.unionByName(fresh), joined.where(mark).select("s.*").drop("_there").unionByName(fresh), pairs)


def _tables(t) -> list[N.Node]:
    return _tables(t.left) + _tables(t.right) if isinstance(t, N.Join) else [t]


def _alias(t) -> str:
    return t.alias or t.name[-1]


def update(spark: SparkSession, tree: N.Update, dialect: str) -> Change:
    """A row that several source rows match takes one of them, as MySQL has it."""
    first, *others = _tables(tree.source)
    name = _alias(first)
    target = spark.table(".".join(first.name))
    if tree.limit is not None:
        if others:
            raise SqlError("UPDATE of several tables takes no LIMIT")
        keyed, view, hits = _first_rows(spark, tree, dialect, first, target)
        chosen = N.Select((N.Item(N.Name((name, "_row")), "_row"), *[N.Item(N.Lit("null") if isinstance(a.value, N.Default) else a.value, f"_v{i}") for i, a in enumerate(tree.assigns)]), N.Table((_view(keyed.join(hits, "_row", "left_semi")),), name))
        return _apply(keyed, _select(spark, chosen, dialect), tree, target)
    owned = {c.lower() for c in target.columns}
    if not others:
        cond = F.expr(_emit(tree.where, dialect)) if tree.where is not None else F.lit(True)
        sets = {}
        for a in tree.assigns:
            if len(a.columns) > 1:
                return _update_by_query(spark, tree, dialect, first, target)
            sets[a.columns[0].parts[-1].lower()] = F.lit(None) if isinstance(a.value, N.Default) else a.value
        if any(isinstance(n, (N.Sub, N.Exists, N.In)) and not (isinstance(n, N.In) and n.query is None) for n in N.every((tree.where, tuple(a.value for a in tree.assigns)))):
            return _update_by_query(spark, tree, dialect, first, target)
        hit = F.coalesce(cond, F.lit(False))
        own = target.alias(name)
        new = [F.when(hit, F.expr(_emit(sets[c.lower()], dialect))).otherwise(F.col(f"{name}.`{c}`")).cast(target.schema[c].dataType).alias(c) if c.lower() in sets else F.col(f"{name}.`{c}`").alias(c) for c in target.columns]
        return Change(own.select(*new), own.where(hit).select(*new), own.where(hit).select(_row(target, target, f"{name}.").alias("old"), F.struct(*new).alias("new")))
    # Several tables: the changed values meet the target by all its columns' row key.
    unknown = [a for a in tree.assigns if a.columns[0].parts[-1].lower() not in owned]
    if unknown:
        raise SqlError("an UPDATE of several tables changes its first table alone")
    return _update_joined(spark, tree, dialect, first, target, others)


def _first_rows(spark, tree, dialect, first, target) -> tuple[DataFrame, str, DataFrame]:
    """(the target's rows numbered, their view, numbers of the rows that WHERE, ORDER BY and LIMIT choose). Rows that tie at the limit are any of them, as in the source."""
    if tree.limit.percent or tree.limit.offset is not None or not isinstance(tree.limit.count, N.Lit):
        raise SqlError("the LIMIT of a data change is a number")
    keyed = _materialized(_with_key(target))
    view = _view(keyed)
    query = N.Select((N.Item(N.Name((_alias(first), "_row")), "_row"),), N.Table((view,), _alias(first)), tree.where, order=tree.order, limit=tree.limit)
    return keyed, view, _materialized(_select(spark, query, dialect))


def _by_joins(spark: SparkSession, tree, dialect: str):
    """A condition whose x IN (query) and x NOT IN (query) are told by EXISTS over an equality, so that they are joins by key, wherever they stand.

    Spark compares every pair of rows where NOT IN is part of a larger
    condition, and sends the query's rows whole to every task where it is not.
    NULLs count as SQL has it: nothing is in no rows; otherwise what is not
    found is unknown where it, or one of the rows, is NULL.  Queries that read
    the outer row, and rows of several columns, stay as they are.
    """

    def told(n):
        if not isinstance(n, N.In) or n.query is None or isinstance(n.arg, N.Row):
            return n
        try:
            rows = _select(spark, n.query, dialect)
        except AnalysisException:  # it reads the outer row
            return n
        if len(rows.columns) != 1:
            return n
        view = _view(rows.toDF("_in"))
        source, own = N.Table((view,), "_q"), N.Name(("_q", "_in"))
        count = lambda x: N.Sub(N.Select((N.Item(N.Func(("count",), (x,)), "n"),), N.Table((view,))))
        number = lambda x: N.Lit("number", x)
        found = N.Exists(N.Select((N.Item(number("1"), "x"),), source, N.Binary("=", own, n.arg)))
        unknown = N.Binary("OR", N.Is(n.arg, "NULL"), N.Binary("<", count(N.Name(("_in",))), count(N.Star())))
        whens = ((N.Binary("=", count(N.Star()), number("0")), N.Lit("bool", n.negated)), (found, N.Lit("bool", not n.negated)), (unknown, N.Lit("null")))
        return N.Case(None, whens, N.Lit("bool", n.negated))

    return N.walk(tree, told)


def _with_key(df: DataFrame) -> DataFrame:
    """Rows with a number. The numbered rows are checkpointed, as both sides of a join must see the same numbers."""
    return df.withColumn("_row", F.monotonically_increasing_id())


def _materialized(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: numbered rows must not be numbered anew."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def _view(df: DataFrame) -> str:
    """A temporary view of its own: statements may run side by side in one session."""
    name = f"_dml_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    return name


def _update_joined(spark, tree, dialect, first, target, others) -> Change:
    if len(others) == 1 and isinstance(tree.source, N.Join) and tree.source.kind in ("INNER", "CROSS") and not (tree.source.using or tree.source.natural):
        return _update_beside(spark, tree, dialect, first, target, others[0])
    keyed = _materialized(_with_key(target))
    view = _view(keyed)
    source = N.walk(tree.source, lambda n: N.Table((view,), _alias(first)) if n == first else n)
    items = [N.Item(N.Name((_alias(first), "_row")), "_row")] + [N.Item(a.value, f"_v{i}") for i, a in enumerate(tree.assigns)]
    hits = _select(spark, N.Select(tuple(items), source, tree.where), dialect)
    return _apply(keyed, hits, tree, target)


def _update_beside(spark, tree, dialect, first, target, other) -> Change:
    """With one other table: an outer join to it, of which each row of the target keeps one match. One pass, and nothing is written."""
    name, beside = _alias(first), _alias(other)
    marked = N.Derived(N.Select((N.Item(N.Star()), N.Item(N.Lit("number", "1"), "_hit")), other), beside)
    cond = N.conjunction([c for c in (tree.source.on, tree.where) if c is not None])
    items = [N.Item(N.Name((name, c)), f"_t{i}") for i, c in enumerate(target.columns)] + [N.Item(N.Name((name, "_row")), "_row"), N.Item(N.Name((beside, "_hit")), "_hit")]
    items += [N.Item(a.value, f"_v{i}") for i, a in enumerate(tree.assigns)]
    source = N.Join(N.Table((_view(_with_key(target)),), name), marked, "LEFT", cond if cond is not None else N.Lit("bool", True))
    met = _select(spark, N.Select(tuple(items), source), dialect).dropDuplicates(["_row"])
    place = {a.columns[0].parts[-1].lower(): i for i, a in enumerate(tree.assigns)}
    hit = F.col("_hit").isNotNull()
    new = [(F.when(hit, F.col(f"_v{place[f.name.lower()]}")).otherwise(F.col(f"_t{i}")) if f.name.lower() in place else F.col(f"_t{i}")).cast(f.dataType).alias(f.name) for i, f in enumerate(target.schema.fields)]
    was = F.struct(*[F.col(f"_t{i}").alias(f.name) for i, f in enumerate(target.schema.fields)])
    return Change(met.select(*new), met.where(hit).select(*new), met.where(hit).select(was.alias("old"), F.struct(*new).alias("new")))


def _update_by_query(spark, tree, dialect, first, target) -> Change:
    keyed = _materialized(_with_key(target))
    items = [N.Item(N.Name((_alias(first), "_row")), "_row")]
    source: N.Node = N.Table((_view(keyed),), _alias(first))
    for i, a in enumerate(tree.assigns):
        if len(a.columns) == 1:
            items.append(N.Item(a.value, f"_v{i}"))
        else:  # (a, b) = (SELECT x, y ...): one scalar subquery of a struct
            q = a.value.query
            packed = N.replace(q, items=(N.Item(N.Func(("struct",), tuple(x.expr for x in q.items)), "_s"),))
            if not q.group and q.limit is None:
                one = N.Func(("any_value",), (packed.items[0].expr,))
                several = N.Binary(">", N.Func(("count",), (N.Star(),)), N.Lit("number", "1"))
                one = N.Case(None, ((several, N.Func(("raise_error",), (N.Lit("string", "a subquery for one row gives several"),))),), one)
                packed = N.replace(packed, items=(N.Item(one, "_s"),)) if not any(isinstance(n, N.Func) and n.upper in ("MAX", "MIN", "SUM", "COUNT", "AVG") for x in q.items for n in N.every(x.expr)) else packed
            items.append(N.Item(N.Sub(packed), f"_v{i}"))
    hits = _select(spark, N.Select(tuple(items), source, _by_joins(spark, tree.where, dialect)), dialect)
    return _apply(keyed, hits, tree, target)


def _apply(keyed: DataFrame, hits: DataFrame, tree: N.Update, target: DataFrame) -> Change:
    one = hits.groupBy("_row").agg(F.first(F.struct(*[c for c in hits.columns if c != "_row"])).alias("_new"))
    joined = keyed.join(one, "_row", "left")
    sets = {}
    for i, a in enumerate(tree.assigns):
        for k, c in enumerate(a.columns):
            value = F.col(f"_new._v{i}")
            if len(a.columns) > 1:
                kind = hits.schema[f"_v{i}"].dataType
                value = value[kind.fields[k].name]
            sets[c.parts[-1].lower()] = value
    hit = F.col("_new").isNotNull()
    new = [F.when(hit, sets[c.lower()]).otherwise(F.col(f"`{c}`")).cast(target.schema[c].dataType).alias(c) if c.lower() in sets else F.col(f"`{c}`") for c in target.columns]
    return Change(joined.select(*new), joined.where(hit).select(*new), joined.where(hit).select(_row(target, target).alias("old"), F.struct(*new).alias("new")))


def delete(spark: SparkSession, tree: N.Delete, dialect: str) -> Change:
    """Rows for which the condition is true go; of several tables the first target is changed."""
    tables = _tables(tree.source)
    first = tables[0]
    if tree.limit is not None:
        if len(tables) > 1:
            raise SqlError("DELETE from several tables takes no LIMIT")
        target = spark.table(".".join(first.name))
        keyed, _, hits = _first_rows(spark, tree, dialect, first, target)
        gone = keyed.join(hits, "_row", "left_semi").select(*target.columns)
        return Change(keyed.join(hits, "_row", "left_anti").select(*target.columns), gone, _gone(gone, target))
    if tree.targets:
        want = tree.targets[0][-1].lower()
        first = next((t for t in tables if _alias(t).lower() == want or t.name[-1].lower() == want), first)
        if len(tree.targets) > 1:
            raise SqlError("a DELETE from several tables gives several changes: deletes()")
    target = spark.table(".".join(first.name))
    if tree.where is None and len(tables) == 1:
        return Change(target.limit(0), target, _gone(target, target))
    if len(tables) == 1 and not any(isinstance(n, (N.Sub, N.Exists)) or isinstance(n, N.In) and n.query is not None for n in N.every(tree.where)):
        hit = F.coalesce(F.expr(_emit(tree.where, dialect)), F.lit(False))
        own = target.alias(_alias(first))
        gone = own.where(hit).select(*target.columns)
        return Change(own.where(~hit).select(*target.columns), gone, _gone(gone, target))
    if len(tables) == 1:  # a condition with subqueries: rows for which it is not true stay
        own = N.Select((N.Item(N.Star()),), N.Table((_view(target),), _alias(first)))
        where = _by_joins(spark, tree.where, dialect)
        gone = _select(spark, N.replace(own, where=where), dialect)
        return Change(_select(spark, N.replace(own, where=N.Is(N.Row((where,)), "TRUE", None, True)), dialect), gone, _gone(gone, target))
    keyed = _materialized(_with_key(target))
    view = _view(keyed)
    source = N.walk(tree.source, lambda n: N.Table((view,), _alias(first)) if n == first else n)
    hits = _select(spark, N.Select((N.Item(N.Name((_alias(first), "_row")), "_row"),), source, tree.where), dialect).distinct()
    gone = keyed.join(hits, "_row", "left_semi").select(*target.columns)
    return Change(keyed.join(hits, "_row", "left_anti").select(*target.columns), gone, _gone(gone, target))


def deletes(spark: SparkSession, sql: str, dialect: str) -> dict[str, Change]:
    """DELETE a, b FROM ...: the change of each target. All see the tables as they were, as the rows of the join are found before any goes."""
    tree, _ = parse(sql, dialect)
    if not isinstance(tree, N.Delete):
        raise SqlError("a DELETE is expected")
    tables = _tables(tree.source)
    out = {}
    for t in tree.targets or ((_alias(tables[0]),),):
        own = next((x for x in tables if _alias(x).lower() == t[-1].lower() or x.name[-1].lower() == t[-1].lower()), None)
        if own is None:
            raise SqlError(f"{t[-1]} is not in FROM")
        out[own.name[-1].lower()] = delete(spark, N.replace(tree, targets=(t,)), dialect)
    return out


def insert_all(spark: SparkSession, sql: str, dialect: str = "oracle") -> dict[str, Change]:
    """INSERT ALL and INSERT FIRST: the change of each target.

    The query runs once, to a written table with the number of the arm or
    arms that take each row; a target reads its rows from that.  A condition
    that is NULL does not hold.  Without VALUES a target takes the query's
    columns in order.
    """
    tree, _ = parse(sql, dialect)
    if not isinstance(tree, N.InsertAll):
        raise SqlError("INSERT ALL or FIRST is expected")
    rows = _select(spark, tree.source, dialect)
    columns = rows.columns
    holds = [F.coalesce(F.expr(_emit(c, dialect)), F.lit(False)) if c is not None else F.lit(True) for c, _ in tree.arms]
    arms = F.array_compact(F.array(*[F.when(h, i) for i, h in enumerate(holds)]))
    arms = F.slice(arms, 1, 1) if tree.first else arms
    arms = F.when(F.size(arms) == 0, F.array(F.lit(-1))).otherwise(arms)
    path = os.path.join(shared_dir(spark), f"routed-{uuid.uuid4().hex}")
    rows.withColumn("_arms", arms).write.parquet(path)
    routed = spark.read.parquet(path)
    out: dict[str, Change] = {}
    for i, targets in [*((i, t) for i, (_, t) in enumerate(tree.arms)), (-1, tree.other)]:
        view = _view(routed.where(F.array_contains("_arms", i)).drop("_arms"))
        for t in targets:
            name = t.table[-1].lower()
            target = spark.table(".".join(t.table))
            values = t.source.rows or (tuple(N.Name((c,)) for c in columns),)
            added = None
            for row in values:
                query = N.Select(tuple(N.Item(N.Lit("null") if isinstance(e, N.Default) else e, f"c{k}") for k, e in enumerate(row)), N.Table((view,)))
                new = _rows(spark, N.Insert(t.table, t.columns, query), target, dialect)
                added = new if added is None else added.unionByName(new)
            before = out[name] if name in out else Change(target, target.limit(0), _added(target.limit(0), target))
            out[name] = Change(before.table.unionByName(added), before.changed.unionByName(added), before.pairs.unionByName(_added(added, target)))
    return out


def merge(spark: SparkSession, tree: N.Merge, dialect: str) -> Change:
    """One full outer join; the first WHEN that holds decides. A target row that several source rows match is an error."""
    name = _alias(tree.target)
    target = spark.table(".".join(tree.target.name))
    source = _select(spark, N.Select((N.Item(N.Star()),), tree.source), dialect)
    other = tree.source.alias or tree.source.name[-1]
    old = _with_key(target).withColumn("_old", F.lit(True)).alias(name)
    new = source.withColumn("_new", F.lit(True)).alias(other)
    on = F.expr(_emit(tree.on, dialect))
    both = old.join(new, on, "full")
    # only the columns that ON reads take part in this, and only rows that match
    twice = old.join(new, on, "inner").groupBy(f"{name}._row").count().where("count > 1")
    if not twice.isEmpty():
        raise SqlError("MERGE: several source rows match one target row")
    matched = F.col(f"{name}._old").isNotNull() & F.col(f"{other}._new").isNotNull()
    fresh = F.col(f"{name}._old").isNull()
    action, values = F.lit(None).cast("int"), {c: F.col(f"{name}.`{c}`") for c in target.columns}
    branches = []
    for i, w in enumerate(tree.whens):
        cond = matched if w.matched else fresh
        if w.condition is not None:
            cond = cond & F.coalesce(F.expr(_emit(w.condition, dialect)), F.lit(False))
        branches.append((cond, w, i))
    for cond, _, i in reversed(branches):
        action = F.when(cond, i).otherwise(action)
    both = both.withColumn("_action", action)
    for c in target.columns:
        out = F.col(f"{name}.`{c}`")
        for _, w, i in branches:
            if w.action == "UPDATE":
                sets = {a.columns[0].parts[-1].lower(): a.value for a in w.assigns}
                if c.lower() in sets:
                    out = F.when(F.col("_action") == i, F.expr(_emit(sets[c.lower()], dialect))).otherwise(out)
            elif w.action == "INSERT":
                cols = [x.lower() for x in (w.columns or target.columns)]
                value = F.expr(_emit(w.values[cols.index(c.lower())], dialect)) if c.lower() in cols else F.lit(None)
                out = F.when(F.col("_action") == i, value).otherwise(out)
        values[c] = out.cast(target.schema[c].dataType).alias(c)
    deletes = [i for _, w, i in branches if w.action == "DELETE"]
    gone = F.coalesce(F.col("_action").isin(deletes), F.lit(False)) if deletes else F.lit(False)
    stays = ~gone & (F.col(f"{name}._old").isNotNull() | F.col("_action").isNotNull())
    cols = [values[c] for c in target.columns]
    was = F.when(F.col(f"{name}._old").isNotNull(), _row(target, target, f"{name}."))
    pairs = both.where(F.col("_action").isNotNull()).select(was.alias("old"), F.when(~gone, F.struct(*cols)).alias("new"))
    return Change(both.where(stays).select(*cols), both.where(F.col("_action").isNotNull()).select(*cols), pairs)
