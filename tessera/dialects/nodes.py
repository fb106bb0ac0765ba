"""The syntax tree: plain dataclasses, rewritten by `walk`."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Node:
    pass


# --- expressions ---------------------------------------------------------


@dataclass(frozen=True)
class Lit(Node):
    kind: str  # number, string, null, bool, hex, bits, date, timestamp, time
    value: Any = None


@dataclass(frozen=True)
class Name(Node):
    parts: tuple[str, ...]
    outer: bool = False  # marked (+)


@dataclass(frozen=True)
class Star(Node):
    qualifier: tuple[str, ...] = ()


@dataclass(frozen=True)
class Param(Node):
    name: str


@dataclass(frozen=True)
class Unary(Node):
    op: str
    arg: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Between(Node):
    arg: Node
    low: Node
    high: Node
    negated: bool = False


@dataclass(frozen=True)
class In(Node):
    arg: Node
    items: tuple[Node, ...] = ()
    query: Node | None = None
    negated: bool = False


@dataclass(frozen=True)
class Like(Node):
    arg: Node
    pattern: Node
    op: str = "LIKE"  # LIKE, RLIKE
    escape: Node | None = None
    negated: bool = False


@dataclass(frozen=True)
class Match(Node):
    """MATCH (columns) AGAINST (text): a condition, or the rank of a row."""

    columns: tuple[Name, ...]
    text: Node
    boolean: bool = False


@dataclass(frozen=True)
class Is(Node):
    arg: Node
    what: str  # NULL, TRUE, FALSE, DISTINCT
    other: Node | None = None
    negated: bool = False


@dataclass(frozen=True)
class Exists(Node):
    query: Node


@dataclass(frozen=True)
class Sub(Node):
    query: Node


@dataclass(frozen=True)
class Quantified(Node):
    op: str
    arg: Node
    how: str  # ANY, ALL
    query: Node


@dataclass(frozen=True)
class Row(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Case(Node):
    arg: Node | None
    whens: tuple[tuple[Node, Node], ...]
    default: Node | None = None


@dataclass(frozen=True)
class TypeName(Node):
    name: str
    args: tuple[str, ...] = ()
    unsigned: bool = False
    extra: tuple[str, ...] = ()


@dataclass(frozen=True)
class Cast(Node):
    arg: Node
    type: TypeName
    soft: bool = False


@dataclass(frozen=True)
class Interval(Node):
    value: Node
    unit: str


@dataclass(frozen=True)
class Order(Node):
    expr: Node
    desc: bool = False
    nulls: str | None = None  # FIRST, LAST


@dataclass(frozen=True)
class Window(Node):
    base: str | None = None
    partition: tuple[Node, ...] = ()
    order: tuple[Order, ...] = ()
    frame: str = ""


@dataclass(frozen=True)
class Func(Node):
    name: tuple[str, ...]
    args: tuple[Node, ...] = ()
    distinct: bool = False
    order: tuple[Order, ...] = ()  # inside the parentheses, or WITHIN GROUP
    within: bool = False
    separator: Node | None = None
    over: Window | None = None
    filter: Node | None = None
    nulls: str | None = None  # IGNORE, RESPECT
    keep: str | None = None  # FIRST, LAST: KEEP (DENSE_RANK ... ORDER BY order)
    words: tuple[str, ...] = ()  # key words between arguments: TRIM(BOTH x FROM y), EXTRACT(unit FROM e)

    @property
    def upper(self) -> str:
        return ".".join(self.name).upper()


@dataclass(frozen=True)
class Fold(Node):
    """A counted loop as one value: a record of variables, each with its type, first value and value after a turn."""

    low: Node
    high: Node
    back: bool
    sofar: str  # the name of the record in a turn
    at: str  # and of the number
    items: tuple[tuple[str, TypeName, Node, Node], ...]


# --- queries --------------------------------------------------------------


@dataclass(frozen=True)
class Item(Node):
    expr: Node
    alias: str | None = None


@dataclass(frozen=True)
class Table(Node):
    name: tuple[str, ...]
    alias: str | None = None
    sample: str = ""  # per cent of the rows
    as_of: tuple[str, Node] | None = None  # SCN or TIMESTAMP, and which


@dataclass(frozen=True)
class JsonColumn(Node):
    name: str
    type: TypeName | None
    path: str | None  # None: the row's number


@dataclass(frozen=True)
class JsonTable(Node):
    expr: Node
    path: str
    columns: tuple[JsonColumn, ...]
    alias: str | None = None


@dataclass(frozen=True)
class Derived(Node):
    query: Node
    alias: str | None = None
    columns: tuple[str, ...] = ()
    lateral: bool = False


@dataclass(frozen=True)
class Unnest(Node):
    expr: Node
    alias: str | None = None
    column: str = "column_value"


@dataclass(frozen=True)
class Pivot(Node):
    source: Node
    aggregates: tuple[Item, ...]
    column: Node
    values: tuple[Item, ...]
    alias: str | None = None


@dataclass(frozen=True)
class Unpivot(Node):
    source: Node
    value: str
    name: str
    columns: tuple[Item, ...]
    keep_nulls: bool = False
    alias: str | None = None


@dataclass(frozen=True)
class Join(Node):
    left: Node
    right: Node
    kind: str  # INNER, LEFT, RIGHT, FULL, CROSS
    on: Node | None = None
    using: tuple[str, ...] = ()
    natural: bool = False


@dataclass(frozen=True)
class Cte(Node):
    name: str
    columns: tuple[str, ...]
    query: Node


@dataclass(frozen=True)
class Limit(Node):
    count: Node | None = None
    offset: Node | None = None
    percent: bool = False
    ties: bool = False


@dataclass(frozen=True)
class Select(Node):
    items: tuple[Item, ...]
    source: Node | None = None
    where: Node | None = None
    group: tuple[Node, ...] = ()
    rollup: bool = False
    having: Node | None = None
    windows: tuple[tuple[str, Window], ...] = ()
    distinct: bool = False
    start: Node | None = None  # hierarchical: START WITH
    connect: Node | None = None  # CONNECT BY
    nocycle: bool = False
    order: tuple[Order, ...] = ()
    limit: Limit | None = None
    ctes: tuple[Cte, ...] = ()
    recursive: bool = False
    siblings: bool = False  # the order is that of rows with the same parent


@dataclass(frozen=True)
class SetOp(Node):
    left: Node
    op: str  # UNION, INTERSECT, EXCEPT
    all: bool
    right: Node
    order: tuple[Order, ...] = ()
    limit: Limit | None = None
    ctes: tuple[Cte, ...] = ()
    recursive: bool = False


@dataclass(frozen=True)
class Values(Node):
    rows: tuple[tuple[Node, ...], ...]


# --- statements -----------------------------------------------------------


@dataclass(frozen=True)
class Default(Node):
    pass


@dataclass(frozen=True)
class Assign(Node):
    columns: tuple[Name, ...]
    value: Node  # a Sub over several columns for a tuple


@dataclass(frozen=True)
class Insert(Node):
    table: tuple[str, ...]
    columns: tuple[str, ...]
    source: Node
    ignore: bool = False
    replace: bool = False
    on_duplicate: tuple[Assign, ...] = ()


@dataclass(frozen=True)
class InsertAll(Node):
    """Rows of a query to several targets: to every arm whose condition holds, or to the first."""

    first: bool
    arms: tuple[tuple[Node | None, tuple[Insert, ...]], ...]
    other: tuple[Insert, ...]
    source: Node


@dataclass(frozen=True)
class Update(Node):
    source: Node
    assigns: tuple[Assign, ...]
    where: Node | None = None
    order: tuple[Order, ...] = ()
    limit: Limit | None = None


@dataclass(frozen=True)
class Delete(Node):
    targets: tuple[tuple[str, ...], ...]
    source: Node
    where: Node | None = None
    order: tuple[Order, ...] = ()
    limit: Limit | None = None


@dataclass(frozen=True)
class MergeWhen(Node):
    matched: bool
    action: str  # UPDATE, DELETE, INSERT
    condition: Node | None = None
    assigns: tuple[Assign, ...] = ()
    columns: tuple[str, ...] = ()
    values: tuple[Node, ...] = ()


@dataclass(frozen=True)
class Merge(Node):
    target: Table
    source: Node
    on: Node
    whens: tuple[MergeWhen, ...]


def walk(node, fn):
    """The tree with `fn` applied to every node, children first; what is equal is kept."""

    def turn(x):
        if isinstance(x, tuple):
            new = tuple(map(turn, x))
            return new if any(a is not b for a, b in zip(new, x)) else x
        if is_dataclass(x):
            changed = {f.name: new for f in fields(x) if (new := turn(old := getattr(x, f.name))) is not old}
            return fn(replace(x, **changed) if changed else x)
        return x

    return turn(node)


def children(x, fn):
    """A node with fn applied to its direct children."""

    def turn(v):
        if isinstance(v, tuple):
            return tuple(map(turn, v))
        return fn(v) if is_dataclass(v) else v

    if isinstance(x, tuple):
        return tuple(map(fn, x))
    if not is_dataclass(x):
        return x
    return replace(x, **{f.name: turn(getattr(x, f.name)) for f in fields(x)})


def every(node):
    """All nodes of a tree, parents first."""
    if isinstance(node, tuple):
        for x in node:
            yield from every(x)
    elif is_dataclass(node):
        yield node
        for f in fields(node):
            yield from every(getattr(node, f.name))


def conjuncts(e: Node | None) -> list[Node]:
    if e is None:
        return []
    if isinstance(e, Binary) and e.op == "AND":
        return conjuncts(e.left) + conjuncts(e.right)
    return [e]


def conjunction(parts) -> Node | None:
    out = None
    for p in parts:
        out = p if out is None else Binary("AND", out, p)
    return out


__all__ = [n for n in dir() if n[0] != "_" and n not in ("annotations", "dataclass", "field", "Any")]
