"""Column types of the sources as Spark types, with the checks that a type implies."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..dialects.nodes import TypeName

#: What stands for a NUMBER or DECFLOAT without a precision: Spark has no unbounded decimal.
UNBOUNDED = "DECIMAL(38,10)"
#: Place of the column's name in a check.
COL = "{col}"


@dataclass
class Mapped:
    """Spark's DDL for a type, checks as SQL over `{col}` (true or NULL: passes), and notes on what is lost."""

    ddl: str
    checks: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    blocking: bool = False
    copied: bool = True
    surrogate: bool = False


def _decimal(args, default=(10, 0)) -> tuple[str, list[str]]:
    p = int(args[0]) if args and args[0].isdigit() else default[0]
    s = int(args[1]) if len(args) > 1 and args[1].lstrip("-").isdigit() else (0 if args else default[1])
    notes = []
    if p > 38:
        notes.append(f"precision {p} is cut to 38; values beyond become NULL and are counted on copy")
        p = 38
    if s > p:
        notes.append(f"scale {s} exceeds precision {p}: precision raised")
        p = min(38, s)
    return f"DECIMAL({p},{max(0, min(s, 38))})", notes


def _length_check(op: str, n: str) -> list[str]:
    return [f"octet_length({COL}) {op} {n}"]


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


# Plain correspondences of type names.
MYSQL = {
    "TINYINT": "SMALLINT", "SMALLINT": "SMALLINT", "MEDIUMINT": "INT", "INT": "INT", "INTEGER": "INT", "BIGINT": "BIGINT", "BOOL": "BOOLEAN", "BOOLEAN": "BOOLEAN",
    "DOUBLE": "DOUBLE", "DOUBLE PRECISION": "DOUBLE", "REAL": "DOUBLE", "FLOAT": "FLOAT", "TINYTEXT": "STRING", "TEXT": "STRING", "MEDIUMTEXT": "STRING", "LONGTEXT": "STRING",
    "TINYBLOB": "BINARY", "BLOB": "BINARY", "MEDIUMBLOB": "BINARY", "LONGBLOB": "BINARY", "VARBINARY": "BINARY", "DATE": "DATE", "DATETIME": "TIMESTAMP_NTZ", "TIMESTAMP": "TIMESTAMP", "UUID": "STRING", "INET4": "STRING", "INET6": "STRING",
}
ORACLE = {
    "CLOB": "STRING", "NCLOB": "STRING", "LONG": "STRING", "LONG RAW": "BINARY", "BLOB": "BINARY", "BINARY_FLOAT": "FLOAT", "BINARY_DOUBLE": "DOUBLE", "FLOAT": "DOUBLE", "REAL": "DOUBLE", "DOUBLE PRECISION": "DOUBLE",
    "XMLTYPE": "STRING", "BOOLEAN": "BOOLEAN", "JSON": "VARIANT", "INTERVAL YEAR TO MONTH": "INTERVAL YEAR TO MONTH", "INTERVAL DAY TO SECOND": "INTERVAL DAY TO SECOND", "PLS_INTEGER": "INT", "BINARY_INTEGER": "INT",
}
DB2 = {
    "SMALLINT": "SMALLINT", "INT": "INT", "INTEGER": "INT", "BIGINT": "BIGINT", "REAL": "FLOAT", "DOUBLE": "DOUBLE", "DOUBLE PRECISION": "DOUBLE", "CLOB": "STRING", "DBCLOB": "STRING", "LONG VARCHAR": "STRING", "LONG VARGRAPHIC": "STRING",
    "BLOB": "BINARY", "VARBINARY": "BINARY", "DATE": "DATE", "TIME": "TIME(0)", "XML": "STRING", "BOOLEAN": "BOOLEAN",
}
SPATIAL = frozenset("GEOMETRY POINT LINESTRING POLYGON MULTIPOINT MULTILINESTRING MULTIPOLYGON GEOMETRYCOLLECTION GEOMCOLLECTION SDO_GEOMETRY".split())
UNSIGNED = {"TINYINT": "SMALLINT", "SMALLINT": "INT", "MEDIUMINT": "INT", "INT": "BIGINT", "INTEGER": "BIGINT", "BIGINT": "DECIMAL(20,0)"}


def _mysql(t: TypeName) -> Mapped:
    name, a = t.name, t.args
    if name in UNSIGNED:
        notes = ["ZEROFILL: pad on reading"] if "ZEROFILL" in t.extra else []
        if name == "TINYINT" and a == ("1",) and not t.unsigned:
            return Mapped("BOOLEAN")
        if t.unsigned:
            return Mapped(UNSIGNED[name], [f"{COL} >= 0"], notes)
        return Mapped(MYSQL[name], [], notes)
    if name in ("FLOAT", "DOUBLE", "REAL") and len(a) == 2:
        ddl, notes = _decimal(a)
        return Mapped(ddl, [], notes)
    if name in ("DECIMAL", "NUMERIC", "DEC", "FIXED"):
        ddl, notes = _decimal(a)
        return Mapped(ddl, [f"{COL} >= 0"] if t.unsigned else [], notes)
    if name == "BIT":
        n = int(a[0]) if a else 1
        return Mapped("BOOLEAN") if n == 1 else Mapped("BINARY", _length_check("=", str((n + 7) // 8)))
    if name in ("CHAR", "VARCHAR", "CHARACTER", "NATIONAL CHAR", "NATIONAL VARCHAR", "NCHAR", "NVARCHAR", "CHARACTER VARYING"):
        n = a[0] if a else "1"
        ddl = f"VARCHAR({n})" if "VAR" in name else f"CHAR({n})"
        out = Mapped(ddl)
        for e in t.extra:
            if e.startswith("COLLATE "):
                c = e.split()[1].lower()
                if c.endswith("_bin"):
                    out.ddl, out.checks = "STRING COLLATE UTF8_BINARY", [f"char_length({COL}) <= {n}"]
                elif c.endswith("_ci"):
                    out.notes.append(f"collation {c}: compare with UTF8_LCASE, which keeps accents apart")
                else:
                    out.notes.append(f"collation {c} has no equivalent")
        return out
    if name == "BINARY":
        return Mapped("BINARY", _length_check("=", a[0] if a else "1"))
    if name == "VARBINARY" and a:
        return Mapped("BINARY", _length_check("<=", a[0]))
    if name == "ENUM":
        return Mapped("STRING", [f"{COL} IN ({_quoted(a)})"])
    if name == "SET":
        return Mapped("ARRAY<STRING>", [f"size(array_except({COL}, array({_quoted(a)}))) = 0"])
    if name == "JSON":
        return Mapped("VARIANT")
    if name == "TIME":
        return Mapped(f"TIME({a[0] if a else 0})")
    if name == "YEAR":
        return Mapped("SMALLINT", [f"{COL} BETWEEN 1901 AND 2155"])
    if name == "VECTOR":
        return Mapped("ARRAY<FLOAT>", [f"size({COL}) = {a[0]}"] if a else [])
    if name in MYSQL:
        return Mapped(MYSQL[name])
    return _unknown(t)


def _oracle(t: TypeName) -> Mapped:
    name, a = t.name, t.args
    if name in ("NUMBER", "NUMERIC", "DECIMAL", "DEC", "INTEGER", "INT", "SMALLINT"):
        if name in ("INTEGER", "INT", "SMALLINT"):
            a = ("38",)
        if not a or a[0] == "*":
            return Mapped(UNBOUNDED, [], [f"NUMBER without a precision becomes {UNBOUNDED}; profile the column before copying"])
        p, s = int(a[0]), int(a[1]) if len(a) > 1 else 0
        if s < 0:
            return Mapped(f"DECIMAL({min(38, p - s)},0)", [], [f"scale {s}: values keep their zeros before the point"])
        if s == 0:
            return Mapped("SMALLINT" if p <= 4 else "INT" if p <= 9 else "BIGINT" if p <= 18 else f"DECIMAL({min(p, 38)},0)")
        ddl, notes = _decimal(a)
        return Mapped(ddl, [], notes)
    if name in ("VARCHAR2", "NVARCHAR2", "VARCHAR", "CHARACTER VARYING"):
        return Mapped(f"VARCHAR({a[0]})" if a else "STRING")
    if name in ("CHAR", "NCHAR", "CHARACTER"):
        return Mapped(f"CHAR({a[0] if a else 1})")
    if name == "RAW":
        return Mapped("BINARY", _length_check("<=", a[0]) if a else [])
    if name == "BFILE":
        return Mapped("BINARY", [], ["BFILE: the file is not copied"], copied=False)
    if name in ("ROWID", "UROWID"):
        return Mapped("BIGINT", [], [f"{name} becomes a generated number"], copied=False, surrogate=True)
    if name == "DATE":
        return Mapped("TIMESTAMP_NTZ")
    if name == "TIMESTAMP":
        notes = ["digits beyond microseconds are cut"] if a and a[0].isdigit() and int(a[0]) > 6 else []
        return Mapped("TIMESTAMP" if "TZ" in t.extra or "LOCAL TZ" in t.extra else "TIMESTAMP_NTZ", [], notes)
    if name == "VECTOR":
        return Mapped("ARRAY<FLOAT>", [f"size({COL}) = {a[0]}"] if a and a[0].isdigit() else [])
    if name.startswith("ORD") and name in ("ORDIMAGE", "ORDAUDIO", "ORDVIDEO", "ORDDOC"):
        return Mapped("BINARY", [], [f"{name} is kept as bytes"])
    if name in ("ANYDATA", "ANYTYPE", "ANYDATASET"):
        return Mapped("VARIANT", [], [f"{name} is kept as a variant"])
    if name in ORACLE:
        return Mapped(ORACLE[name])
    return _unknown(t)


def _db2(t: TypeName) -> Mapped:
    name, a = t.name, t.args
    if "BIT DATA" in t.extra:
        op = "<=" if "VAR" in name else "="
        return Mapped("BINARY", _length_check(op, a[0] if a else "1"))
    if name in ("DECIMAL", "NUMERIC", "DEC"):
        ddl, notes = _decimal(a, (31, 0)) if a else (UNBOUNDED, [f"{name} without a precision becomes {UNBOUNDED}"])
        return Mapped(ddl, [], notes)
    if name == "DECFLOAT":
        return Mapped(UNBOUNDED, [], [f"DECFLOAT becomes {UNBOUNDED}; NaN and infinity become NULL"])
    if name == "FLOAT":
        return Mapped("FLOAT" if a and int(a[0]) <= 24 else "DOUBLE")
    if name in ("CHAR", "CHARACTER", "GRAPHIC"):
        return Mapped(f"CHAR({a[0] if a else 1})" if name != "GRAPHIC" else f"VARCHAR({a[0] if a else 1})")
    if name in ("VARCHAR", "VARGRAPHIC", "CHARACTER VARYING", "CHAR VARYING"):
        return Mapped(f"VARCHAR({a[0]})" if a else "STRING")
    if name in ("BINARY", "VARBINARY") and a:
        return Mapped("BINARY", _length_check("=" if name == "BINARY" else "<=", a[0]))
    if name == "TIMESTAMP":
        notes = ["digits beyond microseconds are cut"] if a and int(a[0]) > 6 else []
        return Mapped("TIMESTAMP" if "TZ" in t.extra else "TIMESTAMP_NTZ", [], notes)
    if name == "ROWID":
        return Mapped("BIGINT", [], ["ROWID becomes a generated number"], copied=False, surrogate=True)
    if name in DB2:
        return Mapped(DB2[name])
    return _unknown(t)


def _db2zos(t: TypeName) -> Mapped:
    if t.name == "BOOLEAN":
        return Mapped("SMALLINT", [f"{COL} IN (0, 1)"])
    if t.name == "TIMESTAMP" and "TZ" in t.extra:
        return Mapped("TIMESTAMP_NTZ", [], ["the time zone is dropped"])
    return _db2(t)


def _unknown(t: TypeName) -> Mapped:
    if t.name in SPATIAL:
        return Mapped("STRING", [], [f"{t.name} is kept as well-known text; spatial functions and indexes have no equivalent"], blocking=True, copied=False)
    if t.name in ("STRING", "DATE", "TIMESTAMP", "BINARY", "INT", "BIGINT", "DOUBLE", "FLOAT", "BOOLEAN", "VARIANT", "TIMESTAMP_NTZ"):
        return Mapped(t.name)
    return Mapped("STRING", [], [f"unknown type {t.name} is kept as text"])


def map_type(t: TypeName, dialect: str) -> Mapped:
    """The mapping of one type; an unknown type is text with a note, never an error."""
    by = {"mysql": _mysql, "mariadb": _mysql, "oracle": _oracle, "db2": _db2, "db2zos": _db2zos}
    return by.get(dialect, _unknown)(t)
