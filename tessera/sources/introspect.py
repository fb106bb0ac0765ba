"""A source's own catalog as a DDL script.

Each catalog view is read once for the whole schema, by whatever gives a
DataFrame for its name (JDBC for a database, stand-ins in tests).  Columns and
keys of all tables become statements by one aggregation; nothing is asked
object by object.  The script goes through the same parser as any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Catalog = Callable[[str], DataFrame]

# Schemas that a source's own software owns.
SYSTEM_SCHEMAS = {
    "mysql": "information_schema mysql performance_schema sys ndbinfo".split(),
    "oracle": """ANONYMOUS APPQOSSYS AUDIT_ADMIN AUDIT_VIEWER AUDSYS CTXAPP CTXSYS DBSFWUSER DBSNMP DGPDB_INT DGPDB_INT_VIEWER DIP DVF DVSYS EXFSYS FLOWS_FILES GGSHAREDCAP GGSYS
        GSMADMIN_INTERNAL GSMCATUSER GSMROOTUSER GSMUSER LBACSYS MDDATA MDSYS OJVMSYS OLAPSYS ORACLE_OCM ORDDATA ORDPLUGINS ORDSYS OUTLN OWBSYS OWBSYS_AUDIT PDBADMIN REMOTE_SCHEDULER_AGENT
        SYS SYS$UMF SYSBACKUP SYSDG SYSKM SYSMAN SYSRAC SYSTEM WMSYS XDB XS$NULL""".split(),
    "db2": """ASN DB2INST1_CONNECT DB2OSC DB2QREP DSN8910 DSNAOCLI DSNRGFDB DSNRLST DSNULI IBM_RTMON IBM_SNAP_REP NULLID SQLJ SYSACCEL SYSCAT SYSFUN SYSIBM SYSIBMADM SYSIBMINTERNAL
        SYSIBMTS SYSPROC SYSPUBLIC SYSSTAT SYSTOOLS""".split(),
}

_SCHEMAS = {"mysql": ("information_schema.schemata", "schema_name"), "oracle": ("all_users", "username"), "db2": ("syscat.schemata", "schemaname")}


def _kind(dialect: str) -> str:
    return {"mariadb": "mysql", "db2zos": "db2"}.get(dialect, dialect)


def schemas(catalog: Catalog, dialect: str) -> DataFrame:
    """(name): the schemas that are not the source's own; of DB2 none that begins with SYS."""
    table, column = _SCHEMAS[_kind(dialect)]
    name = F.trim(F.col(column))
    own = name if _kind(dialect) == "mysql" else F.upper(name)
    rows = catalog(table).select(name.alias("name"), own.alias("_own")).where(~F.col("_own").isin(SYSTEM_SCHEMAS[_kind(dialect)]))
    return (rows.where(~F.col("_own").startswith("SYS")) if _kind(dialect) == "db2" else rows).select("name")


def _quoted(name: Column, dialect: str) -> Column:
    mark = "`" if _kind(dialect) == "mysql" else '"'
    return F.concat(F.lit(mark), F.replace(name, F.lit(mark), F.lit(mark * 2)), F.lit(mark))


def _text(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))


def _columns(catalog: Catalog, dialect: str, schema: str) -> DataFrame:
    """(tab, at, line): a line of CREATE TABLE for each column of the schema's base tables."""
    kind = _kind(dialect)
    if kind == "mysql":
        tables = catalog("information_schema.tables").where((F.col("table_schema") == schema) & F.col("table_type").isin("BASE TABLE", "SYSTEM VERSIONED")).select(F.col("table_name").alias("tab"))
        c = catalog("information_schema.columns").where(F.col("table_schema") == schema)
        extra, default = F.lower(F.coalesce("extra", F.lit(""))), F.col("column_default")
        own_text = F.lower("column_type").rlike("char|text|enum|set|date|time|year") & ~F.lower(F.coalesce(default, F.lit(""))).rlike(r"^(current_timestamp|now)\b|\(") & ~extra.contains("default_generated")
        generated = F.coalesce("generation_expression", F.lit(""))
        line = F.concat_ws(
            " ", _quoted(F.col("column_name"), kind), F.col("column_type"),
            F.when(generated != "", F.concat(F.lit("GENERATED ALWAYS AS ("), generated, F.lit(")"))),
            F.when(F.col("is_nullable") == "NO", F.lit("NOT NULL")),
            F.when(default.isNotNull() & (generated == ""), F.concat(F.lit("DEFAULT "), F.when(own_text, _text(default)).otherwise(default))),
            F.when(extra.contains("auto_increment"), F.lit("AUTO_INCREMENT")),
            F.when(extra.contains("on update"), F.lit("ON UPDATE CURRENT_TIMESTAMP")),
            F.when(F.coalesce("column_comment", F.lit("")) != "", F.concat(F.lit("COMMENT "), _text(F.col("column_comment")))),
        )
        return c.select(F.col("table_name").alias("tab"), F.col("ordinal_position").alias("at"), line.alias("line")).join(tables, "tab", "left_semi")
    if kind == "oracle":
        tables = catalog("all_tables").where((F.col("owner") == schema.upper()) & (F.coalesce("temporary", F.lit("N")) == "N") & (F.coalesce("nested", F.lit("NO")) == "NO") & (F.coalesce("secondary", F.lit("N")) == "N")).select(F.col("table_name").alias("tab"))
        c = catalog("all_tab_columns").where(F.col("owner") == schema.upper())
        t = F.col("data_type")
        size = (
            F.when(t.isin("VARCHAR2", "NVARCHAR2", "CHAR", "NCHAR"), F.concat(F.lit("("), F.coalesce("char_length", "data_length").cast("string"), F.when(F.col("char_used") == "C", " CHAR").otherwise(""), F.lit(")")))
            .when(t == "RAW", F.concat(F.lit("("), F.col("data_length").cast("string"), F.lit(")")))
            .when((t == "NUMBER") & F.col("data_precision").isNotNull(), F.concat(F.lit("("), F.col("data_precision").cast("string"), F.lit(","), F.coalesce("data_scale", F.lit(0)).cast("string"), F.lit(")")))
            .otherwise("")
        )
        line = F.concat_ws(
            " ", _quoted(F.col("column_name"), kind), F.concat(t, size),
            F.when(F.col("identity_column") == "YES", F.lit("GENERATED BY DEFAULT AS IDENTITY")).when(F.col("data_default").isNotNull(), F.concat(F.lit("DEFAULT "), F.trim("data_default"))),
            F.when(F.col("nullable") == "N", F.lit("NOT NULL")),
        )
        return c.select(F.col("table_name").alias("tab"), F.col("column_id").alias("at"), line.alias("line")).join(tables, "tab", "left_semi")
    tables = catalog("syscat.tables").where((F.trim("tabschema") == schema) & (F.col("type") == "T")).select(F.trim("tabname").alias("tab"))
    c = catalog("syscat.columns").where(F.trim("tabschema") == schema)
    t, n = F.trim("typename"), F.col("length").cast("string")
    size = F.when(t.isin("VARCHAR", "CHARACTER", "CHAR", "GRAPHIC", "VARGRAPHIC"), F.concat(F.lit("("), n, F.lit(")"))).when(t.isin("DECIMAL", "NUMERIC"), F.concat(F.lit("("), n, F.lit(","), F.col("scale").cast("string"), F.lit(")"))).when(t == "DECFLOAT", F.when(F.col("length") == 8, "(16)").otherwise("(34)")).otherwise("")
    how = F.when(F.col("generated") == "D", "BY DEFAULT").otherwise("ALWAYS")
    line = F.concat_ws(
        " ", _quoted(F.trim("colname"), kind), F.concat(t, size),
        F.when(F.col("identity") == "Y", F.concat(F.lit("GENERATED "), how, F.lit(" AS IDENTITY"))).when(F.coalesce(F.trim("default"), F.lit("")) != "", F.concat(F.lit("DEFAULT "), F.trim("default"))),
        F.when(F.col("nulls") == "N", F.lit("NOT NULL")),
    )
    return c.select(F.trim("tabname").alias("tab"), F.col("colno").alias("at"), line.alias("line")).join(tables, "tab", "left_semi")


def _keys(catalog: Catalog, dialect: str, schema: str) -> DataFrame:
    """(tab, name, kind, at, col, parent, ref): a row for each column of a primary, unique or foreign key."""
    kind = _kind(dialect)
    if kind == "mysql":
        k = catalog("information_schema.key_column_usage").where(F.col("table_schema") == schema).alias("k")
        c = catalog("information_schema.table_constraints").where(F.col("table_schema") == schema).select("constraint_name", "table_name", "constraint_type")
        both = k.join(c, ["constraint_name", "table_name"])
        return both.select(F.col("table_name").alias("tab"), F.col("constraint_name").alias("name"), F.col("constraint_type").alias("kind"), F.col("ordinal_position").alias("at"), F.col("column_name").alias("col"), F.col("referenced_table_name").alias("parent"), F.col("referenced_column_name").alias("ref"))
    if kind == "oracle":
        c = catalog("all_constraints").where((F.col("owner") == schema.upper()) & F.col("constraint_type").isin("P", "U", "R")).select("constraint_name", "constraint_type", "r_constraint_name", "table_name")
        k = catalog("all_cons_columns").where(F.col("owner") == schema.upper()).select("constraint_name", "column_name", "position")
        refs = k.select(F.col("constraint_name").alias("r_constraint_name"), F.col("column_name").alias("ref"), F.col("position").alias("position"))
        parents = c.select(F.col("constraint_name").alias("r_constraint_name"), F.col("table_name").alias("parent"))
        names = F.create_map(*[F.lit(x) for x in ("P", "PRIMARY KEY", "U", "UNIQUE", "R", "FOREIGN KEY")])
        both = c.join(k, "constraint_name").join(parents, "r_constraint_name", "left").join(refs, ["r_constraint_name", "position"], "left")
        return both.select(F.col("table_name").alias("tab"), F.col("constraint_name").alias("name"), names[F.col("constraint_type")].alias("kind"), F.col("position").alias("at"), F.col("column_name").alias("col"), "parent", "ref")
    c = catalog("syscat.tabconst").where((F.trim("tabschema") == schema) & F.col("type").isin("P", "U")).select("constname", F.trim("tabname").alias("tab"), "type")
    k = catalog("syscat.keycoluse").where(F.trim("tabschema") == schema).select("constname", F.trim("tabname").alias("tab"), F.trim("colname").alias("col"), "colseq")
    names = F.create_map(*[F.lit(x) for x in ("P", "PRIMARY KEY", "U", "UNIQUE")])
    none = F.lit(None).cast("string")
    return c.join(k, ["constname", "tab"]).select("tab", F.trim("constname").alias("name"), names[F.col("type")].alias("kind"), F.col("colseq").alias("at"), "col", none.alias("parent"), none.alias("ref"))


def _gathered(rows: DataFrame, by: list[str], order: str, text: str, sep: str) -> DataFrame:
    """(by, text): the texts of a group in order; a group is the columns of one table or key."""
    got = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(got, lambda s: s["t"]), sep).alias(text))


def _tables(catalog: Catalog, dialect: str, schema: str) -> DataFrame:
    kind = _kind(dialect)
    q = lambda c: _quoted(F.col(c), kind)
    keys = _keys(catalog, dialect, schema).withColumn("c", q("col")).withColumn("r", F.coalesce(q("ref"), F.lit("")))
    own = _gathered(keys, ["tab", "name", "kind", "parent"], "at", "c", ", ").join(_gathered(keys, ["tab", "name"], "at", "r", ", "), ["tab", "name"])
    refers = F.when(F.col("kind") == "FOREIGN KEY", F.concat(F.lit(" REFERENCES "), q("parent"), F.lit(" ("), F.col("r"), F.lit(")"))).otherwise("")
    name = F.when(F.col("kind") == "PRIMARY KEY", "").otherwise(F.concat(F.lit("CONSTRAINT "), q("name"), F.lit(" ")))
    order = F.element_at(F.create_map(*[F.lit(x) for x in ("PRIMARY KEY", 1_000_000, "UNIQUE", 1_000_001, "FOREIGN KEY", 1_000_002)]), F.col("kind"))
    lines = own.select("tab", F.struct(order.alias("a"), F.col("name").alias("b")).alias("at"), F.concat(name, F.col("kind"), F.lit(" ("), F.col("c"), F.lit(")"), refers).alias("line"))
    cols = _columns(catalog, dialect, schema).select("tab", F.struct(F.col("at").cast("int").alias("a"), F.lit("").alias("b")).alias("at"), "line")
    whole = _gathered(cols.unionByName(lines.join(cols.select("tab").distinct(), "tab", "left_semi")), ["tab"], "at", "line", ",\n  ")
    return whole.select(F.lit("table").alias("kind"), F.col("tab").alias("name"), F.concat(F.lit("CREATE TABLE "), q("tab"), F.lit(" (\n  "), F.col("line"), F.lit("\n)")).alias("ddl"))


#: Texts of other objects: kind, catalog view, columns of schema, name and text, and what stands before the text.
_TEXTS = {
    "mysql": [("view", "information_schema.views", "table_schema", "table_name", "view_definition", "CREATE VIEW {name} AS "), ("routine", "information_schema.routines", "routine_schema", "routine_name", "routine_definition", None)],
    "oracle": [("view", "all_views", "owner", "view_name", "text", "CREATE VIEW {name} AS ")],
    "db2": [("view", "syscat.views", "viewschema", "viewname", "text", None), ("trigger", "syscat.triggers", "trigschema", "trigname", "text", None), ("routine", "syscat.routines", "routineschema", "routinename", "text", None)],
}


def introspect(catalog: Catalog, dialect: str, schema: str) -> DataFrame:
    """(kind, name, ddl): the statements that create a schema's tables, with their keys, and its views and other texts.

    A table without columns has no statement; a view whose text is hidden
    (null) has none either.  catalog: the DataFrame of a catalog view by its
    name; views that a source lacks may be empty, but must have their columns.
    """
    kind = _kind(dialect)
    out = _tables(catalog, dialect, schema)
    for what, view, owner, name, text, lead in _TEXTS[kind]:
        rows = catalog(view).where((F.trim(owner) == (schema.upper() if kind == "oracle" else schema)) & F.col(text).isNotNull())
        before = F.lit("") if lead is None else F.concat(F.lit(lead.split("{name}")[0]), _quoted(F.trim(name), kind), F.lit(lead.split("{name}")[1]))
        out = out.unionByName(rows.select(F.lit(what).alias("kind"), F.trim(name).alias("name"), F.concat(before, F.trim(text)).alias("ddl")))
    return out


def script(statements: DataFrame, kinds: tuple[str, ...] = ("table", "view")) -> str:
    """The statements as one script, for plan_schema(): as long as the schema's definitions."""
    rows = statements.where(F.col("kind").isin(*kinds)).orderBy(F.col("kind") != "table", "name").select("ddl").collect()
    return ";\n".join(r.ddl.rstrip().rstrip(";") for r in rows) + ";"
