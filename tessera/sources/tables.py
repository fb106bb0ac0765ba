"""Sources of tables: Parquet folders, databases by JDBC, and dictionary views over the session's catalog."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import Range, key_ranges
from .introspect import SYSTEM_SCHEMAS

class Source(Protocol):
    def __call__(self, table: str) -> DataFrame: ...


@dataclass
class ParquetSource:
    """Tables as Parquet folders under a path, on any file system that Spark reads."""

    spark: SparkSession
    path: str

    def __call__(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}.parquet")


@dataclass
class JdbcSource:
    """Tables of a database. The driver's jar must be on the class path; nothing here was run against one.

    A table with a numeric key is read in ranges of it, each a partition with its own predicate, so filters and columns
    reach the database and no range is read twice.
    """

    spark: SparkSession
    dialect: str
    url: str
    schema: str = ""
    properties: dict[str, str] = field(default_factory=dict)
    width: int = 1_000_000

    @staticmethod
    def url_for(dialect: str, host: str, port: int, database: str, sid: bool = False) -> str:
        if dialect in ("mysql", "mariadb"):
            return f"jdbc:{dialect}://{host}:{port}/{database}?zeroDateTimeBehavior=CONVERT_TO_NULL"
        if dialect == "oracle":
            return f"jdbc:oracle:thin:@{host}:{port}:{database}" if sid else f"jdbc:oracle:thin:@//{host}:{port}/{database}"
        return f"jdbc:db2://{host}:{port}/{database}"

    def quote(self, name: str) -> str:
        mark = "`" if self.dialect in ("mysql", "mariadb") else '"'
        return mark + name.replace(mark, mark * 2) + mark

    def qualified(self, table: str) -> str:
        return (self.quote(self.schema) + "." if self.schema else "") + self.quote(table)

    def reader(self):
        r = self.spark.read.format("jdbc").option("url", self.url).option("fetchsize", "10000")
        for k, v in self.properties.items():
            r = r.option(k, v)
        return r

    def ping_sql(self) -> str:
        return {"oracle": "SELECT banner FROM v$version WHERE ROWNUM = 1", "db2": "SELECT service_level FROM sysibmadm.env_inst_info"}.get(self.dialect, "SELECT version()")

    def version(self) -> str:
        return self.reader().option("query", self.ping_sql()).load().first()[0]

    def schemas_sql(self) -> str:
        hidden = ", ".join(f"'{s}'" for s in SYSTEM_SCHEMAS.get("mysql" if self.dialect == "mariadb" else self.dialect, []))
        base = {"oracle": "SELECT username AS name FROM all_users WHERE username", "db2": "SELECT TRIM(schemaname) AS name FROM syscat.schemata WHERE TRIM(schemaname)"}.get(self.dialect, "SELECT schema_name AS name FROM information_schema.schemata WHERE schema_name")
        return f"{base} NOT IN ({hidden})"

    def catalog(self, view: str) -> DataFrame:
        """A catalog view with its column names in lower case, for introspect()."""
        df = self.reader().option("dbtable", view).load()
        return df.toDF(*[c.lower() for c in df.columns])

    def count_sql(self, table: str) -> str:
        return f"SELECT COUNT(*) AS n FROM {self.qualified(table)}"

    def range_sql(self, table: str, key: str) -> str:
        k = self.quote(key)
        return f"SELECT MIN({k}) AS a, MAX({k}) AS b FROM {self.qualified(table)}"

    def predicates(self, key: str, ranges: list[Range]) -> list[str]:
        """One for each range; rows without a key come with the first."""
        out = [r.predicate(self.quote(key)) for r in ranges]
        return [f"({p}) OR {self.quote(key)} IS NULL" if i == 0 else p for i, p in enumerate(out)]

    def __call__(self, table: str, key: str | None = None) -> DataFrame:
        if key is None:
            return self.reader().option("dbtable", self.qualified(table)).load()
        low, high = self.reader().option("query", self.range_sql(table, key)).load().first()
        return self.spark.read.jdbc(self.url, self.qualified(table), predicates=self.predicates(key, key_ranges(low, high, self.width)), properties=self.properties)


def dictionary_views(spark: SparkSession, database: str | None = None, plan=None) -> None:
    """Oracle's dictionary views over the session's catalog: objects, tables, columns, comments, indexes and their columns, as ALL_, DBA_ and USER_ (without an owner).

    plan: a SchemaPlan, whose keys are the indexes; the catalog has none.
    Rows are as many as the definitions.
    """
    database = database or spark.catalog.currentDatabase()
    tables, columns = [], []
    for t in spark.catalog.listTables(database):
        kind = "VIEW" if t.tableType in ("VIEW", "TEMPORARY") else "TABLE"
        tables.append((database.upper(), t.name.upper(), kind, t.description))
        for i, f in enumerate(spark.catalog.listColumns(t.name if t.isTemporary else f"{database}.{t.name}"), 1):
            columns.append((database.upper(), t.name.upper(), f.name.upper(), f.dataType.upper(), i, "Y" if f.nullable else "N", f.description))
    t = spark.createDataFrame(tables, "owner string, object_name string, object_type string, comments string")
    c = spark.createDataFrame(columns, "owner string, table_name string, column_name string, data_type string, column_id int, nullable string, comments string")
    indexes, parts = [], []
    for table in plan.tables.values() if plan is not None else ():
        for n, k in enumerate(table.keys, 1):
            name = (k.name or f"{table.name}_{'pk' if k.kind == 'primary' else n}").upper()
            indexes.append((database.upper(), name, database.upper(), table.name.upper(), "NONUNIQUE" if k.kind == "index" else "UNIQUE", "DOMAIN" if k.method in ("fulltext", "spatial", "vector") else "BITMAP" if k.method == "bitmap" else "NORMAL"))
            parts += [(database.upper(), name, database.upper(), table.name.upper(), c.upper(), i, "ASC") for i, c in enumerate(k.columns, 1)]
    owned = {
        "objects": t.drop("comments"),
        "tables": t.where("object_type = 'TABLE'").select("owner", F.col("object_name").alias("table_name")),
        "tab_comments": t.select("owner", F.col("object_name").alias("table_name"), F.col("object_type").alias("table_type"), "comments"),
        "tab_columns": c.drop("comments"),
        "col_comments": c.select("owner", "table_name", "column_name", "comments"),
        "indexes": spark.createDataFrame(indexes, "owner string, index_name string, table_owner string, table_name string, uniqueness string, index_type string"),
        "ind_columns": spark.createDataFrame(parts, "index_owner string, index_name string, table_owner string, table_name string, column_name string, column_position int, descend string"),
    }
    for name, df in owned.items():
        for scope in ("all", "dba"):
            df.createOrReplaceTempView(f"{scope}_{name}")
        df.drop("owner", "index_owner").createOrReplaceTempView(f"user_{name}")
