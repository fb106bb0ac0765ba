"""SQL of MySQL, MariaDB, Oracle and DB2: one lexer, one syntax tree, one parser with dialect switches, one emitter."""

from .api import query, to_spark_sql, translate

__all__ = ["query", "to_spark_sql", "translate"]
