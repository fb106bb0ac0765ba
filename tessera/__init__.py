"""A Spark-native engine for SQL in the dialects of MySQL, MariaDB, Oracle and DB2, and for moving their data."""
