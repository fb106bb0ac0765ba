"""Types, tables and constraints."""
