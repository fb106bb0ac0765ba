"""Where tables come from."""

from .tables import JdbcSource, ParquetSource, Source, dictionary_views

__all__ = ["JdbcSource", "ParquetSource", "Source", "dictionary_views"]
