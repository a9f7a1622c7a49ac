"""Spark queries over the driver's tables, each beside its DuckDB oracle."""

from weftline.queries import annotate, compared, measured, prepared, relate, selected, stored
from weftline.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "annotate", "compared", "measured", "prepared", "relate", "selected", "stored"]
