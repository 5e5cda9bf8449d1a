"""Sources: the driver tables and the tables Spark derives from them."""

from webloom.sources.tables import read_table, TABLES

__all__ = ["read_table", "TABLES"]
