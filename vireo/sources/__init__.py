from .tables import TABLES, jdbc_scan, load_table, require_non_empty, scan  # noqa: F401
