"""Query plans wired to the test tables: ``registry.queries()`` and ``registry.oracle_sql()``."""
