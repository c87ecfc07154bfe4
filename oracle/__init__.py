"""SQL twins of the registered queries, written from the definitions and run by DuckDB in the checks."""
