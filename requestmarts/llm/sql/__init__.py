"""DuckDB texts of the queries that SQL can express."""
