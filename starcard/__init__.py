"""starcard: table catalogs, table search and read-only analytics as PySpark jobs."""
