"""Query catalogue: the registered Spark queries and their DuckDB oracle SQL."""
