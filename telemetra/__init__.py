"""Episode analytics on Spark: typed tables, as-of joins, windows, quality rules and exports as DataFrame operations."""
