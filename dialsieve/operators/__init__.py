"""DataFrame -> DataFrame operators (joins, aggregates, windows; no UDFs)."""
