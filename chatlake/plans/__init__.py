"""Query plans over the test tables: adapters, the query catalog and the
DuckDB oracle statements used for the correctness check."""
