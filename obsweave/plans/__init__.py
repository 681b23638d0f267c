"""Query catalogue over the driver tables and its DuckDB counterpart."""
