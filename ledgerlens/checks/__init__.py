"""Result normalisation and the DuckDB oracle used as correctness gate."""
