"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over
the given tables; ``oracle`` holds their DuckDB twins."""
