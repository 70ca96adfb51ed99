"""The catalogue of queries: each binds operators to the given tables and states the same result in DuckDB SQL."""
