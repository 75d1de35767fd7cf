"""Queries of the engine's operators on the supplied tables, and the same in DuckDB SQL."""
