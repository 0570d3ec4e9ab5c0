"""Registered queries by area, with their DuckDB oracles."""
