"""Registered queries: thin calls of the operators on the adapter's frames, each with the DuckDB SQL that must agree."""
