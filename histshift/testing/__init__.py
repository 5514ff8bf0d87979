"""Test support: DuckDB SQL text that recomputes the registered queries independently."""
