"""Helpers for frames in tests."""

from __future__ import annotations


def rows(df, *columns):
    """Rows as sorted tuples."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(row) for row in chosen.collect()), key=lambda row: tuple((v is None, str(v)) for v in row))
