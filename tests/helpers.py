"""Helpers of the tests."""

from __future__ import annotations

def rows(df, *columns) -> list[tuple]:
    """The rows as sorted tuples; nulls sort first."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=lambda r: [(x is not None, str(type(x)), x) for x in r])
