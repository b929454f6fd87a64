"""Small column helpers used by several operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def trimmed(c: str | Column) -> Column:
    """The text without outer blanks, null if nothing remains."""
    t = F.trim(c if isinstance(c, Column) else F.col(c))
    return F.when(t != "", t)
