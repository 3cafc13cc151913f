"""Opt-in semantics of the dialect's older engine, where they differ from SQL; and scalar operators SQL spells otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def like_anywhere(column: Column, pattern: str) -> Column:
    """LIKE as an unanchored pattern: `%` any run, `_` any one character, anywhere in the value."""
    body = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern)
    return column.rlike(body)


def equal_with_nulls(a: Column, b: Column) -> Column:
    """= that holds for two NULLs."""
    return a.eqNullSafe(b)


def strict_and(a: Column, b: Column) -> Column:
    """AND that is NULL as soon as one side is."""
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(a & b)


def strict_or(a: Column, b: Column) -> Column:
    """OR that is NULL as soon as one side is."""
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(a | b)


def xor(a: Column, b: Column) -> Column:
    return a != b


def divide(a: Column, b: Column) -> Column:
    """/ in doubles; NULL where the divisor is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
