"""Checks of rows against a table's columns, as few Spark jobs as the constraints need."""

from __future__ import annotations

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.catalog import Column, Table
from larkspur.errors import ConstraintError


def broken(c: Column) -> dict[str, Col]:
    """Conditions that no row may meet, by their message."""
    out = {}
    if not c.nullable or c.primary:
        out[f"{c.name} can't be null"] = F.col(c.name).isNull()
    if c.type.length is not None:
        out[f"{c.name} is longer than {c.type.length}"] = F.octet_length(c.name) > c.type.length
    if c.type.largest is not None:
        out[f"{c.name} is out of range"] = (F.col(c.name) < 0) | (F.col(c.name) > F.lit(str(c.type.largest)).cast("decimal(20,0)"))
    return out


def check_rows(df: DataFrame, columns: list[Column]) -> int:
    """Number of rows, or the first constraint that some row breaks. One pass."""
    conditions = {m: p for c in columns for m, p in broken(c).items()}
    sums = [F.coalesce(F.max(p.cast("int")), F.lit(0)).alias(f"b{i}") for i, p in enumerate(conditions.values())]
    row = df.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    for i, message in enumerate(conditions):
        if row[f"b{i}"]:
            raise ConstraintError(message)
    return row["n"]


def check_keys(df: DataFrame, keys: list[str]) -> None:
    """No two rows agree in all keys; rows with a null key agree with none."""
    twice = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
    if twice.count():
        raise ConstraintError(f"duplicate value of {', '.join(keys)}")


def key_sets(table: Table) -> list[list[str]]:
    primary = [[c.name for c in table.primary]] if table.primary else []
    return primary + [[c.name] for c in table.unique if [c.name] not in primary]


def within(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows between the least and the largest new key: files and row groups outside are not read."""
    low, high = new.agg(F.min(key), F.max(key)).first()
    return old.where(F.lit(False)) if low is None else old.where(F.col(key).between(F.lit(low), F.lit(high)))


def check_new_keys(new: DataFrame, old: DataFrame | None, sets: list[list[str]]) -> None:
    """Neither the new rows among themselves nor with the old ones share a key. The old table is only semi-joined, and only read
    where keys may meet."""
    for keys in sets:
        check_keys(new, keys)
        if old is not None and within(old, new, keys[0]).select(*keys).join(new.select(*keys), keys, "left_semi").limit(1).count():
            raise ConstraintError(f"duplicate value of {', '.join(keys)}")
