"""SQL type names and the Spark types, ranges and lengths that stand for them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from larkspur.errors import EngineError

#: name -> (Spark type, printed name); unsigned types take the next wider one.
_SIGNED = {"tinyint": (T.ByteType(), "TINYINT"), "smallint": (T.ShortType(), "SMALLINT"), "int": (T.IntegerType(), "INTEGER"), "integer": (T.IntegerType(), "INTEGER"), "bigint": (T.LongType(), "BIGINT")}
_UNSIGNED = {
    "tinyint": (T.ShortType(), "UTINYINT", 2**8 - 1),
    "smallint": (T.IntegerType(), "USMALLINT", 2**16 - 1),
    "int": (T.LongType(), "UINTEGER", 2**32 - 1),
    "integer": (T.LongType(), "UINTEGER", 2**32 - 1),
    "bigint": (T.DecimalType(20, 0), "UBIGINT", 2**64 - 1),
}
_PLAIN = {"boolean": (T.BooleanType(), "BOOLEAN"), "float": (T.FloatType(), "FLOAT"), "double": (T.DoubleType(), "DOUBLE"), "date": (T.DateType(), "DATE"), "datetime": (T.TimestampNTZType(), "DATETIME")}


@dataclass(frozen=True)
class SqlType:
    """A column type: its printed name, Spark's type as DDL, and what Spark doesn't check itself."""

    name: str
    spark: str
    length: int | None = None  # bytes of a string
    largest: int | None = None  # of an unsigned number

    @property
    def data_type(self) -> T.DataType:
        return T.DataType.fromDDL(self.spark)


def sql_type(name: str, args: tuple[int, ...] = (), unsigned: bool = False) -> SqlType:
    name = name.lower()
    if unsigned:
        if name not in _UNSIGNED:
            raise EngineError(f"{name} has no unsigned form")
        kind, printed, largest = _UNSIGNED[name]
        return SqlType(printed, kind.simpleString(), largest=largest)
    if name in _SIGNED:
        kind, printed = _SIGNED[name]
        return SqlType(printed, kind.simpleString())
    if name in _PLAIN:
        kind, printed = _PLAIN[name]
        return SqlType(printed, kind.simpleString())
    if name in ("varchar", "char", "character"):
        return SqlType(f"VARCHAR({args[0]})" if args else "VARCHAR", "string", length=args[0] if args else None)
    if name in ("decimal", "dec"):
        p, s = (args[0], args[1] if len(args) > 1 else 0) if args else (28, 10)
        if not 0 < p <= 38 or not 0 <= s <= p:
            raise EngineError(f"decimal({p}, {s}) is out of range")
        return SqlType(f"DECIMAL({p}, {s})" if args else "DECIMAL", f"decimal({p},{s})")
    raise EngineError(f"unknown type {name}")
