"""Delimited files with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, delimiter: str = "|", header: bool = False, quote: str = '"', escape: str = "\\") -> DataFrame:
    """Every field is cast to its declared type; malformed fields and rows of another width fail, an empty field is NULL.
    A file whose first line ends in a delimiter too many ends every line so."""
    options = {"sep": delimiter, "header": str(header).lower(), "quote": quote, "escape": escape, "mode": "FAILFAST", "enforceSchema": "true", "timestampNTZFormat": "yyyy-MM-dd[ HH:mm:ss]"}
    first = spark.read.text(path).head()
    wide = first is not None and first[0].endswith(delimiter) and first[0].count(delimiter) >= len(schema)
    fields = T.StructType([*schema.fields, T.StructField("_end", T.StringType())]) if wide else schema
    df = spark.read.schema(fields).options(**options).csv(path)
    if not wide:
        return df
    # only nothing may follow the last delimiter
    return df.where(F.when(F.col("_end").isNotNull(), F.raise_error(F.lit("a row has too many fields"))).otherwise(F.lit(True))).drop("_end")
