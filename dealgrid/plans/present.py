"""Flat, engine-neutral result columns: no decimals, dates or nested values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def present(df: DataFrame) -> DataFrame:
    cols = []
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.DecimalType):
            c = c.cast("double")
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(kind, T.ArrayType):
            c = F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
        elif isinstance(kind, T.MapType):
            entries = F.array_sort(F.map_entries(c))
            c = F.concat_ws(",", F.transform(entries, lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))))
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(field.name))
    return df.select(*cols)
