"""Aggregations shared by the jobs; every one combines before its shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVEL = "niveau"
DETAIL, SUBTOTAL, TOTAL = "detail", "sous-total", "total"


def total(c: str | Column) -> Column:
    """Sum with 0 for no rows."""
    return F.coalesce(F.sum(c), F.lit(0))


def total_where(condition: Column, value: str | Column) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))


def first_by_id(column: str, id_column: str = "id") -> Column:
    """First value that is not NULL, in id order."""
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(id_column)))


def first_per_key(df: DataFrame, key: Sequence[str], columns: Sequence[str], id_column: str = "id") -> DataFrame:
    """One row per key with the first non-NULL value of each column."""
    return df.groupBy(*key).agg(*[first_by_id(c, id_column).alias(c) for c in columns])


def distinct_in_order(df: DataFrame, column: str, id_column: str = "id") -> DataFrame:
    """Distinct values that are not NULL with the id they first appear at."""
    seen = df.filter(F.col(column).isNotNull()).groupBy(column)
    return seen.agg(F.min(id_column).alias("premier_id")).orderBy("premier_id")


def pivot_sums(df: DataFrame, key: Sequence[str], names: str, value: str, wanted: list[str]) -> DataFrame:
    """One sum column per wanted name, 0 where a key has none."""
    wide = df.groupBy(*key).pivot(names, wanted).agg(F.sum(value))
    return wide.fillna(0, subset=wanted)


def numeric_summary(df: DataFrame, n: int = 3) -> DataFrame:
    """Sums of the first numeric columns of any result, one row per column."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)][:n]
    sums = df.agg(*[total(F.col(c).cast("decimal(38,4)")).alias(c) for c in numeric])
    pairs = [F.struct(F.lit(c).alias("colonne"), F.col(c).alias("total")) for c in numeric]
    return sums.select(F.inline(F.array(*pairs)))


def at_level(df: DataFrame, level: str) -> DataFrame:
    return df.withColumn(LEVEL, F.lit(level))


def append_levels(detail: DataFrame, *others: DataFrame) -> DataFrame:
    """Detail rows followed by total rows; columns a total lacks are NULL."""
    result = detail
    for other in others:
        result = result.unionByName(other, allowMissingColumns=True)
    return result
