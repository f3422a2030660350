"""Joins to the lookup tables.

No broadcast is forced: the optimizer and adaptive execution broadcast a side
only when its measured size is below the session threshold.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earthworks.functions.columns import NO_LABEL, or_label

SITE = "chantier"


def with_site(
    df: DataFrame, tables: Mapping[str, DataFrame], on: str = "rue_id", label: str = NO_LABEL
) -> DataFrame:
    """Left join to the sites, adding the site name or a label."""
    names = tables["rues"].select(F.col("id").alias("__site"), F.col("nom").alias("__site_name"))
    joined = df.join(names, df[on] == names["__site"], "left")
    return joined.withColumn(SITE, or_label("__site_name", label)).drop("__site", "__site_name")


def with_names(
    df: DataFrame, dim: DataFrame, on: str, how: str = "left", **columns: str
) -> DataFrame:
    """Join to a dimension by id and add the given columns (``new=old``)."""
    side = dim.select(F.col("id").alias("__dim"), *[F.col(old).alias(new) for new, old in columns.items()])
    return df.join(side, df[on] == side["__dim"], how).drop("__dim")


def with_total(df: DataFrame, totals: DataFrame, on: str, key: str) -> DataFrame:
    """Left join to pre-aggregated totals, with 0 where a row has none."""
    values = [c for c in totals.columns if c != key]
    side = totals.withColumnRenamed(key, "__key")
    joined = df.join(side, df[on] == side["__key"], "left")
    filled = {v: F.coalesce(F.col(v), F.lit(0).cast(totals.schema[v].dataType)) for v in values}
    return joined.withColumns(filled).drop("__key")


def name_to_id(df: DataFrame, dim: DataFrame, name: str, out: str) -> DataFrame:
    """Resolve names to ids of a dimension; the lowest id if several rows have a name, NULL if none has."""
    side = dim.groupBy(F.col("nom").alias("__name")).agg(F.min("id").alias(out))
    return df.join(side, df[name] == side["__name"], "left").drop("__name")
