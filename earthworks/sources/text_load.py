"""Bring tables dumped as text to their declared types and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earthworks.functions.columns import blank_to_null, normalised_name
from earthworks.sources import catalog

# Upper and lower case differ in meaning among units, so they are kept as written.
KEPT_AS_WRITTEN = {("devis_rue", "unite")}


def typed(df: DataFrame, table: str) -> DataFrame:
    """Cast text columns to the types of a table; what cannot be read becomes NULL.

    Labels written without accents or in another case take their standard form.
    """
    out = []
    for spec in catalog.columns(table):
        if spec.name not in df.columns:
            continue
        if isinstance(spec.type, T.StringType):
            value = canonical_label(table, spec.name)
        else:
            value = blank_to_null(spec.name).try_cast(spec.type)
        out.append(value.alias(spec.name))
    return df.select(*out)


def canonical_label(table: str, column: str) -> Column:
    """Label in its standard form, or as written when it is not a known one."""
    allowed = catalog.DOMAINS.get((table, column))
    if allowed is None or (table, column) in KEPT_AS_WRITTEN:
        return F.col(column)
    folded = normalised_name(column)
    known = [F.when(folded == normalised_name(F.lit(label)), F.lit(label)) for label in allowed]
    return F.coalesce(*known, F.col(column))
