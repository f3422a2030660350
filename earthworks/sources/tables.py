"""Table scans: lazy access to the domain tables, parameterised SQL and lookups."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earthworks.operators.filters import all_of, between_if, equals_if, in_month
from earthworks.sources import catalog

# Event date of each fact table: partition column for storage and pruning.
EVENT_DATES = {
    "realisations_journalieres": "date_suivi",
    "decomptes_st": "date_decompte",
    "paiements_st": "date_paiement",
    "pointage": "date_pointage",
    "approvisionnements": "date_besoin",
    "mouvements_materiaux": "date_mvt",
    "suivi_materiels": "date_suivi",
    "maintenance_materiels": "date_maintenance",
    "journal_chantier": "date_journal",
    "caisse_chantier": "date_op",
    "courriers": "date_courrier",
    "incidents": "date_incident",
    "receptions_appro": "date_reception",
    "audit_log": "timestamp",
}
MONTH = "mois"


class Tables(Mapping[str, DataFrame]):
    """Domain tables by name, each opened on first use."""

    def __init__(self, spark: SparkSession, names: list[str], open_table: Callable[[str], DataFrame]):
        self.spark = spark
        self._names = names
        self._open = open_table
        self._opened: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._opened:
            if name not in self._names:
                raise KeyError(name)
            self._opened[name] = self._open(name)
        return self._opened[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Scan one domain table with its declared schema."""
    fields = catalog.schema(name)
    if name in EVENT_DATES:
        fields = fields.add(MONTH, "string")
    return spark.read.schema(fields).parquet(f"{directory}/{name}")


def open_warehouse(spark: SparkSession, directory: str) -> Tables:
    return Tables(spark, catalog.table_names(), lambda name: load(spark, directory, name))


def save(df: DataFrame, directory: str, name: str, mode: str = "errorifexists") -> None:
    """Write a domain table; facts are laid out by month of their event date.

    Rows are rebalanced by month: adaptive execution splits a month that holds
    much of the table over many tasks and joins small months.
    """
    df = df.select(*[c.name for c in catalog.columns(name)])
    event_date = EVENT_DATES.get(name)
    if event_date is None:
        df.write.mode(mode).parquet(f"{directory}/{name}")
        return
    by_month = df.withColumn(MONTH, month_of(event_date)).hint("rebalance", MONTH)
    by_month.write.mode(mode).partitionBy(MONTH).parquet(f"{directory}/{name}")


def period(df: DataFrame, name: str, start: dt.date | None, end: dt.date | None) -> DataFrame:
    """Rows of a fact in an inclusive period; stored months outside it are not read."""
    chosen = df.filter(between_if(EVENT_DATES[name], start, end))
    if MONTH in df.columns:
        first = None if start is None else f"{start:%Y-%m}"
        last = None if end is None else f"{end:%Y-%m}"
        chosen = chosen.filter(between_if(MONTH, first, last))
    return chosen


def recent(df: DataFrame, name: str, as_of: dt.date, days: int | None) -> DataFrame:
    """Rows of the last ``days`` days, all when ``days`` is None."""
    return period(df, name, None if days is None else as_of - dt.timedelta(days=days), None)


def month(df: DataFrame, name: str, wanted: str | None) -> DataFrame:
    """Rows of a month given as ``YYYY-MM``, all when it is None."""
    chosen = df.filter(in_month(EVENT_DATES[name], wanted))
    return chosen.filter(equals_if(MONTH, wanted)) if MONTH in df.columns else chosen


def month_of(date: str | Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def sql(spark: SparkSession, query: str, params: dict[str, Any] | None = None, **tables: DataFrame) -> DataFrame:
    """Run a query with typed ``:name`` parameters over ``{name}`` tables."""
    return spark.sql(query, args=params or {}, **tables)


def literal(spec: catalog.ColumnSpec) -> Column:
    """The default of a column as a typed literal."""
    return F.lit(spec.default).cast(spec.type)


def with_defaults(df: DataFrame, name: str, fill_nulls: bool = False) -> DataFrame:
    """Bring a frame to the full schema of a table, adding columns it lacks.

    ``fill_nulls`` also replaces NULLs by the default of their column.
    """
    out = []
    for spec in catalog.columns(name):
        if spec.name not in df.columns:
            out.append(literal(spec).alias(spec.name))
        elif fill_nulls and spec.default is not None:
            out.append(F.coalesce(F.col(spec.name), literal(spec)).alias(spec.name))
        else:
            out.append(F.col(spec.name))
    return df.select(*out)


# Lookups: a filter is added only for an argument that is set.

def sites(tables: Mapping[str, DataFrame], project: int | None = None) -> DataFrame:
    return tables["rues"].filter(equals_if("dossier_id", project))


def deliverables(tables: Mapping[str, DataFrame], site: int | None = None) -> DataFrame:
    return tables["livrables"].filter(equals_if("chantier_id", site))


def materials(tables: Mapping[str, DataFrame], category: str | None = None) -> DataFrame:
    return tables["materiaux"].filter(equals_if("categorie", category))


def fuels(tables: Mapping[str, DataFrame]) -> DataFrame:
    return tables["materiaux"].filter(F.lower("categorie") == catalog.FUEL_CATEGORY)


def plant(tables: Mapping[str, DataFrame], state: str | None = None) -> DataFrame:
    return tables["materiels"].filter(equals_if("etat", state))


def staff(tables: Mapping[str, DataFrame], active_only: bool = True) -> DataFrame:
    return tables["personnel"].filter(equals_if("actif", 1 if active_only else None))


def bill_lines(
    tables: Mapping[str, DataFrame], site: int | None = None, deliverable: int | None = None
) -> DataFrame:
    wanted = all_of(equals_if("rue_id", site), equals_if("livrable_id", deliverable))
    return tables["devis_rue"].filter(wanted)
