"""Plant: log of hours and fuel, maintenance."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earthworks.functions.columns import or_label
from earthworks.operators.aggregates import total
from earthworks.operators.filters import equals_if
from earthworks.operators.joins import with_names, with_site
from earthworks.operators.windows import latest, newest_with_match
from earthworks.plans.facts import Frames
from earthworks.sources import catalog
from earthworks.sources.tables import MONTH, recent

# Fixed value: note of a fuel exit, before the name of the plant.
FUEL_NOTE = "Carburant engin "


def _entries(tables: Frames, as_of: dt.date, days: int | None, site: int | None) -> DataFrame:
    return recent(tables["suivi_materiels"], "suivi_materiels", as_of, days).filter(equals_if("rue_id", site))


def _log(tables: Frames, as_of: dt.date, days: int | None, site: int | None, k: int | None) -> DataFrame:
    chosen = newest_with_match(
        _entries(tables, as_of, days, site), tables["materiels"], "materiel_id", "date_suivi", k, MONTH)
    rows = with_names(chosen, tables["materiels"], "materiel_id", "inner", engin="nom")
    return rows if k is None else latest(rows, "date_suivi", "id", k)


def plant_log(
    tables: Frames, as_of: dt.date, days: int | None = 7, site: int | None = None, k: int = 200
) -> DataFrame:
    rows = with_site(_log(tables, as_of, days, site, k), tables)
    rows = with_names(rows, tables["materiaux"], "carburant_materiau_id", __fuel="nom")
    return rows.select(
        "id", "date_suivi", "chantier", "engin", "heures_travail", or_label("__fuel").alias("carburant"),
        "carburant_consomme", "observations",
    ).orderBy(F.desc("date_suivi"), F.desc("id"))


def plant_totals(
    tables: Frames, as_of: dt.date, days: int | None = None, site: int | None = None, last_n: int | None = None
) -> DataFrame:
    """Hours and fuel of known plant; sums are taken per machine first, and only they meet the list of plant."""
    rows = _entries(tables, as_of, days, site) if last_n is None else _log(tables, as_of, days, site, last_n)
    per_machine = rows.groupBy("materiel_id").agg(
        total("heures_travail").alias("heures"), total("carburant_consomme").alias("carburant"))
    return with_names(per_machine, tables["materiels"], "materiel_id", "inner").agg(
        total("heures").alias("total_heures"), total("carburant").alias("total_carburant")
    )


def fuel_exits(tables: Frames) -> DataFrame:
    """Stock exits for the fuel plant used, ready to append."""
    used = tables["suivi_materiels"].filter(
        F.col("carburant_materiau_id").isNotNull() & (F.col("carburant_consomme") > 0)
    )
    rows = with_names(used, tables["materiels"], "materiel_id", "inner", __plant="nom")
    return rows.select(
        F.col("date_suivi").alias("date_mvt"), "rue_id", F.col("carburant_materiau_id").alias("materiau_id"),
        F.lit(catalog.EXIT).alias("type_mvt"), F.col("carburant_consomme").alias("quantite"),
        F.concat(F.lit(FUEL_NOTE), F.col("__plant")).alias("observation"),
    )


def maintenance_history(tables: Frames, k: int = 100) -> DataFrame:
    newest = newest_with_match(
        tables["maintenance_materiels"], tables["materiels"], "materiel_id", "date_maintenance", k, MONTH)
    rows = with_names(newest, tables["materiels"], "materiel_id", "inner", engin="nom")
    return latest(rows, "date_maintenance", "id", k).select(
        "id", "date_maintenance", "engin", "type_maintenance", "description", "cout"
    )


def maintenance_costs(tables: Frames) -> DataFrame:
    costs = tables["maintenance_materiels"].groupBy("materiel_id").agg(
        F.count(F.lit(1)).alias("nb_interventions"), total("cout").alias("cout_total")
    )
    return with_names(costs, tables["materiels"], "materiel_id", "inner", engin="nom").select(
        "engin", "nb_interventions", "cout_total"
    )
