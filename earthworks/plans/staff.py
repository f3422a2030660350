"""Staff, payroll and attendance."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earthworks.operators.aggregates import LEVEL, total_where
from earthworks.operators.changes import append_rows, upsert_rows
from earthworks.operators.filters import equals_if
from earthworks.operators.joins import with_names, with_site
from earthworks.operators.windows import newest_with_match
from earthworks.plans.facts import Frames
from earthworks.sources import catalog
from earthworks.sources.tables import MONTH, staff

DEFAULT_HOURS = 8


def payroll(tables: Frames, category: str | None = None) -> DataFrame:
    """Active headcount and daily wages per category, with a total row."""
    active = F.col("actif") == 1
    rows = tables["personnel"].filter(equals_if("categorie", category))
    return rows.rollup("categorie").agg(
        F.when(F.grouping_id() == 0, "detail").otherwise("total").alias(LEVEL),
        F.count_if(active).alias("effectif"),
        total_where(active, "salaire_journalier").alias("masse_salariale_jour"),
    )


def attendance_history(tables: Frames, k: int = 300) -> DataFrame:
    """Newest attendance rows with the person and the site."""
    rows = newest_with_match(tables["pointage"], tables["personnel"], "personnel_id", "date_pointage", k, MONTH)
    people = with_names(
        rows, tables["personnel"], "personnel_id", "inner",
        nom="nom", prenom="prenom", categorie="categorie",
    )
    newest = people.orderBy(F.desc("date_pointage"), "nom", "id").limit(k)
    return with_site(newest, tables).select(
        "id", "date_pointage", "nom", "prenom", "categorie", "statut", "heures_travaillees", "tache", "chantier"
    ).orderBy(F.desc("date_pointage"), "nom", "id")


def attendance_entries(
    tables: Frames, day: dt.date, site: int | None = None, status: str = catalog.PRESENT,
    hours: float = DEFAULT_HOURS,
) -> DataFrame:
    """One attendance row for every active person on a day, with the form's defaults."""
    if not 0 <= hours <= 24:
        raise ValueError("hours must lie between 0 and 24")
    return staff(tables).select(
        F.lit(day).alias("date_pointage"), F.col("id").alias("personnel_id"),
        F.lit(site).cast("bigint").alias("rue_id"), F.lit(status).alias("statut"),
        F.lit(hours).cast(catalog.MONEY).alias("heures_travaillees"),
    )


def post_attendance(tables: Frames, entries: DataFrame) -> DataFrame:
    """Attendance table after entering a batch: one row per person and day."""
    table = tables["pointage"]
    numbered = append_rows(table, entries, "pointage", order="personnel_id", keep_base=False)
    return upsert_rows(table, numbered, ["date_pointage", "personnel_id"], "id")
