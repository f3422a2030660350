"""Key figures, progress and delays of the portfolio."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earthworks.functions.columns import delay, delay_band, or_label, percent, zero_if_null
from earthworks.operators.aggregates import total_where
from earthworks.operators.filters import equals_if
from earthworks.operators.joins import with_names, with_site, with_total
from earthworks.operators.windows import latest
from earthworks.plans import facts, market
from earthworks.plans.facts import Frames
from earthworks.sources import catalog
from earthworks.sources.tables import period


def present_count(tables: Frames, day: dt.date, site: int | None = None) -> DataFrame:
    present = (F.col("statut") == catalog.PRESENT) & equals_if("rue_id", site)
    return period(tables["pointage"], "pointage", day, day).filter(present).agg(
        F.count(F.lit(1)).alias("presents")
    )


def cash_totals(tables: Frames, site: int | None = None) -> DataFrame:
    kind = F.col("type_op")
    sums = tables["caisse_chantier"].filter(equals_if("rue_id", site)).agg(
        total_where(kind == catalog.INCOME, "montant").alias("recettes"),
        total_where(kind == catalog.EXPENSE, "montant").alias("depenses"),
        total_where(kind == catalog.ADVANCE, "montant").alias("avances"),
    )
    return sums.withColumn("solde", F.col("recettes") - F.col("depenses") - F.col("avances"))


def open_counts(tables: Frames, site: int | None = None) -> DataFrame:
    """Open incidents [site], orders not yet stocked, projects and sites."""
    def how_many(df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)))

    incidents = tables["incidents"].filter((F.col("cloture") == 0) & equals_if("rue_id", site))
    pending = tables["approvisionnements"].filter(F.col("statut") != catalog.STOCKED)
    return incidents.agg(F.count(F.lit(1)).alias("incidents_ouverts")).select(
        "incidents_ouverts",
        how_many(pending).scalar().alias("appros_en_attente"),
        how_many(tables["dossiers"]).scalar().alias("nb_dossiers"),
        how_many(tables["rues"]).scalar().alias("nb_chantiers"),
    )


def execution(tables: Frames, site: int | None = None) -> DataFrame:
    return market.work_statement_total(tables, site)


def site_progress(tables: Frames, site: int | None = None) -> DataFrame:
    """Market and executed amount of every site, sites without lines at 0."""
    sites = tables["rues"].filter(equals_if("id", site))
    sites = with_names(sites, tables["dossiers"], "dossier_id", __dossier="nom")
    done = with_total(sites, facts.amounts_by_site(tables, site), "id", "rue_id")
    market, executed = F.col("montant_marche"), F.col("montant_execute")
    return done.select(
        F.col("id").alias("rue_id"),
        F.col("nom").alias("chantier"),
        or_label("__dossier").alias("dossier"),
        F.round(market, 0).alias("montant_marche"),
        F.round(executed, 0).alias("montant_execute"),
        F.when(market > 0, percent(executed, market)).otherwise(0.0).alias("taux_pct"),
    ).orderBy("chantier", "rue_id")


def site_delays(tables: Frames, as_of: dt.date, site: int | None = None) -> DataFrame:
    sites = tables["rues"].filter(equals_if("id", site))
    figures = delay("date_demarrage", "delai_jours", as_of)
    return sites.select(
        F.col("id").alias("rue_id"), F.col("nom").alias("chantier"), "delai_jours",
        *[c.alias(name) for name, c in figures.items()],
    ).orderBy("chantier", "rue_id")


def site_schedule(tables: Frames, as_of: dt.date, site: int | None = None) -> DataFrame:
    """Planned end, overrun and delay band of the site sheet."""
    sites = tables["rues"].filter(equals_if("id", site))
    figures = delay("date_demarrage", "delai_jours", as_of)
    days = zero_if_null(F.col("delai_jours"))
    return sites.select(
        F.col("id").alias("rue_id"),
        F.col("nom").alias("chantier"),
        "date_demarrage",
        F.date_add("date_demarrage", days.cast("int")).alias("fin_prevue"),
        (figures["jours_restants"] < 0).alias("depassement"),
        F.when(days > 0, delay_band(figures["pct_delai"])).alias("tranche"),
        F.when(days > 0, F.round(days.cast("double") / 30, 1)).alias("delai_mois"),
    ).orderBy("chantier", "rue_id")


def pending_orders(tables: Frames, k: int = 8) -> DataFrame:
    """Newest orders that are not yet in stock."""
    pending = tables["approvisionnements"].filter(F.col("statut") != catalog.STOCKED)
    newest = latest(pending, "date_besoin", "id", k)
    return with_site(newest, tables).select("id", "date_besoin", "chantier", "designation", "statut")
