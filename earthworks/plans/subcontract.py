"""Subcontractors: quotes, statements, payments and balances."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earthworks.functions.columns import amount, percent
from earthworks.operators.aggregates import total
from earthworks.operators.filters import equals_if
from earthworks.operators.joins import with_names, with_site, with_total
from earthworks.plans import facts
from earthworks.plans.facts import Frames


def balances(tables: Frames) -> DataFrame:
    """Contract, paid and what is left of the contract."""
    paid = with_total(tables["sous_traitants"], facts.payments_by_subcontractor(tables), "id", "st_id")
    return with_site(paid, tables).select(
        "id", "nom", "specialite", "chantier", "montant_contrat", "total_paye",
        (F.col("montant_contrat") - F.col("total_paye")).alias("solde"), "statut",
    ).orderBy("nom", "id")


def quote_lines(tables: Frames, subcontractor: int | None = None) -> DataFrame:
    return tables["devis_st"].filter(equals_if("st_id", subcontractor)).select(
        "id", "st_id", "code_poste", "designation", "unite", "quantite", "prix_unitaire",
        amount("quantite", "prix_unitaire").alias("montant"),
    )


def quote_totals(tables: Frames, subcontractor: int | None = None) -> DataFrame:
    return quote_lines(tables, subcontractor).groupBy("st_id").agg(total("montant").alias("montant_total"))


def statement(tables: Frames, subcontractor: int | None = None, site: int | None = None) -> DataFrame:
    """Quoted against executed per line; executed amounts are those stored."""
    lines = tables["devis_st"].filter(equals_if("st_id", subcontractor) & equals_if("rue_id", site))
    narrowed = subcontractor is not None or site is not None
    done = with_total(lines, facts.statements_by_line(tables, lines if narrowed else None), "id", "devis_st_id")
    named = with_names(done, tables["rues"], "rue_id", rue="nom")
    return named.select(
        "id", "st_id", "rue", "code_poste", "designation", "unite",
        F.col("quantite").alias("qte_devis"), "qte_executee",
        percent(F.col("qte_executee"), F.col("quantite")).alias("taux_pct"),
        amount("quantite", "prix_unitaire").alias("montant_devis"), "montant_execute",
    )


def account(tables: Frames, subcontractor: int | None = None, site: int | None = None) -> DataFrame:
    """Quoted, executed, paid and what is due per subcontractor."""
    per_line = statement(tables, subcontractor, site)
    sums = per_line.groupBy("st_id").agg(
        total("montant_devis").alias("montant_devis"), total("montant_execute").alias("montant_execute")
    )
    who = tables["sous_traitants"].filter(equals_if("id", subcontractor))
    rows = with_total(who.select("id", "nom"), sums, "id", "st_id")
    paid = facts.payments_by_subcontractor(tables, None if subcontractor is None else who)
    rows = with_total(rows, paid, "id", "st_id")
    return rows.withColumn("solde_a_payer", F.col("montant_execute") - F.col("total_paye"))


def payments(tables: Frames, subcontractor: int | None = None) -> DataFrame:
    """Payment history, newest first, with the total paid to each."""
    chosen = tables["paiements_st"].filter(equals_if("st_id", subcontractor))
    totals = chosen.groupBy("st_id").agg(F.sum("montant").alias("total_paye"))
    return with_total(chosen, totals, "st_id", "st_id").select(
        "id", "st_id", "date_paiement", "montant", "reference", "mode_paiement", "observation", "total_paye"
    ).orderBy(F.desc("date_paiement"), F.desc("id"))


def post_statements(
    tables: Frames, entries: DataFrame, number: int, day: dt.date, note: str = ""
) -> DataFrame:
    """Statement rows for entered quantities above 0, amount at the line price.

    ``entries`` holds ``devis_st_id`` and ``quantite``.
    """
    lines = tables["devis_st"].select(F.col("id").alias("devis_st_id"), "st_id", "prix_unitaire")
    return entries.filter(F.col("quantite") > 0).join(lines, "devis_st_id").select(
        "st_id", F.lit(number).alias("numero_decompte"), F.lit(day).alias("date_decompte"), "devis_st_id",
        F.col("quantite").alias("quantite_executee"), amount("quantite", "prix_unitaire").alias("montant"),
        F.lit(note).alias("observation"),
    )
