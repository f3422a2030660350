"""The eleven exportable reports, each a set of named sheets."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earthworks.functions.columns import (
    NO_DELIVERABLE, or_label, percent, percent_of_one,
)
from earthworks.operators.aggregates import (
    DETAIL, LEVEL, SUBTOTAL, TOTAL, append_levels, at_level, total,
)
from earthworks.operators.filters import equals_if
from earthworks.operators.joins import with_names, with_site, with_total
from earthworks.operators.windows import sequential_runs
from earthworks.plans import facts, stock
from earthworks.plans.facts import Frames
from earthworks.plans.projects import with_project
from earthworks.sources.tables import period

LEVEL_RANK = "rang_niveau"


def deliverable_runs(tables: Frames, site: int | None = None) -> DataFrame:
    """Bill lines with the run of equal deliverable name they belong to.

    Lines follow each other by deliverable id, those without one first; a run
    never leaves its site.
    """
    named = with_names(facts.line_progress(tables, site), tables["livrables"], "livrable_id", __livrable="nom")
    named = named.withColumn("livrable", or_label("__livrable", NO_DELIVERABLE)).drop("__livrable")
    return sequential_runs(named, F.col("livrable"), "rue_id", "livrable_id", "groupe")


_SUMS = ["quantite_marche", "montant_marche", "qte_realisee", "montant_realise", "reste"]


def progress(tables: Frames, site: int | None = None) -> DataFrame:
    """Progress statement: lines, a subtotal per run of deliverable, a grand total.

    Lines advance by quantity, totals by amount.
    """
    lines = with_site(deliverable_runs(tables, site), tables)
    lines = lines.withColumnsRenamed({"qte_executee": "qte_realisee", "montant_execute": "montant_realise"})
    lines = lines.withColumn("reste", F.col("montant_marche") - F.col("montant_realise"))
    detail = lines.select(
        F.lit(DETAIL).alias(LEVEL), F.lit(0).alias(LEVEL_RANK), "rue_id", "groupe", "id", "chantier", "livrable",
        "code_poste", "designation", "unite", "prix_unitaire", *_SUMS,
        percent_of_one(F.col("qte_realisee"), F.col("quantite_marche")).alias("pct_avancement"),
    )
    by_amount = percent(F.col("montant_realise"), F.col("montant_marche"))
    runs = lines.groupBy("rue_id", "chantier", "groupe", "livrable").agg(*[F.sum(c).alias(c) for c in _SUMS])
    subtotal = at_level(runs, SUBTOTAL).withColumns({LEVEL_RANK: F.lit(1), "pct_avancement": by_amount})
    whole = runs.agg(*[total(c).alias(c) for c in _SUMS])
    grand = at_level(whole, TOTAL).withColumns({LEVEL_RANK: F.lit(2), "pct_avancement": by_amount})
    return append_levels(detail, subtotal, grand).orderBy(
        F.asc_nulls_last("rue_id"), F.asc_nulls_last("groupe"), LEVEL_RANK, F.asc_nulls_last("id")
    )


def subcontractors(tables: Frames, site: int | None = None) -> DataFrame:
    """Contract, quote, statements and payments; each child summed before the join, for one site only its own rows."""
    rows = tables["sous_traitants"].filter(equals_if("rue_id", site))
    who = None if site is None else rows
    for child in (
        facts.quotes_by_subcontractor(tables, who),
        facts.statements_by_subcontractor(tables, who),
        facts.payments_by_subcontractor(tables, who),
    ):
        rows = with_total(rows, child, "id", "st_id")
    return rows.select(
        F.col("nom").alias("sous_traitant"), "specialite", "montant_contrat", "montant_devis",
        "total_decompte", "total_paye", (F.col("total_decompte") - F.col("total_paye")).alias("solde_a_payer"),
    ).orderBy("sous_traitant")


def _in_period(
    tables: Frames, name: str, site: int | None, start: dt.date | None, end: dt.date | None
) -> DataFrame:
    return period(tables[name], name, start, end).filter(equals_if("rue_id", site))


def attendance(tables: Frames, site: int | None, start: dt.date | None, end: dt.date | None) -> DataFrame:
    rows = _in_period(tables, "pointage", site, start, end)
    rows = with_names(rows, tables["personnel"], "personnel_id", "inner",
                      nom="nom", prenom="prenom", categorie="categorie", poste="poste")
    return rows.select(
        "id", F.concat("nom", F.lit(" "), F.coalesce("prenom", F.lit(""))).alias("personnel"), "categorie", "poste",
        F.col("date_pointage").alias("date"), "statut", F.col("heures_travaillees").alias("heures"),
    ).orderBy("date", "personnel", "id")


def stock_sheet(tables: Frames) -> DataFrame:
    return stock.balances(tables).select(
        F.col("nom").alias("materiau"), "unite", "categorie", "stock_initial",
        F.col("entrees").alias("total_entrees"), F.col("sorties").alias("total_sorties"),
        F.col("stock").alias("stock_actuel"),
    ).orderBy("materiau")


def plant(tables: Frames, site: int | None, start: dt.date | None, end: dt.date | None) -> DataFrame:
    """Plant log; hours and fuel come in two column pairs, the first that is set counts."""
    rows = _in_period(tables, "suivi_materiels", site, start, end)
    rows = with_names(rows, tables["materiels"], "materiel_id", "inner", engin="nom", immat="immatriculation")
    zero = F.lit(0).cast("decimal(18,2)")
    return with_site(rows, tables).select(
        "id", "engin", "immat", "chantier", F.col("date_suivi").alias("date"), "heures_marche", "heures_travail",
        F.coalesce(F.nullif("heures_marche", zero), "heures_travail").alias("heures_effectives"),
        "heures_arret", "carburant_l", "carburant_consomme",
        F.coalesce(F.nullif("carburant_l", zero), "carburant_consomme").alias("carburant_effectif"),
        "cout_carburant", "chauffeur", "panne",
    ).orderBy("date", "engin", "id")


def diary(tables: Frames, site: int | None, start: dt.date | None, end: dt.date | None) -> DataFrame:
    rows = _in_period(tables, "journal_chantier", site, start, end)
    return with_site(rows, tables).select(
        "id", F.col("date_journal").alias("date"), "chantier", "meteo", "temperature", "nb_ouvriers",
        "nb_encadrants", "travaux_realises", "observations",
    ).orderBy("date", "id")


def cash(tables: Frames, site: int | None, start: dt.date | None, end: dt.date | None) -> DataFrame:
    rows = _in_period(tables, "caisse_chantier", site, start, end)
    return with_site(rows, tables).select(
        "id", F.col("date_op").alias("date"), "chantier", "type_op", "rubrique", "montant", "beneficiaire",
        "mode_paiement", "reference_piece",
    ).orderBy("date", "id")


def incidents(tables: Frames, site: int | None, start: dt.date | None, end: dt.date | None) -> DataFrame:
    rows = _in_period(tables, "incidents", site, start, end)
    return with_site(rows, tables).select(
        "id", F.col("date_incident").alias("date"), "chantier", "type_incident", "gravite", "description",
        "personne_concernee", "mesures_prises",
        F.when(F.col("cloture") == 1, "Clôturé").otherwise("Ouvert").alias("statut"),
    ).orderBy("date", "id")


def gap(tables: Frames, site: int | None = None) -> DataFrame:
    """Market against executed, line by line."""
    rows = with_site(facts.line_progress(tables, site), tables)
    return rows.select(
        "id", "chantier", "code_poste", "designation", "unite", "quantite_marche", "prix_unitaire",
        "montant_marche", F.col("qte_executee").alias("qte_realisee"),
        F.col("montant_execute").alias("montant_realise"),
        (F.col("montant_marche") - F.col("montant_execute")).alias("ecart"),
        percent_of_one(F.col("qte_executee"), F.col("quantite_marche")).alias("pct_avancement"),
    ).orderBy("chantier", "id")


def procurement(tables: Frames, site: int | None, start: dt.date | None, end: dt.date | None) -> DataFrame:
    rows = _in_period(tables, "approvisionnements", site, start, end)
    return with_site(rows, tables).select(
        "id", "date_besoin", "chantier", "designation", "unite", "quantite_demandee", "quantite_recue",
        "fournisseur", "statut", "prix_unitaire_reel", "date_reception",
    ).orderBy("date_besoin", "id")


def global_sites(tables: Frames, site: int | None = None) -> DataFrame:
    rows = with_project(tables["rues"].filter(equals_if("id", site)), tables)
    return rows.select(
        F.col("nom").alias("chantier"), "dossier", "numero_marche", "maitre_ouvrage", "entreprise",
        "date_notification", "date_demarrage", "delai_jours",
    ).orderBy("chantier")


def global_progress(tables: Frames, site: int | None = None) -> DataFrame:
    rows = with_site(facts.line_progress(tables, site), tables)
    return rows.select(
        "id", "chantier", "designation", "unite", "quantite_marche", "prix_unitaire",
        F.col("qte_executee").alias("qte_realisee"), "montant_marche",
        F.col("montant_execute").alias("montant_realise"),
    ).orderBy("chantier", "id")


def global_stock(tables: Frames) -> DataFrame:
    return stock.balances(tables).select(
        F.col("nom").alias("materiau"), "unite", "stock_initial",
        (F.col("entrees") - F.col("sorties")).alias("mouvements_net"),
    ).orderBy("materiau")


def global_staff(tables: Frames) -> DataFrame:
    return tables["personnel"].select("nom", "prenom", "categorie", "poste", "telephone").orderBy("categorie", "nom")


def global_subcontractors(tables: Frames) -> DataFrame:
    return tables["sous_traitants"].select(
        "nom", "specialite", "responsable", "telephone", "montant_contrat", "statut"
    ).orderBy("nom")


def global_plant(tables: Frames) -> DataFrame:
    return tables["materiels"].select("nom", "immatriculation", "type_materiel", "etat").orderBy("nom")


Sheets = dict[str, DataFrame]
_BUILDERS: dict[int, Callable[..., Sheets]] = {
    1: lambda t, s, a, b: {"Avancement": progress(t, s)},
    2: lambda t, s, a, b: {"Sous-Traitants": subcontractors(t, s)},
    3: lambda t, s, a, b: {"Personnel": attendance(t, s, a, b)},
    4: lambda t, s, a, b: {"Stock": stock_sheet(t)},
    5: lambda t, s, a, b: {"Engins": plant(t, s, a, b)},
    6: lambda t, s, a, b: {"Journal": diary(t, s, a, b)},
    7: lambda t, s, a, b: {"Caisse": cash(t, s, a, b)},
    8: lambda t, s, a, b: {"Incidents": incidents(t, s, a, b)},
    9: lambda t, s, a, b: {"Devis vs Réalisé": gap(t, s)},
    10: lambda t, s, a, b: {"Approvisionnement": procurement(t, s, a, b)},
    11: lambda t, s, a, b: {
        "Chantiers": global_sites(t, s),
        "Avancement": global_progress(t, s),
        "Stock": global_stock(t),
        "Personnel": global_staff(t),
        "Sous-Traitants": global_subcontractors(t),
        "Engins": global_plant(t),
    },
}


def report(
    number: int, tables: Frames, site: int | None = None,
    start: dt.date | None = None, end: dt.date | None = None,
) -> Sheets:
    """Sheets of a report by its number, 1 to 11, for a site and an inclusive period."""
    if number not in _BUILDERS:
        raise ValueError(f"no report {number}")
    return _BUILDERS[number](tables, site, start, end)


def default_period(as_of: dt.date) -> tuple[dt.date, dt.date]:
    """From the first of January to the day itself."""
    return as_of.replace(month=1, day=1), as_of
