"""Projects, sites, their parties, staff and deliverables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earthworks.functions.columns import blank_to_null, or_label
from earthworks.operators.filters import equals_if
from earthworks.operators.joins import with_names, with_site, with_total
from earthworks.plans.facts import Frames
from earthworks.sources.tables import deliverables, sites

# Roles of the parties of a site, by column.
PARTY_ROLES = {
    "maitre_ouvrage": "Maître d'ouvrage",
    "maitre_ouvrage_delegue": "MOA Délégué",
    "bureau_controle": "Bureau de contrôle",
    "labo": "Laboratoire",
    "coordinateur_securite": "Coord. sécurité",
    "entreprise": "Entreprise",
}


def with_project(df: DataFrame, tables: Frames, on: str = "dossier_id") -> DataFrame:
    named = with_names(df, tables["dossiers"], on, __dossier="nom")
    return named.withColumn("dossier", or_label("__dossier")).drop("__dossier")


def project_sites(tables: Frames) -> DataFrame:
    """Projects with how many sites each has."""
    counts = tables["rues"].groupBy("dossier_id").agg(F.count(F.lit(1)).alias("nb_chantiers"))
    return with_total(tables["dossiers"], counts, "id", "dossier_id").select(
        "id", "nom", or_label("client").alias("client"), "statut", "nb_chantiers"
    ).orderBy("nom")


def site_list(tables: Frames, project: int | None = None) -> DataFrame:
    return with_project(sites(tables, project), tables).select(
        "id", "dossier", F.col("nom").alias("chantier"), "numero_marche", "statut_chantier",
        "date_demarrage", "delai_jours",
    ).orderBy("dossier", "chantier", "id")


def site_labels(tables: Frames) -> DataFrame:
    """Pick-list label "[project] site" of every site."""
    label = F.concat(F.lit("["), F.col("dossier"), F.lit("] "), F.col("nom"))
    return with_project(tables["rues"], tables).select(
        F.col("id").alias("rue_id"), label.alias("libelle")
    ).orderBy("libelle", "rue_id")


def site_parties(tables: Frames, site: int | None = None) -> DataFrame:
    """Parties of a site by role, one row each, a dash where none is named."""
    chosen = tables["rues"].filter(equals_if("id", site))
    parties = [F.struct(F.lit(role).alias("role"), F.col(c).alias("intervenant")) for c, role in PARTY_ROLES.items()]
    long = chosen.select(F.col("id").alias("rue_id"), F.col("nom").alias("chantier"), F.inline(F.array(*parties)))
    return long.withColumn("intervenant", or_label(blank_to_null("intervenant")))


def site_headcount(tables: Frames, site: int | None = None) -> DataFrame:
    active = tables["personnel"].filter((F.col("actif") == 1) & equals_if("rue_id", site))
    counts = active.groupBy("rue_id", "categorie").agg(F.count(F.lit(1)).alias("effectif"))
    return with_site(counts, tables).select("chantier", "categorie", "effectif")


def site_subcontractors(tables: Frames, site: int | None = None) -> DataFrame:
    chosen = tables["sous_traitants"].filter(equals_if("rue_id", site))
    return with_site(chosen, tables).select("chantier", "nom", "specialite", "responsable").orderBy("chantier", "nom")


def site_deliverables(tables: Frames, site: int | None = None) -> DataFrame:
    named = with_site(deliverables(tables, site), tables, on="chantier_id")
    return named.select("id", "chantier", "nom", "type_livrable", "longueur_m", "largeur_m").orderBy("chantier", "nom", "id")
