"""Totals the jobs share: each fact summed once per key before any join."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earthworks.functions.columns import amount, zero_if_null
from earthworks.operators.aggregates import total, total_where
from earthworks.operators.joins import with_total
from earthworks.sources import catalog
from earthworks.sources.tables import bill_lines

Frames = Mapping[str, DataFrame]


def _of(fact: DataFrame, column: str, owners: DataFrame | None) -> DataFrame:
    """A fact, or only its rows that belong to the given owners (column ``id``): they are chosen before any sum."""
    if owners is None:
        return fact
    chosen = owners.select(F.col("id").alias("__owner"))
    return fact.join(chosen, fact[column] == chosen["__owner"], "left_semi")


def executed_by_line(tables: Frames, lines: DataFrame | None = None) -> DataFrame:
    """Executed quantity of every line, or of the given lines only."""
    done = _of(tables["realisations_journalieres"], "devis_id", lines)
    return done.groupBy("devis_id").agg(F.sum("quantite_jour").alias("qte_executee"))


def line_progress(tables: Frames, site: int | None = None, deliverable: int | None = None) -> DataFrame:
    """Bill lines with executed quantity, market amount and executed amount."""
    lines = bill_lines(tables, site, deliverable).withColumns({
        c: zero_if_null(F.col(c)) for c in ("quantite_marche", "prix_unitaire")
    })
    narrowed = site is not None or deliverable is not None
    done = with_total(lines, executed_by_line(tables, lines if narrowed else None), "id", "devis_id")
    return done.withColumns({
        "montant_marche": amount("quantite_marche", "prix_unitaire"),
        "montant_execute": amount("qte_executee", "prix_unitaire"),
    })


def amounts_by_site(tables: Frames, site: int | None = None) -> DataFrame:
    return line_progress(tables, site).groupBy("rue_id").agg(
        F.sum("montant_marche").alias("montant_marche"),
        F.sum("montant_execute").alias("montant_execute"),
    )


def received_by_order(tables: Frames) -> DataFrame:
    return tables["receptions_appro"].groupBy("appro_id").agg(F.sum("quantite_recue").alias("total_recu"))


def movements_by_material(tables: Frames) -> DataFrame:
    kind = F.col("type_mvt")
    return tables["mouvements_materiaux"].groupBy("materiau_id").agg(
        total_where(kind == catalog.ENTRY, "quantite").alias("entrees"),
        total_where(kind == catalog.EXIT, "quantite").alias("sorties"),
    )


def statements_by_line(tables: Frames, lines: DataFrame | None = None) -> DataFrame:
    return _of(tables["decomptes_st"], "devis_st_id", lines).groupBy("devis_st_id").agg(
        total("quantite_executee").alias("qte_executee"), total("montant").alias("montant_execute")
    )


def statements_by_subcontractor(tables: Frames, who: DataFrame | None = None) -> DataFrame:
    return _of(tables["decomptes_st"], "st_id", who).groupBy("st_id").agg(F.sum("montant").alias("total_decompte"))


def payments_by_subcontractor(tables: Frames, who: DataFrame | None = None) -> DataFrame:
    return _of(tables["paiements_st"], "st_id", who).groupBy("st_id").agg(F.sum("montant").alias("total_paye"))


def quotes_by_subcontractor(tables: Frames, who: DataFrame | None = None) -> DataFrame:
    return _of(tables["devis_st"], "st_id", who).groupBy("st_id").agg(
        F.sum(amount("quantite", "prix_unitaire")).alias("montant_devis")
    )
