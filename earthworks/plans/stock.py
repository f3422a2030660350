"""Material stock: levels, alerts, movements and overdrawn exits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earthworks.functions.columns import GENERAL, signed, zero_if_null
from earthworks.operators.aggregates import total, total_where
from earthworks.operators.filters import all_of, equals_if
from earthworks.operators.joins import with_names, with_site, with_total
from earthworks.operators.windows import latest, newest_with_match, running_total
from earthworks.plans import facts
from earthworks.plans.facts import Frames
from earthworks.sources import catalog
from earthworks.sources.tables import MONTH

# Texts for where a movement came from.
MANUAL = "Saisie manuelle"
VIA_ORDER = "Circuit Appro — BC: "


def balances(tables: Frames) -> DataFrame:
    """Materials with quantities in, out and in stock."""
    rows = with_total(tables["materiaux"], facts.movements_by_material(tables), "id", "materiau_id")
    return rows.withColumn("stock", zero_if_null(F.col("stock_initial")) + F.col("entrees") - F.col("sorties"))


def levels(tables: Frames, category: str | None = None) -> DataFrame:
    stock, threshold, price = F.col("stock"), zero_if_null(F.col("seuil_alerte")), zero_if_null(F.col("prix_unitaire"))
    return balances(tables).filter(equals_if("categorie", category)).select(
        "id", "nom", "categorie", "unite", "stock", "seuil_alerte", "prix_unitaire",
        F.round(stock.cast("decimal(24,2)") * price.cast("decimal(14,2)"), 0).alias("valeur"),
        ((stock <= threshold) & (threshold > 0)).alias("alerte"),
    )


def alerts(tables: Frames) -> DataFrame:
    """Materials at or under their threshold; a threshold of 0 never alerts."""
    return levels(tables).filter("alerte").select("id", "nom", "unite", "stock", "seuil_alerte").orderBy("nom", "id")


def overdrawn_exits(tables: Frames) -> DataFrame:
    """Exits that took more than was in stock at that point of the history."""
    moves = tables["mouvements_materiaux"]
    impact = signed("type_mvt", "quantite", [catalog.ENTRY], [catalog.EXIT])
    history = running_total(
        moves.select("id", "date_mvt", "materiau_id", "type_mvt", "quantite"),
        impact, ["materiau_id"], ["date_mvt", "id"], "__moved",
    )
    return overdrawn(history, tables["materiaux"])


def overdrawn(history: DataFrame, materials: DataFrame) -> DataFrame:
    """The exits of a history with running totals ``__moved`` that took more than there was."""
    opened = with_names(history, materials, "materiau_id", "inner", article="nom", __opening="stock_initial")
    before = F.col("__opening") + F.col("__moved") + F.col("quantite")
    exits = opened.filter(F.col("type_mvt") == catalog.EXIT).withColumn("stock_avant", before)
    return exits.filter(F.col("quantite") > F.col("stock_avant")).select(
        "id", "date_mvt", "materiau_id", "article", "quantite", "stock_avant"
    )


def _movements(tables: Frames, article: int | None, kind: str | None, last_n: int | None) -> DataFrame:
    """Movements of catalogued materials; filters come first, then the newest are kept."""
    wanted = all_of(equals_if("materiau_id", article), equals_if("type_mvt", kind))
    moves = tables["mouvements_materiaux"].filter(wanted)
    moves = newest_with_match(moves, tables["materiaux"], "materiau_id", "date_mvt", last_n, MONTH)
    rows = with_names(moves, tables["materiaux"], "materiau_id", "inner", article="nom")
    return rows if last_n is None else latest(rows, "date_mvt", "id", last_n)


def movement_history(
    tables: Frames, article: int | None = None, kind: str | None = None, last_n: int | None = 500
) -> DataFrame:
    """Newest movements with site and provenance."""
    rows = with_site(_movements(tables, article, kind, last_n), tables, label=GENERAL)
    rows = with_names(rows, tables["approvisionnements"], "appro_id", __bc="numero_bc")
    source = F.concat(F.lit(VIA_ORDER), F.coalesce(F.col("__bc"), F.col("appro_id").cast("string")))
    rows = rows.withColumn("provenance", F.when(F.col("appro_id").isNotNull(), source).otherwise(MANUAL))
    return rows.select(
        "id", "date_mvt", "type_mvt", "article", "quantite", "prix_unitaire", "chantier", "fournisseur",
        "bon_livraison", "provenance", "observation",
    ).orderBy(F.desc("date_mvt"), F.desc("id"))


def movement_totals(
    tables: Frames, article: int | None = None, kind: str | None = None, last_n: int | None = None
) -> DataFrame:
    """Quantities in and out and how many movements came from procurement.

    Sums are taken per material first, and only they meet the catalogue.
    """
    if last_n is None:
        wanted = all_of(equals_if("materiau_id", article), equals_if("type_mvt", kind))
        rows = tables["mouvements_materiaux"].filter(wanted)
    else:
        rows = _movements(tables, article, kind, last_n)
    per_material = rows.groupBy("materiau_id").agg(
        total_where(F.col("type_mvt") == catalog.ENTRY, "quantite").alias("entrees"),
        total_where(F.col("type_mvt") == catalog.EXIT, "quantite").alias("sorties"),
        F.count_if(F.col("appro_id").isNotNull()).alias("circuit"),
    )
    known = with_names(per_material, tables["materiaux"], "materiau_id", "inner")
    return known.agg(
        total("entrees").alias("total_entrees"), total("sorties").alias("total_sorties"),
        total("circuit").alias("dont_circuit_appro"),
    )
