"""The five stages of procurement, from need to stock."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earthworks.functions.columns import GENERAL, amount, percent, remaining
from earthworks.operators.changes import append_rows, update_rows
from earthworks.operators.filters import equals_if
from earthworks.operators.joins import with_site, with_total
from earthworks.operators.lineage import stable
from earthworks.plans import facts
from earthworks.plans.facts import Frames
from earthworks.sources.catalog import ENTRY, NEED, ORDERED, RECEIVED, REJECTED, STOCKED, VALIDATED

# Moves an order may make.
MOVES = [
    (NEED, VALIDATED), (NEED, REJECTED), (VALIDATED, ORDERED), (ORDERED, RECEIVED), (RECEIVED, STOCKED),
]
# Texts shown with an order.
POSTED_NOTE = "Via Circuit Appro BC:"
DELIVERING, CLOSED = "En livraison", "Clôturé - en attente mise en stock"
OPEN_STAGES = [NEED, VALIDATED, ORDERED, RECEIVED]


def queue(tables: Frames, stages: list[str] | None = None) -> DataFrame:
    """Orders waiting at the given stages with their estimated amount."""
    waiting = tables["approvisionnements"].filter(F.col("statut").isin(stages or OPEN_STAGES))
    return with_site(waiting, tables, label=GENERAL).select(
        "id", "date_besoin", "chantier", "designation", "unite", "quantite_demandee", "prix_unitaire_estime",
        amount("prix_unitaire_estime", "quantite_demandee").alias("montant_estime"), "statut",
    )


def reception_status(tables: Frames) -> DataFrame:
    """Received against ordered quantity of the orders being delivered."""
    orders = tables["approvisionnements"].filter(F.col("statut").isin(ORDERED, RECEIVED))
    rows = with_total(orders, facts.received_by_order(tables), "id", "appro_id")
    ordered, received = F.col("quantite_demandee"), F.col("total_recu")
    state = F.when(F.col("statut") == ORDERED, DELIVERING).otherwise(CLOSED)
    return rows.select(
        "id", "designation", "unite", "quantite_demandee", "total_recu",
        remaining(ordered, received).alias("reste"),
        F.least(F.lit(100.0), percent(received, ordered)).alias("pct_recu"),
        state.alias("etat_livraison"),
    )


def to_stock(tables: Frames) -> DataFrame:
    """Received orders with the quantity to stock: receptions, else the order's own field."""
    orders = tables["approvisionnements"].filter(F.col("statut") == RECEIVED)
    rows = with_total(orders, facts.received_by_order(tables), "id", "appro_id")
    return rows.withColumn("qte_a_stocker", _quantity_to_stock())


def _quantity_to_stock() -> Column:
    return F.when(F.col("total_recu") != 0, F.col("total_recu")).otherwise(F.col("quantite_recue"))


def post_stock_entries(tables: Frames, day: dt.date) -> DataFrame:
    """Stock entries for received orders of a catalogued material, ready to append."""
    rows = to_stock(tables).filter(F.col("materiau_id").isNotNull() & (F.col("qte_a_stocker") > 0))
    note = F.concat(F.lit(POSTED_NOTE), F.coalesce("numero_bc", F.lit("")))
    return rows.select(
        F.lit(day).alias("date_mvt"), "rue_id", "materiau_id", F.lit(ENTRY).alias("type_mvt"),
        F.col("qte_a_stocker").alias("quantite"), F.col("prix_unitaire_estime").alias("prix_unitaire"),
        F.coalesce("fournisseur", F.lit("")).alias("fournisseur"),
        F.coalesce("bon_livraison", F.lit("")).alias("bon_livraison"),
        F.col("id").alias("appro_id"), note.alias("observation"),
    )


def transitions(tables: Frames, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply a batch of stage moves: the new orders and the refused requests.

    ``requests`` holds ``appro_id, cible, date_etape, acteur, numero_bc, fournisseur``;
    an order asked to move more than once in a batch is refused altogether.
    """
    orders = tables["approvisionnements"]
    request = F.struct("cible", "date_etape", "acteur", "numero_bc", "fournisseur")
    asked = requests.groupBy(F.col("appro_id").alias("__order")).agg(
        F.count(F.lit(1)).alias("__times"), F.any_value(request).alias("__ask")
    )
    rows = orders.join(asked, orders["id"] == asked["__order"], "left")
    rows = with_total(rows, facts.received_by_order(tables), "id", "appro_id")
    accepted = (F.col("__times") == 1) & _is_legal(F.col("statut"), F.col("__ask.cible"))
    return _moved(rows.withColumn("__to", F.when(accepted, F.col("__ask.cible"))), orders), _refused(orders, requests)


def _is_legal(source: Column, target: Column) -> Column:
    return reduce(or_, [(source == a) & (target == b) for a, b in MOVES])


def _refused(orders: DataFrame, requests: DataFrame) -> DataFrame:
    times = requests.groupBy("appro_id").agg(F.count(F.lit(1)).alias("__times"))
    current = orders.select(F.col("id").alias("appro_id"), F.col("statut").alias("ancien_statut"))
    judged = requests.join(times, "appro_id").join(current, "appro_id", "left")
    reason = F.when(F.col("ancien_statut").isNull(), "inconnu").when(F.col("__times") > 1, "doublon")
    reason = reason.when(~_is_legal(F.col("ancien_statut"), F.col("cible")), "interdit")
    return judged.select("appro_id", "ancien_statut", "cible", reason.alias("motif_refus")).filter(
        F.col("motif_refus").isNotNull()
    )


def _moved(rows: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders with stage, stage date, actor and quantities of the accepted moves."""
    def on(stage: str, value: Column | str, column: str) -> Column:
        given = F.col(value) if isinstance(value, str) else value
        kind = orders.schema[column].dataType
        return F.when(F.col("__to") == stage, given.cast(kind)).otherwise(F.col(column)).alias(column)

    changed = {
        "statut": F.coalesce("__to", "statut").alias("statut"),
        "date_validation_cc": on(VALIDATED, "__ask.date_etape", "date_validation_cc"),
        "validateur_cc": on(VALIDATED, "__ask.acteur", "validateur_cc"),
        "numero_bc": on(ORDERED, "__ask.numero_bc", "numero_bc"),
        "fournisseur": on(ORDERED, "__ask.fournisseur", "fournisseur"),
        "date_bc": on(ORDERED, "__ask.date_etape", "date_bc"),
        "quantite_recue": on(RECEIVED, "total_recu", "quantite_recue"),
        "date_mise_stock": on(STOCKED, "__ask.date_etape", "date_mise_stock"),
        "quantite_mise_stock": on(STOCKED, _quantity_to_stock(), "quantite_mise_stock"),
        "prix_unitaire_reel": on(STOCKED, "prix_unitaire_estime", "prix_unitaire_reel"),
    }
    return rows.select(*[changed.get(c, F.col(c)) for c in orders.columns])


def stock_moves(tables: Frames, requests: DataFrame, day: dt.date) -> tuple[DataFrame, DataFrame]:
    """Orders after a batch of requests, and the stock entries of exactly the orders it moves to stock.

    An entry takes the quantity and price that the order keeps; orders without a catalogued material get none.
    """
    orders, _ = transitions(tables, requests)
    before = tables["approvisionnements"].select(F.col("id").alias("__id"), F.col("statut").alias("__before"))
    moved = orders.filter(F.col("statut") == STOCKED).join(before, F.col("id") == F.col("__id")).filter(
        (F.col("__before") != STOCKED) & F.col("materiau_id").isNotNull())
    note = F.concat(F.lit(POSTED_NOTE), F.coalesce("numero_bc", F.lit("")))
    entries = moved.select(
        F.lit(day).alias("date_mvt"), "rue_id", "materiau_id", F.lit(ENTRY).alias("type_mvt"),
        F.col("quantite_mise_stock").alias("quantite"), F.col("prix_unitaire_reel").alias("prix_unitaire"),
        F.coalesce("fournisseur", F.lit("")).alias("fournisseur"),
        F.coalesce("bon_livraison", F.lit("")).alias("bon_livraison"),
        F.col("id").alias("appro_id"), note.alias("observation"),
    )
    return orders, entries


class Batch(NamedTuple):
    """What a batch of requests does: the new orders, the steps taken, the requests refused, the stock entries."""

    orders: DataFrame
    taken: DataFrame
    refused: DataFrame
    entries: DataFrame


# How many moves an order can make one after the other, and what is stocked if nothing came in.
LONGEST_PATH = 4
LEAST_STOCKED = 1


def run_batch(tables: Frames, requests: DataFrame) -> Batch:
    """Take the requests of each order one after the other, by date and number, as forms that are sent one by one.

    ``requests`` holds ``appro_id, numero, cible, date_etape, acteur, numero_bc, fournisseur, quantite, prix``; the number
    is unique. A request moves its order if the stage that the order has reached by then allows it; otherwise it is refused
    with that stage. Quantity and price count when an order goes to stock; without them it takes what was received (1 if
    nothing was) and the estimated price.

    Stages never recur, so an order makes at most four moves: each round finds, for all orders at once, the first legal
    request after the last one taken. That is a combining aggregate, whatever number of requests an order has.
    """
    orders = tables["approvisionnements"]
    asked = stable(requests.select(
        "appro_id", F.struct("date_etape", "numero").alias("place"), "cible",
        F.struct("acteur", "numero_bc", "fournisseur", "quantite", "prix").alias("form")))
    begun = orders.join(asked.select(F.col("appro_id").alias("id")).distinct(), "id", "left_semi")
    # an order without a stage moves nowhere
    never = F.lit(None).cast(asked.schema["place"].dataType)
    state = begun.select(F.col("id").alias("__order"), F.col("statut").alias("reached"), never.alias("since"))
    steps = []
    for number in range(1, LONGEST_PATH + 1):
        waiting = asked.join(state, asked["appro_id"] == state["__order"]).filter(
            (F.col("since").isNull() | (F.col("place") > F.col("since"))) & _is_legal(F.col("reached"), F.col("cible")))
        step = F.struct("place", "cible", "form", F.col("reached").alias("ancien_statut"))
        found = stable(waiting.groupBy("appro_id").agg(F.min_by(step, F.col("place")).alias("step")))
        steps.append(found.select("appro_id", F.lit(number).alias("rang"), "step.*"))
        state = found.select(
            F.col("appro_id").alias("__order"), F.col("step.cible").alias("reached"), F.col("step.place").alias("since"))
    taken = reduce(DataFrame.union, steps)
    paths = taken.groupBy("appro_id").agg(F.sort_array(F.collect_list(F.struct("place", "cible", "form"))).alias("path"))
    moved = _after_path(tables, orders, paths)
    return Batch(
        moved, taken.select("appro_id", "rang", "place.numero", "ancien_statut", "cible", "place.date_etape"),
        _refused_requests(orders, asked, paths), _entries(moved, paths))


def _step_to(stage: str) -> Column:
    """The step of a path that leads to a stage."""
    return F.get(F.filter("path", lambda x: x["cible"] == stage), 0)


def _after_path(tables: Frames, orders: DataFrame, paths: DataFrame) -> DataFrame:
    """Orders with what the steps on their path set."""
    rows = orders.join(paths.withColumnRenamed("appro_id", "__order"), orders["id"] == F.col("__order"), "left")
    rows = with_total(rows, facts.received_by_order(tables), "id", "appro_id")
    rows = rows.withColumns({f"__{k}": _step_to(stage) for k, stage in enumerate((VALIDATED, ORDERED, RECEIVED, STOCKED))})
    came = F.when(F.col("__2").isNotNull(), F.col("total_recu")).otherwise(F.col("quantite_recue"))
    came = F.when(F.col("total_recu") != 0, F.col("total_recu")).otherwise(came)
    stocked = F.coalesce(F.col("__3.form.quantite"), F.when(came > 0, came).otherwise(LEAST_STOCKED))
    price = F.coalesce(F.col("__3.form.prix"), F.col("prix_unitaire_estime"))

    def on(step: str, value: Column, column: str) -> Column:
        return F.when(F.col(step).isNotNull(), value.cast(orders.schema[column].dataType)).otherwise(F.col(column)).alias(column)

    changed = {
        "statut": F.coalesce(F.get(F.col("path.cible"), F.size("path") - 1), "statut").alias("statut"),
        "date_validation_cc": on("__0", F.col("__0.place.date_etape"), "date_validation_cc"),
        "validateur_cc": on("__0", F.col("__0.form.acteur"), "validateur_cc"),
        "numero_bc": on("__1", F.col("__1.form.numero_bc"), "numero_bc"),
        "fournisseur": on("__1", F.col("__1.form.fournisseur"), "fournisseur"),
        "date_bc": on("__1", F.col("__1.place.date_etape"), "date_bc"),
        "quantite_recue": on("__2", F.col("total_recu"), "quantite_recue"),
        "date_mise_stock": on("__3", F.col("__3.place.date_etape"), "date_mise_stock"),
        "quantite_mise_stock": on("__3", stocked, "quantite_mise_stock"),
        "prix_unitaire_reel": on("__3", price, "prix_unitaire_reel"),
    }
    return rows.select(*[changed.get(c, F.col(c)) for c in orders.columns])


def _refused_requests(orders: DataFrame, asked: DataFrame, paths: DataFrame) -> DataFrame:
    """Requests that were not taken, with the stage at which they came (NULL for an unknown order) and the reason."""
    current = orders.select(F.col("id").alias("__order"), "statut")
    side = paths.withColumnRenamed("appro_id", "__path")
    rows = asked.join(current, asked["appro_id"] == current["__order"], "left")
    rows = rows.join(side, rows["appro_id"] == side["__path"], "left")
    done = F.filter("path", lambda x: x["place"] < F.col("place"))
    stage = F.coalesce(F.get(F.transform(done, lambda x: x["cible"]), F.size(done) - 1), "statut")
    taken = F.exists("path", lambda x: x["place"] == F.col("place"))
    return rows.filter(~F.coalesce(taken, F.lit(False))).select(
        "appro_id", "place.numero", stage.alias("ancien_statut"), "cible",
        F.when(F.col("__order").isNull(), "inconnu").otherwise("interdit").alias("motif_refus"))


def _entries(moved: DataFrame, paths: DataFrame) -> DataFrame:
    """Stock entries of the orders that the batch takes to stock, at their date, quantity and price."""
    stocked = paths.filter(F.exists("path", lambda x: x["cible"] == STOCKED)).select(F.col("appro_id").alias("id"))
    rows = moved.join(stocked, "id", "left_semi").filter(F.col("materiau_id").isNotNull())
    note = F.concat(F.lit(POSTED_NOTE), F.coalesce("numero_bc", F.lit("")))
    return rows.select(
        F.col("date_mise_stock").alias("date_mvt"), "rue_id", "materiau_id", F.lit(ENTRY).alias("type_mvt"),
        F.col("quantite_mise_stock").alias("quantite"), F.col("prix_unitaire_reel").alias("prix_unitaire"),
        F.coalesce("fournisseur", F.lit("")).alias("fournisseur"), F.coalesce("bon_livraison", F.lit("")).alias("bon_livraison"),
        F.col("id").alias("appro_id"), note.alias("observation"))


def post_receptions(tables: Frames, deliveries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Receptions with new deliveries, and the orders with the quantity, last date and last note that follow.

    ``deliveries`` holds ``appro_id, date_reception, quantite_recue, bon_livraison, observation`` and a unique
    ``source_id`` that settles the order of those of one day. Deliveries of nothing are left out.
    """
    new = deliveries.filter(F.col("quantite_recue") > 0)
    base = tables["receptions_appro"]
    receptions = append_rows(base, new, "receptions_appro", order="source_id")
    last = new.groupBy(F.col("appro_id").alias("id")).agg(
        F.max_by(F.struct("date_reception", "bon_livraison"), F.struct("date_reception", "source_id")).alias("__last"))
    sums = facts.received_by_order({"receptions_appro": receptions}).withColumnRenamed("appro_id", "id")
    changes = last.join(sums, "id").select(
        "id", F.col("total_recu").alias("quantite_recue"), "__last.date_reception", "__last.bon_livraison")
    orders = update_rows(tables["approvisionnements"], changes, ["quantite_recue", "date_reception", "bon_livraison"])
    return receptions, orders


def recompute_received(tables: Frames, touched: DataFrame) -> DataFrame:
    """Orders whose receptions changed get their received quantity anew.

    ``touched`` holds ``appro_id``; the receptions are those after the change.
    """
    orders = touched.select(F.col("appro_id").alias("id")).distinct()
    sums = with_total(orders, facts.received_by_order(tables), "id", "appro_id")
    changes = sums.select("id", F.col("total_recu").alias("quantite_recue"))
    return update_rows(tables["approvisionnements"], changes, ["quantite_recue"])


def followup(tables: Frames, status: str | None = None) -> DataFrame:
    chosen = tables["approvisionnements"].filter(equals_if("statut", status))
    return with_site(chosen, tables).select(
        "id", "date_besoin", "chantier", "designation", "unite", "quantite_demandee", "fournisseur",
        "numero_bc", "quantite_recue", "statut",
    ).orderBy(F.desc("date_besoin"), F.desc("id"))


def receipt_history(tables: Frames, order: int | None = None) -> DataFrame:
    return tables["receptions_appro"].filter(equals_if("appro_id", order)).select(
        "id", "appro_id", "date_reception", "quantite_recue", "bon_livraison", "observation"
    ).orderBy("appro_id", "date_reception", "id")
