"""Every job under its name, run over whole tables with fixed arguments.

The arguments are those the SQL texts in ``oracle/`` spell out.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections import ChainMap
from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earthworks.functions import columns as fn
from earthworks.operators import aggregates, changes, filters, joins, windows
from earthworks.operators.lineage import shared_folder, stable
from earthworks.plans import (
    dashboard, history, ingest, market, plant, procurement, projects, quality, records, reports, staff, stock,
    subcontract,
)
from earthworks.sources import catalog, sinks, tables as scans
from earthworks.sources.tables import Tables
from earthworks.sources.text_load import typed
from earthworks.sources.versions import Store, counts

Job = Callable[[Tables], DataFrame]

SITES_AS_OF = dt.date(2001, 8, 1)
EVENTS_AS_OF = dt.date(2024, 1, 30)
DIARY_AS_OF = dt.date(2024, 2, 10)
POSTING_DAY = dt.date(2024, 2, 1)
EVENT_PERIOD = (dt.date(2024, 1, 5), dt.date(2024, 1, 20))
ORDER_PERIOD = (dt.date(1996, 1, 1), dt.date(1999, 12, 31))
DIARY_PERIOD = (dt.date(2024, 1, 5), dt.date(2024, 2, 20))


# --- inputs the jobs need beyond the tables, derived from the tables ---

class Upload(NamedTuple):
    """Uploaded sheets: their cells in one table, the layout of the site import, and the site of each file."""

    cells: DataFrame
    columns: DataFrame
    files: DataFrame


def _upload(t: Tables) -> Upload:
    """The fixture puts the cells together from many scans, so they are kept once, as an upload would be stored."""
    cells = stable(t["raw_cells"])
    columns = ingest.layout(cells)
    return Upload(cells, columns, _files(t, columns))


def _files(t: Tables, columns: DataFrame) -> DataFrame:
    """Site of each file of a layout, two files per site."""
    count = t["rues"].agg(F.count(F.lit(1))).scalar()
    return columns.select("file_id").distinct().withColumn("rue_id", (F.col("file_id") % 25) % count)


def _stage_requests(t: Tables) -> DataFrame:
    """Mostly the next stage, some refused ones, a few orders asked twice."""
    following = F.when(F.col("statut") == catalog.NEED, catalog.VALIDATED)
    following = following.when(F.col("statut") == catalog.VALIDATED, catalog.ORDERED)
    following = following.when(F.col("statut") == catalog.ORDERED, catalog.RECEIVED).otherwise(catalog.STOCKED)
    target = F.when(F.col("id") % 7 == 0, catalog.STOCKED).when(F.col("id") % 20 == 1, catalog.REJECTED).otherwise(following)
    times = F.when(F.col("id") % 50 == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return t["approvisionnements"].select(
        F.col("id").alias("appro_id"), target.alias("cible"), F.lit(POSTING_DAY).alias("date_etape"),
        F.lit("Chef").alias("acteur"), F.concat(F.lit("N"), F.col("id").cast("string")).alias("numero_bc"),
        F.concat(F.lit("F"), (F.col("id") % 9).cast("string")).alias("fournisseur"), F.explode(times).alias("__time"),
    ).drop("__time")


def _overriding(t: Tables, **frames: DataFrame) -> Mapping[str, DataFrame]:
    return ChainMap(frames, t)


def _dirty_names(t: Tables) -> Mapping[str, DataFrame]:
    return _overriding(
        t,
        sous_traitants=t["sous_traitants"].withColumn("nom", F.right("nom", F.lit(1))),
        materiaux=t["materiaux"].withColumn("nom", F.split_part("nom", F.lit(" #"), F.lit(1))),
    )


def _blanked(t: Tables) -> Mapping[str, DataFrame]:
    lines = t["devis_rue"].withColumns({
        "designation": F.when(F.col("id") % 6 == 0, "  ").otherwise(F.col("designation")),
        "unite": F.when(F.col("id") % 9 != 0, F.col("unite")),
    })
    people = t["personnel"].withColumn("nom", F.when(F.col("prenom").isNotNull(), F.col("nom")))
    return _overriding(t, devis_rue=lines, personnel=people)


def _digit(column: str) -> Column:
    """A figure from 0 to 9 that differs from row to row: the last digit of a key."""
    return F.right(F.col(column).cast("string"), F.lit(1)).cast("int")


def _spoiled(t: Tables) -> Mapping[str, DataFrame]:
    """The stored values, except where the id ends in 3 (an unknown word) or 4 (a number out of range)."""
    frames = {}
    for name in dict.fromkeys(n for n, _ in (*catalog.DOMAINS, *quality.RANGES)):
        words = {c: F.when(_digit("id") == 3, F.lit("inconnu")).otherwise(F.col(c)) for n, c in catalog.DOMAINS if n == name}
        numbers = {c: F.when(_digit("id") == 4, F.lit(-1)).otherwise(F.col(c)) for n, c in quality.RANGES if n == name}
        frames[name] = t[name].withColumns(words | numbers)
    return _overriding(t, **frames)


def _thinned(t: Tables) -> Mapping[str, DataFrame]:
    return _overriding(
        t,
        rues=t["rues"].filter(F.col("statut_chantier") != "Terminé"),
        materiaux=t["materiaux"].filter(F.col("categorie") != "Consommable"),
        sous_traitants=t["sous_traitants"].filter(F.col("statut") != "Suspendu"),
        personnel=t["personnel"].filter(F.col("actif") == 1),
        materiels=t["materiels"].filter(F.col("etat") == catalog.OPERATIONAL),
        dossiers=t["dossiers"].filter(F.col("statut") == "En cours"),
    )


# --- jobs that put several pieces together ---

def param_scan(t: Tables) -> DataFrame:
    query = """
        SELECT mode_paiement, count(*) AS nb, sum(montant) AS montant FROM {payments}
        WHERE montant > :above GROUP BY mode_paiement
    """
    recent = scans.period(t["paiements_st"], "paiements_st", dt.date(1997, 1, 1), None)
    return scans.sql(t.spark, query, {"above": 50000}, payments=recent)


def schema_defaults(t: Tables) -> DataFrame:
    given = t["personnel"].select("id", "nom", "prenom", "categorie", "actif", "salaire_journalier")
    return scans.with_defaults(given, "personnel", fill_nulls=True)


def typed_load(t: Tables) -> DataFrame:
    """Orders written as text, some dates and numbers unreadable, labels without accents."""
    texts = t["approvisionnements"].select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 10 == 3, "inconnue").otherwise(F.col("date_besoin").cast("string")).alias("date_besoin"),
        F.when(F.col("id") % 13 == 0, " ").otherwise(F.col("quantite_demandee").cast("string")).alias("quantite_demandee"),
        F.upper(F.translate("statut", "é", "e")).alias("statut"), F.lit("").alias("date_bc"),
    )
    return typed(texts, "approvisionnements")


def lookup_filters(t: Tables) -> DataFrame:
    parts = {
        "livrables": scans.deliverables(t),
        "materiaux": scans.materials(t, "Consommable"),
        "personnel": scans.staff(t),
        "devis_rue": scans.bill_lines(t).withColumn("nom", F.col("designation")),
        "materiels": scans.plant(t, catalog.OPERATIONAL),
        "rues": scans.sites(t),
    }
    rows = [df.select(F.lit(name).alias("source"), "id", "nom") for name, df in parts.items()]
    return aggregates.append_levels(*rows)


def filter_status(t: Tables) -> DataFrame:
    wanted = F.col("statut").isin(catalog.ORDERED, catalog.RECEIVED) & (F.col("statut") != catalog.STOCKED)
    return t["approvisionnements"].filter(wanted).select("id", "statut")


def filter_period(t: Tables) -> DataFrame:
    return scans.recent(t["pointage"], "pointage", EVENTS_AS_OF, 7).select(
        "id", "date_pointage", "personnel_id", "statut"
    )


def filter_range(t: Tables) -> DataFrame:
    inside = scans.period(t["caisse_chantier"], "caisse_chantier", dt.date(1997, 1, 1), dt.date(1998, 12, 31))
    return inside.select("id", "date_op", "montant")


def join_inner_left(t: Tables) -> DataFrame:
    rows = joins.with_names(t["suivi_materiels"], t["materiels"], "materiel_id", "inner", engin="nom")
    rows = joins.with_names(joins.with_site(rows, t), t["materiaux"], "carburant_materiau_id", carburant="nom")
    return rows.select("id", "engin", "chantier", fn.or_label("carburant").alias("carburant"), "carburant_consomme")


def name_to_id(t: Tables) -> DataFrame:
    number = F.when(F.col("id") % 10 == 0, F.col("id") + 100000000).otherwise(F.col("id"))
    asked = t["devis_rue"].select(
        F.col("id").alias("ligne"), F.concat("designation", F.lit(" #"), number.cast("string")).alias("article")
    )
    return joins.name_to_id(asked, t["materiaux"], "article", "materiau_id").select("ligne", "materiau_id")


def format_amounts(t: Tables) -> DataFrame:
    return t["devis_rue"].select(
        "id", fn.money_text(fn.amount("quantite_marche", "prix_unitaire"), "EUR").alias("montant_texte"),
        fn.percent_text(F.col("prix_unitaire").cast("double") / 7).alias("pct_texte"),
    )


def date_parts(t: Tables) -> DataFrame:
    day = F.col("date_besoin")
    return t["approvisionnements"].select(
        "id", F.date_trunc("week", day).cast("date").alias("lundi"), scans.month_of(day).alias("mois"),
        F.date_format(day, "dd/MM/yyyy").alias("jour"), F.trunc(day, "year").alias("debut_annee"),
        F.datediff(F.lit(SITES_AS_OF), day).alias("jours"), F.date_add(day, 1).alias("lendemain"),
    )


def diary_notes(t: Tables) -> DataFrame:
    entries = t["journal_chantier"].select(
        "id",
        F.when(F.col("nb_ouvriers") > 0, F.col("nb_ouvriers").cast("string")).otherwise(" ").alias("incidents"),
        F.when(F.col("id") % 3 != 0, F.concat(F.lit(" L"), F.col("id").cast("string"))).alias("livraisons"),
        F.when(F.col("id") % 5 == 0, "V ").otherwise("").alias("visites"),
        F.col("travaux_realises").alias("remarques"),
    )
    return records.diary_notes(entries)


def unit_check(t: Tables) -> DataFrame:
    return t["raw_cells"].filter(F.col("col_idx") == 2).select(
        "file_id", "row_idx", fn.unit_or_mark("value").alias("unite"), fn.is_known_unit("value").alias("connue")
    )


def post_executions(t: Tables) -> DataFrame:
    entries = t["devis_rue"].select(F.col("id").alias("devis_id"), (F.col("id") % 4).cast(catalog.MONEY).alias("quantite"))
    return market.post_executions(t, entries, POSTING_DAY)


def post_statements(t: Tables) -> DataFrame:
    entries = t["devis_st"].select(F.col("id").alias("devis_st_id"), (F.col("id") % 5).cast(catalog.MONEY).alias("quantite"))
    return subcontract.post_statements(t, entries, 3, POSTING_DAY)


def attendance_batch(t: Tables) -> DataFrame:
    entered = staff.post_attendance(t, staff.attendance_entries(t, EVENTS_AS_OF))
    return joins.with_site(entered, t)


def stage_transitions(t: Tables) -> DataFrame:
    return procurement.transitions(t, _stage_requests(t))[0]


def stage_rejects(t: Tables) -> DataFrame:
    return procurement.transitions(t, _stage_requests(t))[1]


def recompute_received(t: Tables) -> DataFrame:
    receptions = t["receptions_appro"]
    deleted = receptions.filter(F.col("quantite_recue") > 45)
    after = {"approvisionnements": t["approvisionnements"], "receptions_appro": receptions.filter(F.col("quantite_recue") <= 45)}
    return procurement.recompute_received(after, deleted)


def _deliveries(t: Tables) -> DataFrame:
    """Two deliveries for some orders, one for others, some of nothing, none for those that were rejected."""
    times = F.when(F.col("id") % 9 == 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    wanted = t["approvisionnements"].filter(F.col("statut") != catalog.REJECTED)
    asked = wanted.select("id", F.explode(times).alias("k"))
    return asked.select(
        (F.col("id") * 10 + F.col("k")).alias("source_id"), F.col("id").alias("appro_id"),
        F.date_add(F.lit(POSTING_DAY), (F.col("id") % 3 + F.col("k")).cast("int")).alias("date_reception"),
        (F.col("id") % 4 * F.col("k")).cast(catalog.MONEY).alias("quantite_recue"),
        F.concat(F.lit("BL"), F.col("id").cast("string"), F.lit("-"), F.col("k").cast("string")).alias("bon_livraison"),
    )


def _numbered_receptions(t: Tables) -> Mapping[str, DataFrame]:
    """Receptions under whole-number ids, as the reception form gives them."""
    ids = F.split(F.col("id").cast("string"), "-")
    whole = (ids[0].cast("bigint") * 10 + ids[1].cast("bigint")).alias("id")
    return _overriding(t, receptions_appro=t["receptions_appro"].withColumn("id", whole))


def post_receptions_orders(t: Tables) -> DataFrame:
    return procurement.post_receptions(_numbered_receptions(t), _deliveries(t))[1]


def post_receptions_rows(t: Tables) -> DataFrame:
    return procurement.post_receptions(_numbered_receptions(t), _deliveries(t))[0]


def _batch_requests(t: Tables) -> DataFrame:
    """Several requests of one order in a batch: along the stages, skipping one, repeating one; some orders are unknown.

    What an order asks for follows from its material and its quantity: the first request aims at the stage after its own or
    beyond, later ones at the stages that follow. Stocking comes with a quantity and a price, or without.
    """
    stages = F.array(*[F.lit(x) for x in (catalog.NEED, catalog.VALIDATED, catalog.ORDERED, catalog.RECEIVED, catalog.STOCKED)])
    here = F.array_position(stages, F.col("statut"))  # from 1; 0 for a rejected order
    wide = F.coalesce(F.col("materiau_id"), F.lit(0)) + F.col("quantite_demandee").cast("int")
    asked = t["approvisionnements"].select("*", here.alias("__here"), (wide % 5).cast("int").alias("__kind")).select(
        "id", "statut", "quantite_demandee", "__here", "__kind", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"))
    # kind 0: all stages that follow; 1: begins one stage too far; 2: asks twice for each; 3: only two; 4: all, in reverse order of dates
    ahead = F.when(F.col("__kind") == 1, F.col("k") % 4 + 1).when(F.col("__kind") == 2, F.ceil(F.col("k") / 2)).otherwise(F.col("k"))
    target = F.when(F.col("__kind").isin(3) & (F.col("k") > 2), F.lit(catalog.REJECTED)).otherwise(
        F.get(stages, (F.col("__here") - 1 + ahead).cast("int")))
    day = F.date_add(F.lit(POSTING_DAY), F.when(F.col("__kind") == 4, -F.col("k")).otherwise(F.floor(F.col("k") / 3)).cast("int"))
    given = (F.col("quantite_demandee").cast("int") % 2 == 0) & (F.col("k") >= 2)
    return asked.filter(target.isNotNull()).select(
        F.when(F.col("quantite_demandee").cast("int") % 17 == 0, F.col("id") + 900000000).otherwise(F.col("id")).alias("appro_id"),
        (F.col("id") * 10 + F.col("k")).alias("numero"), target.alias("cible"), day.alias("date_etape"),
        F.concat(F.lit("Chef "), F.col("k").cast("string")).alias("acteur"),
        F.concat(F.lit("N"), F.col("id").cast("string"), F.lit("-"), F.col("k").cast("string")).alias("numero_bc"),
        F.concat(F.lit("F"), F.col("k").cast("string")).alias("fournisseur"),
        F.when(given, F.col("quantite_demandee") / 2).cast(catalog.MONEY).alias("quantite"),
        F.when(given, F.col("k") * 10).cast(catalog.MONEY).alias("prix"),
    )


def batch_orders(t: Tables) -> DataFrame:
    return procurement.run_batch(t, _batch_requests(t)).orders


def batch_steps(t: Tables) -> DataFrame:
    return procurement.run_batch(t, _batch_requests(t)).taken


def batch_refused(t: Tables) -> DataFrame:
    return procurement.run_batch(t, _batch_requests(t)).refused


def batch_entries(t: Tables) -> DataFrame:
    return procurement.run_batch(t, _batch_requests(t)).entries


def stock_moves(t: Tables) -> DataFrame:
    return procurement.stock_moves(t, _stage_requests(t), POSTING_DAY)[1]


def append_rows(t: Tables) -> DataFrame:
    spent = t["maintenance_materiels"].select(
        F.col("id").alias("source_id"), F.col("date_maintenance").alias("date_op"), F.lit(catalog.EXPENSE).alias("type_op"),
        F.col("type_maintenance").alias("rubrique"), F.col("cout").alias("montant"),
    )
    return changes.append_rows(t["caisse_chantier"], spent, "caisse_chantier", order="source_id")


def upsert_rows(t: Tables) -> DataFrame:
    entered = t["suivi_materiels"].select(
        "id", F.col("date_suivi").alias("date_pointage"), F.col("materiel_id").alias("personnel_id"),
        F.lit("Mission").alias("statut"), F.col("heures_travail").alias("heures_travaillees"),
        F.col("id").alias("__order"),
    )
    full = scans.with_defaults(entered, "pointage").withColumn("__order", F.col("id"))
    return changes.upsert_rows(t["pointage"], full, ["date_pointage", "personnel_id"], "__order")


def insert_ignore(t: Tables) -> DataFrame:
    listed = t["devis_rue"].select((F.col("id") + 1000000).alias("id"), F.col("designation").alias("nom"))
    again = t["materiaux"].select((F.col("id") + 2000000).alias("id"), "nom")
    new = scans.with_defaults(listed.unionByName(again).withColumn("unite", F.lit("U")), "materiaux")
    return changes.insert_ignore(t["materiaux"], new, ["nom"], "id")


def update_rows(t: Tables) -> DataFrame:
    """Every entry asks for its price, so most materials are asked for many times; the highest price counts."""
    entries = t["mouvements_materiaux"].filter(F.col("type_mvt") == catalog.ENTRY)
    asked = entries.select(F.col("materiau_id").alias("id"), "prix_unitaire")
    return changes.update_rows(t["materiaux"], asked, ["prix_unitaire"])


def import_simple(t: Tables) -> DataFrame:
    up = _upload(t)
    return ingest.import_simple(up.cells, up.files, t["livrables"], columns=up.columns)


def import_multi(t: Tables) -> DataFrame:
    up = _upload(t)
    return ingest.import_multi(up.cells, up.files, t["livrables"], up.columns)


def deliverable_match(t: Tables) -> DataFrame:
    up = _upload(t)
    return ingest.match_deliverables(up.columns, up.files, t["livrables"])


def replace_slice(t: Tables) -> DataFrame:
    """Bill lines after the import of the simple sheets; the sites of accepted sheets without lines are cleared too."""
    up = _upload(t)
    lines = ingest.import_simple(up.cells, up.files, t["livrables"], columns=up.columns)
    lines = lines.withColumn("quantite_marche", F.col("quantite").cast(catalog.MONEY))
    lines = lines.withColumn("prix_unitaire", F.col("prix_unitaire").cast(catalog.MONEY))
    lines = lines.withColumn("id", F.col("row_idx") * 100 + F.col("file_id") + 1000000000)
    sites = ingest.simple_files(up.cells, up.files, t["livrables"], up.columns).select("rue_id")
    return changes.replace_slice(t["devis_rue"], scans.with_defaults(lines, "devis_rue"), ["rue_id"], sites)


def _owned(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The cells, and deliverable and subcontractor of every simple sheet."""
    up = _upload(t)
    files = stable(ingest.simple_files(up.cells, up.files, t["livrables"], up.columns))
    return (up.cells, files.withColumn("livrable_id", F.col("rue_id") * 5 + F.col("file_id") % 4),
            files.withColumn("st_id", F.col("rue_id")))


def import_deliverable(t: Tables) -> DataFrame:
    cells, files, _ = _owned(t)
    return ingest.import_simple(cells, files, target="livrable")


def import_subcontractor(t: Tables) -> DataFrame:
    cells, _, files = _owned(t)
    return ingest.import_simple(cells, files, target="sous_traitant")


def replace_deliverable(t: Tables) -> DataFrame:
    cells, files, _ = _owned(t)
    lines = ingest.import_simple(cells, files, target="livrable").withColumns({
        "quantite_marche": F.col("quantite").cast(catalog.MONEY), "prix_unitaire": F.col("prix_unitaire").cast(catalog.MONEY),
        "id": F.col("row_idx") * 100 + F.col("file_id") + 1000000000,
    })
    slices = files.select("rue_id", "livrable_id")
    return changes.replace_slice(t["devis_rue"], scans.with_defaults(lines, "devis_rue"), ["rue_id", "livrable_id"], slices)


def replace_subcontractor(t: Tables) -> DataFrame:
    cells, _, files = _owned(t)
    lines = ingest.import_simple(cells, files, target="sous_traitant").withColumns({
        "quantite": F.col("quantite").cast(catalog.MONEY), "prix_unitaire": F.col("prix_unitaire").cast(catalog.MONEY),
        "id": F.col("row_idx") * 100 + F.col("file_id") + 1000000000,
    })
    return changes.replace_slice(t["devis_st"], scans.with_defaults(lines, "devis_st"), ["st_id"], files.select("st_id"))


def name_to_id_repeated(t: Tables) -> DataFrame:
    """Names that many materials share resolve to the lowest id, once per asked row."""
    shared = t["materiaux"].withColumn("nom", F.split_part("nom", F.lit(" #"), F.lit(1)))
    asked = t["devis_rue"].select(F.col("id").alias("ligne"), F.col("designation").alias("article"))
    return joins.name_to_id(asked, shared, "article", "materiau_id").select("ligne", "materiau_id")


def cascade_delete(t: Tables) -> DataFrame:
    finished = t["rues"].filter(F.col("statut_chantier") == "Terminé").select("id")
    unlinked = {"devis_rue": "livrable_id", "materiels": "rue_id_affectation"}
    rows = []
    for name, df in changes.cascade_delete(t, finished).items():
        link = F.col(unlinked[name]) if name in unlinked else F.lit(None)
        rows.append(df.select(F.lit(name).alias("table_name"), F.col("id").cast("string").alias("id"), link.cast("bigint").alias("lien")))
    return aggregates.append_levels(*rows)


def audit_diff(t: Tables) -> DataFrame:
    """Materials after dropping the consumables, raising some prices and thresholds, adding every bill line."""
    base = t["materiaux"]
    kept = base.filter(F.col("categorie") != "Consommable").withColumns({
        "prix_unitaire": F.col("prix_unitaire") + F.col("unite").isin("PROMO", "SMALL").cast("int"),
        "seuil_alerte": F.col("seuil_alerte") * (1 + F.col("unite").isin("PROMO", "MEDIUM").cast("int")),
    })
    kept = kept.withColumns({c: F.col(c).cast(catalog.MONEY) for c in ("prix_unitaire", "seuil_alerte")})
    added = t["devis_rue"].select((F.col("id") + 5000000000).alias("id"), F.col("designation").alias("nom"), "unite")
    new = kept.unionByName(scans.with_defaults(added, "materiaux").select(base.columns))
    return changes.audit_diff(base, new, "materiaux", dt.datetime(2024, 2, 1, 8))


def _folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def warehouse_scan(t: Tables) -> DataFrame:
    """Tables stored by month and read again: their rows, months and ids."""
    folder, names = _folder(t, "warehouse"), ["rues", "personnel", "materiaux", "caisse_chantier", "pointage", "audit_log", "paiements_st"]
    for name in names:
        scans.save(t[name], folder, name)
    stored = scans.open_warehouse(t.spark, folder)
    rows = [stored[n].agg(
        F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n"),
        (F.countDistinct(scans.MONTH) if scans.MONTH in stored[n].columns else F.lit(0)).cast("bigint").alias("nb_mois"),
        F.sum(F.col("id").cast("decimal(28,0)")).alias("somme_ids")) for n in names]
    return aggregates.append_levels(*rows)


def export_sheets(t: Tables) -> DataFrame:
    """The sheets of the global report and an empty one, written as CSV: their rows as listed and as read again."""
    folder = _folder(t, "sheets")
    sheets = reports.report(11, t) | {"Vide": t["rues"].filter(F.lit(False))}
    paths = sinks.export(sheets, folder, "csv", labels=True)
    listed = t.spark.read.parquet(f"{folder}/{sinks.LISTING}")
    read = [t.spark.read.option("header", True).option("multiLine", True).csv(p).agg(
        F.lit(name).alias("feuille"), F.count(F.lit(1)).alias("lues")) for name, p in zip(sheets, paths, strict=True)]
    return listed.join(aggregates.append_levels(*read), "feuille")


def preview_alerts(t: Tables) -> DataFrame:
    """The first twenty alerts, each with how many there are."""
    rows, count = sinks.preview(stock.alerts(t), 20)
    return rows.withColumn("total", F.lit(count))


# --- the same on stored versions ---

def _stored(t: Tables, *names: str, **frames: DataFrame) -> Store:
    """A new store whose first version has the given tables."""
    store = Store(t.spark, _folder(t, "versions"))
    store.create({n: t[n] for n in names} | frames)
    return store


def _attendance_changes(t: Tables) -> DataFrame:
    """What plant was used for becomes attendance, as in ``upsert_rows``, of the last days only."""
    late = t["suivi_materiels"].filter(F.col("date_suivi") >= F.lit(EVENTS_AS_OF - dt.timedelta(days=10)))
    entered = late.select(
        "id", F.col("date_suivi").alias("date_pointage"), F.col("materiel_id").alias("personnel_id"),
        F.lit("Mission").alias("statut"), F.col("heures_travail").alias("heures_travaillees"),
    )
    return scans.with_defaults(entered, "pointage")


def stored_upsert(t: Tables) -> DataFrame:
    store = _stored(t, "pointage")
    store.upsert("pointage", _attendance_changes(t), ["date_pointage", "personnel_id"], "id")
    return store.read("pointage").drop(scans.MONTH)


def version_changes(t: Tables) -> DataFrame:
    """What differs between the versions before and after."""
    store = _stored(t, "pointage")
    store.upsert("pointage", _attendance_changes(t), ["date_pointage", "personnel_id"], "id")
    return store.change_log("pointage", 0, 1, dt.datetime(2024, 2, 1, 8))


def _late_costs(t: Tables) -> DataFrame:
    return t["maintenance_materiels"].filter(F.col("date_maintenance") >= F.lit(LATE)).select(
        F.col("id").alias("source_id"), F.col("date_maintenance").alias("date_op"), F.col("materiel_id").alias("rue_id"),
        F.lit(catalog.EXPENSE).alias("type_op"), F.col("type_maintenance").alias("rubrique"), F.col("cout").alias("montant"))


LATE = dt.date(1998, 1, 1)


def stored_replace(t: Tables) -> DataFrame:
    """The cash book after the operations of all finished sites made way for the late costs of their plant."""
    store = _stored(t, "caisse_chantier")
    finished = t["rues"].filter(F.col("statut_chantier") == "Terminé").select(F.col("id").alias("rue_id"))
    costs = _late_costs(t).join(finished, "rue_id", "left_semi").withColumn("id", F.col("source_id") + 1000000000)
    store.replace("caisse_chantier", scans.with_defaults(costs, "caisse_chantier"), ["rue_id"], finished)
    return store.read("caisse_chantier").drop(scans.MONTH)


def stored_versions(t: Tables) -> DataFrame:
    """Every version of a cash book and a list of materials, read one after the other: first, appended, updated, replaced."""
    store = _stored(t, "caisse_chantier", "materiaux")
    store.append("caisse_chantier", _late_costs(t), "source_id")
    asked = t["caisse_chantier"].filter(F.col("type_op") == catalog.ADVANCE).select("id", F.add_months("date_op", 2).alias("date_op"))
    store.update("caisse_chantier", asked, ["date_op"])
    consumed = t["materiaux"].filter(F.col("categorie") == "Consommable").select("categorie")
    store.replace("materiaux", t["materiaux"].limit(0), ["categorie"], consumed)
    return counts(store, store.numbers())


def stored_cascade(t: Tables) -> DataFrame:
    """Rows and freed links before and after the finished sites went with what hangs on them, both versions from the store."""
    store = _stored(t, *CASCADED)
    store.delete_sites(t["rues"].filter(F.col("statut_chantier") == "Terminé").select("id"))
    unlinked = {"devis_rue": "livrable_id", "materiels": "rue_id_affectation"}
    rows = []
    for number in store.numbers():
        for name, df in store.tables(number).items():
            link = F.count(unlinked[name]) if name in unlinked else F.lit(0)
            rows.append(df.agg(F.lit(number).alias("version"), F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"),
                               link.cast("bigint").alias("liens")))
    return aggregates.append_levels(*rows)


# Tables of every kind of link: below a site, two levels below, freed instead of deleted, stored by month.
CASCADED = ["rues", "livrables", "devis_rue", "sous_traitants", "devis_st", "personnel", "caisse_chantier", "materiels"]


def _with_numbers(df: DataFrame) -> DataFrame:
    """Ids as whole numbers, in the order of the texts they were."""
    return changes.number_rows(df, "id", "id")


def _late_cash(t: Tables) -> Store:
    store = _stored(t, "caisse_chantier")
    store.append("caisse_chantier", _late_costs(t), "source_id")
    return store


def cash_since_site(t: Tables) -> DataFrame:
    """Balances from the first month on that late costs changed; the months before come as sums."""
    store = _late_cash(t)
    return history.cash_running(store, history.first_changed(store, "caisse_chantier", 0, 1), per_site=True)


def cash_since_all(t: Tables) -> DataFrame:
    store = _late_cash(t)
    return history.cash_running(store, history.first_changed(store, "caisse_chantier", 0, 1), per_site=False)


def overdraw_since(t: Tables) -> DataFrame:
    store = _stored(t, "materiaux", mouvements_materiaux=_with_numbers(t["mouvements_materiaux"]))
    return history.overdrawn_exits(store, f"{LATE:%Y-%m}")


def import_stats(t: Tables) -> DataFrame:
    up = _upload(t)
    multi = ingest.import_multi(up.cells, up.files, t["livrables"], up.columns)
    simple = ingest.import_simple(up.cells, up.files, t["livrables"], columns=up.columns)
    return ingest.import_stats(multi).unionByName(ingest.import_stats(simple))


def recap_wide(t: Tables) -> DataFrame:
    wide = market.recap_wide(t, [fn.NO_DELIVERABLE, *[f"Livrable {k}" for k in range(4)]])
    return wide.withColumnsRenamed({n: n.lower().replace(" ", "_") for n in wide.columns})


def _global(name: str) -> Job:
    return lambda t: reports.report(11, t)[name]


JOBS: dict[str, Job] = {
    # scans, sources and ingestion
    "param_scan": param_scan,
    "schema_defaults": schema_defaults,
    "typed_load": typed_load,
    "lookup_filters": lookup_filters,
    "warehouse_scan": warehouse_scan,
    "export_sheets": export_sheets,
    "preview_alerts": preview_alerts,
    "site_labels": projects.site_labels,
    "name_norm": lambda t: t["raw_cells"].select("file_id", "row_idx", "col_idx", fn.normalised_name("value").alias("nom")),
    "header_detect": lambda t: ingest.detect_header(t["raw_cells"]),
    "column_resolve": lambda t: ingest.fields_of(ingest.layout(t["raw_cells"])),
    "import_rejects": lambda t: ingest.missing_fields(ingest.layout(t["raw_cells"])),
    "grid_table": lambda t: ingest.grid(t["raw_cells"]),
    "numeric_coerce": lambda t: ingest.numbers(t["raw_cells"]),
    "deliverable_match": deliverable_match,
    "import_simple": import_simple,
    "import_multi": import_multi,
    "import_stats": import_stats,
    "import_deliverable": import_deliverable,
    "import_subcontractor": import_subcontractor,
    "grid_cells": lambda t: ingest.grid_cells(t["raw_cells"]),
    # filters and projections
    "filter_status": filter_status,
    "filter_mail": lambda t: records.mail(t, kind="Entrant", status="Nouveau"),
    "filter_period": filter_period,
    "filter_range": filter_range,
    "filter_month": lambda t: records.cash_list(t, month="1997-03", last_n=None),
    "audit_log_view": lambda t: records.audit_view(t, EVENTS_AS_OF, 30, "devis", "UPDATE"),
    "fuel_materials": lambda t: scans.fuels(t).select("id", "nom", "unite"),
    "operational_plant": lambda t: scans.plant(t, catalog.OPERATIONAL).select("id", "nom"),
    "boq_lines": market.lines_with_amount,
    "boq_lines_total": market.lines_total,
    # joins
    "join_site": lambda t: joins.with_site(t["caisse_chantier"], t).select("id", "chantier", "montant"),
    "join_inner_left": join_inner_left,
    "name_to_id": name_to_id,
    "name_to_id_repeated": name_to_id_repeated,
    # aggregates, windows, top-k
    "distinct_values": lambda t: aggregates.distinct_in_order(t["devis_rue"], "unite"),
    "numeric_summary": lambda t: aggregates.numeric_summary(reports.subcontractors(t)),
    "cash_running_site": lambda t: records.cash_running(t, per_site=True),
    "cash_running_all": lambda t: records.cash_running(t, per_site=False),
    "boq_islands": lambda t: reports.deliverable_runs(t).select("rue_id", "id", "livrable", "groupe"),
    "first_per_key": lambda t: aggregates.first_per_key(t["devis_rue"], ["designation"], ["unite", "prix_unitaire"]),
    "latest_k": lambda t: windows.latest(t["paiements_st"].select("id", "date_paiement", "montant"), "date_paiement", "id", 100),
    # scalar functions
    "site_delays": lambda t: dashboard.site_delays(t, SITES_AS_OF),
    "site_schedule": lambda t: dashboard.site_schedule(t, SITES_AS_OF),
    "format_amounts": format_amounts,
    "date_parts": date_parts,
    "diary_notes": diary_notes,
    "unit_check": unit_check,
    # dashboard and projects
    "kpi_present": lambda t: dashboard.present_count(t, dt.date(2024, 1, 15)),
    "kpi_cash": dashboard.cash_totals,
    "kpi_counts": dashboard.open_counts,
    "kpi_execution": dashboard.execution,
    "site_progress": dashboard.site_progress,
    "pending_orders_top8": dashboard.pending_orders,
    "site_list": projects.site_list,
    "site_parties": projects.site_parties,
    "project_sites": projects.project_sites,
    "site_headcount": projects.site_headcount,
    "site_subcontractors": projects.site_subcontractors,
    "site_deliverables": projects.site_deliverables,
    # market
    "boq_recap": market.recap,
    "boq_recap_wide": recap_wide,
    "boq_recap_matrix": market.recap_cells,
    "boq_recap_totals": market.recap_totals,
    "work_statement": market.work_statement,
    "work_statement_total": market.work_statement_total,
    "work_statement_sites": market.work_statement_sites,
    "post_executions": post_executions,
    # the same for one site
    "site_work_statement": lambda t: market.work_statement(t, site=3),
    "site_work_total": lambda t: dashboard.execution(t, site=3),
    "site_progress_one": lambda t: dashboard.site_progress(t, site=3),
    "site_present": lambda t: dashboard.present_count(t, dt.date(2024, 1, 15), site=3),
    "site_cash": lambda t: dashboard.cash_totals(t, site=3),
    "site_counts": lambda t: dashboard.open_counts(t, site=3),
    "site_boq_lines": lambda t: market.lines_with_amount(t, site=3, deliverable=18),
    "site_deliverable_total": lambda t: market.work_statement_total(t, site=3, deliverable=18),
    "site_subcontractor_statement": lambda t: subcontract.statement(t, subcontractor=0, site=3),
    "site_subcontractor_account": lambda t: subcontract.account(t, site=3),
    "site_report_subcontractors": lambda t: reports.subcontractors(t, site=3),
    "site_report_progress": lambda t: reports.progress(t, site=3),
    "site_report_gap": lambda t: reports.gap(t, site=3),
    # subcontractors
    "subcontractor_balance": subcontract.balances,
    "subcontractor_boq": subcontract.quote_lines,
    "subcontractor_boq_total": subcontract.quote_totals,
    "post_statements": post_statements,
    "subcontractor_statement": subcontract.statement,
    "subcontractor_account": subcontract.account,
    "payments": subcontract.payments,
    # staff
    "payroll": staff.payroll,
    "attendance_history": staff.attendance_history,
    "attendance_batch": attendance_batch,
    # procurement
    "procurement_queue": procurement.queue,
    "reception_status": procurement.reception_status,
    "to_stock_qty": lambda t: procurement.to_stock(t).select("id", "qte_a_stocker"),
    "stage_transitions": stage_transitions,
    "stage_rejects": stage_rejects,
    "recompute_received": recompute_received,
    "post_stock_entries": lambda t: joins.with_site(procurement.post_stock_entries(t, POSTING_DAY), t).select(
        "date_mvt", "chantier", "materiau_id", "type_mvt", "quantite", "prix_unitaire", "appro_id", "observation"
    ),
    "procurement_followup": procurement.followup,
    "receipt_history": procurement.receipt_history,
    "post_receptions_orders": post_receptions_orders,
    "post_receptions_rows": post_receptions_rows,
    "stock_moves": stock_moves,
    "batch_orders": batch_orders,
    "batch_steps": batch_steps,
    "batch_refused": batch_refused,
    "batch_entries": batch_entries,
    # stock
    "stock_levels": stock.levels,
    "stock_alerts": stock.alerts,
    "stock_overdraw": stock.overdrawn_exits,
    "movement_totals": stock.movement_totals,
    "movement_history_article": lambda t: stock.movement_history(t, article=7, last_n=5),
    "movement_history": stock.movement_history,
    # plant
    "plant_log": lambda t: plant.plant_log(t, EVENTS_AS_OF, 7),
    "plant_totals": lambda t: plant.plant_totals(t, EVENTS_AS_OF),
    "fuel_to_stock": plant.fuel_exits,
    "maintenance_history": plant.maintenance_history,
    "maintenance_costs": plant.maintenance_costs,
    # records
    "diary_list": lambda t: records.diary(t, DIARY_AS_OF, 30),
    "diary_weekly": records.diary_weekly,
    "cash_month": records.cash_months,
    "incident_list": lambda t: records.incidents(t, status="Ouvert"),
    "incident_breakdown": records.incident_breakdown,
    # reports
    "report_progress": reports.progress,
    "report_subcontractors": reports.subcontractors,
    "report_attendance": lambda t: reports.attendance(t, None, *EVENT_PERIOD),
    "report_stock": reports.stock_sheet,
    "report_plant": lambda t: reports.plant(t, None, *EVENT_PERIOD),
    "report_diary": lambda t: reports.diary(t, None, *DIARY_PERIOD),
    "report_cash": lambda t: reports.cash(t, None, *ORDER_PERIOD),
    "report_incidents": lambda t: reports.incidents(t, None, *EVENT_PERIOD),
    "report_gap": reports.gap,
    "report_procurement": lambda t: reports.procurement(t, None, *ORDER_PERIOD),
    "report_global_sites": _global("Chantiers"),
    "report_global_progress": _global("Avancement"),
    "report_global_stock": _global("Stock"),
    "report_global_staff": _global("Personnel"),
    "report_global_subcontractors": _global("Sous-Traitants"),
    "report_global_plant": _global("Engins"),
    # changes
    "append_rows": append_rows,
    "upsert_rows": upsert_rows,
    "insert_ignore": insert_ignore,
    "update_rows": update_rows,
    "replace_slice": replace_slice,
    "replace_deliverable": replace_deliverable,
    "replace_subcontractor": replace_subcontractor,
    "cascade_delete": cascade_delete,
    "audit_diff": audit_diff,
    # stored versions
    "stored_upsert": stored_upsert,
    "stored_replace": stored_replace,
    "stored_versions": stored_versions,
    "stored_cascade": stored_cascade,
    "version_changes": version_changes,
    "cash_since_site": cash_since_site,
    "cash_since_all": cash_since_all,
    "overdraw_since": overdraw_since,
    # quality
    "dq_unique": lambda t: quality.duplicate_names(_dirty_names(t)),
    "dq_orphans": lambda t: quality.orphans(_thinned(t)),
    "dq_required": lambda t: quality.blank_required(_blanked(t)),
    "dq_domain": lambda t: quality.outside_domain(_spoiled(t)),
    "dq_range": lambda t: quality.outside_range(_spoiled(t)),
}


def plain_types(df: DataFrame) -> DataFrame:
    """Numbers as bigint or double, dates and times as ISO text, for comparing engines."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DecimalType, T.FloatType)):
            column = column.cast("double")
        elif isinstance(field.dataType, T.IntegralType):
            column = column.cast("bigint")
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        out.append(column.alias(field.name))
    return df.select(*out)
