"""Domain tables derived from the generic test tables.

Every expression is valid in Spark SQL and in DuckDB, so both engines start
from the same rows. Source tables are written ``{name}``.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from earthworks.sources import catalog
from earthworks.sources.tables import Tables

SOURCES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

# A lineitem row has no short key: order, line, part, supplier, ship date and price.
_LINE_ID = (
    "concat(CAST(l_orderkey AS STRING),'-',CAST(l_linenumber AS STRING),'-',CAST(l_partkey AS STRING),'-',"
    "CAST(l_suppkey AS STRING),'-',CAST(CAST(l_shipdate AS DATE) AS STRING),'-',"
    "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING))"
)
_SUPPLIERS = "(SELECT count(*) FROM {supplier})"
_SITES = _SUPPLIERS  # one site per supplier
_PARTS = "(SELECT count(*) FROM {part})"
_ZERO = "CAST(0 AS DECIMAL(18,2))"

# table: (FROM clause, {column: expression}); columns not listed take their default.
DERIVED = {
    "dossiers": ("{region}", {
        "id": "r_regionkey",
        "nom": "r_name",
        "statut": "CASE WHEN r_regionkey = 0 THEN 'Suspendu' ELSE 'En cours' END",
    }),
    "rues": ("{supplier}", {
        "id": "s_suppkey",
        "dossier_id": "CASE WHEN s_suppkey % 8 = 7 THEN NULL ELSE s_nationkey % 5 END",
        "nom": "s_name",
        "maitre_ouvrage": "concat('MO ', s_name)",
        "entreprise": "CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE concat('ENT ', s_name) END",
        "date_demarrage": "CASE WHEN s_suppkey % 6 = 5 THEN NULL "
                          "ELSE DATE '1999-01-01' + CAST(s_suppkey % 25 AS INT) * 40 END",
        "delai_jours": "s_suppkey % 25 * 60",
        "statut_chantier": "CASE s_suppkey % 3 WHEN 0 THEN 'En cours' WHEN 1 THEN 'Terminé' "
                           "ELSE 'Non démarré' END",
    }),
    # each site carries five deliverables, 0 to 4
    "livrables": ("(SELECT s_suppkey, explode(sequence(0, 4)) AS k FROM {supplier})", {
        "id": "s_suppkey * 5 + k",
        "chantier_id": "s_suppkey",
        "nom": "concat('Livrable ', CAST(k AS STRING))",
        "longueur_m": "100 + s_suppkey * 7 + k",
    }),
    "devis_rue": ("{part}", {
        "id": "p_partkey",
        "rue_id": f"p_partkey % {_SITES}",
        "livrable_id": f"CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE (p_partkey % {_SITES}) * 5 + p_partkey % 4 END",
        "code_poste": "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END",
        "designation": "p_name",
        "unite": "p_type",
        "quantite_marche": f"CASE WHEN p_partkey % 40 = 0 THEN {_ZERO} ELSE CAST(p_size * 30 AS DECIMAL(18,2)) END",
        "prix_unitaire": "p_retailprice",
    }),
    "realisations_journalieres": ("{lineitem}", {
        "id": _LINE_ID,
        "date_suivi": "l_shipdate",
        "rue_id": f"l_partkey % {_SITES}",
        "devis_id": "l_partkey",
        "quantite_jour": "l_quantity",
    }),
    "sous_traitants": ("{supplier}", {
        "id": "s_suppkey",
        "nom": "s_name",
        "montant_contrat": "CAST(s_acctbal AS DECIMAL(18,2)) * 1000",
        "statut": "CASE s_suppkey % 3 WHEN 0 THEN 'Actif' WHEN 1 THEN 'Terminé' ELSE 'Suspendu' END",
        "rue_id": f"CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE s_nationkey % {_SITES} END",
    }),
    "devis_st": ("{part}", {
        "id": "p_partkey",
        "st_id": f"p_partkey % {_SUPPLIERS}",
        "rue_id": f"CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE (p_partkey + 3) % {_SITES} END",
        "designation": "p_name",
        "unite": "p_type",
        "quantite": "p_size * 30",
        "prix_unitaire": "p_retailprice",
    }),
    "decomptes_st": ("{lineitem}", {
        "id": _LINE_ID,
        "st_id": f"l_partkey % {_SUPPLIERS}",
        "numero_decompte": "l_linenumber",
        "date_decompte": "l_shipdate",
        "devis_st_id": "l_partkey",
        "quantite_executee": "l_quantity",
        "montant": "l_extendedprice",
    }),
    "paiements_st": ("{orders}", {
        "id": "o_orderkey",
        "st_id": f"o_custkey % {_SUPPLIERS}",
        "date_paiement": "o_orderdate",
        "montant": "o_totalprice",
        "mode_paiement": "CASE o_orderstatus WHEN 'F' THEN 'Virement' WHEN 'O' THEN 'Chèque' ELSE 'Espèces' END",
    }),
    "personnel": ("{customer}", {
        "id": "c_custkey",
        "nom": "c_name",
        "prenom": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('P', CAST(c_custkey AS STRING)) END",
        "categorie": "c_mktsegment",
        "salaire_journalier": "abs(c_acctbal)",
        "actif": "CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END",
        "rue_id": f"CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE c_nationkey % {_SITES} END",
    }),
    "pointage": ("{events}", {
        "id": "event_id",
        "date_pointage": "ts",
        "personnel_id": "user_id",
        "rue_id": f"CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id % {_SITES} END",
        "statut": "CASE event_type WHEN 'view' THEN 'Présent' WHEN 'click' THEN 'Absent' "
                  "WHEN 'purchase' THEN 'Congé' WHEN 'signup' THEN 'Mission' ELSE 'Maladie' END",
        "heures_travaillees": "LEAST(value, 24)",
    }),
    "materiaux": ("{part}", {
        "id": "p_partkey",
        "nom": "concat(p_name, ' #', CAST(p_partkey AS STRING))",
        "unite": "p_type",
        "categorie": "CASE p_type WHEN 'PROMO' THEN 'Carburant' WHEN 'LARGE' THEN 'Consommable' "
                     "ELSE 'Matériau' END",
        "stock_initial": "p_size * 10",
        "seuil_alerte": f"CASE WHEN p_partkey % 4 = 0 THEN {_ZERO} ELSE CAST(p_size AS DECIMAL(18,2)) END",
        "prix_unitaire": "p_retailprice",
    }),
    "approvisionnements": ("{orders} JOIN {customer} ON c_custkey = o_custkey", {
        "id": "o_orderkey",
        "date_besoin": "o_orderdate",
        "rue_id": f"CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE c_nationkey % {_SITES} END",
        "materiau_id": f"CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % {_PARTS} END",
        "designation": "concat('Article ', CAST(o_orderkey % 50 AS STRING))",
        "unite": "'U'",
        "quantite_demandee": "60 + o_orderkey % 120",
        "prix_unitaire_estime": "o_orderkey % 500",
        "quantite_recue": "o_orderkey % 30",
        "numero_bc": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('BC', CAST(o_orderkey AS STRING)) END",
        "statut": "CASE WHEN o_orderkey % 20 = 0 THEN 'Rejeté' "
                  "WHEN o_orderpriority = '1-URGENT' THEN 'Besoin exprimé' "
                  "WHEN o_orderpriority = '2-HIGH' THEN 'Validé chef chantier' "
                  "WHEN o_orderpriority = '3-MEDIUM' THEN 'Bon de commande émis' "
                  "WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Réceptionné' ELSE 'Mis en stock' END",
    }),
    "receptions_appro": ("{lineitem}", {
        "id": _LINE_ID,
        "appro_id": "l_orderkey",
        "date_reception": "l_shipdate",
        "quantite_recue": "l_quantity",
        "bon_livraison": "concat('BL', CAST(l_partkey AS STRING))",
        "observation": "concat('R', CAST(l_suppkey AS STRING))",
    }),
    "mouvements_materiaux": ("{lineitem}", {
        "id": _LINE_ID,
        "date_mvt": "l_shipdate",
        "rue_id": "CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE l_suppkey END",
        "materiau_id": "l_partkey",
        "type_mvt": "CASE WHEN l_linestatus = 'O' THEN 'ENTREE' ELSE 'SORTIE' END",
        "quantite": "l_quantity",
        "prix_unitaire": "l_extendedprice",
        "fournisseur": "concat('F', CAST(l_suppkey AS STRING))",
        "bon_livraison": "concat('BL', CAST(l_linenumber AS STRING))",
        "observation": "CASE WHEN l_linenumber = 2 THEN 'deux' ELSE '' END",
        "appro_id": "CASE WHEN l_returnflag = 'N' THEN l_orderkey ELSE NULL END",
    }),
    "materiels": ("{supplier}", {
        "id": "s_suppkey",
        "nom": "s_name",
        "type_materiel": "CASE s_suppkey % 2 WHEN 0 THEN 'Camion' ELSE 'Pompe' END",
        "etat": "CASE s_suppkey % 4 WHEN 0 THEN 'En panne' ELSE 'Opérationnel' END",
    }),
    "suivi_materiels": ("{events}", {
        "id": "event_id",
        "date_suivi": "ts",
        "rue_id": f"event_id % {_SITES}",
        "materiel_id": f"user_id % {_SUPPLIERS}",
        "heures_marche": f"CASE WHEN event_id % 2 = 0 THEN CAST(LEAST(value, 24) AS DECIMAL(18,2)) ELSE {_ZERO} END",
        "heures_travail": "LEAST(value, 24)",
        "carburant_materiau_id": f"CASE WHEN event_type = 'view' THEN NULL ELSE event_id % {_PARTS} END",
        "carburant_consomme": "value",
        "observations": "props",
    }),
    "maintenance_materiels": ("{orders}", {
        "id": "o_orderkey",
        "materiel_id": f"o_custkey % {_SUPPLIERS}",
        "date_maintenance": "o_orderdate",
        "type_maintenance": "CASE o_orderstatus WHEN 'F' THEN 'Préventive' WHEN 'O' THEN 'Corrective' "
                            "ELSE 'Vidange' END",
        "description": "concat('Intervention ', CAST(o_orderkey AS STRING))",
        "cout": "o_totalprice",
    }),
    "journal_chantier": ("{conversations}", {
        "id": "conv_id * 100 + turn",
        "date_journal": "DATE '2024-01-01' + CAST(conv_id % 90 AS INT)",
        "rue_id": f"conv_id % {_SITES}",
        "nb_ouvriers": "turn * 3",
        "nb_encadrants": "turn",
        "travaux_realises": "text",
        "meteo": "CASE turn % 3 WHEN 0 THEN 'Soleil' WHEN 1 THEN 'Pluie' ELSE 'Vent' END",
        "temperature": "20 + turn",
        "observations": "role",
    }),
    "caisse_chantier": ("{orders}", {
        "id": "o_orderkey",
        "date_op": "o_orderdate",
        "categorie": "o_orderpriority",
        "rue_id": f"o_custkey % {_SITES}",
        "type_op": "CASE o_orderstatus WHEN 'F' THEN 'Dépense' WHEN 'O' THEN 'Recette' ELSE 'Avance' END",
        "rubrique": "o_orderpriority",
        "montant": "o_totalprice",
        "beneficiaire": "concat('B', CAST(o_custkey AS STRING))",
        "reference_piece": "concat('P', CAST(o_orderkey AS STRING))",
    }),
    "courriers": ("{conversations}", {
        "id": "conv_id * 100 + turn",
        "date_courrier": "DATE '2024-01-01' + CAST(conv_id % 90 AS INT)",
        "rue_id": f"CASE WHEN conv_id % 6 = 0 THEN NULL ELSE conv_id % {_SITES} END",
        "type_courrier": "CASE role WHEN 'user' THEN 'Entrant' WHEN 'assistant' THEN 'Sortant' ELSE 'Interne' END",
        "priorite": "CASE turn % 3 WHEN 0 THEN 'Normale' WHEN 1 THEN 'Urgente' ELSE 'Confidentielle' END",
        "statut": "CASE conv_id % 3 WHEN 0 THEN 'Nouveau' WHEN 1 THEN 'En traitement' ELSE 'Clôturé' END",
        "objet": "text",
        "reference": "concat('C-', CAST(conv_id AS STRING))",
        "expediteur": "role",
        "destinataire": "concat('D', CAST(turn AS STRING))",
    }),
    "incidents": ("{events} WHERE event_type = 'error'", {
        "id": "event_id",
        "date_incident": "ts",
        "rue_id": f"user_id % {_SITES}",
        "type_incident": "'Accident'",
        "gravite": "CASE event_id % 4 WHEN 0 THEN 'Mineur' WHEN 1 THEN 'Modéré' WHEN 2 THEN 'Grave' "
                   "ELSE 'Critique' END",
        "description": "props",
        "nb_victimes": "event_id % 3",
        "cout_estime": "value",
        "statut": "CASE event_id % 3 WHEN 0 THEN 'Ouvert' WHEN 1 THEN 'En cours' ELSE 'Clôturé' END",
        "cloture": "CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END",
        "personne_concernee": "concat('U', CAST(user_id AS STRING))",
        "mesures_prises": "CASE WHEN event_id % 2 = 0 THEN 'Balisage' ELSE '' END",
    }),
    "audit_log": ("{events}", {
        "id": "event_id",
        "timestamp": "ts",
        "table_name": "CASE event_id % 4 WHEN 0 THEN 'devis_rue' WHEN 1 THEN 'pointage' "
                      "WHEN 2 THEN 'devis_st' ELSE 'rues' END",
        "action": "CASE event_type WHEN 'click' THEN 'UPDATE' WHEN 'error' THEN 'DELETE' ELSE 'CREATE' END",
        "record_id": "user_id",
        "details": "props",
    }),
}

# Uploaded sheets as cells, two per nation. Sheet f < 25 holds a share of the lines
# with one quantity column; sheet f + 25 holds them with a column per deliverable.
# The header sits on row f % 6. Sheet 7 lacks a unit header, sheet 8 has no known
# header at all.
_SHEET = "CAST(p_partkey % 25 AS INT)"
_ROW = "CAST((p_partkey % 25) % 6 + 1 + floor(p_partkey / 25) AS INT)"
_PRICE = "CASE WHEN p_partkey % 17 = 0 THEN 'n/a' ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS STRING) END"
_NAME = "CASE WHEN p_partkey % 29 = 0 THEN '  ' WHEN p_partkey % 31 = 0 THEN 'nan' ELSE p_name END"
_SIMPLE_HEADERS = ["N° Code", "Désignation", "Unité", "Qté", "Prix Unitaire"]
_NO_UNIT_HEADERS = ["Code", "Désignation", "Observations", "Qté", "Prix"]
_UNKNOWN_HEADERS = ["Col 0", "Col 1", "Col 2", "Col 3", "Col 4"]
_SIMPLE_CELLS = ["p_brand", _NAME, "p_type", "CAST(p_size AS STRING)", _PRICE]
_WIDE_HEADERS = [
    "Code poste", "Libellé travaux", "Unités", "PU (HT)",
    "Livrable 0", "Livrable 1", " livrable-2 ", "Remarques",
]
_WIDE_CELLS = [
    "p_brand", _NAME, "p_type", _PRICE,
    "CAST(p_size % 4 AS STRING)",
    "CASE WHEN p_partkey % 2 = 0 THEN '' ELSE CAST(p_size AS STRING) END",
    "CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE '12.5' END",
    "CASE WHEN p_partkey % 3 = 0 THEN 'ok' ELSE NULL END",
]

_DEEP_HEADERS = ["concat('N° Code', chr(10))", "concat(chr(160), 'Désignation')", "concat('Unité', chr(9))", "'Qté'",
                 "concat(chr(160), 'Prix Unitaire', chr(160))"]
_DEEP_CELLS = [
    "p_brand", "concat(chr(160), p_name, chr(10))", "concat(chr(9), p_type)",
    "CASE WHEN p_partkey % 3 = 0 THEN concat(CAST(p_size AS STRING), 'd') ELSE concat(' ', CAST(p_size AS STRING), chr(9)) END",
    "CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS STRING)",
]


def _pick(values: list[str], quote: bool = False) -> str:
    whens = " ".join(f"WHEN {k} THEN " + (f"'{v}'" if quote else v) for k, v in enumerate(values))
    return f"CASE k {whens} END"


def _spread(source: str, width: int) -> str:
    return f"(SELECT *, explode(sequence(0, {width - 1})) AS k FROM {{{source}}})"


def _cells() -> str:
    simple_header = (
        f"CASE n_nationkey WHEN 7 THEN {_pick(_NO_UNIT_HEADERS, True)} "
        f"WHEN 8 THEN {_pick(_UNKNOWN_HEADERS, True)} ELSE {_pick(_SIMPLE_HEADERS, True)} END"
    )
    parts = [
        "SELECT CAST(n_nationkey AS INT) AS file_id, 0 AS row_idx, 0 AS col_idx, n_name AS value "
        "FROM {nation} WHERE n_nationkey % 6 > 0",
        f"SELECT CAST(n_nationkey AS INT), CAST(n_nationkey % 6 AS INT), CAST(k AS INT), {simple_header} "
        f"FROM {_spread('nation', 5)}",
        f"SELECT CAST(n_nationkey + 25 AS INT), CAST(n_nationkey % 6 AS INT), CAST(k AS INT), "
        f"{_pick(_WIDE_HEADERS, True)} FROM {_spread('nation', 8)}",
        f"SELECT {_SHEET}, {_ROW}, CAST(k AS INT), {_pick(_SIMPLE_CELLS)} FROM {_spread('part', 5)}",
        f"SELECT {_SHEET} + 25, {_ROW}, CAST(k AS INT), {_pick(_WIDE_CELLS)} FROM {_spread('part', 8)}",
    ]
    # sheet 50 begins below row 7 with an empty first column, among white space of all kinds; sheet 51 is a header only
    parts += [
        f"SELECT 50, 8, CAST(k + 1 AS INT), {_pick(_DEEP_HEADERS)} FROM {_spread('nation', 5)} WHERE n_nationkey = 0",
        f"SELECT 50, CAST(9 + floor(p_partkey / 50) AS INT), CAST(k + 1 AS INT), {_pick(_DEEP_CELLS)} "
        f"FROM {_spread('part', 5)} WHERE p_partkey % 50 = 1",
        "SELECT 51, 2, CAST(k AS INT), " + _pick(["Code", "Désignation", "Unité"], True)
        + f" FROM {_spread('nation', 3)} WHERE n_nationkey = 0",
    ]
    return " UNION ALL ".join(parts)


_SQL_TYPES = {"bigint": "BIGINT", "int": "INT", "string": "STRING", "decimal(18,2)": "DECIMAL(18,2)", "date": "DATE"}
RAW_CELLS = "raw_cells"


@cache
def select_text(name: str, duckdb: bool = False) -> str:
    """SELECT deriving one domain table (or the raw cells) from the sources."""
    if name == RAW_CELLS:
        return _dialect(_cells(), duckdb)
    source, given = DERIVED[name]
    columns = []
    for spec in catalog.columns(name):
        kind = _SQL_TYPES.get(spec.type.simpleString(), "TIMESTAMP" if duckdb else "TIMESTAMP_NTZ")
        if spec.name in given:
            text = given[spec.name]
        elif spec.default is None:
            text = "NULL"
        else:
            text = "'" + spec.default.replace("'", "''") + "'"
        if given.get(spec.name) == _LINE_ID:
            kind = "STRING"
        columns.append(f"CAST({text} AS {kind}) AS {spec.name}")
    return _dialect(f"SELECT {', '.join(columns)} FROM {source}", duckdb)


def _dialect(text: str, duckdb: bool) -> str:
    return re.sub(r"explode\(sequence\(0, (\d+)\)\)", r"unnest(range(0, \1 + 1))", text) if duckdb else text


# Scans by application, folder and name, so that schemas are read from the files once.
_opened: dict[tuple[str, str, str], DataFrame] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The domain tables, lazily derived from the Parquet files of ``sf_dir``."""
    session = spark.sparkContext.applicationId

    def source(name: str) -> DataFrame:
        key = (session, sf_dir, name)
        if key not in _opened:
            _opened[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return _opened[key]

    sources = Tables(spark, SOURCES, source)

    def derive(name: str) -> DataFrame:
        text = select_text(name)
        used = {s: sources[s] for s in SOURCES if "{" + s + "}" in text}
        return spark.sql(text, **used)

    return Tables(spark, [*DERIVED, RAW_CELLS], derive)
