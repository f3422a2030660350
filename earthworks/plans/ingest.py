"""Bill-of-quantity sheets as cells: find the header, name the columns, import lines.

All files are handled together. Cells come as ``file_id, row_idx, col_idx, value``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earthworks.functions.columns import VISIBLE, blank_to_null, has_name, normalised_name, strip, to_number
from earthworks.operators.lineage import stable
from earthworks.operators.windows import running_total

# Words that mark a header row.
HEADER_WORDS = [
    "designation", "libelle", "intitule", "description", "poste", "ouvrage", "travaux", "prestation", "nature",
    "article", "unite", "unit", "unites", "mesure", "quantite", "qte", "prix", "pu", "code", "reference", "num",
]
# Names a field goes by, best first.
_CODE = ["code", "code_poste", "n_", "num", "item", "ref", "reference", "no", "numero"]
_DESIGNATION = [
    "designation", "libelle", "intitule", "description", "poste", "ouvrage", "travaux", "prestation", "nature",
    "article", "tache", "objet", "libelle_travaux",
]
_UNIT = ["unite", "unit", "u", "unites", "mesure", "un"]
_PRICE = ["prix_unitaire", "pu", "prix", "cout_unitaire", "tarif", "montant_unitaire", "pu_ht"]
_QUANTITY = ["quantite_marche", "quantite", "qte", "q", "qt", "volume", "quantites"]
ALIASES = {
    "site": {
        "code": _CODE, "designation": _DESIGNATION, "unite": _UNIT,
        "qte": [*_QUANTITY, "total", "qte_total"], "pu": _PRICE,
    },
    "livrable": {
        "code": _CODE, "designation": _DESIGNATION, "unite": _UNIT, "qte": _QUANTITY, "pu": _PRICE,
    },
    "sous_traitant": {
        "code": _CODE, "designation": _DESIGNATION, "unite": _UNIT,
        "qte": ["quantite", "qte", "q", "qt", "volume", "quantite_marche", "quantites"], "pu": _PRICE,
    },
}
REQUIRED = ["designation", "unite"]
# Columns that are never deliverables.
_TOTAL_COLUMNS = ["montant", "total", "montant_total", "montant_ht"]
_NO_COLUMNS = ["nan", "none", ""]
MAX_SCAN = 15


def detect_header(cells: DataFrame, max_scan: int = MAX_SCAN) -> DataFrame:
    """Header row of each file: most cells with a header word, earliest on a tie."""
    top = cells.filter(F.col("row_idx") < max_scan)
    known = F.coalesce(normalised_name("value").rlike("|".join(HEADER_WORDS)), F.lit(False))
    scores = top.groupBy("file_id", "row_idx").agg(F.count_if(known).alias("score"))
    best = scores.groupBy("file_id").agg(
        F.max(F.struct("score", (-F.col("row_idx")).alias("up"))).alias("best")
    )
    row = F.when(F.col("best.score") > 0, -F.col("best.up")).otherwise(0)
    return best.select("file_id", row.alias("header_row"), F.col("best.score").alias("score"))


def _filled(cells: DataFrame) -> DataFrame:
    return cells.filter(F.col("value").rlike(VISIBLE))


def column_names(cells: DataFrame, max_scan: int = MAX_SCAN) -> DataFrame:
    """Normalised names of the columns that hold anything below the header.

    The cells are read once for the last filled row of each column, and once
    more for the few rows a header may be in. A file with a header and nothing
    below it has one row without a column.

    Of many small sheets these few rows are most of the cells, in a file that the
    planner takes for small and would broadcast, so the join is told to sort.
    """
    last = _filled(cells).groupBy("file_id", "col_idx").agg(F.max("row_idx").alias("last_row"))
    heads = cells.filter(F.col("row_idx") < max_scan).select(
        "file_id", "col_idx", F.col("row_idx").alias("header_row"), "value"
    )
    known = detect_header(cells, max_scan).select("file_id", "header_row")
    used = last.join(known, "file_id", "left").withColumn("header_row", F.coalesce("header_row", F.lit(0)))
    below = F.col("last_row") > F.col("header_row")
    files = used.groupBy("file_id").agg(F.first("header_row").alias("header_row"), F.count_if(below).alias("n"))
    bare = files.filter("n = 0").select("file_id", "header_row", F.lit(None).cast("int").alias("col_idx"), F.lit(None).cast("string").alias("nom"))
    named = used.filter(below).join(heads.hint("merge"), ["file_id", "col_idx", "header_row"], "left")
    text = F.coalesce(blank_to_null("value"), F.concat(F.lit("Unnamed: "), F.col("col_idx")))
    return named.select("file_id", "header_row", "col_idx", normalised_name(text).alias("nom")).unionByName(bare)


def resolve(names: DataFrame, target: str = "site") -> DataFrame:
    """Column chosen for each field of each file.

    Best is a name equal to an alias, then a name that contains one, then a name
    of three letters or more that is contained in one; within each, the
    order of the aliases decides, then that of the columns.
    """
    aliases = [
        F.struct(F.lit(field).alias("champ"), F.lit(i).alias("place"), F.lit(alias).alias("alias"))
        for field, listed in ALIASES[target].items() for i, alias in enumerate(listed)
    ]
    pairs = names.select("file_id", "col_idx", "nom", F.inline(F.array(*aliases)))
    name, alias = F.col("nom"), F.col("alias")
    tier = F.when(name == alias, 1).when(name.contains(alias), 2).when(alias.contains(name) & (F.length(name) >= 3), 3)
    ranked = pairs.withColumn("rang", tier).filter(F.col("rang").isNotNull())
    best = ranked.groupBy("file_id", "champ").agg(F.min(F.struct("rang", "place", "col_idx", "nom")).alias("best"))
    return best.select("file_id", "champ", "best.rang", "best.col_idx", "best.nom")


def layout(cells: DataFrame, target: str = "site") -> DataFrame:
    """Every used column of every file: header row, position, name and field.

    A column chosen for two fields has two rows; one chosen for none has a NULL field.
    The layout is few rows that are read several times, so it is kept.
    """
    named = column_names(cells)
    fields = resolve(named.filter(F.col("col_idx").isNotNull()), target).select("file_id", "col_idx", "champ", "rang")
    return stable(named.join(fields.hint("merge"), ["file_id", "col_idx"], "left"))  # as many as columns, see below


# Columns of all files together that may pass the driver: some 30 MB of its memory.
FEW_COLUMNS = 100_000


def _below_header(cells: DataFrame, side: DataFrame) -> DataFrame:
    """Filled cells below the header with what is known of their column; ``side`` has a ``header_row`` and is read from
    kept columns.

    The columns of a few sheets are broadcast. Those of many are too much for that, though they are a small file, so the
    join is then told to sort.
    """
    side = side.hint("merge") if side.count() > FEW_COLUMNS else side
    return _filled(cells).join(side, ["file_id", "col_idx"]).filter(F.col("row_idx") > F.col("header_row"))


def fields_of(columns: DataFrame) -> DataFrame:
    chosen = columns.filter(F.col("champ").isNotNull())
    return chosen.select("file_id", "champ", "rang", "col_idx", "nom")


def missing_fields(columns: DataFrame) -> DataFrame:
    """Files refused for want of a designation or a unit, with the fields missing."""
    found = columns.groupBy("file_id").agg(
        *[F.count_if(F.col("champ") == field).alias(field) for field in REQUIRED]
    )
    absent = F.concat_ws(",", *[F.when(F.col(field) == 0, F.lit(field)) for field in REQUIRED])
    return found.select("file_id", absent.alias("manquants")).filter(F.col("manquants") != "")


def _body(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """Filled cells below the header with the field of their column, if any."""
    return _below_header(cells, columns.select("file_id", "col_idx", "header_row", "champ"))


def _rows(cells: DataFrame, columns: DataFrame, target: str) -> DataFrame:
    """One row per sheet row that is not blank, with its fields as text."""
    return _body(cells, columns).groupBy("file_id", "row_idx").agg(
        *[F.max(F.when(F.col("champ") == f, F.col("value"))).alias(f) for f in ALIASES[target]]
    )


def grid(cells: DataFrame, target: str = "site") -> DataFrame:
    """Sheet rows with their resolved fields as text, numbered from 0 in each file."""
    rows = _rows(cells, layout(cells, target), target)
    counted = running_total(rows, F.lit(1), ["file_id"], ["row_idx"], "__n")
    return counted.withColumn("ligne", F.col("__n") - 1).drop("__n")


def grid_cells(cells: DataFrame, target: str = "site") -> DataFrame:
    """Every filled cell below the header in long form: file, row from 0, column name and value, of any width."""
    body = _below_header(cells, layout(cells, target).select("file_id", "col_idx", "header_row", "nom").distinct())
    rows = running_total(body.select("file_id", "row_idx").distinct(), F.lit(1), ["file_id"], ["row_idx"], "__n")
    return body.join(rows, ["file_id", "row_idx"]).select(
        "file_id", (F.col("__n") - 1).alias("ligne"), "col_idx", "nom", "value")


GRAM = 3


def _grams(text: str, sizes: range) -> Column:
    """All distinct groups of so many neighbouring letters of a text."""
    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - n + 1)
        return F.when(F.length(text) >= n, F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array())

    return F.array_distinct(F.flatten(F.array(*[of(n) for n in sizes])))


def containment_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of texts of one site, one of each side, of which ``grand`` may contain ``petit``; ``cote`` is the side of the
    first, 0 or 1.

    A text that contains another has all its letter groups. So a group of three letters of the small text, or the text
    itself if it is shorter, is looked up in an index of the groups of the other side: of its groups that which the fewest
    texts of the site have there. A small text with a group that none has is in none. An empty text is in every text.

    The planner takes the exploded groups for as few bytes as the texts and would broadcast them, so the joins are told to sort.
    """
    both = left.select("rue_id", F.lit(0).alias("cote"), "texte").union(right.select("rue_id", F.lit(1), "texte"))
    groups = F.concat(F.array(F.lit("")), _grams("texte", range(1, GRAM + 1)))
    index = both.select("rue_id", "cote", F.col("texte").alias("grand"), F.explode(groups).alias("groupe"))
    often = index.groupBy("rue_id", "cote", "groupe").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.length("texte") >= GRAM, _grams("texte", range(GRAM, GRAM + 1))).otherwise(F.array("texte"))
    asked = both.select("rue_id", (1 - F.col("cote")).alias("cote"), F.col("texte").alias("petit"), F.explode(own).alias("groupe"))
    rated = asked.hint("merge").join(often, ["rue_id", "cote", "groupe"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = rated.groupBy("rue_id", "cote", "petit").agg(F.min(F.struct("n", "groupe")).alias("r"))
    wanted = rarest.select("rue_id", "cote", "petit", "r.groupe")
    return index.hint("merge").join(wanted, ["rue_id", "cote", "groupe"]).select("rue_id", "cote", "grand", "petit")


def containment(left: DataFrame, right: DataFrame) -> DataFrame:
    """``rue_id``, ``gauche``, ``droite``: pairs of texts of one site (columns ``rue_id`` and ``texte``), one of which contains
    the other, once each."""
    found = containment_candidates(left, right).filter(F.col("grand").contains(F.col("petit")))
    first = F.col("cote") == 0
    return found.select("rue_id", F.when(first, F.col("grand")).otherwise(F.col("petit")).alias("gauche"),
                        F.when(first, F.col("petit")).otherwise(F.col("grand")).alias("droite")).distinct()


def match_deliverables(columns: DataFrame, files: DataFrame, deliverables: DataFrame) -> DataFrame:
    """Deliverable each leftover column of a file stands for.

    Names match when one contains the other; the first deliverable by name
    counts. ``files`` gives the site of each file. Only deliverables of these
    sites are looked at, and only pairs that an index of letter groups finds
    are compared (``containment``).
    """
    free = columns.filter(F.col("champ").isNull() & ~F.col("nom").isin(_TOTAL_COLUMNS + _NO_COLUMNS))
    placed = free.join(files, "file_id")
    # each name of a site is matched once, however many of its files have it
    heads = placed.select("rue_id", F.col("nom").alias("texte")).distinct()
    side = deliverables.select(
        F.col("chantier_id").alias("rue_id"), F.col("id").alias("livrable_id"),
        F.lower(F.trim("nom")).alias("livrable"), normalised_name("nom").alias("__norm"),
    ).join(heads.select("rue_id").distinct(), "rue_id", "left_semi")
    names = side.select("rue_id", F.col("__norm").alias("texte")).distinct()
    met = containment(heads, names).select("rue_id", F.col("gauche").alias("nom"), F.col("droite").alias("__norm"))
    pairs = met.join(side.hint("merge"), ["rue_id", "__norm"])  # deliverables may come exploded, see above
    best = F.min(F.struct("livrable", "livrable_id")).alias("best")
    found = pairs.groupBy("rue_id", "nom").agg(best)
    return placed.join(found, ["rue_id", "nom"]).select(
        "file_id", "rue_id", "col_idx", "nom", "best.livrable_id", "best.livrable"
    )


def simple_files(cells: DataFrame, files: DataFrame, deliverables: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """The files with one quantity column that can be imported: neither refused nor with a column per deliverable."""
    columns = layout(cells) if columns is None else columns
    multi = match_deliverables(columns, files, deliverables).select("file_id")
    unfit = missing_fields(columns).select("file_id").union(multi)
    return files.join(columns.select("file_id"), "file_id", "left_semi").join(unfit, "file_id", "left_anti")


def _accepted(cells: DataFrame, columns: DataFrame, target: str) -> DataFrame:
    """Sheet rows with a designation, from files that are not refused."""
    refused = missing_fields(columns).select("file_id")
    return _rows(cells, columns, target).filter(has_name("designation")).join(refused, "file_id", "left_anti")


def _text(field: str) -> Column:
    return F.coalesce(strip(field), F.lit(""))


def import_simple(
    cells: DataFrame, files: DataFrame, deliverables: DataFrame | None = None, target: str = "site",
    columns: DataFrame | None = None,
) -> DataFrame:
    """Lines of files with one quantity column, with the amount of each.

    ``files`` holds what the lines belong to: the site, and for the other
    targets the deliverable or the subcontractor. For the site target, files
    with deliverable columns are left to ``import_multi``. A layout at hand can be passed.
    """
    columns = layout(cells, target) if columns is None else columns
    rows = _accepted(cells, columns, target).join(files, "file_id")
    if deliverables is not None:
        multi = match_deliverables(columns, files, deliverables).select("file_id").distinct()
        rows = rows.join(multi, "file_id", "left_anti")
    owner = [c for c in files.columns if c != "file_id"]
    return rows.select(
        "file_id", "row_idx", *owner,
        _text("code").alias("code_poste"), _text("designation").alias("designation"), _text("unite").alias("unite"),
        to_number("qte").alias("quantite"), to_number("pu").alias("prix_unitaire"),
        (to_number("qte") * to_number("pu")).alias("montant"),
    )


def import_multi(
    cells: DataFrame, files: DataFrame, deliverables: DataFrame, columns: DataFrame | None = None
) -> DataFrame:
    """Lines of files with a column per deliverable, one per quantity that is not 0.

    The matched columns are few rows, but the planner takes them for more bytes than a file of cells and would broadcast the
    cells, so they are kept as the layout is.
    """
    columns = layout(cells) if columns is None else columns
    matches = match_deliverables(columns, files, deliverables).select("file_id", "col_idx", "rue_id", "livrable_id")
    side = stable(columns.join(matches, ["file_id", "col_idx"], "left").select(
        "file_id", "col_idx", "header_row", "champ", "rue_id", "livrable_id"))
    body = _below_header(cells, side)
    # one group per sheet row: its fields, and as many quantities as the sheet has deliverable columns
    number = to_number("value")
    counted = F.when(F.col("livrable_id").isNotNull() & (number != 0), F.struct("rue_id", "livrable_id", number.alias("quantite")))
    rows = body.groupBy("file_id", "row_idx").agg(
        *[F.max(F.when(F.col("champ") == f, F.col("value"))).alias(f) for f in ALIASES["site"]],
        F.collect_list(counted).alias("__counted"),
    )
    refused = missing_fields(columns).select("file_id")
    accepted = rows.filter(has_name("designation")).join(refused, "file_id", "left_anti")
    return accepted.select(
        "file_id", "row_idx", _text("code").alias("code_poste"), _text("designation").alias("designation"),
        _text("unite").alias("unite"), to_number("pu").alias("prix_unitaire"), F.inline("__counted"),
    ).select("file_id", "row_idx", "rue_id", "livrable_id", "code_poste", "designation", "unite", "quantite", "prix_unitaire")


def import_stats(lines: DataFrame) -> DataFrame:
    """Lines imported and deliverables touched, per file."""
    deliverable = F.col("livrable_id") if "livrable_id" in lines.columns else F.lit(None).cast("bigint")
    return lines.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("nb_lignes"), F.countDistinct(deliverable).alias("nb_livrables")
    )


def numbers(cells: DataFrame, target: str = "site") -> DataFrame:
    """Quantity and price cells as numbers, 0 where the text is none."""
    body = _body(cells, layout(cells, target)).filter(F.col("champ").isin("qte", "pu"))
    return body.select("file_id", "row_idx", "champ", to_number("value").alias("nombre"))
