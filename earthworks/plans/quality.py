"""Constraints and form rules as checks over whole tables.

Each check gives ``table_name, colonne, n``: how many rows break it. A table
is scanned once per check, whatever the number of its columns.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earthworks.functions.columns import blank_to_null
from earthworks.operators.lineage import stable
from earthworks.plans.facts import Frames
from earthworks.sources import catalog

# Texts that must not be blank.
REQUIRED = {
    "dossiers": ["nom"],
    "rues": ["nom"],
    "livrables": ["nom"],
    "devis_rue": ["designation", "unite"],
    "sous_traitants": ["nom"],
    "devis_st": ["designation", "unite"],
    "personnel": ["nom"],
    "approvisionnements": ["designation"],
    "materiaux": ["nom", "unite"],
    "materiels": ["nom"],
}
# Lower and upper bound of numbers; a bound may be open.
RANGES = {
    ("devis_rue", "quantite_marche"): (0, None),
    ("devis_rue", "prix_unitaire"): (0, None),
    ("devis_st", "quantite"): (0, None),
    ("devis_st", "prix_unitaire"): (0, None),
    ("sous_traitants", "montant_contrat"): (0, None),
    ("personnel", "salaire_journalier"): (0, None),
    ("pointage", "heures_travaillees"): (0, 24),
    ("approvisionnements", "quantite_demandee"): (0.01, None),
    ("caisse_chantier", "montant"): (0.01, None),
    ("mouvements_materiaux", "quantite"): (0.01, None),
}


def _counts(tables: Frames, checks: Mapping[tuple[str, str], Column]) -> DataFrame:
    """Rows breaking each check, one aggregation per table."""
    parts = []
    for table in dict.fromkeys(t for t, _ in checks):
        columns = {c: bad for (t, c), bad in checks.items() if t == table}
        counts = tables[table].agg(*[F.count_if(bad).alias(c) for c, bad in columns.items()])
        pairs = [F.struct(F.lit(c).alias("colonne"), F.col(c).alias("n")) for c in columns]
        parts.append(counts.select(F.lit(table).alias("table_name"), F.inline(F.array(*pairs))))
    return reduce(DataFrame.unionAll, parts)


def blank_required(tables: Frames) -> DataFrame:
    return _counts(tables, {(t, c): blank_to_null(c).isNull() for t, cs in REQUIRED.items() for c in cs})


def outside_domain(tables: Frames) -> DataFrame:
    return _counts(tables, {
        (t, c): F.col(c).isNotNull() & ~F.col(c).isin(allowed) for (t, c), allowed in catalog.DOMAINS.items()
    })


def outside_range(tables: Frames) -> DataFrame:
    checks = {}
    for (table, column), (low, high) in RANGES.items():
        bad = F.col(column) < low if low is not None else F.lit(False)
        checks[table, column] = bad | (F.col(column) > high) if high is not None else bad
    return _counts(tables, checks)


def duplicate_names(tables: Frames) -> DataFrame:
    """How many names occur more than once, per table with unique names."""
    parts = []
    for table in catalog.UNIQUE_NAMES:
        seen = tables[table].groupBy("nom").agg(F.count(F.lit(1)).alias("times"))
        parts.append(seen.agg(F.count_if(F.col("times") > 1).alias("n")).select(
            F.lit(table).alias("table_name"), F.lit("nom").alias("colonne"), "n"
        ))
    return reduce(DataFrame.unionAll, parts)


BITMAP_ROW, BITMAP_BYTES = 4096 + 64, 32 << 20


def id_bitmaps(tables: Frames, parents: list[str]) -> DataFrame:
    """``parent``, ``__bucket`` and ``__bits``: which ids each table has."""
    ids = reduce(DataFrame.unionAll, [tables[p].select(F.lit(p).alias("parent"), F.col("id")) for p in parents])
    placed = ids.select("parent", F.bitmap_bucket_number("id").alias("__bucket"), F.bitmap_bit_position("id").alias("__bit"))
    return placed.groupBy("parent", "__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bits"))


def _has_bit(bits: Column, place: Column) -> Column:
    """Whether a bit of a bitmap is set; not in a missing one."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def orphans(tables: Frames) -> DataFrame:
    """Rows whose foreign key has no parent, per key.

    The ids of every parent become bitmaps, a bit for each id, kept in rows of 32,768 bits. While all bitmaps together are
    below ``BITMAP_BYTES`` they are sent to the scans of the children, each read once and without a shuffle of its rows;
    beyond that the children are counted per key value first and meet the bitmaps in one join.
    """
    links = [link for link in catalog.FOREIGN_KEYS if link[0] in tables and link[2] in tables]
    children = []
    for child in dict.fromkeys(t for t, *_ in links):
        pairs = [
            F.struct(F.lit(column).alias("colonne"), F.lit(parent).alias("parent"), F.col(column).alias("id"))
            for table, column, parent, _ in links if table == child
        ]
        values = tables[child].select(F.lit(child).alias("table_name"), F.inline(F.array(*pairs)))
        children.append(values.filter(F.col("id").isNotNull()))
    keys = reduce(DataFrame.unionAll, children)
    bits = stable(id_bitmaps(tables, list(dict.fromkeys(p for *_, p, _ in links))))
    if bits.count() * BITMAP_ROW <= BITMAP_BYTES:
        counts, bits = keys.withColumn("rows", F.lit(1).cast("bigint")), F.broadcast(bits)
    else:
        counts = keys.groupBy("table_name", "colonne", "parent", "id").agg(F.count(F.lit(1)).alias("rows"))
    met = counts.withColumn("__bucket", F.bitmap_bucket_number("id")).join(bits, ["parent", "__bucket"], "left")
    lost = met.filter(~_has_bit(F.col("__bits"), F.bitmap_bit_position("id"))).select("table_name", "colonne", "rows")
    session = keys.sparkSession
    listed = session.createDataFrame([(t, c, 0) for t, c, *_ in links], "table_name string, colonne string, rows bigint")
    return lost.unionByName(listed).groupBy("table_name", "colonne").agg(F.sum("rows").alias("n"))
