"""Running totals over a stored history that grows: older months come as sums, only the later ones are read.

For every write of a stored table the sums per key and month are kept beside the data. They add up over the writes of a
version, so a change needs the sums of its own files only, and the balance at the start of any month is a sum over few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earthworks.functions.columns import signed
from earthworks.operators.windows import join_nullsafe, running_total, total_type
from earthworks.plans import stock
from earthworks.sources import catalog
from earthworks.sources.tables import MONTH
from earthworks.sources.versions import WRITE, Store


def first_changed(store: Store, table: str, old: int, new: int) -> str | None:
    """The first month in which two versions differ, None if they are alike. Rows without a date count as the first."""
    before, after = set(store.version(old).of(table)), set(store.version(new).of(table))
    months = [p.month or "" for p in before ^ after]
    return min(months) if months else None


def month_sums(store: Store, table: str, label: str, value: Column, by: Sequence[str], version: int | None = None) -> DataFrame:
    """``by``, ``mois`` and ``somme``: the sums of a value per key, month and write, of one version; they add up over the writes.

    ``label`` names value and key; sums of writes that were seen before under it are read, those of others are made.
    """
    parts = store.version(version).of(table)
    folder = f"{store.directory}/soldes/{table}/{label}"
    for write in sorted({p.write for p in parts}):
        if not store.is_written(f"{folder}/{WRITE}={write}"):
            rows = store.of_write(table, write)
            # a write that broke off is made anew
            rows.groupBy(*by, MONTH).agg(F.sum(value).alias("somme")).write.mode("overwrite").parquet(f"{folder}/{WRITE}={write}")
    if not parts:
        return store.read(table, version).groupBy(*by, MONTH).agg(F.sum(value).alias("somme"))
    read = store.spark.read.option("basePath", folder).parquet(*sorted({f"{folder}/{WRITE}={p.write}" for p in parts}))
    held = store.spark.createDataFrame([(p.write, p.month) for p in parts], "__w string, __m string")  # a row a part
    same = (F.col(WRITE).cast("string") == F.col("__w")) & F.col(MONTH).eqNullSafe(F.col("__m"))
    return read.join(F.broadcast(held), same, "left_semi").select(*by, MONTH, "somme")


def running_since(
    store: Store, table: str, since: str, label: str, value: Column, by: Sequence[str], order: Sequence[str], out: str,
    columns: Sequence[str], version: int | None = None,
) -> DataFrame:
    """The rows from a month on, with the running total over the whole history, rows without a date first.

    The months before are not read: each key opens with the sum of its months.
    """
    months = [m for m in store.months(table, version) if (m or "") >= since]
    rows = store.read(table, version, months).select(*columns)
    kind = total_type(rows, value)
    run = running_total(rows, value, by, order, out)
    sums = month_sums(store, table, label, value, by, version).filter(F.coalesce(MONTH, F.lit("")) < since)
    opening = F.coalesce(F.sum("somme"), F.lit(0)).cast(kind)
    if not by:
        return run.withColumn(out, (F.col(out) + sums.agg(opening).scalar()).cast(kind))
    opened = join_nullsafe(run, sums.groupBy(*by).agg(opening.alias("__opening")), by, "left")
    return opened.withColumn(out, (F.col(out) + F.coalesce("__opening", F.lit(0))).cast(kind)).drop("__opening")


def cash_running(store: Store, since: str, per_site: bool, version: int | None = None) -> DataFrame:
    """Cash operations from a month on with the balance after each, to whole units."""
    impact = signed("type_op", "montant", [catalog.INCOME], [catalog.EXPENSE, catalog.ADVANCE])
    by, columns = (["rue_id"] if per_site else []), ["id", "date_op", "rue_id", "type_op", "montant"]
    run = running_since(
        store, "caisse_chantier", since, "site" if per_site else "tout", impact, by, ["date_op", "id"], "solde_cumule",
        columns, version)
    return run.withColumn("solde_cumule", F.round("solde_cumule", 0))


def overdrawn_exits(store: Store, since: str, version: int | None = None) -> DataFrame:
    """Exits from a month on that took more than was in stock at that point of the whole history."""
    impact = signed("type_mvt", "quantite", [catalog.ENTRY], [catalog.EXIT])
    history = running_since(
        store, "mouvements_materiaux", since, "materiau", impact, ["materiau_id"], ["date_mvt", "id"], "__moved",
        ["id", "date_mvt", "materiau_id", "type_mvt", "quantite"], version)
    return stock.overdrawn(history, store.read("materiaux", version))
