"""Changes to whole tables: each takes a base and changes and gives a new table.

The month a stored fact is laid out by is not part of the table and is left out.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earthworks.operators.lineage import stable, together
from earthworks.operators.windows import numbered
from earthworks.sources import catalog
from earthworks.sources.tables import MONTH, with_defaults


def number_rows(df: DataFrame, order: str, out: str) -> DataFrame:
    """Number rows from 1 in the order of a unique column, without a one-task window."""
    return numbered(df, order, out)


def append_rows(
    base: DataFrame, new: DataFrame, table: str, order: str, keep_base: bool = True
) -> DataFrame:
    """Append rows with the defaults of the table and ids after the highest one.

    ``order`` is a unique column of the new rows that decides their numbers.
    """
    base = base.drop(MONTH)
    highest = base.agg(F.coalesce(F.max("id"), F.lit(-1))).scalar()
    numbered = number_rows(new, order, "__n").withColumn("id", highest + F.col("__n"))
    full = with_defaults(numbered, table)
    return base.unionByName(full.select(base.columns)) if keep_base else full


def newest_per_key(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The row of highest order per key, found with a combining aggregate."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__row"))
    return best.select(*key, "__row.*").select(df.columns)


def upsert_rows(base: DataFrame, changes: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Replace the base rows of every changed key and add the new keys; the change of highest order counts."""
    base = base.drop(MONTH)
    changes = newest_per_key(changes, key, order)
    return without(base, changes, key).unionByName(changes.select(base.columns))


def insert_ignore(base: DataFrame, new: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Add the rows whose key is not there yet; the lowest order wins among equals."""
    base = base.drop(MONTH)
    first = newest_per_key(new.withColumn("__o", -F.col(order)), key, "__o").drop("__o")
    return base.unionByName(without(first, base, key).select(base.columns))


def update_rows(
    base: DataFrame, changes: DataFrame, columns: Sequence[str], key: str = "id", order: str | None = None
) -> DataFrame:
    """Set the given columns from the change with the same key; other rows stay.

    A change sets what it holds, NULL included. Of several changes of a key the one of highest ``order`` counts; without
    an order the greatest values do, compared column by column.
    """
    ranked = changes.withColumn("__order", F.col(order) if order else F.struct(*columns))
    side = newest_per_key(ranked.filter(F.col(key).isNotNull()).select(key, *columns, "__order"), [key], "__order")
    side = side.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = base.join(side, base[key] == side["__key"], "left")
    hit = F.col("__key").isNotNull()
    return joined.select(*[
        F.when(hit, F.col(f"__{c}").cast(base.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        if c in columns else F.col(c)
        for c in base.columns
    ])


def _same_key(base: DataFrame, side: DataFrame, key: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [base[k].eqNullSafe(side[f"__{k}"]) for k in key])


def without(base: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    """Base rows whose key does not occur in ``gone``; NULL keys are compared too."""
    side = gone.select(*[F.col(k).alias(f"__{k}") for k in key])
    return base.join(side, _same_key(base, side, key), "left_anti")


def with_key(base: DataFrame, wanted: DataFrame, key: Sequence[str]) -> DataFrame:
    """Base rows whose key occurs in ``wanted``; NULL keys are compared too."""
    side = wanted.select(*[F.col(k).alias(f"__{k}") for k in key])
    return base.join(side, _same_key(base, side, key), "left_semi")


def replace_slice(base: DataFrame, new: DataFrame, key: Sequence[str], slices: DataFrame | None = None) -> DataFrame:
    """Delete slices, then add the new rows.

    ``slices`` names the slices by their key, also those that get no new row; by default they are those of the new rows.
    """
    base = base.drop(MONTH)
    named = (new if slices is None else slices).select(*key).distinct()
    return without(base, named, key).unionByName(new.select(base.columns))


# How a site takes its records with it: child, column, parent, what happens.
# Plant outlives a site and is only unassigned.
DETACH = {("materiels", "rue_id_affectation")}


def cascade_delete(tables: Mapping[str, DataFrame], site_ids: DataFrame) -> dict[str, DataFrame]:
    """Every table after deleting sites, along the foreign keys from the sites.

    Children go with their parent, except columns that are set to NULL. The ids
    that go are kept once per table with children, all reasons together.
    ``site_ids`` holds one column ``id``.
    """
    gone = cascade_ids(tables, site_ids)
    return {table: cascade_rest(table, tables[table], gone) for table in cascade_order(tables)}


def cascade_order(tables: Mapping[str, DataFrame]) -> list[str]:
    """The sites and all tables below them that there are, parents first."""
    return [t for t in ["rues", *_children_after_parents("rues")] if t in tables]


def _links(table: str, gone: Mapping[str, DataFrame]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Columns (with their parent) by which rows go, and those that are set to NULL."""
    links = [(c, p, rule) for t, c, p, rule in catalog.FOREIGN_KEYS if t == table and p in gone]
    freed = [(c, p) for c, p, rule in links if rule == "set null" or (table, c) in DETACH]
    return [(c, p) for c, p, _ in links if (c, p) not in freed], freed


def cascade_ids(tables: Mapping[str, DataFrame], site_ids: DataFrame) -> dict[str, DataFrame]:
    """The ids that go, of every table that others hang on."""
    gone = {"rues": stable(site_ids)}
    parents = {p for _, _, p, _ in catalog.FOREIGN_KEYS}
    waiting = [t for t in cascade_order(tables)[1:] if t in parents]

    def ids_of(table: str) -> DataFrame | None:
        doomed = [_linked(tables[table], c, gone[p]).select("id") for c, p in _links(table, gone)[0]]
        return stable(reduce(DataFrame.union, doomed).distinct()) if doomed else None

    while waiting:
        # tables none of whose parents is still to come, at the same time
        ready = [t for t in waiting if not any(p in waiting and p != t for own, _, p, _ in catalog.FOREIGN_KEYS if own == t)]
        for table, ids in zip(ready, together(ids_of, ready), strict=True):
            if ids is not None:
                gone[table] = ids
        waiting = [t for t in waiting if t not in ready]
    return gone


def _linked(df: DataFrame, column: str, gone: DataFrame, how: str = "left_semi") -> DataFrame:
    ids = gone.select(F.col("id").alias("__gone"))
    return df.join(ids, df[column] == ids["__gone"], how)


def cascade_rest(table: str, df: DataFrame, gone: Mapping[str, DataFrame]) -> DataFrame:
    """What is left of a table, or of some of its rows, when the ids of ``cascade_ids`` go."""
    taken, freed = _links(table, gone)
    if table in gone:
        kept = without(df, gone[table], ["id"])
    else:
        kept = reduce(lambda rows, link: _linked(rows, link[0], gone[link[1]], "left_anti"), taken, df)
    return reduce(lambda rows, link: _set_null(rows, link[0], gone[link[1]]), freed, kept)


def cascade_hit(table: str, df: DataFrame, gone: Mapping[str, DataFrame]) -> DataFrame:
    """The rows of a table that go or change, some of them several times."""
    taken, freed = _links(table, gone)
    hit = [_linked(df, c, gone[p]) for c, p in (*taken, *freed)]
    if table in gone:
        hit.append(with_key(df, gone[table], ["id"]))
    return reduce(DataFrame.union, hit, df.filter(F.lit(False)))


def _set_null(df: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    side = gone.select(F.col("id").alias("__gone")).distinct()
    joined = df.join(side, df[column] == side["__gone"], "left")
    value = F.when(F.col("__gone").isNull(), F.col(column))
    return joined.withColumn(column, value).drop("__gone")


def _children_after_parents(root: str) -> list[str]:
    """Tables below ``root``, each after all its parents that are below it too."""
    reached, grown = {root}, True
    while grown:
        found = {t for t, _, p, _ in catalog.FOREIGN_KEYS if p in reached} - reached
        reached |= found
        grown = bool(found)
    order: list[str] = []
    left = [t for t in catalog.table_names() if t in reached and t != root]
    while left:
        ready = [
            t for t in left
            if all(p == root or p in order or p not in reached for c, _, p, _ in catalog.FOREIGN_KEYS if c == t)
        ]
        order += ready
        left = [t for t in left if t not in ready]
    return order


def audit_diff(base: DataFrame, new: DataFrame, table: str, at: dt.datetime) -> DataFrame:
    """One audit row per changed id; an update lists the columns that changed."""
    fields = [c for c in base.columns if c not in ("id", MONTH)]
    old = base.select("id", F.struct(*fields).alias("__old"))
    now = new.select("id", F.struct(*fields).alias("__new"))
    both = old.join(now, "id", "full_outer")
    changed = [F.when(~F.col(f"__old.{c}").eqNullSafe(F.col(f"__new.{c}")), F.lit(c)) for c in fields]
    action = (
        F.when(F.col("__old").isNull(), "CREATE").when(F.col("__new").isNull(), "DELETE").otherwise("UPDATE")
    )
    details = F.when(action == "UPDATE", F.concat_ws(",", *changed)).otherwise("")
    rows = both.select(
        F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz").alias("timestamp"), F.lit(table).alias("table_name"),
        action.alias("action"), F.col("id").alias("record_id"), details.alias("details"),
    )
    return rows.filter((F.col("action") != "UPDATE") | (F.col("details") != ""))
