"""Ordered analytics that stay distributed when one key holds most rows.

Rows are dealt out once by ranges of (key, order): a hot key, or a whole table, then lies in many parts of like size,
whatever its ids look like. Each part is summed, the few sums are added up along the parts of a key, and a window inside
a part does the rest. There is one path for every size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earthworks.operators.lineage import stable

PART = "__part"


def dealt(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with the part they are dealt to; kept, since parts must not change while they are read twice."""
    along = [F.asc_nulls_first(c) for c in (*by, *order)]
    return stable(df.repartitionByRange(*along).withColumn(PART, F.spark_partition_id()))


def _inside(by: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*by, PART).orderBy(*[F.asc_nulls_first(c) for c in order])


def numbered(df: DataFrame, order: str, out: str) -> DataFrame:
    """Rows numbered from 1 along a unique column, missing values first; a number named like the column takes its place.

    Rows are sorted in the part they are dealt to and kept with their place there, so the numbers need no further shuffle:
    a part's first number follows from the sizes of the parts before it, one row a part.
    """
    along = F.asc_nulls_first(order)
    placed = df.repartitionByRange(along).sortWithinPartitions(along).withColumn("__at", F.monotonically_increasing_id())
    rows = stable(placed.drop(order) if out == order else placed)
    part = F.shiftright("__at", 33).cast("int").alias(PART)  # an id of this kind is part * 2^33 + place
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(PART, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    opened = rows.withColumn(PART, part).join(F.broadcast(starts), PART)  # a row a part
    return opened.withColumn(out, F.col("__start") + place + 1).select(*dict.fromkeys([*df.columns, out]))


def total_type(df: DataFrame, value: Column) -> T.DataType:
    """The type of a running total of a value."""
    kind = df.select(F.sum(value).alias("t")).schema["t"].dataType
    return T.DecimalType(38, kind.scale) if isinstance(kind, T.DecimalType) else kind


def running_total(df: DataFrame, value: Column, by: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Running sum of ``value`` per key along ``order``, which is unique in a key; over the whole table without one."""
    rows = dealt(df.withColumn("__v", value.cast(total_type(df, value))), by, order)
    return _summed(rows, by, order, out).select(*df.columns, out)


def _summed(rows: DataFrame, by: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Running sum of the column ``__v`` of dealt rows.

    Only the first key of a part can have begun before it, so there is at most one start a part, and only keys at the ends
    of parts are summed for it. The rows are shuffled once, for the window inside a part.
    """
    kind = rows.schema["__v"].dataType
    sums = _at_ends(rows, by).groupBy(*by, PART).agg(F.sum("__v").alias("__sum"))
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, PART, F.sum("__sum").over(before).cast(kind).alias("__start")).filter("__start IS NOT NULL")
    upto = _inside(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = join_nullsafe(rows, F.broadcast(starts), [*by, PART], "left")
    total = F.coalesce("__start", F.lit(0)) + F.coalesce(F.sum("__v").over(upto), F.lit(0))
    return opened.withColumn(out, total.cast(kind))


def _at_ends(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The dealt rows whose key may lie in several parts: its first column is lowest or highest in a part, or missing."""
    if not by:
        return rows
    ends = rows.groupBy(PART).agg(F.min(by[0]).alias("__low"), F.max(by[0]).alias("__high"))
    values = ends.select(F.explode(F.array("__low", "__high", F.lit(None))).alias(by[0])).distinct()
    return join_nullsafe(rows, F.broadcast(values), by[:1], "left_semi")  # two rows a part


def join_nullsafe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys that may be NULL, keeping the left key columns."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"__r_{k}" for k in keys])


def sequential_runs(df: DataFrame, label: Column, by: str, position: str, out: str) -> DataFrame:
    """Number the runs of equal labels along a position, within each key.

    The label depends on the position, so runs are found on the distinct
    positions of a key, far fewer than the rows, and joined back to the rows.
    """
    places = dealt(df.select(by, position, label.alias("__label")).distinct(), [by], [position])
    last = places.groupBy(by, PART).agg(
        F.max_by("__label", F.struct(F.col(position).isNotNull(), F.col(position))).alias("__last"))
    along = Window.partitionBy(by).orderBy(PART)
    edges = last.select(by, PART, F.lag("__last").over(along).alias("__edge"))
    rows = join_nullsafe(places, edges, [by, PART])
    inside = _inside([by], [position])
    before = F.when(F.row_number().over(inside) == 1, F.col("__edge")).otherwise(F.lag("__label").over(inside))
    fresh = rows.withColumn("__v", F.when(before.eqNullSafe(F.col("__label")), 0).otherwise(1).cast("bigint"))
    numbered = _summed(fresh, [by], [position], out)
    return join_nullsafe(df, numbered.select(by, position, out), [by, position])


def latest(df: DataFrame, date: str, id_column: str, k: int | None) -> DataFrame:
    """Newest first; ``k`` keeps the first rows. Ids settle equal dates."""
    ordered = df.orderBy(F.desc(date), F.desc(id_column))
    return ordered if k is None else ordered.limit(k)


def newest_with_match(
    df: DataFrame, dim: DataFrame, on: str, date: str, k: int | None, month: str | None = None
) -> DataFrame:
    """The newest part of a fact, in which at least ``k`` rows have a known ``on``; the whole fact if there are fewer.

    The fact is walked from its newest end, a longer part at a time, until the part holds ``k`` rows whose key is in the
    dimension. A stored fact is walked by months, whose names come from the folders, so older ones are never read; of any
    other fact the rows per day are counted once, which moves no rows. Equal days stay together, so a cut by (date, id) can
    follow; rows without a date are older than all others.
    """
    if k is None:
        return df
    known = dim.select(F.col("id").alias(on))

    def holds(part: DataFrame) -> bool:
        return part.filter(F.col(on).isNotNull()).select(on).join(known, on, "left_semi").limit(k).count() >= k

    parts = _newest_months(df, month) if month and month in df.columns else _newest_days(df, on, date, k)
    return next((part for part in parts if holds(part)), df)


def _newest_months(df: DataFrame, month: str) -> Iterator[DataFrame]:
    """The newest month of a stored fact, the newest two, four and so on."""
    folders = {m[1] for path in df.inputFiles() if (m := re.search(rf"/{month}=([^/]+)/", path))}
    dated = sorted(m for m in folders if not m.startswith("__"))  # the folder of rows without a month has no name
    back = 1
    while back < len(dated):
        yield df.filter(F.col(month) >= dated[-back])
        back *= 2


def _newest_days(df: DataFrame, on: str, date: str, k: int) -> Iterator[DataFrame]:
    """The newest days with twice ``k`` rows, with four times as many and so on."""
    days = df.filter(F.col(on).isNotNull()).groupBy(F.to_date(date).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    counted = sorted(((r.d, r.n) for r in days.filter("d IS NOT NULL").collect()), reverse=True)  # a row a calendar day
    rows, wanted = 0, 2 * k
    for day, n in counted:
        rows += n
        if rows >= wanted:
            yield df.filter(F.col(date) >= F.lit(day))
            wanted = 4 * rows
