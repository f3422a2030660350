"""Mix sources to target weights: whole epochs of every source, then Efraimidis-Spirakis sampling of the rest.

Each source has a size (its words) and a mixing weight. Targets share a total by weight; none is above ``most`` times its
source's size, and what is cut off goes to the others by weight until none is above. A source is taken in whole epochs as
far as they go; the fraction that remains is a weighted sample without replacement: every document draws the key
``-ln(u) / weight``, an exponential variable scaled by its quality weight, and the smallest keys are taken until their
running size comes nearest to the fraction's budget. ``u`` is a hash of the row, so reruns agree.

Running sizes take no window over a whole source: keys are dealt to buckets by their logarithm, sizes are summed by
(source, bucket) with partial sums, and only the bucket in which the budget ends is sorted inside. A weight only shifts the
logarithm, so the rows of one weight spread over many buckets whether it is 1 or 1e-9.

``repeated`` moves no texts: the draw of a row depends on the row and on where its source's draw ends, so each source's
last place is found on narrow rows and joined to the scan.

Defined results: a null source is a source of its own and comes last; a null or blank text has size 0 and is never needed;
it comes as often as its source's whole epochs, and once more if its key lies before the end of the draw. Rows with equal
keys are ordered by doc_id, null first, then by size; exact duplicates of a row are interchangeable. With no words at all
every target is 0 and nothing is taken. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earthworks.llm.store import kept
from earthworks.llm.words import word_count

MOST_EPOCHS = 3
SEED = 20240229
LEAST_WEIGHT = 1e-9
# -ln(u) lies between 2**-53 and 37, so the logarithm of a key lies between these
LOWEST, HIGHEST = -37.0, 25.0


def letter_share(text: Column) -> Column:
    """A cheap quality weight from 0.1 to 1: the share of a text's characters that are letters."""
    whole = F.coalesce(text, F.lit(""))
    n = F.length(whole)
    letters = n - F.length(F.regexp_replace(whole, r"[\p{L}]+", ""))
    return F.when(n > 0, F.greatest(letters / n, F.lit(0.1))).otherwise(0.1)


def targets(sizes: DataFrame, most: float = MOST_EPOCHS) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target``. The input has ``source`` and ``size``, one row each.

    The level L solves sum(min(weight * L, most * size)) = total: sources in order of the level at which they fill up.
    The windows see one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("_w", ((F.row_number().over(order) - 1) % 3 + 1).cast("double")).withColumn(
        "_cap", F.lit(float(most)) * F.col("size"))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before, rest = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest)
    # this is highest at the first source that does not fill up; all that follow have its level
    fits = F.when(F.col("_cap") / F.col("_w") >= F.col("_level"), F.col("_level"))
    return weighed.withColumn("_level", level).withColumn("_at", F.max(fits).over(whole)).select(
        "source", F.col("size").alias("source_size"),
        F.least("_cap", F.col("_w") * F.coalesce("_at", F.lit(float("inf")))).alias("target"))


def draw_key() -> Column:
    """The exponential key of a row, scaled by its weight; ``u`` is a hash of the row."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", "salt"), 11) + 1) / F.lit(float(2**53 + 1))
    return -F.log(u) / F.greatest("weight", F.lit(LEAST_WEIGHT))


def drawn(docs: DataFrame, buckets: int = 4096) -> DataFrame:
    """How many words of each row the mix takes.

    ``docs`` has ``doc_id``, ``source``, ``size``, ``weight`` and ``salt`` (a long that tells rows apart); the columns
    ``source_size``, ``target``, ``taken`` are added, and ``_times``, how often it takes the row. ``buckets`` sets the grain of the running sizes, not the result.
    """
    step = (F.log("_key") - LOWEST) * (buckets / (HIGHEST - LOWEST))
    bucket = F.greatest(F.least(F.floor(step), F.lit(buckets - 1)), F.lit(0)).cast("int")
    keyed = docs.withColumn("_key", draw_key()).withColumn("_bucket", bucket)
    # a hot source has its rows in thousands of (source, bucket) groups
    sums = kept(keyed.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum")), "buckets")
    aims = targets(sums.groupBy("source").agg(F.sum("_sum").alias("size")))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    grid = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    same = F.col("a.source").eqNullSafe(F.col("g.source"))
    grid = grid.alias("g").join(aims.alias("a"), same).select("g.source", "_bucket", "_sum", "_before", "source_size", "target")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0)
    grid = grid.withColumn("_epochs", epochs).withColumn(
        "_budget", F.greatest(F.col("target") - F.col("_epochs") * F.col("source_size"), F.lit(0.0)))
    place = (F.when(F.col("_before") + F.col("_sum") <= F.col("_budget"), "in")
             .when(F.col("_before") >= F.col("_budget"), "out").otherwise("edge"))
    grid = kept(grid.withColumn("_place", place), "grid")
    match = F.col("d.source").eqNullSafe(F.col("g.source")) & (F.col("d._bucket") == F.col("g._bucket"))
    placed = keyed.alias("d").join(grid.alias("g"), match).select("d.*", "_before", "_epochs", "_budget", "_place",
                                                                 "source_size", "target")
    # only the bucket in which the budget ends needs an order; the others keep any
    group = Window.partitionBy("source", "_bucket").orderBy("_key", F.col("doc_id").asc_nulls_first(), "size", "salt")
    ahead = F.coalesce(F.sum("size").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = placed.where(F.col("_place") == "edge").withColumn(
        "_in", (F.col("_before") + ahead + F.col("size") / 2 <= F.col("_budget")) & (F.col("_budget") > 0))
    rest = placed.where(F.col("_place") != "edge").withColumn("_in", (F.col("_place") == "in") & (F.col("_budget") > 0))
    return edge.unionByName(rest).withColumn(
        "_times", (F.col("_epochs") + F.when(F.col("_in"), 1).otherwise(0)).cast("int")).withColumn(
        "taken", F.col("size") * F.col("_times"))


def _figures(text: str, weight: Column | None) -> list[Column]:
    return [F.col("doc_id"), F.col("source"), word_count(F.col(text)).alias("size"),
            (letter_share(F.col(text)) if weight is None else weight).alias("weight"), F.xxhash64(text).alias("salt")]


def sized(df: DataFrame, text: str = "text", weight: Column | None = None) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``weight`` and ``salt`` of every row."""
    return df.select(*_figures(text, weight))


def mix(df: DataFrame, text: str = "text", weight: Column | None = None) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` of every row."""
    docs = kept(sized(df, text, weight), "sizes")  # narrow; texts are read once
    return drawn(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


def ends(docs: DataFrame) -> DataFrame:
    """Where the draw of each source ends: ``_s`` the source, ``_epochs``, and ``_cut``, the place of the last row it takes.

    If rows that are alike lie at that place and only some of them are taken, ``_some`` is how many, else it is null.
    """
    place = _place().alias("place")
    taken = kept(drawn(docs).select("source", place, "_in", "_epochs"), "drawn")
    # a third of all rows may have one source: partial maxima come before the shuffle
    last = taken.groupBy("source").agg(
        F.max("_epochs").alias("_epochs"), F.max(F.when(F.col("_in"), F.col("place"))).alias("_cut"),
        F.min(F.when(~F.col("_in"), F.col("place"))).alias("_out"))
    last = kept(last.withColumnRenamed("source", "_s"), "ends")
    torn = last.where("_cut = _out").select("_s", "_cut")
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("place") == F.col("_cut"))
    some = taken.where("_in").join(torn, same).groupBy("_s").agg(F.count(F.lit(1)).alias("_some"))
    some = some.withColumnRenamed("_s", "_t")
    return kept(last.join(some, F.col("_s").eqNullSafe(F.col("_t")), "left").select("_s", "_epochs", "_cut", "_some"), "cuts")


def _place() -> Column:
    return F.struct(F.col("_key").alias("k"), F.col("doc_id").alias("d"), F.col("size").alias("n"), F.col("salt").alias("x"))


def repeated(df: DataFrame, text: str = "text", weight: Column | None = None) -> DataFrame:
    """All columns, every row as often as the mix takes it. Rows of size 0 follow their source's whole epochs.

    The scan of the texts meets one row per source; only rows that are alike and lie where a draw ends are numbered.
    """
    cuts = ends(kept(sized(df, text, weight), "sizes"))
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    rows = df.select(whole, *_figures(text, weight)).withColumn("_key", draw_key()).select("row", "source", _place().alias("place"))
    met = rows.join(cuts, F.col("source").eqNullSafe(F.col("_s")))
    torn = (F.col("place") == F.col("_cut")) & F.col("_some").isNotNull()
    clear = met if cuts.where("_some IS NOT NULL").isEmpty() else met.where(~F.coalesce(torn, F.lit(False)))
    taken = clear.withColumn("_n", F.when(F.col("place") <= F.col("_cut"), 1).otherwise(0))
    if clear is not met:
        number = F.row_number().over(Window.partitionBy("source").orderBy(F.lit(0)))
        alike = met.where(torn).withColumn("_n", F.when(number <= F.col("_some"), 1).otherwise(0))
        taken = taken.unionByName(alike)
    times = taken.select("row", (F.col("_epochs") + F.col("_n")).cast("int").alias("times")).where("times > 0")
    return times.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
