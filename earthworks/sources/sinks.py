"""Output: named sheets and previews."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from earthworks.sources.labels import with_labels

NO_DATA = "Aucune donnée"
LISTING = "_feuilles"


def export(
    sheets: Mapping[str, DataFrame], directory: str, fmt: str = "parquet", mode: str = "errorifexists",
    labels: bool = False,
) -> list[str]:
    """Write one directory per sheet and give their paths.

    A folder has the full name of its sheet; a sheet without rows gets one row saying so. ``labels`` writes display names as
    column heads. Each sheet is computed once: its rows are counted while they are written. The list of all sheets with
    their rows is written last, so an export without it broke off.
    """
    if mode not in ("errorifexists", "error", "overwrite", "append"):
        raise ValueError(f"unknown mode {mode}")
    written = [(name, f"{directory}/{name}", _write(df, f"{directory}/{name}", fmt, mode, labels)) for name, df in sheets.items()]
    if written:
        session = next(iter(sheets.values())).sparkSession
        listing = session.createDataFrame([(name, rows) for name, _, rows in written], "feuille string, lignes bigint")
        listing.coalesce(1).write.mode(mode).parquet(f"{directory}/{LISTING}")
    return [path for _, path, _ in written]


def _write(df: DataFrame, path: str, fmt: str, mode: str, labels: bool) -> int:
    seen = Observation()
    shown = (with_labels(df) if labels else df).observe(seen, F.count(F.lit(1)).alias("lignes"))
    options = {"header": True} if fmt == "csv" else {}
    shown.write.mode(mode).options(**options).format(fmt).save(path)
    rows = seen.get["lignes"]
    if not rows:
        marker = df.sparkSession.createDataFrame([(NO_DATA,)], "message string")
        marker.coalesce(1).write.mode("append" if mode == "append" else "overwrite").options(**options).format(fmt).save(path)
    return rows


def preview(df: DataFrame, n: int = 20) -> tuple[DataFrame, int]:
    """The first rows and how many there are in all."""
    return df.limit(n), df.count()
