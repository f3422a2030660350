"""Input tables, and intermediate tables kept in the folder that all executors share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earthworks.operators.lineage import shared_folder


ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application, unless they have it on their path."""
    context = spark.sparkContext
    on_path = str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if on_path or context.applicationId in _shipped or not ROOT.is_dir():
        return
    _shipped.add(context.applicationId)
    folder = tempfile.mkdtemp()  # the driver's own; Spark hands the file out
    context.addPyFile(shutil.make_archive(f"{folder}/earthworks-code", "zip", ROOT, "earthworks"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it from there.

    Later steps start at these files, so a lost executor costs only the step that it was in.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame) -> DataFrame:
    """All columns as one, ``row``, so that no name of theirs can clash with one of the work's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
