"""Results that several later steps read, kept in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def stable(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder and read it from there.

    It survives the loss of executors, and what built it is not run again.
    """
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(work: Callable[[Any], Any], items: Iterable[Any]) -> list[Any]:
    """Several small Spark jobs at a time; the first failure is raised."""
    with ThreadPoolExecutor(4) as pool:
        return list(pool.map(work, items))


def shared_folder(spark: SparkSession) -> str:
    """The folder for kept results that the session names; else one below its warehouse, which executors share too."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_kept").rstrip("/")
