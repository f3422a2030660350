from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from earthworks.session import build  # noqa: E402
from earthworks.sources import testdata  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = build(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="4g",
        spark__checkpoint__dir=f"file://{shared}/kept", spark__sql__warehouse__dir=f"file://{shared}/warehouse",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    return testdata.tables(spark, SF_DIR)


@pytest.fixture
def make(spark):
    """Frame of a domain table from a few given columns; the rest take their defaults."""
    from earthworks.sources import catalog
    from earthworks.sources.tables import with_defaults

    def build_frame(table: str, rows: list[dict]):
        kinds = {c.name: c.type for c in catalog.columns(table)}
        names = sorted({k for r in rows for k in r}, key=list(kinds).index)
        from pyspark.sql import types as T
        from decimal import Decimal

        def cell(name, value):
            decimal = isinstance(kinds[name], T.DecimalType)
            return Decimal(str(value)) if decimal and value is not None else value

        schema = T.StructType([T.StructField(n, kinds[n]) for n in names])
        data = [tuple(cell(n, r.get(n)) for n in names) for r in rows]
        return with_defaults(spark.createDataFrame(data, schema), table)

    return build_frame
