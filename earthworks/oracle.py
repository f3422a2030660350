"""SQL texts for DuckDB that compute what the jobs compute, over the same files."""

from __future__ import annotations

import re
from functools import cache
from pathlib import Path

from earthworks.sources import testdata

FOLDER = Path(__file__).resolve().parent.parent / "oracle"
_CASTS = {
    "s": "CAST({c} AS VARCHAR)",
    "i": "CAST({c} AS BIGINT)",
    "d": "CAST({c} AS DOUBLE)",
    "b": "CAST({c} AS BOOLEAN)",
    "t": "CAST({c} AS VARCHAR)",
    "ts": "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')",
}


@cache
def texts() -> dict[str, tuple[dict[str, str], str]]:
    """Output columns with their kind, and the query, of every name."""
    found = {}
    for path in sorted(FOLDER.glob("*.sql")):
        for part in path.read_text(encoding="utf-8").split("-- name: ")[1:]:
            name, columns, body = part.split("\n", 2)
            listed = columns.removeprefix("-- columns: ").split()
            kinds = dict(c.split(":") for c in listed)
            found[name.strip()] = (kinds, body.strip())
    return found


def query(name: str) -> str:
    """One statement: the domain tables it reads, then the query in plain types."""
    kinds, body = texts()[name]
    views = []
    for table in [*testdata.DERIVED, testdata.RAW_CELLS]:
        if re.search(rf"\b{table}\b", body):
            text = testdata.select_text(table, duckdb=True)
            views.append(f"{table} AS ({_unbraced(text)})")
    listed = ", ".join(f"{_CASTS[kind].format(c=c)} AS {c}" for c, kind in kinds.items())
    head = f"WITH {', '.join(views)} " if views else ""
    return f"{head}SELECT {listed} FROM ({body}) AS q"


def _unbraced(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)
