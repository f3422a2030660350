"""Run the jobs and their SQL side by side."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import __spark_entry__ as contract  # noqa: E402
from earthworks import registry  # noqa: E402
from earthworks.sources import testdata  # noqa: E402


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in testdata.SOURCES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(rows: list[tuple], order: list[int]) -> list[str]:
    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else repr(v)
        return repr(v)

    return sorted(repr([cell(r[i]) for i in order]) for r in rows)


def differences(df, con, name: str) -> tuple[int, list[str]]:
    """Row count and what differs between both engines; nothing when equal."""
    cur = con.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    theirs = canonical(cur.fetchall(), sorted(range(len(names)), key=lambda i: names[i]))
    ours = canonical([tuple(r) for r in df.collect()], sorted(range(len(df.columns)), key=lambda i: df.columns[i]))
    if sorted(names) != sorted(df.columns):
        return len(ours), [f"columns {sorted(df.columns)} against {sorted(names)}"]
    if len(ours) != len(theirs):
        both = set(ours) & set(theirs)
        extra = [r for r in ours if r not in both][:2] + ["--"] + [r for r in theirs if r not in both][:2]
        return len(ours), [f"{len(ours)} rows against {len(theirs)}", *extra]
    return len(ours), [x for a, b in zip(ours, theirs) if a != b for x in (a, b)][:4]


if __name__ == "__main__":
    from earthworks.session import build

    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    only = sys.argv[2:]
    session = build(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                    spark__driver__memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    connection = database(sf)
    bad = 0
    for key in registry.JOBS:
        if only and key not in only:
            continue
        start = time.time()
        try:
            n, diff = differences(contract.queries()[key](session, sf), connection, key)
        except Exception as error:  # report and go on with the other keys
            n, diff = -1, [f"{type(error).__name__}: {str(error)[:700]}"]
        took = time.time() - start
        if diff:
            bad += 1
            print(f"BAD  {key} rows={n}", *diff, sep="\n     ", flush=True)
        else:
            print(f"ok   {key} rows={n} {took:.1f}s", flush=True)
    print("bad:", bad, "of", len(only or registry.JOBS))
