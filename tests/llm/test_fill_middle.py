from __future__ import annotations

import hashlib
import random
import re

import pyarrow as pa
import pytest

from earthworks.llm import fill_middle, queries
from tests.llm.conftest import LONG, SF_DIR

UNIT = re.compile("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(text, numbers):
    text = text or ""
    units = UNIT.findall(text)
    a, b = sorted(h % (len(units) + 1) for h in numbers[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or numbers[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if numbers[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("block", [7, 40, 4 << 20])
def test_core_equals_a_loop(monkeypatch, block):
    """Blocks of any size, so pieces of any size, give what a loop over the units gives."""
    monkeypatch.setattr(fill_middle, "BLOCK", block)
    random.seed(block)
    for _ in range(120):
        texts = ["".join(random.choice("ab é\n\t <P>SM ") for _ in range(random.choice([0, 1, 5, 30, 300])))
                 for _ in range(random.choice([1, 2, 9]))] + [None, ""]
        numbers = [[random.randrange(2**32) for _ in texts] for _ in range(4)]
        found = fill_middle._framed(pa.array(texts, pa.string()), [pa.array(n) for n in numbers], 50, 80)
        rows = list(zip(*[f.to_pylist() for f in found], strict=True))
        for row, text, *draws in zip(rows, texts, *numbers, strict=True):
            assert row == (*brute(text, draws)[:4], brute(text, draws)[4].encode())


def draws_of(doc_id):
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


@pytest.mark.parametrize("where", ["small", "edge"])
def test_query_equals_a_loop(spark, edge_dir, where):
    folder = SF_DIR if where == "small" else edge_dir
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    wanted = []
    for row in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        *figures, output = brute(row.text, draws_of(row.doc_id))
        wanted.append((row.doc_id, *figures, sha(output), sha(row.text or "")))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, queries.op11_fill_middle(spark, folder).collect()), key=key) == sorted(wanted, key=key)


def test_round_trip_of_every_form(spark):
    """Texts with halves of markers and without words come back from each form."""
    texts = ["a <", "<P <S >M> x", "S> P> M>", "  ", "one", "\n two  three \n", LONG, "é <s> x", "<P>kept plain"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts * 40)], "doc_id long, text string")
    for spm_rate in (0, 100):
        found = fill_middle.transformed(df, ["doc_id", "text"], fill_middle.draws(df["doc_id"]), rate=100, spm_rate=spm_rate)
        found = found.withColumn("back", fill_middle.restored(found["output"], found["form"]))
        rows = found.collect()
        assert {r.form for r in rows} == {"plain", "spm" if spm_rate else "psm"}
        assert all(r.back == r.text for r in rows)
        assert all((r.output == r.text) == (r.form == "plain") for r in rows)
