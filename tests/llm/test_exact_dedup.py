from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from earthworks.llm import exact_dedup
from tests.llm.conftest import LONG


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(0, 2**48 - 1), unique=True, max_size=300))
def test_codes_come_back(values):
    values = np.array(sorted(values), np.uint64)
    assert np.array_equal(exact_dedup.decode(exact_dedup.encode(values)), values)


def test_codes_are_short():
    """Near the bound for sorted random numbers, log2(range / count) + 1.5 bits each."""
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 20_000).astype(np.uint64))
    assert len(exact_dedup.encode(values)) * 8 / len(values) < np.log2((1 << 40) / len(values)) + 2.5


def brute(rows):
    """Rows as sorted results: in a group the largest id stays once, null below all."""
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""), []).append(i)
    out = []
    for body, ids in groups.items():
        ids.sort(key=lambda i: (i is None, -(i or 0)))
        digest = hashlib.sha256(body.encode()).hexdigest()
        out += [(i, ids[0], len(ids), k == 0, digest) for k, i in enumerate(ids)]
    return sorted(out, key=str)


ROWS = [(1, "A b"), (2, "a B"), (3, "a b "), (3, "a b "), (None, "a b"), (None, None), (None, ""), (7, None), (8, "É"), (9, "é"),
        (-4, "x"), (-5, "X"), (None, "lone"), (20, LONG), (21, LONG.upper()), (22, LONG + "!")]
ROWS += [(100 + k, "hot copy") for k in range(300)] + [(500 + k, f"only {k}") for k in range(200)] + [(50, "two"), (50, "TWO")]


# Eight bits make most fingerprints meet, chunks of three rows split every group; a filter of 64 bits lets nearly all texts pass.
@pytest.mark.parametrize("options", [{}, {"bits": 8, "owners": 3}, {"chunk": 3, "owners": 5}, {"bits": 12, "chunk": 7, "filter_bits": 64},
                                     {"bits": 62, "owners": 1}])
def test_equal_to_a_loop(spark, options):
    df = spark.createDataFrame([(i, t, "z", "z") for i, t in ROWS], "doc_id long, text string, sha string, ids string").repartition(6)
    found = exact_dedup.judged(df, **options).collect()
    assert sorted(((r.id, r.keep_id, r.group_size, r.kept, bytes(r.sha).hex()) for r in found), key=str) == brute(ROWS)


def test_only_suspects_are_shuffled(spark):
    """Texts that no other chunk has do not reach the grouping by bytes."""
    df = spark.createDataFrame([(k, f"text {k % 990}") for k in range(1000)], "doc_id long, text string").repartition(4)
    marked = exact_dedup.suspects(*exact_dedup.classes(df, "doc_id", "text", 4)).cache()
    assert marked.where("suspect").agg({"fp": "count"}).first()[0] <= 20
    groups = exact_dedup.verified(df, marked, "doc_id", "text")
    assert groups.where("group_size = 2").count() == 10 and groups.count() == 10
