from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from earthworks.llm import periodic_runs, queries
from tests.llm.conftest import LONG, SF_DIR


def brute(words, least=6, times=4):
    """All runs by the definition: for every period the maximal stretches, the smallest period of each first."""
    n, seen, out = len(words), set(), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and (i, j + q) not in seen:
                # a multiple of a smaller period has the same stretch
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def rows_of(found):
    return [tuple(r) for r in found.tolist()]


@settings(deadline=None, max_examples=400)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4))
def test_search_equals_a_loop(texts):
    ids = np.array([w for t in texts for w in t], np.int64)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    wanted, offset = [], 0
    for t in texts:
        wanted += [(a + offset, length, q) for a, length, q in brute(t)]
        offset += len(t)
    found = rows_of(periodic_runs.search(ids, text)) if len(ids) else []
    assert found == sorted(wanted, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(40))
def test_planted_runs(seed):
    """Runs of all periods next to, after and inside each other, in longer texts."""
    random.seed(seed)
    words = []
    while len(words) < 700:
        piece = [random.randrange(random.choice([2, 3, 50])) for _ in range(random.choice([1, 2, 3, 5, 8, 13, 40]))]
        words += (piece * random.randrange(1, 8))[: random.randrange(1, 200)]
        if random.random() < 0.3:
            words = words * random.choice([1, 4])
    assert rows_of(periodic_runs.search(np.array(words), np.zeros(len(words), np.int64))) == brute(words)


def test_range_successor():
    rng = np.random.default_rng(2)
    values = rng.permutation(500)
    tree = periodic_runs.WaveletTree(values)
    low = rng.integers(0, 400, 300)
    high = low + rng.integers(1, 100, 300)
    at = rng.integers(0, 500, 300)
    assert tree.upto(low, high, at).tolist() == [(values[a:b] <= v).sum() for a, b, v in zip(low, high, at, strict=True)]
    k = rng.integers(0, high - low)
    assert tree.smallest(low, high, k).tolist() == [np.sort(values[a:b])[j] for a, b, j in zip(low, high, k, strict=True)]


def wanted_row(doc_id, text):
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_a_loop(spark):
    """Shorter texts of the test tables, with the planted repeats."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect() if len(r.text or "") < 6000]
    found = {r.doc_id: tuple(r) for r in queries.op13_periodic_runs(spark, SF_DIR).collect()}
    assert sum(found[d][1] > 0 for d, _ in docs) > 10
    assert all(found[d] == wanted_row(d, t) for d, t in docs)


def test_odd_texts(spark, edge_dir):
    found = queries.op13_periodic_runs(spark, edge_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{edge_dir}/documents.parquet").collect()}
    short = [r for r in found if len(texts[r.doc_id] or "") < 10_000]
    assert len(short) > 10 and all(tuple(r)[1:] == wanted_row(r.doc_id, texts[r.doc_id])[1:] for r in short if r.doc_id is not None)
    period = len(LONG.split()) // 40_000
    assert [(r.n_runs, r.start, r.length, r.period) for r in found if texts[r.doc_id] == LONG] == [(1, 0, period * 40_000, period)]


def test_blocks_do_not_matter(spark, monkeypatch):
    """Each text alone or all together: the same runs."""
    texts = ["a b " * 5, "x " * 6, None, "a b c", "x y x y x y x y x", " ", "p q r s " * 4 + "p"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = {r.doc_id: (r.runs, r.collapsed) for r in periodic_runs.found(df, ["doc_id"]).collect()}
    assert [[tuple(x) for x in rows[k][0]] for k in range(7)] == [
        [(0, 10, 2)], [(0, 6, 1)], [], [], [(0, 9, 2)], [], [(0, 17, 4)]]
    assert [rows[k][1] for k in range(7)] == ["a b", "x", "", "a b c", "x y", "", "p q r s"]
