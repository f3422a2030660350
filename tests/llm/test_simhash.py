from __future__ import annotations

import re

import numpy as np
import xxhash

from earthworks.llm import queries, simhash
from earthworks.llm.components import components
from tests.llm.conftest import SF_DIR


def brute_print(text):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(ids, prints, radius=3):
    label = list(range(len(ids)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                label[root(a)] = root(b)
    names = {}
    for k, i in enumerate(ids):
        names.setdefault(root(k), []).append(i)
    return [min((i for i in names[root(k)] if i is not None), default=None) for k in range(len(ids))]


def check(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    prints = [brute_print(r.text) for r in docs]
    wanted = sorted(zip((r.doc_id or -1 for r in docs), (f"{p:016x}" for p in prints),
                        (c if c is not None else -1 for c in brute_components([r.doc_id for r in docs], prints)), strict=True))
    found = queries.op1_simhash(spark, folder).collect()
    assert sorted((r.doc_id or -1, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in found) == wanted


def test_equal_to_brute_force(spark):
    check(spark, SF_DIR)


def test_odd_rows_equal_to_brute_force(spark, edge_dir):
    check(spark, edge_dir)


def test_pieces_change_nothing(monkeypatch):
    text = "a bb  ccc \n dddd e " * 50
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.fingerprint(text) == whole == brute_print(text)


def test_hot_shards_lose_no_link(spark):
    """Thousands of prints around one centre, dealt into small parts, connect as all pairs do."""
    rng = np.random.default_rng(5)
    near = {sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(600)}
    far = {int(x) for x in rng.integers(0, 1 << 62, 300)}
    values = sorted(near | far)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(df, leaf=50)).collect()}
    groups = {}
    for v, s in zip(brute_components(list(range(len(values))), values), signed, strict=True):
        groups.setdefault(v, set()).add(roots.get(s, s))
    assert all(len(g) == 1 for g in groups.values())
    assert len(set().union(*groups.values())) == len(groups)


def test_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 1 << 12, 400).astype(np.uint64))
    queries_ = rng.integers(0, 1 << 12, 50).astype(np.uint64)
    found = {(int(values[n]), int(q)) for n, at in simhash.BkTree(values).within(queries_, 2) for q in queries_[at]}
    assert found == {(int(v), int(q)) for v in values for q in queries_ if (int(v) ^ int(q)).bit_count() <= 2}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 200)] + [(500, 501), (501, 501)], "a long, b long")
    found = {r.node: r.root for r in components(links).collect()}
    assert found == {k: 0 for k in range(1, 201)} | {501: 500}
