from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import functions as F

from earthworks.llm import mixing, queries, secrets
from tests.llm.conftest import SF_DIR

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_spans(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_spans_equal_to_brute_force(spark):
    texts = ["secret: token: abcdefghij", "token=password=abcdefgh", "AKIA" * 9, "x" + "AKIA" + "Q" * 15 + " AKIA" + "Q" * 16,
             "😀é API_KEY = 'Zz/+=._-1' " + "ab" * 12 + " apikey:\"12345\"", "passwd   :   " + "9f" * 30, "tokenTOKEN=abcdef",
             "password=" + "a" * 5 + " password=" + "a" * 6, "f" * 23 + "g" + "f" * 24, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secrets.report(df, ["doc_id"]).select("doc_id", secrets.spans_text(F.col("spans")).alias("s")).collect()
    assert {r.doc_id: r.s for r in found} == {k: brute_spans(t or "") for k, t in enumerate(texts)}


def test_ledger_skips_what_was_scanned(spark):
    df = spark.createDataFrame([(1, "token=abcdef"), (2, "token=abcdef"), (3, "AKIA" + "B" * 16), (4, "plain"), (5, None)],
                               "doc_id long, text string")
    ledger = secrets.Ledger.fresh(spark)
    part = secrets.report(df.where("doc_id < 3"), ["doc_id"], ledger=ledger)
    assert ledger.rows().count() == 1 and [r.n_assign for r in part.collect()] == [1, 1]
    whole = secrets.report(df, ["doc_id"], ledger=ledger)
    assert ledger.rows().count() == 4 and ledger.pairs().count() == 4 * len(secrets.RULES)
    assert {r.doc_id: (r.n_assign, r.n_access) for r in whole.collect()} == {1: (1, 0), 2: (1, 0), 3: (0, 1), 4: (0, 0), 5: (0, 0)}
    # the same table again: no pair is scanned
    _, fresh = secrets.scan(df, ledger=ledger.pairs())
    assert fresh.isEmpty()
    secrets.masked(df, ledger=ledger)
    assert ledger.rows().count() == 4
    # a new rule version: its own pairs only, and its findings count instead of the old ones
    newer = tuple(secrets.Rule(r.kind, r.pattern, r.group, 7 if r.kind == "assign" else r.least, r.hint, 2 if r.kind == "assign" else 1)
                  for r in secrets.RULES)
    _, again = secrets.scan(df, ledger=ledger.pairs(), rules=newer)
    assert {(r.rule, r.version) for r in again.collect()} == {("assign", 2)} and again.count() == 4
    assert sum(r.n_assign for r in secrets.report(df, ["doc_id"], rules=newer, ledger=ledger).collect()) == 0
    assert sum(r.n_assign for r in secrets.report(df, ["doc_id"], ledger=ledger).collect()) == 2


def test_stop_words_in_capitals_and_beside_commas(spark):
    """A text in capitals, or with a sign at every word, gets the verdict of the plain one."""
    from earthworks.llm import quality_rules

    plain = " ".join(f"the word{k} of line{k} and that is it for some{k}" for k in range(12))
    texts = [plain, plain.upper(), " ".join(f"\u201c{w}\u201d," for w in plain.split()), " ".join(f"xq{k} zv{k}" for k in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in quality_rules.judge(df, ["doc_id"]).collect()}
    assert [rows[k].kept for k in range(4)] == [True, True, True, False]
    assert rows[0].stop_ratio == rows[1].stop_ratio == rows[2].stop_ratio > 0.5 and rows[3].stop_ratio == 0


def test_masks_replace_overlapping_spans_once(spark):
    df = spark.createDataFrame([(1, "é token=" + "ab" * 12 + " end"), (2, "clean"), (3, None)], "doc_id long, text string")
    assert [r.text for r in secrets.masked(df).orderBy("doc_id").collect()] == ["é [SECRET] end", "clean", None]


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    out, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def check_mix(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    count = lambda t: len(re.findall("[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += count(r.text)
    aims = brute_targets(sizes)
    rows = mixing.mix(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    taken, largest = defaultdict(int), defaultdict(int)
    assert sorted(r["size"] for r in rows) == sorted(count(r.text) for r in docs)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - aims[r.source]) < 1e-6 * max(aims[r.source], 1)
        assert 0 <= r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        assert r.taken >= r["size"] * int(aims[r.source] / max(sizes[r.source], 1) + 1e-9)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - aims[s]) <= largest[s] for s in sizes)
    key = lambda r: (str(r.doc_id), str(r.source), r["size"], r.taken)
    again = mixing.mix(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_mix_equal_to_brute_force(spark):
    check_mix(spark, SF_DIR)


def test_mix_of_odd_rows(spark, edge_dir):
    check_mix(spark, edge_dir)


def test_targets_stop_at_three_sizes(spark):
    sizes = {"a": 1000, "b": 10, "c": 10, "d": 0, None: 5}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    found = {r.source: r.target for r in mixing.targets(df).collect()}
    assert {k: round(v, 6) for k, v in found.items()} == {k: round(v, 6) for k, v in brute_targets(sizes).items()}


def test_sample_goes_by_weight(spark):
    """Of two kinds of documents of one source, the heavier kind is taken more often."""
    rows = [(k, "s", 10, 1.0 if k % 2 else 0.2, k) for k in range(4000)] + [(9000 + k, "t", 10, 1.0, k) for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, weight double, salt long")
    found = mixing.drawn(df).where("source = 's'").collect()
    heavy = sum(r.taken for r in found if r.doc_id % 2)
    assert heavy > 1.3 * sum(r.taken for r in found if r.doc_id % 2 == 0)


def test_smallest_keys_are_taken(spark):
    """The rows in are, by key, id, size and salt, those before the place at which the budget is nearest."""
    rows = [(k % 90, "abc"[k % 3] if k % 7 else None, k % 13 if k % 5 else 0, [1.0, 0.3, 1e-9][k % 3], k % 50) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, weight double, salt long")
    for buckets in (1, 7, 4096):
        found = mixing.drawn(df, buckets).collect()
        for source in (None, *"abc"):
            mine = [r for r in found if r.source == source]
            mine.sort(key=lambda r: (r["_key"], r.doc_id, r["size"], r.salt))
            epochs = int(mine[0].target / mine[0].source_size + 1e-9)
            budget, before = mine[0].target - epochs * mine[0].source_size, 0
            for r in mine:
                taken = budget > 0 and before + r["size"] / 2 <= budget
                assert r.taken == r["size"] * (epochs + taken)
                before += r["size"]


def test_buckets_stay_small_for_small_weights(spark):
    """Rows of one source and one weight, whatever it is, spread over the buckets."""
    for weight in (1.0, 0.05, 1e-3, 1e-9):
        df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).cast("long").alias("size"),
                                       F.lit(weight).alias("weight"), F.col("id").alias("salt"))
        assert mixing.drawn(df).groupBy("_bucket").count().agg(F.max("count")).first()[0] < 0.012 * 20000


def test_a_source_of_blanks_is_not_taken(spark):
    df = spark.createDataFrame([(1, " ", "b"), (2, "", "b"), (3, None, "b"), (4, "some words", "a")], "doc_id long, text string, source string")
    assert {r.doc_id for r in mixing.repeated(df).collect()} == {4}


def test_copies_at_the_end_of_a_draw(spark):
    """Of rows that are alike only some may be taken; the repeats hold as many as the mix."""
    df = spark.createDataFrame([(1, "w " * 10, "a")] * 40 + [(2, "v " * 20, "b")] * 10 + [(9, "x", "c")], "doc_id long, text string, source string")
    taken = {}
    for r in mixing.mix(df).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken // r["size"]
    times = {}
    for r in mixing.repeated(df).collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times == {k: n for k, n in taken.items() if n} and any(n % 40 for n in (taken[1],)) | any(n % 10 for n in (taken[2],))


def test_only_hinted_texts_are_joined(spark):
    df = spark.createDataFrame([(1, "token=abcdef x"), (2, "no hint"), (3, None), (4, "secret: ab")], "doc_id long, text string")
    assert [r.text for r in secrets.masked(df).orderBy("doc_id").collect()] == ["[SECRET] x", "no hint", None, "secret: ab"]


def test_repeats_follow_the_mix(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    taken = sum(r.taken for r in mixing.mix(docs).collect())
    words = lambda t: len(re.findall("[^\x20\x09-\x0D]+", t or ""))
    assert sum(words(r.text) for r in mixing.repeated(docs).collect()) == taken
    assert queries.op8_mixing(spark, edge_dir).count() == docs.count()
