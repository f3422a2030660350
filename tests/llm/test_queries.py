"""Every query on whole tables: against SQL where there is some, on odd tables, and on empty ones."""

from __future__ import annotations

import pytest

import corpus_pipeline
from earthworks.llm import queries
from tests.compare import differences
from tests.llm.conftest import SF_DIR

COLUMNS = {
    "op1_simhash": {"doc_id", "fingerprint", "component_id"},
    "op2_sentencepiece": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op3_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op4_quality_classifier": {"doc_id", "held_out", "score", "predicted"},
    "op5_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op6_nearest": {"query_id", "rank", "vec_id", "score"},
    "op7_secret_scans": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op8_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op9_chat_formatting": {"conv_id", "turn", "role", "text", "rendered"},
    "op10_html_extraction": {"page_id", "url", "text", "n_chars"},
    "op11_fill_middle": {"doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"},
    "op12_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op13_periodic_runs": {
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
}
TABLES = {"op6_nearest": "embeddings", "op9_chat_formatting": "conversations", "op10_html_extraction": "pages"}


def database(folder):
    import duckdb

    con = duckdb.connect()
    tail = "/*.parquet" if folder != SF_DIR else ""
    for name in ("documents", "labels", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet{tail}')")
    return con


@pytest.mark.parametrize("name", list(queries.oracles()))
@pytest.mark.parametrize("where", ["small", "edge"])
def test_equal_to_sql(spark, edge_dir, name, where):
    folder = SF_DIR if where == "small" else edge_dir
    rows, diff = differences(queries.QUERIES[name](spark, folder), database(folder), name)
    assert rows and not diff


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_odd_tables(spark, edge_dir, name):
    df = queries.QUERIES[name](spark, edge_dir)
    assert COLUMNS[name] <= set(df.columns)
    rows = df.collect()
    if name not in ("op6_nearest", "op9_chat_formatting"):
        table = TABLES.get(name, "documents")
        assert len(rows) == spark.read.parquet(f"{edge_dir}/{table}.parquet").count()
    unknown = {"doc_id", "component_id", "page_id", "url", "conv_id", "prefix_chars", "middle_chars", "keep_id",
               "start", "length", "period", "exponent_milli"}
    assert all(r[c] is not None for r in rows for c in COLUMNS[name] - unknown)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", ["op3_quality_rules", "op7_secret_scans"])
def test_native_ones_run_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


def test_pipeline_on_empty_tables(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_language_stage_keeps_mixtures_and_drops_other_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    some = {r.lang: r.text[:1200] for r in docs.where("length(text) > 3000").collect()}
    mixed = " ".join(some[k] for k in sorted(some)[:3])
    strange = "Привет как дела сегодня мы пошли гулять в парк и видели много людей " * 5
    odd = spark.createDataFrame([(10**9, mixed), (10**9 + 1, strange)], "doc_id long, text string")
    whole = docs.unionByName(odd, allowMissingColumns=True)
    kept = {r.doc_id for r in corpus_pipeline.identify(spark, whole, None).collect()}
    lettered = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert kept == lettered | {10**9}


def test_pipeline_stages_on_odd_tables(spark, edge_dir, tmp_path):
    """Each stage against what a loop over its own input gives."""
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    names, before = docs.columns, docs.collect()
    for number, (label, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, edge_dir).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        rows = docs.collect()
        if number < 4:
            assert docs.columns == names
        if label == "language ID":
            assert {r.text for r in rows} <= {r.text for r in before if r.text and any(c.isalpha() for c in r.text)}
            assert len(rows) >= 12 and all(r.lang for r in rows)
        if label == "SimHash near-dedup":
            from earthworks.llm.simhash import fingerprint

            prints = [(fingerprint(r.text), r) for r in rows]
            assert all((a ^ b).bit_count() > 3 for i, (a, _) in enumerate(prints) for b, _ in prints[:i])
            assert all(any((fingerprint(r.text) ^ a).bit_count() <= 3 for a, _ in prints) for r in before)
        if label == "secret scans":
            assert len(rows) == len(before)
            joined = " ".join(r.text for r in rows)
            assert "hunter22" not in joined and "AKIAZ" not in joined and "[SECRET]" in joined and "0f0f" not in joined
            assert all(r.n_chars == len(r.text) for r in rows)
        if label == "mixing sources":
            assert {r.text for r in rows} <= {r.text for r in before} and max(
                sum(x.doc_id == r.doc_id for x in rows) for r in rows) <= 3
        if label == "SentencePiece encoding":
            assert len(rows) == len(before) and all(len(r.ids) == len(r.starts) == len(r.ends) for r in rows)
        before = rows
