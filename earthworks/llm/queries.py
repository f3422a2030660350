"""One query for each operator over its whole table, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earthworks.llm import (
    ann, chat, exact_dedup, fill_middle, html_extract, langid, mixing, periodic_runs, quality_classifier, quality_rules,
    secrets, sentencepiece_codec, simhash,
)
from earthworks.llm.store import table
from earthworks.llm.words import words

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
SQL_FOLDER = Path(__file__).resolve().parent / "sql"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = PIECE_MODEL) -> DataFrame:
    model = sentencepiece_codec.read_model(model_path)
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), model)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _remainder(by: int) -> Column:
    """The checksum of doc_id as text, modulo a number; a null id has the checksum of no bytes."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % by


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    vectors, net = quality_classifier.learn(docs, labels.where(_remainder(5) != 0))
    found = quality_classifier.scored(docs, ["doc_id"], vectors, net)
    return found.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score",
                        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(_remainder(4) != 2))
    return langid.predicted(docs, model, ["doc_id"]).select(
        "doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.report(table(spark, sf_dir, "documents"), ["doc_id"])
    text = secrets.spans_text(F.col("spans"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(text, 256).alias("base_sha256"),
                        text.alias("spans"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    text = chat.transcript(F.col("conv_id"), F.col("role"), F.col("text"))
    lines = talks.select("conv_id", F.col("turn").alias("place"), text.alias("text"))
    return chat.turns(lines, "conv_id", ["place"], model=chat.fitted(talks))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extracted(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.transformed(table(spark, sf_dir, "documents"), ["doc_id"], fill_middle.draws(F.col("doc_id")))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                        F.sha2(back, 256).alias("restored_sha256"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.judged(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs.found(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")), ["doc_id"])
    best = periodic_runs.strongest(F.col("runs"))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(best["length"] * 1000 / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(listed, lambda t: F.concat(t, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def planted(doc_id: Column, text: Column) -> Column:
    """The text whose runs are asked for: in a tenth of the documents the words from some place on repeat."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    cut = words(text)
    n = F.size(cut)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(cut, a + 1, p), times)), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(cut, F.lit(1), a), tail), " ")).otherwise(text)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_quality_rules": op3_quality_rules,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_language_id": op5_language_id,
    "op6_nearest": op6_nearest,
    "op7_secret_scans": op7_secret_scans,
    "op8_mixing": op8_mixing,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_html_extraction": op10_html_extraction,
    "op11_fill_middle": op11_fill_middle,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}


def oracles() -> dict[str, str]:
    return {path.stem: path.read_text() for path in sorted(SQL_FOLDER.glob("*.sql"))}
