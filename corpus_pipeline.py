"""A training corpus from documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the
columns of documents; what a stage decides takes effect in them: rows go, texts are masked, rows repeat as often as the
mix takes them. The last stage returns token ids with their byte spans.

Defined results: null and empty texts are no language and go in the first stage, so later stages see only texts with a
letter; an empty table passes through. Extra columns of documents are carried as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earthworks.llm import langid, mixing, secrets, sentencepiece_codec, simhash
from earthworks.llm.queries import PIECE_MODEL
from earthworks.llm.store import packed, table
from earthworks.operators.lineage import shared_folder

# Log likelihood per n-gram below that of learned languages: clean texts of the test tables reach -4.0, Finnish -5.3, Polish
# -6.4, Russian -8.6.
LEAST_FIT, LEAST_CHARS = -5.0, 50

def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in learned languages stay, one or several; ``lang`` becomes the predicted one.

    Texts without a letter go, and texts that no mixture of learned languages explains; a text of fewer than ``LEAST_CHARS``
    characters is too short to be judged by that.
    """
    found = langid.predicted(packed(docs).select("row", "row.text"), langid.learn(docs), ["row"])
    strange = (F.col("fit") < LEAST_FIT) & (F.length("row.text") >= LEAST_CHARS)
    known = found.where((F.col("lang_pred") != langid.UNKNOWN) & ~strange)
    return known.select(F.col("row").withField("lang", F.col("lang_pred")).alias("row")).select("row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose fingerprints link: three-word shingles, at most three bits apart."""
    return simhash.deduplicated(docs)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mask; ``n_chars`` follows the text."""
    return secrets.masked(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as the mix of sources takes it, up to three times or not at all."""
    return mixing.repeated(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their spans of every document."""
    return sentencepiece_codec.encoded(docs, ["doc_id", "lang", "source"], sentencepiece_codec.read_model(PIECE_MODEL))


STAGES = [
    ("language ID", identify),
    ("SimHash near-dedup", deduplicate),
    ("secret scans", mask),
    ("mixing sources", mix),
    ("SentencePiece encoding", tokenize),
]

# Byte pairs, 64-bit hashes and fitted proportions are beyond SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
