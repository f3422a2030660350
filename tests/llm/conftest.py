from __future__ import annotations

import numpy as np
import pytest

SF_DIR = "/root/testdata/sf0.001"
LONG = "the river of stones and a cart with " * 40_000
# Names that the operators use for results or inside their work.
CLASHES = ["score", "fp", "salt", "n", "root", "row", "blob", "spans", "size", "target", "taken", "lang_pred", "c", "part",
           "times", "bucket", "id", "_n", "component_id", "weight"]
TEXTS = [
    None, "", "   \n\t ", "one", "One two", "one two three", "ONE TWO THREE", LONG, LONG + "end", "12 34 !!",
    "password = hunter22 and token:'abc' then AKIA" + "Z" * 16 + " and " + "0f" * 13,
    "é" * 5 + " secret: ßßß12345678 " + "a1" * 12, "word " * 60, "der Hund und die Katze im Haus mit dem Ball",
    "le chat et la souris dans une maison avec les amis",
]


def documents(spark, rows):
    shape = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in rows], shape)


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    """Tables with nulls everywhere, empty and very long texts, ties, repeated rows and clashing names."""
    folder = str(tmp_path_factory.mktemp("edge"))
    rows = [(k, t, ["en", "de", "fr", None][k % 4], ["a", "b", None][k % 3], len(t or "")) for k, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (None, "one two three", None, None, None), (None, None, None, None, None)]
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 0, None), (4, None, 1), (None, 1, 1), (99, 0, 0), (7, 1, 0), (12, 0, 0), (12, 0, 0)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    html = ["<article><h1>A title</h1><p>Some words that are the content of this page, and more.</p></article>", None, "",
            "plain words without any tag, enough of them to be content", "<p>" + LONG + "</p>", "<!-- never closed", "<nav>menu</nav>"]
    spark.createDataFrame([(k, None if k == 2 else f"u{k}", h, "x") for k, h in enumerate([*html, html[0]])] + [(None, None, None, None)],
                          "page_id long, url string, html string, text string").write.parquet(f"{folder}/pages.parquet")
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 8)).tolist()
    odd = [None, [0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [1.0, None] * 4, [1.0] * 3]
    data = [(k, v, 0, "x") for k, v in enumerate(vectors)] + [(60 + k, v, None, "x") for k, v in enumerate(odd)]
    data += [(100 + k, vectors[0], 1, "x") for k in range(45)] + [(5, vectors[5], 0, "x"), (None, vectors[1], 0, "x")]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, rep string").write.parquet(f"{folder}/embeddings.parquet")
    talk = [(1, 0, "user", "Hi there"), (1, 1, "assistant", "Hello\nyou"), (1, 1, "assistant", "Hello\nyou"), (2, None, None, None),
            (None, 0, "user", "Who?"), (3, 0, "system", ""), (3, 1, "user", "word " * 5000), (4, 0, "other", "no marker")]
    spark.createDataFrame([(*t, "x") for t in talk], "conv_id long, turn long, role string, text string, part string").write.parquet(
        f"{folder}/conversations.parquet")
    return folder


@pytest.fixture(scope="session")
def empty_dir(spark, edge_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "pages", "embeddings", "conversations"):
        spark.read.parquet(f"{edge_dir}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder
