"""Near duplicates by SimHash fingerprints and BK-trees.

A fingerprint bit is set if it is set in over half of the 64-bit hashes of a text's word shingles. Texts link if their
fingerprints differ in at most ``radius`` bits. Equal fingerprints are merged first, so the search sees distinct ones.

The search splits fingerprints into shards: of ``blocks`` groups of bits, two linked fingerprints agree in at least
``blocks - radius``, and every choice of that many groups keys one shard. Each shard has a BK-tree, in which a node's
children hang by their Hamming distance to it; a search follows only edges within the radius of the distance that it
measured. A shard of over ``leaf`` members is dealt into parts by hash, and every pair of parts is a task of its own: the
tree of one, searched with all of the other. So memory is bounded, no task holds a hot group, and no link is lost. Trees
travel with the shuffle to the task that holds their queries; a broadcast of all trees would send the fingerprints of all
documents through the driver. A task returns the links of a spanning forest, not all pairs.

Defined results: null, empty and blank texts have fingerprint zero and link like any other. Texts with fewer words than a
shingle are one shingle of all their words. Repeated rows each get a result. Ties do not arise: a component is named by
its smallest id, null ids are passed over, and only a component without any id has a null name. Long texts are hashed in
pieces, whole. Empty tables give empty results. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earthworks.llm.components import components
from earthworks.llm.store import kept, packed
from earthworks.llm.words import pieces

RADIUS = 3
SHINGLE = 3
BLOCKS = 5
LEAF = 4096
PIECE = 1 << 18


def _bit_counts(words: list[bytes], shingle: int, seed: int) -> np.ndarray:
    """How many of the words' shingles have each hash bit set."""
    digest = xxhash.xxh64_intdigest
    grams = zip(*(words[k:] for k in range(shingle)), strict=False)
    hashes = np.fromiter((digest(b" ".join(g), seed) for g in grams), "<u8", len(words) - shingle + 1)
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of one text. bytes.lower() changes A-Z only, bytes.split() cuts at ASCII white space."""
    counts, total, words = np.zeros(64, np.int64), 0, []
    for piece in pieces((text or "").encode("utf-8", "surrogatepass").lower(), PIECE):
        words = (words[len(words) - shingle + 1 :] if total else words) + piece.split()
        if len(words) >= shingle:
            counts += _bit_counts(words, shingle, seed)
            total += len(words) - shingle + 1
    if not total and words:
        counts, total = _bit_counts([b" ".join(words)], 1, seed), 1
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(text: Column, shingle: int = SHINGLE, seed: int = 42) -> Column:
    """The fingerprint as a signed long with the same bits."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        out = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in texts), np.uint64, len(texts))
        return pa.array(out.view(np.int64))

    return of(text)


class BkTree:
    """Distinct 64-bit values; each node's children are keyed by their Hamming distance to it."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in range(len(values))]
        plain = values.tolist()
        for new in range(1, len(plain)):
            node = 0
            while True:
                gap = (plain[new] ^ plain[node]).bit_count()
                after = self.children[node].setdefault(gap, new)
                if after == new:
                    break
                node = after

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each node that has queries within the radius, with their places.

        All queries walk together; those at a node go on along an edge only if their distance is within the radius of it.
        """
        todo = [(0, np.arange(len(queries)))] if len(self.values) and len(queries) else []
        while todo:
            node, at = todo.pop()
            gaps = np.bitwise_count(queries[at] ^ self.values[node]).astype(np.int64)
            if (near := at[gaps <= radius]).size:
                yield node, near
            for edge, child in self.children[node].items():
                if (on := at[np.abs(gaps - edge) <= radius]).size:
                    todo.append((child, on))


def forest(tree: np.ndarray, queries: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components among a tree's values and the queries (the values themselves if None)."""
    everything = tree if queries is None else np.concatenate([tree, queries])
    offset, label = (0 if queries is None else len(tree)), np.arange(len(everything))
    for node, near in BkTree(tree).within(tree if queries is None else queries, radius):
        meet = np.unique(np.append(label[near + offset], label[node]))
        if meet.size > 1:
            label[np.isin(label, meet)] = meet[0]
    moved = np.flatnonzero(label != np.arange(len(label)))
    return everything[moved], everything[label[moved]]


def _masks(blocks: int, radius: int) -> list[int]:
    """One bit mask for each choice of ``blocks - radius`` groups of bits, as signed longs."""
    if blocks <= radius:
        raise ValueError("there must be more blocks than bits in the radius")
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    groups = [sum(1 << bit for bit in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    unsigned = [sum(chosen) for chosen in combinations(groups, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in unsigned]


def links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, leaf: int = LEAF) -> DataFrame:
    """Links ``a``, ``b`` that connect all distinct fingerprints (column ``fp``) within the radius of each other."""
    keys = F.array(*[F.struct(F.lit(k).alias("m"), F.col("fp").bitwiseAND(F.lit(mask)).alias("k"))
                     for k, mask in enumerate(_masks(blocks, radius))])
    keyed = prints.select("fp", F.explode(keys).alias("s")).select("fp", "s.m", "s.k")
    heavy = keyed.groupBy("m", "k").count().where(F.col("count") > leaf)
    heavy = kept(heavy.select("m", "k", F.ceil(F.col("count") / leaf).cast("int").alias("parts")), "heavy")
    parts = F.coalesce("parts", F.lit(1))
    dealt = keyed.join(heavy, ["m", "k"], "left").select(
        "fp", "m", "k", F.pmod(F.xxhash64("fp"), parts).cast("int").alias("own"),
        F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    shards = dealt.groupBy("m", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(
        F.collect_list(F.when(F.col("own") <= F.col("other"), F.col("fp"))).alias("tree"),
        F.collect_list(F.when(F.col("own") > F.col("other"), F.col("fp"))).alias("queries"))
    shards = shards.where((F.size("tree") > 0) & (F.size("tree") + F.size("queries") > 1))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, j, tree, queries in zip(*batch.columns, strict=True):
                # members of one part meet as a tree of their own, those of two parts as tree and queries
                other = None if i.as_py() == j.as_py() else queries.values.to_numpy().view(np.uint64)
                found.append(forest(tree.values.to_numpy().view(np.uint64), other, radius))
            if found:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
                yield pa.record_batch({"a": a, "b": b})

    return shards.select("i", "j", "tree", "queries").mapInArrow(search, "a long, b long")


def near_duplicates(
    df: DataFrame, text: str = "text", radius: int = RADIUS, blocks: int = BLOCKS, leaf: int = LEAF,
) -> DataFrame:
    """``doc_id``, ``fp``, ``salt`` (a hash of the text) and ``component_id`` of every row."""
    rows = kept(df.select("doc_id", fingerprints(F.col(text)).alias("fp"), F.xxhash64(text).alias("salt")), "prints")
    prints = kept(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-prints")
    return named(rows, prints, links(prints.select("fp"), radius, blocks, leaf))


def named(rows: DataFrame, prints: DataFrame, linked: DataFrame) -> DataFrame:
    """Rows with the component of their ``fp``; ``prints`` has each ``fp`` with the ``first`` of its ids."""
    roots = components(linked)
    member = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = member.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = kept(member.join(names, "root").select("fp", "component_id", "root"), "classes")
    return rows.join(classes, "fp").select("doc_id", "fp", "salt", "component_id", "root")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicated(df: DataFrame, text: str = "text", **options: int) -> DataFrame:
    """One row of each component with all its columns: the smallest id, among its texts the one with the smallest hash."""
    return one_of_each(df, near_duplicates(df, text, **options), text)


def one_of_each(df: DataFrame, rows: DataFrame, text: str = "text") -> DataFrame:
    """One row of each component of ``rows``, which has the ``doc_id``, ``salt`` and ``root`` of all rows."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "salt")
    stay = kept(rows.groupBy("root").agg(F.min(order).alias("o")).select("o.*"), "stay")
    key = ["none", "id", "salt"]  # never null, so that join and window share one shuffle of the rows
    whole = packed(df).select("row", F.col("row.doc_id").isNull().alias("none"), F.coalesce("row.doc_id", F.lit(0)).alias("id"),
                              F.xxhash64(f"row.{text}").alias("salt"))
    # rows with the same id and text meet here, nothing else does; the one with the smallest hash of all its columns stays
    once = Window.partitionBy(*key).orderBy(F.xxhash64("row"))
    return whole.join(stay, key).withColumn("n", F.row_number().over(once)).where("n = 1").select("row.*")
