"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Texts are equal if they are the same bytes after A-Z became a-z. No text is shuffled to find out which could be equal:

1. A scan takes the SHA-256 of every text and deals its rows to chunks of at most ``chunk`` rows. Equal digests of a chunk
   become one class with all its ids. The first ``bits`` bits of the digest are the fingerprint; the range of fingerprints
   is split among ``owners``. Each chunk sends every owner its distinct fingerprints, sorted, as Golomb-coded gaps: some
   twenty to forty bits instead of the digest, and one entry however many copies the chunk has.
2. An owner finds the fingerprints that came from several chunks and answers each chunk with a bitmap, one bit for each
   fingerprint in the order in which it was sent.
3. A class is suspect if its bit is set or it has several rows itself. A second scan of the texts passes on the suspect
   ones only, chosen by a bitmap over hashed fingerprints of fixed size (``filter_bits``, 8 MB by default, so it can be
   broadcast at any size of input; a full one lets more texts pass and changes no result). They are grouped by their bytes,
   counted in each task before the shuffle.
4. Suspect classes take count and largest id from the group of their text; all others are alone.

No step has a task per group of copies: a hot text is one entry per chunk, one partial count per task, and one class per
chunk in the last join. A task holds one chunk, or the coded fingerprints of one owner; raise ``owners`` (the number of
shuffle partitions by default) as the data grows.

Defined results: null counts as empty. Of equal texts the row with the largest id stays; null ids are lower than all
others. If that id occurs several times one of its rows stays, in the chunk of the highest number. Each row of the input
gets one row. An empty table gives an empty result. Only the id and the text are read, so other columns can have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earthworks.llm.store import kept

BITS = 48
CHUNK = 1 << 16
FILTER_BITS = 1 << 26
SECTOR = 1 << 15  # bits of one bitmap of Spark's bitmap functions
CLASSES = "chunk long, owner int, rank int, fp long, sha binary, ids array<long>, sure boolean"
SENT = "chunk long, owner int, codes binary"


def encode(values: np.ndarray) -> bytes:
    """Sorted distinct numbers as Golomb-coded gaps; the divisor is a power of two near the mean gap.

    The head holds how many there are and the bits of a remainder; then come all remainders, then all quotients in unary.
    """
    if not len(values):
        return np.zeros(2, "<u4").tobytes()
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    width = max(int(gaps.mean()).bit_length() - 1, 0)
    quotients = (gaps >> np.uint64(width)).astype(np.int64)
    places = np.arange(width, dtype=np.uint64)
    low = np.packbits((gaps[:, None] >> places & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
    stops = np.cumsum(quotients + 1) - 1
    unary = np.zeros(stops[-1] + 1, np.uint8)
    unary[stops] = 1
    head = np.array([len(values), width], "<u4")
    return head.tobytes() + low.tobytes() + np.packbits(unary, bitorder="little").tobytes()


def decode(codes: bytes) -> np.ndarray:
    n, width = np.frombuffer(codes, "<u4", 2).tolist()
    if not n:
        return np.zeros(0, np.uint64)
    body = np.frombuffer(codes, np.uint8, offset=8)
    cut = -(-n * width // 8)
    low = np.unpackbits(body[:cut], bitorder="little", count=n * width).reshape(n, width).astype(np.uint64)
    remainders = (low << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    stops = np.flatnonzero(np.unpackbits(body[cut:], bitorder="little"))[:n]
    quotients = np.diff(stops, prepend=-1) - 1
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(width)) + remainders, dtype=np.uint64)


def _normal(text: pa.Scalar) -> bytes:
    """The bytes of a text with A-Z as a-z (bytes.lower() changes no others)."""
    buffer = text.as_buffer()
    return buffer.to_pybytes().lower() if buffer else b""


def _fingerprint(sha: bytes, bits: int) -> int:
    return int.from_bytes(sha[:8], "big") >> (64 - bits)


def _chunk_rows(number: int, found: dict[bytes, list[int | None]], owners: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The classes of a chunk, and what it sends to the owners."""
    shas = list(found)
    fps = np.array([_fingerprint(s, bits) for s in shas], np.uint64)
    values, which, times = np.unique(fps, return_inverse=True, return_counts=True)
    span = -(-(1 << bits) // owners)
    owner = (values // np.uint64(span)).astype(np.int32)
    used, first = np.unique(owner, return_index=True)
    rank = np.arange(len(values)) - np.repeat(first, np.diff(np.append(first, len(values))))
    # the largest id comes first, null last
    ids = [sorted(found[s], key=lambda i: (i is None, -(i or 0))) for s in shas]
    yield pa.RecordBatch.from_arrays([
        pa.array(np.full(len(shas), number)), pa.array(owner[which]), pa.array(rank[which].astype(np.int32)),
        pa.array(fps.astype(np.int64)), pa.array(shas, pa.binary()), pa.array(ids, pa.list_(pa.int64())),
        pa.array([len(i) > 1 or bool(t > 1) for i, t in zip(ids, times[which], strict=True)]),
        pa.nulls(len(shas), pa.binary())], names=_names())
    codes = [encode(part - np.uint64(int(o) * span)) for o, part in zip(used, np.split(values, first[1:]), strict=True)]
    empty = [pa.nulls(len(used), kind) for kind in (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.bool_())]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(used), number)), pa.array(used), *empty, pa.array(codes, pa.binary())], names=_names())


def _names() -> list[str]:
    return [part.split()[0] for part in CLASSES.split(", ")] + ["codes"]


def classes(df: DataFrame, key: str, text: str, owners: int, bits: int = BITS, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The classes of all chunks, and the coded fingerprints that the chunks send."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, found, held = TaskContext.get().partitionId() << 32, {}, 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found.setdefault(hashlib.sha256(_normal(t)).digest(), []).append(i)
                held += 1
                if held == chunk:
                    yield from _chunk_rows(number, found, owners, bits)
                    number, found, held = number + 1, {}, 0
        if found:
            yield from _chunk_rows(number, found, owners, bits)

    made = kept(df.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`").cast("string")).mapInArrow(
        read, f"{CLASSES}, codes binary"), "exact-classes")
    sent = made.where(F.col("codes").isNotNull()).select("chunk", "owner", "codes")
    return made.where(F.col("codes").isNull()).drop("codes"), sent


def bitmaps(sent: DataFrame) -> DataFrame:
    """``chunk``, ``owner``, ``hits``: a bit for each fingerprint that the owner also has from another chunk."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = [decode(c.as_py()) for c in table["codes"]]
        values, times = np.unique(np.concatenate(lists), return_counts=True)
        shared = values[times > 1]
        hits = [np.isin(v, shared, assume_unique=True) for v in lists]
        some = pa.array([bool(h.any()) for h in hits])
        out = [np.packbits(h, bitorder="little").tobytes() for h in hits]
        return pa.table({"chunk": table["chunk"], "owner": table["owner"], "hits": pa.array(out, pa.binary())}).filter(some)

    return sent.groupBy("owner").applyInArrow(compare, "chunk long, owner int, hits binary")


def _bit(hits: Column, rank: Column) -> Column:
    byte = F.conv(F.hex(F.substring(hits, F.floor(rank / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, rank % 8).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def suspects(made: DataFrame, sent: DataFrame) -> DataFrame:
    """The classes with ``suspect``: whether another row of the table has, or may have, the same text."""
    met = made.join(bitmaps(sent), ["chunk", "owner"], "left")
    return met.select("chunk", "fp", "sha", "ids", (F.col("sure") | _bit(F.col("hits"), F.col("rank"))).alias("suspect"))


def _filter(fps: DataFrame, size: int) -> np.ndarray:
    """A bitmap of ``size`` bits with those of all fingerprints set, built by Spark in sectors of fixed size."""
    at = F.pmod("fp", F.lit(size)) + 1
    places = fps.select(F.bitmap_bucket_number(at).alias("k"), F.bitmap_bit_position(at).alias("p"))
    # places are dealt out before they become bitmaps, which are much longer
    sectors = places.repartition("k").groupBy("k").agg(F.bitmap_construct_agg("p").alias("b"))
    out = np.zeros((-(-size // SECTOR), SECTOR // 8), np.uint8)
    for row in sectors.collect():  # at most size / SECTOR rows of 4 KB
        out[row.k - 1] = np.frombuffer(row.b, np.uint8)
    return out.ravel()


def verified(df: DataFrame, marked: DataFrame, key: str, text: str, bits: int = BITS, size: int = FILTER_BITS) -> DataFrame:
    """``sha`` and ``group_size`` of each text among the suspects: rows are equal if their bytes are."""
    wanted = df.sparkSession.sparkContext.broadcast(_filter(marked.where("suspect").select("fp"), size))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = wanted.value
        for batch in batches:
            shas, bodies = [], []
            for t in batch.column(0):
                sha = hashlib.sha256(body := _normal(t)).digest()
                at = _fingerprint(sha, bits) % size
                if marks[at >> 3] >> (at & 7) & 1:
                    shas.append(sha)
                    bodies.append(body)
            yield pa.record_batch({"sha": pa.array(shas, pa.binary()), "body": pa.array(bodies, pa.binary())})

    chosen = df.select(F.col(f"`{text}`").cast("string")).mapInArrow(choose, "sha binary, body binary")
    groups = chosen.groupBy("sha", "body").agg(F.count(F.lit(1)).alias("group_size"))
    two = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("two texts have one SHA-256")).cast("long"))
    return groups.groupBy("sha").agg(F.coalesce(two, F.sum("group_size")).alias("group_size"))


def judged(
    df: DataFrame, key: str = "doc_id", text: str = "text", owners: int | None = None, bits: int = BITS, chunk: int = CHUNK,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """``id``, ``keep_id``, ``group_size``, ``kept`` and ``sha`` (of the text with small letters) of every row."""
    owners = owners or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = kept(suspects(*classes(df, key, text, owners, bits, chunk)), "exact-marked")
    groups = verified(df, marked, key, text, bits, filter_bits)
    shared = marked.where("suspect").select("chunk", "sha", "ids")
    # null is the lowest id
    first = shared.groupBy("sha").agg(F.max(F.struct(F.col("ids")[0].alias("id"), "chunk")).alias("first"))
    met = shared.join(first.join(groups, "sha"), "sha").select(
        "sha", "ids", "group_size", F.col("first.id").alias("keep_id"), (F.col("chunk") == F.col("first.chunk")).alias("here"))
    together = met.select("sha", "group_size", "keep_id", "here", F.posexplode("ids").alias("place", "id")).select(
        "id", "keep_id", "group_size", (F.col("here") & (F.col("place") == 0)).alias("kept"), "sha")
    alone = marked.where(~F.col("suspect")).select(F.col("ids")[0].alias("id"), "sha").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return together.unionByName(alone)
