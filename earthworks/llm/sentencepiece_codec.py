"""SentencePiece encoding with byte offsets, and decoding.

Normalisation is done here, by the model's own rules: at each place the longest prefix that the compiled character map
knows is replaced, other characters stay; then extra white space goes, the dummy prefix comes and spaces are escaped, as
far as the model says. Every byte of the normalised text keeps the source byte that it comes from. The library then cuts
the normalised text into pieces, with a copy of the model whose own normalisation is off; each piece is projected back
through the alignment to the span of source bytes that it covers.

Defined results: null and empty texts have no ids and decode to an empty text. Repeated rows each get the same result,
nothing depends on order. Texts are encoded whole, one at a time, and leave Python in batches of bounded size. Empty
tables give empty results. The input's columns that are named as keys are carried; others are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as model_format

SPACE, ESCAPED = 0x20, np.frombuffer("▁".encode(), np.uint8)
BATCH_IDS = 1 << 18
MODEL_BYTES = 64 << 20


def read_model(path: str) -> bytes:
    """The model file, small enough to be sent to every executor."""
    with open(path, "rb") as file:
        model = file.read(MODEL_BYTES + 1)
    if len(model) > MODEL_BYTES:
        raise ValueError(f"the model is larger than {MODEL_BYTES} bytes")
    return model


class CharMap:
    """A compiled character map: a double-array trie of prefixes whose values point at their replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]
        self.starts = frozenset(c for c in range(256) if self.units and self._step(self._below(0, self.units[0]), c))

    @staticmethod
    def _below(node: int, unit: int) -> int:
        return node ^ ((unit >> 10) << ((unit & (1 << 9)) >> 6))

    def _step(self, node: int, byte: int) -> int | None:
        """The place of the edge for a byte, if there is one."""
        at = node ^ byte
        if at < len(self.units) and self.units[at] & ((1 << 31) | 0xFF) == byte:
            return at
        return None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest known prefix at a place."""
        node, found = self._below(0, self.units[0]), None
        for k in range(at, len(data)):
            edge = self._step(node, data[k])
            if edge is None:
                break
            node = self._below(edge, self.units[edge])
            if self.units[edge] >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                found = k + 1 - at, self.texts[value : self.texts.index(b"\0", value)]
        return found

    def edits(self, data: bytes) -> list[tuple[int, int, bytes]]:
        """Replacements as (start, end, new bytes); only places whose byte begins some prefix are looked at."""
        if not self.starts:
            return []
        marked = np.frombuffer(bytes(c in self.starts for c in range(256)), np.uint8)
        out, end = [], 0
        for at in np.flatnonzero(marked[np.frombuffer(data, np.uint8)]).tolist():
            # a place inside a replaced prefix, or inside a character, is no start
            if at < end or data[at] & 0xC0 == 0x80:
                continue
            if found := self.longest(data, at):
                end = at + found[0]
                out.append((at, end, found[1]))
        return out


class Normalizer:
    """Text to normalised UTF-8 and, for each of its bytes and the end, the source byte at which it begins."""

    def __init__(self, spec, suffix: bool = False):
        self.map = CharMap(spec.precompiled_charsmap)
        self.spec, self.suffix = spec, suffix

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        data = text.encode("utf-8", "replace")
        out, at = np.frombuffer(data, np.uint8), np.arange(len(data))
        if edits := self.map.edits(data):
            parts, places, done = [], [], 0
            for start, end, new in edits:
                parts += [out[done:start], np.frombuffer(new, np.uint8)]
                places += [at[done:start], np.full(len(new), start)]
                done = end
            out, at = np.concatenate([*parts, out[done:]]), np.concatenate([*places, at[done:]])
        stop = len(data)
        if self.spec.remove_extra_whitespaces and len(out):
            space = out == SPACE
            keep = ~space | np.append(False, ~space[:-1])
            solid = np.flatnonzero(~space)
            last = solid[-1] + 1 if solid.size else 0
            stop = int(at[last]) if last < len(out) else stop
            keep[last:] = False
            out, at = out[keep], at[keep]
        if self.spec.add_dummy_prefix and len(out):
            where = len(out) if self.suffix else 0
            out, at = np.insert(out, where, SPACE), np.insert(at, where, stop if self.suffix else at[0])
        if self.spec.escape_whitespaces and len(out):
            space = out == SPACE
            wide = np.where(space, len(ESCAPED), 1)
            first = np.cumsum(wide) - wide
            grown = np.repeat(out, wide)
            for k, byte in enumerate(ESCAPED):
                grown[first[space] + k] = byte
            out, at = grown, np.repeat(at, wide)
        return out.tobytes(), np.append(at, stop)


class Codec:
    def __init__(self, model: bytes):
        parsed = model_format.ModelProto()
        parsed.ParseFromString(model)
        self.normalize = Normalizer(parsed.normalizer_spec, parsed.trainer_spec.treat_whitespace_as_suffix)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        kind = model_format.ModelProto.SentencePiece
        # a byte piece covers one byte, a piece without a text of its own none; an unknown piece has any length
        self.lengths = np.array([1 if p.type == kind.BYTE else 0 if p.type == kind.CONTROL else len(p.piece.encode())
                                 for p in parsed.pieces])
        self.unknown = next((k for k, p in enumerate(parsed.pieces) if p.type == kind.UNKNOWN), -1)
        cut = model_format.ModelProto()
        cut.CopyFrom(parsed)
        bare = cut.normalizer_spec
        bare.Clear()
        bare.name, bare.precompiled_charsmap = "identity", b""
        bare.add_dummy_prefix = bare.remove_extra_whitespaces = bare.escape_whitespaces = False
        self.cutter = sentencepiece.SentencePieceProcessor(model_proto=cut.SerializeToString())

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids, and the source byte at which each piece begins, with the end of the last."""
        data, align = self.normalize(text or "")
        clean = data.decode()
        ids = np.asarray(self.cutter.encode(clean, num_threads=1), np.int32)
        lengths = self.lengths[ids]
        if (strange := np.flatnonzero(ids == self.unknown)).size:
            pieces = self.cutter.encode(clean, out_type=str, num_threads=1)
            lengths[strange] = [len(pieces[k].encode()) for k in strange]
        return ids, align[np.append(0, np.cumsum(lengths))] if len(ids) else align[:1]

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids) if ids else ""


@lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    """One codec for each model in a Python worker."""
    return Codec(model)


def encoded(df: DataFrame, keys: list[str], model: bytes, text: str = "text") -> DataFrame:
    """The keys, ``ids`` and for every id ``starts`` and ``ends``, its span of bytes in the UTF-8 source."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([df.schema[k] for k in keys] + [
        T.StructField(name, T.ArrayType(T.IntegerType(), False)) for name in ("ids", "starts", "ends")])

    def lists(parts: list[np.ndarray], bounds: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(parts), pa.int32()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(sent.value)
        for batch in batches:
            texts, begun, ids, edges = batch.column(len(keys)), 0, [], []
            for row in range(len(texts)):
                one, edge = of.encode(texts[row].as_py())
                ids.append(one)
                edges.append(edge.astype(np.int32))
                if row + 1 == len(texts) or sum(map(len, ids[-64:])) > BATCH_IDS or (
                        len(ids) % 64 == 0 and sum(map(len, ids)) > BATCH_IDS):
                    bounds = np.append(0, np.cumsum([len(x) for x in ids]))
                    yield pa.RecordBatch.from_arrays(
                        [c.slice(begun, row + 1 - begun) for c in batch.columns[: len(keys)]]
                        + [lists(ids, bounds), lists([x[:-1] for x in edges], bounds), lists([x[1:] for x in edges], bounds)],
                        names=schema.names)
                    begun, ids, edges = row + 1, [], []

    return df.select(*keys, text).mapInArrow(encode, schema)


def decoded(ids: Column, model: bytes, spark) -> Column:
    """The text of a list of ids."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def of(lists: pa.Array) -> pa.Array:
        one = codec(sent.value)
        return pa.array([one.decode(x.as_py() or []) for x in lists], pa.string())

    return of(ids)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def digests(df: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and ``n_bytes``, the end of the last span.

    One pass: the ids of a text are decoded and hashed where they arise, only the digests leave Python.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([df.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType()), T.StructField("n_bytes", T.LongType())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(sent.value)
        for batch in batches:
            rows = []
            for one in batch.column(1):
                ids, edges = of.encode(one.as_py())
                ids = ids.tolist()
                rows.append((len(ids), _sha256(",".join(map(str, ids))), _sha256(of.decode(ids)), int(edges[-1]) if ids else 0))
            found = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, kind) for c, kind in zip(found, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)]],
                names=schema.names)

    return df.select("doc_id", text).mapInArrow(digest, schema)
