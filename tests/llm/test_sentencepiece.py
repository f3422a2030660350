from __future__ import annotations

import hashlib

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as model_format

from earthworks.llm import queries, sentencepiece_codec
from tests.llm.conftest import SF_DIR


@pytest.fixture(scope="module")
def model():
    return sentencepiece_codec.read_model(queries.PIECE_MODEL)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("where", ["small", "edge"])
def test_equal_to_the_library(spark, edge_dir, model, where):
    folder = SF_DIR if where == "small" else edge_dir
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    wanted = []
    for r in rows:
        ids = library.encode(r.text or "")
        wanted.append((r.doc_id or -1, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))))
    found = queries.op2_sentencepiece(spark, folder).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == sorted(wanted)


def test_spans_cover_the_source(model):
    codec = sentencepiece_codec.Codec(model)
    for text in ["", " ", "a  b\n\tc é ﬁ 😀 x▁y ", "\x00", "ab" * 1000]:
        ids, edges = codec.encode(text)
        data = text.encode()
        assert len(edges) == max(len(ids) + 1, 1) and list(edges) == sorted(edges)
        assert b"".join(data[a:b] for a, b in zip(edges, edges[1:], strict=False)) == data
        assert codec.decode(ids.tolist()) == codec.whole.decode(codec.whole.encode(text))


def trie(entries: dict[bytes, bytes]) -> bytes:
    """A compiled character map, built by placing each node's children at the first free offset."""
    texts, values = b"", {}
    for key, new in entries.items():
        values[key] = len(texts)
        texts += new + b"\0"
    units, used = [0] * 65536, {0}
    todo = [(b"", 0)]
    while todo:
        prefix, node = todo.pop(0)
        below = sorted({k[len(prefix)] for k in entries if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in values
        offset = next(o for o in range(256, 60000, 256) if all((node ^ o ^ c) not in used for c in below + [0] * leaf))
        units[node] |= (offset >> 8) << 10 | 1 << 9 | leaf << 8  # large offsets are stored without their last byte
        if leaf:
            used.add(node ^ offset)
            units[node ^ offset] = values[prefix] | 1 << 31
        for c in below:
            used.add(node ^ offset ^ c)
            units[node ^ offset ^ c] = c
            todo.append((prefix + bytes([c]), node ^ offset ^ c))
    size = (max(used) | 0xFF) + 1
    return (4 * size).to_bytes(4, "little") + b"".join(u.to_bytes(4, "little") for u in units[:size]) + texts


def test_character_map_takes_the_longest_prefix(model):
    entries = {"ﬁ".encode(): b"fi", "é".encode(): b"e", b"ab": b"X", b"abc": b"Y", b"\t": b" ", "…".encode(): b"..."}
    parsed = model_format.ModelProto()
    parsed.ParseFromString(model)
    parsed.normalizer_spec.precompiled_charsmap = trie(entries)
    parsed.normalizer_spec.name = "own"
    parsed.normalizer_spec.remove_extra_whitespaces = True
    own = parsed.SerializeToString()
    codec, library = sentencepiece_codec.Codec(own), sentencepiece.SentencePieceProcessor(model_proto=own)
    assert codec.normalize.map.longest(b"xabcd", 1) == (3, b"Y") and codec.normalize.map.longest(b"a", 0) is None
    for text in ["abc ab a", "  ﬁn  café…\t\tabcab  ", "plain", "é", "   "]:
        ids, edges = codec.encode(text)
        assert ids.tolist() == library.encode(text)
        assert codec.normalize(text)[0].decode() == library.normalize(text).replace(" ", "▁")
        assert list(edges) == sorted(edges) and (not len(ids) or edges[-1] <= len(text.encode()))
