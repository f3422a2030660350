"""Fill-in-the-middle transformation of whole texts, as a pipeline of Arrow compute functions.

A text is cut into units, a word with the white space before it, or white space at the end. Two draws cut its n units into
prefix, middle and suffix; two more choose the form: the plain text, or its three parts behind markers in the order
prefix, suffix, middle (psm) or suffix, prefix, middle (spm). Texts that hold a marker stay plain, so ``restored`` finds
every part again.

The work inside a task is columnar. Texts go through in blocks of bounded size, long ones in pieces that end where a unit
ends. A first pass counts the units of every piece. A second splits each piece into a list of units, flattens the lists
with the index of their parent, gives each unit its ordinal in the document, filters the units by role, rebuilds the lists
of each role and joins them. So the lists of units never hold more than one block, however long a text is.

Defined results: null and empty texts have no units and stay plain. A text without a cut has empty parts. Repeated rows
each get a result of their own draws, nothing depends on order. Empty tables give empty results. Only the keys and the text
are read, so other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earthworks.llm.words import pieces_of_units

PLAIN, PSM, SPM = "plain", "psm", "spm"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM_RATE = 50, 80  # per cent
BLOCK = 4 << 20
BREAK = b"\xff"  # no byte of UTF-8
WORD_UNIT = rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
UNIT = WORD_UNIT + rb"|[\x20\x09-\x0D]+"
EMPTY = pa.scalar(b"", pa.large_binary())


def draws(key: Column, seed: int = 42) -> list[Column]:
    """Four numbers from 0 to 2**32 - 1 of a key: the first digits of the SHA-256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _remainder(a: pa.Array, by: pa.Array | int) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, by), by))


def _starts(counts: pa.Array) -> pa.Array:
    """Where each list begins in the flat array, and where the last ends."""
    return pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(counts)])


def _joined(counts: pa.Array, values: pa.Array) -> pa.Array:
    """Consecutive values as lists of the given lengths, each list as one string."""
    return pc.binary_join(pa.LargeListArray.from_arrays(_starts(counts), values), EMPTY)


def _units(block: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The units of all pieces in one array, and the piece of each."""
    marked = pc.replace_substring_regex(block, pattern=WORD_UNIT, replacement=rb"\0" + BREAK)
    lists = pc.split_pattern(marked, pattern=BREAK)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    # what follows the last word of a piece is white space or nothing
    some = pc.greater(pc.binary_length(flat), 0)
    return pc.filter(flat, some), pc.filter(parent, some)


def _blocks(lengths: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of pieces with at most ``BLOCK`` bytes, or one piece."""
    edges, held = [0], 0
    for k, length in enumerate(lengths.tolist()):
        if held and held + length > BLOCK:
            edges.append(k)
            held = 0
        held += length
    return list(zip(edges, [*edges[1:], len(lengths)], strict=True))


def parts(texts: pa.Array, first: pa.Array, second: pa.Array) -> tuple[pa.Array, list[pa.Array]]:
    """The number of units of each text (bytes), and its prefix, middle and suffix for two draws of where to cut."""
    cut = [[texts[k]] if n <= BLOCK else list(pieces_of_units(texts[k].as_py(), BLOCK))
           for k, n in enumerate(pc.binary_length(texts).to_pylist())]
    of_text = pa.array([len(c) for c in cut], pa.int64())
    flat = texts if len(cut) == sum(map(len, cut)) else pa.array(
        [p.as_py() if isinstance(p, pa.Scalar) else p for c in cut for p in c], pa.large_binary())
    owner = pa.array(np.repeat(np.arange(len(cut)), of_text.to_numpy()))
    blocks = _blocks(pc.binary_length(flat).to_numpy())

    units = pa.concat_arrays([pc.cast(pc.count_substring_regex(flat.slice(a, b - a), pattern=UNIT), pa.int64())
                              for a, b in blocks])
    before = _starts(units)  # units of all pieces before each
    piece_edges = _starts(of_text)
    total = pc.subtract(before.take(piece_edges[1:]), before.take(piece_edges[:-1]))
    ends = pc.add(total, 1)
    one, two = _remainder(first, ends), _remainder(second, ends)
    low, high = pc.min_element_wise(one, two), pc.max_element_wise(one, two)

    joined: list[list[pa.Array]] = [[], [], []]
    of_piece = before.take(piece_edges).take(owner)  # units of all texts before that of a piece
    offset = pc.subtract(before[:-1], of_piece)
    for a, b in blocks:
        values, parent = _units(flat.slice(a, b - a))
        piece = pc.add(parent, a)
        place = pc.subtract(pa.array(np.arange(len(values))), pc.subtract(before.take(piece), before[a].as_py()))
        ordinal, text = pc.add(place, offset.take(piece)), owner.take(piece)
        role = pc.add(pc.cast(pc.greater_equal(ordinal, low.take(text)), pa.int8()),
                      pc.cast(pc.greater_equal(ordinal, high.take(text)), pa.int8()))
        for which in range(3):
            mine = pc.equal(role, which)
            counts = np.bincount(pc.filter(parent, mine).to_numpy(), minlength=b - a)
            joined[which].append(_joined(pa.array(counts), pc.filter(values, mine)))
    whole = [pa.concat_arrays(j) for j in joined]
    return total, whole if len(flat) == len(texts) else [_joined(of_text, w) for w in whole]


def _framed(texts: pa.Array, numbers: Sequence[pa.Array], rate: int, spm_rate: int) -> list[pa.Array]:
    texts = pc.cast(pc.fill_null(texts, ""), pa.large_binary())
    total, (prefix, middle, suffix) = parts(texts, numbers[0], numbers[1])
    marked = pc.or_(pc.or_(*[pc.match_substring(texts, pattern=m) for m in (PREFIX, SUFFIX)]),
                    pc.match_substring(texts, pattern=MIDDLE))
    plain = pc.or_(pc.or_(marked, pc.equal(total, 0)), pc.greater_equal(_remainder(numbers[2], 100), rate))
    spm = pc.less(_remainder(numbers[3], 100), spm_rate)
    marks = {m: pa.scalar(m.encode(), pa.large_binary()) for m in (PREFIX, SUFFIX, MIDDLE)}
    output = pc.if_else(plain, texts, pc.if_else(
        spm,
        pc.binary_join_element_wise(marks[SUFFIX], suffix, marks[PREFIX], prefix, marks[MIDDLE], middle, EMPTY),
        pc.binary_join_element_wise(marks[PREFIX], prefix, marks[SUFFIX], suffix, marks[MIDDLE], middle, EMPTY)))
    form = pc.if_else(plain, PLAIN, pc.if_else(spm, SPM, PSM))
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.cast(pc.utf8_length(pc.cast(p, pa.large_string())), pa.int64()))
             for p in (prefix, middle)]
    return [total, pc.cast(form, pa.string()), *chars, output]


def transformed(
    df: DataFrame, keys: list[str], numbers: Sequence[Column], text: str = "text", rate: int = RATE, spm_rate: int = SPM_RATE,
) -> DataFrame:
    """The keys, ``n`` units, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of every row.

    ``numbers`` are four long columns: two for the cuts, one for whether, one for which form.
    """
    added = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
             T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
             T.StructField("output", T.StringType())]
    schema = T.StructType([df.schema[k] for k in keys] + added)

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keys))
            for a, b in _blocks(pc.binary_length(pc.fill_null(texts, "")).to_numpy()):
                if a == b:
                    continue
                rows = batch.slice(a, b - a)
                made = _framed(rows.column(len(keys)), rows.columns[len(keys) + 1 :], rate, spm_rate)
                made[-1] = pc.cast(made[-1], pa.string())
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(keys)], *made], names=schema.names)

    wanted = [F.col(f"`{k}`") for k in (*keys, text)] + [c.alias(f"_{k}") for k, c in enumerate(numbers)]
    return df.select(*wanted).mapInArrow(change, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No part holds a marker, so each marker is found where it was put."""
    piece = lambda mark, k: F.split_part(output, F.lit(mark), F.lit(k))
    body = F.substring(output, len(PREFIX) + 1, F.length(output))
    middle = piece(MIDDLE, 2)
    psm = F.concat(F.split_part(body, F.lit(SUFFIX), F.lit(1)), middle,
                   F.split_part(piece(SUFFIX, 2), F.lit(MIDDLE), F.lit(1)))
    spm = F.concat(F.split_part(piece(PREFIX, 2), F.lit(MIDDLE), F.lit(1)), middle,
                   F.split_part(body, F.lit(PREFIX), F.lit(1)))
    return F.when(form == PLAIN, output).when(form == PSM, psm).otherwise(spm)
