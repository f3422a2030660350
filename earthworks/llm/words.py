"""Words as all text operators here take them: runs of anything but ASCII white space."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def word_count(text: Column) -> Column:
    """The number of words, without building them: gaps inside the trimmed text, and one."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


PIECE = 1 << 20
BLANK = re.compile(r"[\x20\x09-\x0D]")
BYTE_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: str | bytes, size: int = PIECE) -> Iterator[str | bytes]:
    """A text in pieces cut at white space, so that no list of its words is very long."""
    blank, at = (BLANK if isinstance(text, str) else BYTE_BLANK), 0
    while len(text) - at > size:
        cut = blank.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


BYTE_WORD_END = re.compile(rb"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")


def pieces_of_units(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """A text in pieces, each but the last cut where a word ends, so that no word loses the white space before it."""
    at = 0
    while len(text) - at > size:
        cut = BYTE_WORD_END.search(text, at + size - 1)
        if not cut:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]
