"""Trigram blooms: which files can be skipped for a regular expression."""

from __future__ import annotations

import re
import re._parser as parser
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 2048


def literals(pattern: str) -> list[str]:
    """Stretches of literal characters that every match of the pattern contains."""
    out: list[str] = []

    def walk(items) -> None:
        run = ""
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                run += chr(arg)
                continue
            if run:
                out.append(run)
                run = ""
            if name == "SUBPATTERN":
                walk(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
                walk(arg[2])
        if run:
            out.append(run)

    parsed = parser.parse(pattern)
    if parsed.state.flags & re.I:
        return []
    walk(parsed)
    return out


def required_trigrams(pattern: str) -> list[str]:
    """Trigrams without which no match exists; none if the pattern has no long literal."""
    return sorted({t[i : i + 3] for t in literals(pattern) for i in range(len(t) - 2)})


def slot(trigram: str) -> int:
    """The place of a trigram in a bloom."""
    return zlib.crc32(trigram.encode()) % BITS


def blooms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches (path, text) with length, and the bloom of the text's trigrams as ``BITS`` bits."""
    places: dict[str, int] = {}
    for b in batches:
        made, sizes = [], []
        for x in b.column(1).to_pylist():
            text = x or ""
            grams = {text[i : i + 3] for i in range(len(text) - 2)}
            if len(places) > 1_000_000:
                places.clear()
            places.update((g, slot(g)) for g in grams.difference(places))
            bits = np.zeros(BITS, np.uint8)
            bits[[places[g] for g in grams]] = 1
            made.append(np.packbits(bits, bitorder="little").tobytes())
            sizes.append(len(text.encode()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.array(made, pa.binary()), b.column(1)], ["path", "length", "bloom", "text"])


def may_match(bloom: Column, pattern: str) -> Column:
    """False only for texts that cannot match the pattern."""
    out = F.lit(True)
    for at in sorted({slot(t) for t in required_trigrams(pattern)}):
        byte = F.conv(F.hex(F.substring(bloom, at // 8 + 1, 1)), 16, 10).cast("int")
        out = out & (byte.bitwiseAND(F.lit(1 << at % 8)) != 0)
    return out
