"""What the operators of this package share: stashed tables, keys, words and their hashes.

Words are maximal runs of characters other than space and U+0009..U+000D. On UTF-8
bytes that is exactly ``bytes.split()``, and ``bytes.lower()`` lowers A-Z alone, so
the Python parts of the operators take text as binary.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.storage import prepare, shared_dir, stash  # noqa: F401

#: Arrays that one task adds up.
FAN = 256
#: Rows that are worked on together, and their bytes of text.
ROWS = 512
BYTES = 8 << 20
#: The word pattern in the syntax of Java, RE2 and Python.
WORD = r"[^\x20\x09-\x0D]+"


def text_bytes(col: str = "text") -> Column:
    """A text column as UTF-8 bytes; null is the empty text."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def host_key(col: str = "source") -> Column:
    """A key that keeps a null apart from every string."""
    return F.when(F.col(col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(col)))


def fresh(df: DataFrame) -> str:
    """A prefix that no column of ``df`` starts with."""
    names, out = [c.lower() for c in df.columns], "_"
    while any(c.startswith(out) for c in names):
        out += "_"
    return out


def hash_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word; equal words are hashed once."""
    import xxhash

    seen: dict[bytes, int] = {}
    digest = xxhash.xxh3_64_intdigest
    for w in set(words):
        seen[w] = digest(w)
    return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def portions(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """(first, count) of runs of rows of at most ``ROWS`` rows, and ``BYTES`` bytes if more than one."""
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if i > first and (i - first == ROWS or held + size > BYTES):
            yield first, i - first
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes) - first


def sliced(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in portions by the texts of ``column``, so that what is made of them stays small."""
    for b in batches:
        for first, count in portions([n or 0 for n in pc.binary_length(b.column(column)).to_pylist()]):
            yield b.slice(first, count)


def give_back() -> None:
    """Hand memory that is free to the system: a worker lives on, idle or in another stage, beside the executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # no glibc
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, for mapInArrow, with its memory given back at the end of a task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def add_arrays(parts: DataFrame) -> DataFrame:
    """(piece, counts) with the sums, number by number, of (part, piece, counts): arrays of longs in binary.

    As a tree: a part's number is divided by ``FAN`` from level to level, so that no task
    gathers more than ``FAN`` arrays of a piece, however many parts there are.
    """

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("counts"))
        return pa.table({"part": table.column("part")[:1], "piece": table.column("piece")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    parts = stash(parts, "parts")
    most = parts.agg(F.max("part")).first()[0] or 0
    while True:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("part", "piece").applyInArrow(add, "part int, piece int, counts binary")
        most //= FAN
        if most == 0:
            return parts.select("piece", "counts")
        parts = stash(parts, "parts")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def roll(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` hashes, in order; needs at least ``n`` of them."""
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix(out + hashes[k : k + len(out)] * np.uint64(2 * k + 3))
    return out
