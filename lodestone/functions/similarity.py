"""Similarities of vectors and sets as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; 0 where one of them is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(n != 0, n))


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / F.when(n != 0, n)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 1 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.when(union > 0, union))


#: Tokens whose hashes are worked on together.
TOKENS = 1 << 16
_P1, _P2, _P3, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def hash_int(seeds: np.ndarray, x: int) -> np.ndarray:
    """What ``xxhash64`` makes of an int after a value whose hash is the seed."""
    with np.errstate(over="ignore"):
        h = (seeds + (_P5 + np.uint64(4))) ^ (np.uint64(x) * _P1)
        h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P2 + _P3
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    return h


def _least(hashes: pa.ListArray, slots: int) -> Iterator[pa.ListArray]:
    """Signatures of lists of token hashes, a portion of rows at a time; slots of a row without tokens are null."""
    ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(hashes), 0).to_numpy())]
    values, first = hashes.flatten().to_numpy().view(np.uint64), 0
    while first < len(hashes):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + TOKENS, "right")) - 1)
        full = np.flatnonzero(ends[first + 1 : last + 1] > ends[first:last])
        out, none = np.zeros((last - first, slots), np.int64), np.ones((last - first, slots), bool)
        none[full] = False
        if len(full):
            part, starts = values[ends[first] : ends[last]], ends[first:last][full] - ends[first]
            for s in range(slots):
                out[full, s] = np.minimum.reduceat(hash_int(part, s).view(np.int64), starts)
        yield pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, slots, dtype=np.int32)), pa.array(out.ravel(), mask=none.ravel()))
        first = last


def with_minhash(rows: DataFrame, tokens: str, slots: int = 128) -> DataFrame:
    """``rows`` with ``signature``, the least seeded hash of the tokens in every slot, in place of ``tokens``.

    Slot s has the least ``xxhash64(token, s)``. Tokens are hashed once by built-in functions,
    and once a slot with numpy, as lambdas are interpreted.
    """
    keep = [c for c in rows.columns if c != tokens]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for made in _least(b.column(len(keep)), slots):
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(made)) for c in b.columns[:-1]), made], [*keep, "signature"])
                at += len(made)

    hashed = rows.select(*keep, F.transform(tokens, lambda t: F.xxhash64(t)).alias(tokens))
    kinds = StructType([*(rows.schema[c] for c in keep), StructField("signature", ArrayType(LongType()))])
    return hashed.mapInArrow(run, kinds)


def minhash_jaccard(a: Column, b: Column) -> Column:
    """The share of equal slots of two signatures."""
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("double"))
    return F.aggregate(same, F.lit(0.0), lambda acc, x: acc + x) / F.size(a)


def bands(signature: Column, rows: int) -> Column:
    """Fingerprints of the bands of ``rows`` slots each, with the band's number."""

    def cut(s: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.floor(F.size(s) / rows).cast("int") - 1),
            lambda b: F.struct(b.alias("band"), F.xxhash64(F.slice(s, b * rows + 1, rows)).alias("mark")),
        )

    # The signature is bound once, as a lambda's variable.
    return F.element_at(F.transform(F.array(signature), cut), 1)


def with_words(rows: DataFrame, text: str, name: str, keep_text: bool = True) -> DataFrame:
    """``rows`` with the sorted distinct words of a text column, between white space as in Java's ``\\s``; null for a null text."""
    at, drop = rows.columns.index(text), 0 if keep_text else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
            words = [None if t is None else sorted(set(t.split())) for t in b.column(at).cast(pa.binary()).to_pylist()]
            ends = np.cumsum([0, *(len(w or ()) for w in words)]).astype(np.int32)
            flat = pa.array([x for w in words for x in w or ()], pa.binary()).cast(pa.string())
            made = pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([w is None for w in words]))
            kept = [k for k in range(b.num_columns) if not drop or k != at]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), made], [*(b.schema.names[k] for k in kept), name])

    kinds = [f for f in rows.schema if not drop or f.name != text]
    return rows.mapInArrow(run, StructType([*kinds, StructField(name, ArrayType(StringType()))]))
