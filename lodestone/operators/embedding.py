"""Embedders, a deterministic one by feature hashing, and a cache of vectors by content."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.storage import stash

SCHEMA = "digest binary, embedding array<float>"


class Embedder(Protocol):
    """Turns texts into unit vectors; ``name`` tells models and their versions apart."""

    name: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class HashingEmbedder:
    """Counts of words and of their runs of three characters, hashed with a sign to ``dim`` places; no model is needed.

    An empty text is the zero vector. Equal texts have equal vectors on every machine.
    """

    dim: int = 128

    @property
    def name(self) -> str:
        return f"hashing-{self.dim}"

    def embed(self, texts: list[str]) -> np.ndarray:
        import re
        import xxhash

        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts):
            words = re.findall(r"\w+", text.lower())
            parts = [*words, *(f"<{w}>"[i : i + 3] for w in words for i in range(len(w)))]
            h = np.array([xxhash.xxh3_64_intdigest(p) for p in parts], np.uint64)
            np.add.at(row, (h >> np.uint64(1)).astype(np.int64) % self.dim, np.where(h & np.uint64(1), 1.0, -1.0))
            norm = float(np.sqrt((row * row).sum()))
            if norm:
                row /= norm
        return out


def _embed(embedder: Embedder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                vectors = embedder.embed([x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(vectors), pa.list_(pa.float32()))], ["digest", "embedding"])

    return run


def embed_cached(rows: DataFrame, embedder: Embedder, cache: str) -> DataFrame:
    """(id, embedding) of ``rows`` (id, text); ``cache`` is a folder of vectors by the digest of content and model.

    Only distinct texts that the cache lacks are embedded, and appended to it. A null text is
    the empty one.
    """
    spark = rows.sparkSession
    table = f"{cache.rstrip('/')}/{embedder.name}"
    spark.createDataFrame([], SCHEMA).write.mode("append").parquet(table)
    text = F.coalesce("text", F.lit(""))
    keyed = rows.select("id", text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    missing = keyed.join(spark.read.schema(SCHEMA).parquet(table).select("digest"), "digest", "left_anti").dropDuplicates(["digest"])
    stash(missing.select("digest", "text").mapInArrow(_embed(embedder), SCHEMA), "embedded").write.mode("append").parquet(table)
    known = spark.read.schema(SCHEMA).parquet(table).dropDuplicates(["digest"])
    return keyed.select("id", "digest").join(known, "digest").select("id", "embedding")
