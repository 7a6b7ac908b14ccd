"""Ranked hybrid search: channels, fusion, re-ranking, filters, limit."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import PathScope, is_doc_path, metadata_matches
from lodestone.operators import bm25, lookup, ranking, vectors


@dataclass(frozen=True)
class SearchRequest:
    query: str
    limit: int = 20
    kind: str | None = None
    near: str | None = None
    scope: PathScope = PathScope()
    visibility: str | None = None
    modifiers: tuple[str, ...] = ()
    docs: bool = True
    fetch: int = 60


#: What a channel gives, best first from rank 0.
RANKED = ("path", "name", "line", "kind", "match_type", "rank", "score")


class Channel(Protocol):
    """A source of ranked rows for a request; ``name`` tells it from the others."""

    name: str

    def ranked(self, request: SearchRequest) -> DataFrame: ...


@dataclass(frozen=True)
class StructuralChannel:
    """Symbols by their names: exact, prefix, then fuzzy."""

    symbols: DataFrame
    index: DataFrame
    name: str = "structural"

    def ranked(self, request: SearchRequest) -> DataFrame:
        rows = lookup.ranked_candidates(self.symbols, self.index, request.query, request.fetch)
        kind = F.when(F.col("rung") >= 2, "fuzzy").otherwise("structural")
        return rows.withColumns({"match_type": kind, "score": F.lit(1.0)}).select(*RANKED)


@dataclass(frozen=True)
class TextChannel:
    """Symbols by the terms of their texts."""

    symbols: DataFrame
    words: bm25.Bm25Index
    name: str = "bm25"

    def ranked(self, request: SearchRequest) -> DataFrame:
        hits = ranking.ranks(bm25.search(self.words, request.query, request.fetch))
        return self.symbols.join(hits, "sym_id").withColumn("match_type", F.lit(self.name)).select(*RANKED)


@dataclass(frozen=True)
class SemanticChannel:
    """Symbols by the cosine of their vectors (id, embedding) to the query's."""

    symbols: DataFrame
    vectors: DataFrame
    query: list[float]
    name: str = "semantic"

    def ranked(self, request: SearchRequest) -> DataFrame:
        near = vectors.search_exact(self.vectors, self.query, request.fetch).select(F.col("id").alias("sym_id"), F.col("similarity").alias("score"))
        return self.symbols.join(ranking.ranks(near), "sym_id").withColumn("match_type", F.lit(self.name)).select(*RANKED)


def channels(sources: list[Channel], request: SearchRequest) -> dict[str, DataFrame]:
    """Ranked lists by channel."""
    return {c.name: c.ranked(request) for c in sources}


def search(symbols: DataFrame, sources: list[Channel], request: SearchRequest) -> DataFrame:
    """(path, name, line, kind, score, match_type), best first. Filters come before the limit."""
    lists = channels(sources, request)
    fused = ranking.fuse(list(lists.values()))
    ranked = ranking.rerank(fused, request.query, request.kind, request.near)
    kept = ranked.where(request.scope.accepts(F.col("path")))
    if request.visibility or request.modifiers:
        signature = symbols.select("path", "name", "line", "signature")
        kept = kept.join(signature, ["path", "name", "line"], "left").where(metadata_matches(F.col("signature"), request.visibility, request.modifiers))
    if not request.docs:
        kept = kept.where(~is_doc_path(F.col("path")))
    return kept.select("path", "name", "line", "kind", F.col("boosted").alias("score"), "match_type").orderBy(F.desc("score"), "path", "name", "line").limit(request.limit)


def trace(lists: dict[str, DataFrame]) -> DataFrame:
    """(channel, hits) of a search's channels."""
    out = None
    for name, rows in lists.items():
        one = rows.agg(F.count("*").alias("hits")).select(F.lit(name).alias("channel"), "hits")
        out = one if out is None else out.unionByName(one)
    return out
