"""Fusion of ranked lists, re-ranking, signals, and ranking metrics."""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.paths import is_test_path
from lodestone.functions.text import query_shape

#: Fixed values of fusion and re-ranking.
RRF_K = 60
KIND_BOOST = {
    "type": (("class", "struct", "interface", "trait", "enum", "type_alias"), 1.3),
    "function": (("function", "method"), 1.2),
    "constant": (("constant", "property"), 1.1),
}
IMPL, HEADING, EXACT, TEST, HINT = 0.7, 0.6, 1.5, 0.8, 1.4
DEPTH_STEP, DEPTH_FLOOR = 0.02, 0.5
OVERLAP_STEP, OVERLAP_CAP = 0.08, 1.4
SAME_DIR, SIBLING_DIR = 1.15, 1.05
#: What an infinite score is taken for.
LARGEST = sys.float_info.max / 2
#: Other names of kinds that can be asked for.
KIND_NAMES = {"def": "def", "definition": "def", "comment": "comment", "test": "test", "ref": "ref", "reference": "ref"}


def ranks(rows: DataFrame, score: str = "score", tie: str = "sym_id") -> DataFrame:
    """0-based rank by score; the list is small by then, a limit or a query's hits."""
    return rows.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), tie)) - 1)


def fuse(lists: list[DataFrame]) -> DataFrame:
    """Reciprocal-rank fusion of lists (path, name, line, kind, match_type, rank).

    A row seen twice is ``hybrid``; else it keeps its list's match type. The first list's
    kind stands for the row.
    """
    every = None
    for i, rows in enumerate(lists):
        one = rows.select("path", "name", "line", "kind", "match_type", "rank").withColumn("list", F.lit(i))
        every = one if every is None else every.unionByName(one)
    first = lambda c: F.min_by(c, F.struct("list", "rank"))
    return every.groupBy("path", "name", "line").agg(
        first("kind").alias("kind"),
        F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"),
        F.when(F.count("*") > 1, "hybrid").otherwise(first("match_type")).alias("match_type"),
    )


def kind_boost(kind: Column, shape: str) -> Column:
    """How much a kind counts for a query of this shape; blocks of implementation count less, but for constants."""
    kinds, boost = KIND_BOOST.get(shape, ((), 1.0))
    out = F.lit(1.0) if shape == "constant" else F.when(kind == "impl", IMPL).otherwise(1.0)
    return F.when(kind.isin(*kinds), boost).otherwise(out) if kinds else out


def kinds_asked(kind: str | None) -> list[str]:
    """The kinds of a list with commas, other names resolved."""
    return [KIND_NAMES.get(k, k) for x in (kind or "").split(",") if (k := x.strip())]


def has_kind(asked: list[str]) -> Column:
    """Whether a row (kind, path) is of any of the kinds asked for."""
    rules = {
        "def": F.col("kind") != "heading",
        "comment": F.col("kind") == "heading",
        "test": is_test_path(F.col("path")),
        "ref": F.lit(False),  # usages alone have references
    }
    return reduce(lambda a, b: a | b, (rules.get(k, F.col("kind") == k) for k in asked), F.lit(False))


def nearness(near: str) -> Column:
    """How much a row's path counts beside the path ``near``: directories they share from the top, and neighbourhood."""
    above = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    own = above(near)
    here = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    parent = F.when(F.contains(here, F.lit("/")), F.regexp_replace(here, "/[^/]*$", "")).otherwise("")
    parts = own.split("/")
    prefixes = ["/".join(parts[: i + 1]) for i in range(len(parts))] if own else []
    shared = sum((((here == p) | here.startswith(p + "/")).cast("int") for p in prefixes), F.lit(0))
    overlap = F.when(shared > 0, F.least(F.lit(OVERLAP_CAP), 1 + OVERLAP_STEP * shared)).otherwise(1.0)
    beside = F.when((here == own) & F.lit(own != ""), SAME_DIR).when((parent == above(own)) & F.lit(above(own) != ""), SIBLING_DIR).otherwise(1.0)
    return overlap * beside


def finite(score: Column) -> Column:
    """A score without NaN (0) or infinities (the largest)."""
    return F.when(F.isnan(score), 0.0).when(F.abs(score) == float("inf"), LARGEST).otherwise(score)


def rerank(rows: DataFrame, query: str, kind: str | None = None, near: str | None = None) -> DataFrame:
    """Boost scores by kind, name, place and hints; a lone row stays as it is.

    ``kind`` names kinds asked for, with commas; ``near`` is a path whose neighbourhood is
    favoured. Order is by boosted score, then by the order before.
    """
    asked = kinds_asked(kind)
    depth = F.size(F.split("path", "/")) - 1
    boost = kind_boost(F.col("kind"), query_shape(query))
    if not {"comment", "heading"} & set(asked):
        boost = boost * F.when(F.col("kind") == "heading", HEADING).otherwise(1.0)
    boost = boost * F.when(F.lower("name") == query.lower(), EXACT).otherwise(1.0)
    boost = boost * F.when(depth > 1, F.greatest(F.lit(DEPTH_FLOOR), 1 - DEPTH_STEP * (depth - 1))).otherwise(1.0)
    boost = boost * F.when(is_test_path(F.col("path")), TEST).otherwise(1.0)
    if asked:
        boost = boost * F.when(has_kind(asked), HINT).otherwise(1.0)
    if near:
        boost = boost * nearness(near)
    alone = F.count("*").over(W.partitionBy()) == 1
    score = finite(F.col("score"))
    return rows.withColumn("boosted", F.when(alone, score).otherwise(finite(score * boost)))


def signals(results: DataFrame, structural: DataFrame, bm25: DataFrame, semantic: DataFrame) -> DataFrame:
    """``results`` with what each channel knew of the row, by (path, name, line)."""
    key = ["path", "name", "line"]
    return (
        results.join(structural.select(*key, F.lit(True).alias("fst_hit")), key, "left")
        .join(bm25.select(*key, F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score")), key, "left")
        .join(semantic.select(*key, F.col("rank").alias("semantic_rank"), F.col("score").alias("semantic_cosine")), key, "left")
        .withColumn("fst_hit", F.coalesce("fst_hit", F.lit(False)))
    )


def result_label(fst_hit: Column, fuzzy: bool) -> Column:
    return F.when(fst_hit & F.lit(not fuzzy), "def").otherwise("neighbor")


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """ndcg, recall and reciprocal rank at ``k`` of every query of ``relevant``.

    ``ranked`` has (query_id, tag, rank from 1), ``relevant`` (query_id, tag; a null tag for a
    query without any). A tag counts once, at its best rank. Nothing relevant gives 1, k = 0
    gives 0.
    """
    want = relevant.groupBy("query_id").agg(F.countDistinct("tag").alias("n"))
    best = ranked.where(F.col("rank") <= k).groupBy("query_id", "tag").agg(F.min("rank").alias("rank"))
    hits = best.join(relevant.where("tag IS NOT NULL").distinct(), ["query_id", "tag"], "left_semi")
    got = hits.groupBy("query_id").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.count("*").alias("found"), F.min("rank").alias("first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(max(k, 1))).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0)) if k else F.lit(0.0)
    rate = lambda c: F.when(F.col("n") == 0, 1.0 if k else 0.0).otherwise(zero(c))
    return want.join(got, "query_id", "left").select(
        "query_id",
        rate(F.col("dcg") / F.when(F.col("n") > 0, ideal)).alias("ndcg"),
        rate(F.col("found") / F.when(F.col("n") > 0, F.col("n"))).alias("recall"),
        rate(1 / F.col("first")).alias("mrr"),
    )
