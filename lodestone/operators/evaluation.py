"""The evaluation harness: golden queries against ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ranking import ranking_metrics

K = 10


def tag(results: DataFrame, golden: DataFrame) -> DataFrame:
    """Results (query_id, path, rank) with the acceptable path that each matches, if any.

    A path matches one that it equals, ends with after a slash, or lies below. The first
    acceptable path in the list's order is the tag.
    """
    accepted = golden.select("query_id", F.posexplode("acceptable").alias("at", "tag"))
    j = results.join(accepted, "query_id")
    fits = (F.col("path") == F.col("tag")) | F.col("path").endswith(F.concat(F.lit("/"), "tag")) | F.col("path").startswith(F.concat("tag", F.lit("/")))
    return j.where(fits).groupBy("query_id", "path", "rank").agg(F.min_by("tag", "at").alias("tag"))


def run(results: DataFrame, golden: DataFrame, k: int = K) -> DataFrame:
    """ndcg, recall and mrr of every golden query (query_id, query_type, acceptable)."""
    relevant = golden.select("query_id", F.explode_outer("acceptable").alias("tag"))
    scores = ranking_metrics(tag(results, golden), relevant, k)
    return golden.select("query_id", "query_type").join(scores, "query_id")


def report(scores: DataFrame) -> DataFrame:
    """Means by query type, and over all (null type)."""
    return scores.rollup("query_type").agg(
        F.count("*").alias("n"), F.avg("ndcg").alias("ndcg"), F.avg("recall").alias("recall"), F.avg("mrr").alias("mrr")
    )


def containing(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """(item_id, doc_id) of ``documents`` (doc_id, body) that hold the whole text of ``passages`` (item_id, text).

    A passage looks for documents by one word of its own that stands between two separators, the
    one that the fewest documents have; what meets is compared whole. A passage of fewer than
    three words is compared with all documents.
    """
    split = r"[^\\p{L}\\p{N}_]+"
    inner = F.expr(f"array_distinct(filter(slice(split(text, '{split}'), 2, greatest(size(split(text, '{split}')) - 2, 0)), x -> x <> ''))")
    asked = passages.select("item_id", "text", F.explode(inner).alias("word"))
    terms = documents.select("doc_id", F.explode(F.expr(f"array_distinct(split(body, '{split}'))")).alias("word")).join(asked.select("word").distinct(), "word", "left_semi")
    rare = asked.join(terms.groupBy("word").agg(F.count("*").alias("df")), "word").groupBy("item_id").agg(F.min_by("word", F.struct("df", "word")).alias("word"))
    met = terms.join(rare, "word").select("item_id", "doc_id")
    near = met.join(passages.select("item_id", "text"), "item_id").join(documents, "doc_id").where(F.contains("body", F.col("text"))).select("item_id", "doc_id")
    short = passages.where((F.size(inner) == 0) & F.col("text").isNotNull()).select("item_id", "text")
    return near.unionByName(documents.join(short, F.contains("body", F.col("text"))).select("item_id", "doc_id"))
