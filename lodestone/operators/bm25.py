"""BM25 over distinct terms: an index of postings, statistics, and scores."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import document_terms, query_terms
from lodestone.sources.storage import persisted, size

K1 = 1.2
B = 0.75
#: Document lengths are kept in sixteen bits.
LONGEST = 65535


#: Folders that postings are divided by; a query opens those of its terms.
BUCKETS = 32


#: Bytes of source files for each part of a bucket, so that a task sorts about as much whatever the input.
PART = 4 << 20


@dataclass
class Bm25Index:
    """postings (bucket, term, sym_id, dl), lengths (sym_id, dl), stats (n, avgdl; one row) and terms (sym_id, terms, dl; a document's own)."""

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    terms: DataFrame


def bucket(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _terms(docs: DataFrame, text: str) -> DataFrame:
    return docs.select("sym_id", document_terms(F.coalesce(F.col(text), F.lit(""))).alias("terms")).withColumn("dl", F.least(F.size("terms"), F.lit(LONGEST)))


def _index(postings: DataFrame, terms: DataFrame) -> Bm25Index:
    lengths = terms.select("sym_id", "dl")
    return Bm25Index(postings, lengths, lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), terms)


def _postings(terms: DataFrame) -> DataFrame:
    return terms.select("sym_id", "dl", F.explode("terms").alias("term")).withColumn("bucket", bucket("term"))


def build(docs: DataFrame, text: str = "text") -> Bm25Index:
    """An index of ``docs`` (sym_id and a text column); documents without terms count too.

    Nothing is written: an index that is asked more than once should be opened by ``open_index``.
    """
    terms = _terms(docs, text)
    return _index(_postings(terms), terms)


def open_index(docs: DataFrame, paths: list[str], text: str = "text") -> Bm25Index:
    """The index of ``docs``, which come from the files below ``paths``: written once, texts being split once, then opened.

    Postings lie in folders by a hash of the term and sorted within, so a query's terms are a
    few folders' few row groups. A folder is written in parts by document, more of them for a
    longer input, so that neither a folder nor a common term is one task's work.
    """
    spark = docs.sparkSession
    terms = persisted(spark, "terms", paths, lambda: (_terms(docs, text), []))

    def postings():
        parts = max(1, -(-size(spark, paths) // (PART * BUCKETS)))
        part = F.pmod(F.xxhash64("sym_id"), F.lit(parts))
        rows = _postings(terms)
        return rows.repartition(BUCKETS * parts, "bucket", part).sortWithinPartitions("bucket", "term", "sym_id"), ["bucket"]

    return _index(persisted(spark, "postings", paths, postings), terms)


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def _weights(hits: DataFrame, index: Bm25Index) -> DataFrame:
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("times") * idf * (K1 + 1) / (1 + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.crossJoin(F.broadcast(index.stats)).withColumn("part", part)


def search(index: Bm25Index, query: str, limit: int | None = 20) -> DataFrame:
    """(sym_id, score) of the best documents for a query; a repeated term counts again.

    Only postings of the query's terms leave the scan; their frequencies are counts of the
    same rows.
    """
    counts = Counter(query_terms(query))
    spark = index.postings.sparkSession
    asked = spark.createDataFrame(list(counts.items()) or [("", 0)], "term string, times int")
    terms = list(counts) or [""]
    folders = [r.b for r in spark.createDataFrame([(t,) for t in terms], "term string").select(bucket("term").alias("b")).distinct().collect()]  # a query's terms
    hits = index.postings.where(F.col("bucket").isin(*folders) & F.col("term").isin(*terms))
    df = document_frequency(hits)
    # As many rows as the query has terms.
    weighted = F.broadcast(asked.join(df, "term"))
    scores = _weights(hits.join(weighted, "term"), index).groupBy("sym_id").agg(F.sum("part").alias("score"))
    return scores.orderBy(F.desc("score"), "sym_id").limit(limit) if limit is not None else scores


def search_many(index: Bm25Index, queries: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, sym_id, score, rank) for a whole table of queries (query_id, query) at once.

    Postings meet the distinct terms asked for, so unasked terms drop out before anything
    is shuffled by document.
    """
    from pyspark.sql import Window as W

    from lodestone.functions.text import SEPARATOR, STOPWORDS

    words = F.filter(F.split(F.lower("query"), SEPARATOR), lambda x: (F.octet_length(x) >= 2) & ~x.isin(*STOPWORDS))
    asked = queries.select("query_id", F.explode(words).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    df = document_frequency(index.postings).join(asked.select("term").distinct(), "term", "left_semi")
    hits = index.postings.drop("bucket").join(df, "term").join(asked, "term")
    scores = _weights(hits, index).groupBy("query_id", "sym_id").agg(F.sum("part").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "sym_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
