"""Regular-expression scans of lines, with trigram skipping."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.trigrams import blooms, may_match
from lodestone.sources.storage import persisted

LARGEST = 1 << 20


def lines(files: DataFrame) -> DataFrame:
    """(path, line, text) of files (path, text), lines from 1, a trailing carriage return dropped."""
    split = F.posexplode(F.split("text", "\n")).alias("at", "raw")
    return files.select("path", split).select("path", (F.col("at") + 1).alias("line"), F.regexp_replace("raw", "\r$", "").alias("text"))


def trigram_index(files: DataFrame) -> DataFrame:
    """(path, length, bloom, text) of files; the length tells whether an entry is still good."""
    return files.select("path", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(blooms, "path string, length int, bloom binary, text string")


def open_index(files: DataFrame, paths: list[str]) -> DataFrame:
    """The trigram index of ``files``, which come from the files below ``paths``: written once, then opened."""
    return persisted(files.sparkSession, "trigrams", paths, lambda: (trigram_index(files), []))


def grep_indexed(index: DataFrame, pattern: str, limit: int | None = None) -> DataFrame:
    """As ``grep``, over an index that holds the texts beside their blooms.

    What a bloom rules out is dropped before its text is looked at, without a join.
    """
    return grep(index.where(may_match(F.col("bloom"), pattern)).select("path", "text"), pattern, limit=limit)


def grep(files: DataFrame, pattern: str, index: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(path, line, text) of lines that match; files beyond 1 MiB are left out.

    With an index of earlier states, a file is skipped before it is split if its entry is
    current and lacks a trigram that every match needs. Files without a current entry are
    always read.
    """
    files = files.where(F.octet_length("text") <= LARGEST)
    if index is not None:
        known = index.select("path", F.col("length").alias("_length"), "bloom")
        files = files.join(known, "path", "left").where(
            F.col("bloom").isNull() | (F.col("_length") != F.octet_length("text")) | may_match(F.col("bloom"), pattern)
        ).select("path", "text")
    elif not re.search(r"[\^$]|\\[AbBZz]", pattern):
        files = files.where(F.col("text").rlike(f"(?m){pattern}"))
    hits = lines(files).where(F.col("text").rlike(pattern)).select("path", "line", F.trim("text").alias("text"))
    return hits.orderBy("path", "line").limit(limit) if limit is not None else hits


def grep_word(files: DataFrame, name: str, **kwargs) -> DataFrame:
    """Lines with the name as a whole word."""
    return grep(files, rf"\b{re.escape(name)}\b", **kwargs)
