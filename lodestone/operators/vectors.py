"""Vector search: exact scans, blocked joins, and a locality-sensitive option."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.similarity import cosine, normalised

#: Vectors of a block of a search, and of one where pairs are looked for; pairs of texts that are compared together.
BLOCK, PAIR_BLOCK, PAIRS = 4096, 16384, 128
IDENTIFIER = re.compile("[a-z0-9_]+")


def search_exact(vectors: DataFrame, query: list[float], k: int, threshold: float | None = None) -> DataFrame:
    """The ``k`` rows (id, embedding) with the highest cosine to ``query``; ties by id."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.where("embedding IS NOT NULL").select("id", cosine(F.col("embedding"), q).alias("similarity"))
    if threshold is not None:
        scored = scored.where(F.col("similarity") >= threshold)
    return scored.orderBy(F.desc("similarity"), "id").limit(k)


def _unit(vectors: DataFrame) -> DataFrame:
    return vectors.where("embedding IS NOT NULL").select("id", normalised(F.col("embedding")).alias("embedding"))


def _best(k: int, threshold: float | None, others: bool, buckets=None):
    """The best of a block; with ``buckets`` (a function of unit vectors) among rows that share one with the query."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asked, rows = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        out = [pd.DataFrame({"query_id": [], "id": [], "similarity": []})]
        if len(asked) and len(rows):
            x, ids = np.stack(rows["embedding"].tolist()), rows["id"].to_numpy()
            at_rows = None if buckets is None else buckets(x)
            for q, v in zip(asked["id"], asked["embedding"]):
                s = x @ np.asarray(v)
                ok = np.ones(len(s), bool) if threshold is None else s >= threshold
                if buckets is not None:
                    ok &= (at_rows == buckets(np.asarray(v)[None, :])).any(axis=1)
                at = np.flatnonzero(ok & (ids != q) if others else ok)
                at = at[np.lexsort((ids[at], -np.round(s[at], 12)))[:k]]
                out.append(pd.DataFrame({"query_id": q, "id": ids[at], "similarity": s[at]}))
        return pd.concat(out)

    return run


def search_many(vectors: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, others: bool = False) -> DataFrame:
    """(query_id, id, similarity, rank): the ``k`` rows with the highest cosine to each of ``queries`` (id, embedding).

    Exact: rows and queries are dealt to blocks, every block of rows meets every block of
    queries as one product of matrices, and a block's best are ranked with the others'.
    """
    return _ranked(vectors, queries, k, _best(k, threshold, others))


def _ranked(vectors: DataFrame, queries: DataFrame, k: int, best) -> DataFrame:
    """The ``k`` best rows of each query, from those that ``best`` finds in each pair of blocks."""
    rows, asked = _unit(vectors), _unit(queries)
    n, q = max(1, -(-vectors.count() // BLOCK)), max(1, -(-queries.count() // BLOCK))
    own = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = rows.select("id", "embedding", own(n).alias("r"), every(q).alias("c"), F.lit(False).alias("asks"))
    right = asked.select("id", "embedding", every(n).alias("r"), own(q).alias("c"), F.lit(True).alias("asks"))
    found = left.unionByName(right).groupBy("r", "c").applyInPandas(best, "query_id long, id long, similarity double")
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 12)), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similar_to(vectors: DataFrame, seeds: DataFrame, k: int = 10, threshold: float = 0.5) -> DataFrame:
    """(query_id, id, similarity, rank): rows nearest to each of the rows ``seeds``, itself left out."""
    return search_many(vectors, seeds, k, threshold, others=True)


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a table (id, embedding)."""
    x = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(table), -1)
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return table.column("id").to_numpy(), x / np.where(n == 0, 1, n)


def _pairs(threshold: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        r, c = (k.as_py() for k in key)
        a, x = _matrix(table.filter(pc.equal(table.column("own"), r)))
        b, y = (a, x) if r == c else _matrix(table.filter(pc.equal(table.column("own"), c)))
        out = []
        for lo in range(0, len(a) if len(b) else 0, 512):
            s = x[lo : lo + 512] @ y.T
            i, j = np.nonzero((s >= threshold) & (a[lo : lo + 512, None] < b[None, :]) if r == c else s >= threshold)
            one, two = a[lo + i], b[j]
            out.append(pa.table({"a": np.minimum(one, two), "b": np.maximum(one, two), "similarity": s[i, j]}))
        return pa.concat_tables(out) if out else pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})

    return run


def near_pairs(vectors: DataFrame, threshold: float, blocks: int | None = None) -> DataFrame:
    """(a, b, similarity) of all pairs at or above the threshold, exactly.

    Vectors are dealt to blocks; a task gets two blocks and multiplies their matrices. Two blocks
    meet once, so a vector travels, as it is stored, as often as there are blocks, and no task
    holds more than two of them.
    """
    if blocks is None:
        blocks = max(1, -(-vectors.count() // PAIR_BLOCK))
    own = vectors.where("embedding IS NOT NULL").select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own"))
    met = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    cells = met.select("id", "embedding", "own", F.least("own", "other").alias("r"), F.greatest("own", "other").alias("c"))
    return cells.groupBy("r", "c").applyInArrow(_pairs(threshold), "a long, b long, similarity double")


def duplicates(vectors: DataFrame, lines: DataFrame, threshold: float = 0.9, min_lines: int = 5, limit: int = 20) -> DataFrame:
    """The closest pairs whose bodies (id, lines) both have enough lines."""
    long = lines.where(F.col("lines") >= min_lines).select("id")
    able = vectors.join(long, "id", "left_semi")
    return near_pairs(able, threshold).orderBy(F.desc("similarity"), "a", "b").limit(limit)


def search_lsh(vectors: DataFrame, queries: DataFrame, k: int, tables: int = 24, width: float = 0.75) -> DataFrame:
    """(query_id, id, similarity, rank): approximate neighbours of ``queries`` (id, embedding).

    Unit vectors fall into buckets by random projections; a query meets the rows that share a
    bucket with it in any table, and those are ranked by their exact cosines. Buckets hold a
    share of all rows, so rows and queries are dealt to blocks, as for an exact search, and
    buckets are compared within them: what meets is never a row of a table.
    """
    lines = np.random.default_rng(7).standard_normal((len(vectors.where("embedding IS NOT NULL").first().embedding), tables))
    shift = np.random.default_rng(8).random(tables) * width

    def buckets(x: np.ndarray) -> np.ndarray:
        return np.floor((x @ lines + shift) / width).astype(np.int32)

    return _ranked(vectors, queries, k, _best(k, None, False, buckets))


def body_lines(symbols: DataFrame) -> DataFrame:
    """Lines up to the next symbol of the file; the last one has no end (null)."""
    order = W.partitionBy("path").orderBy("line", "sym_id")
    return symbols.withColumn("lines", F.lead("line").over(order) - F.col("line"))


def _alike(a: str, b: str) -> float:
    """The Jaccard similarity of the identifiers of two texts in lower case."""
    x, y = ({w for w in IDENTIFIER.findall(t) if len(w) > 1} for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


def _lower(text: str) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _compared(pairs: DataFrame, texts: list[Column], made: dict[str, str], compare) -> DataFrame:
    """``pairs`` with what ``compare`` makes of the texts (columns and types ``made``) in place of text_a and text_b.

    Workers take ``PAIRS`` pairs at a time, and no text goes back.
    """
    keep, n = [c for c in pairs.columns if c not in ("text_a", "text_b")], len(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, PAIRS) for whole in batches for at in range(0, whole.num_rows, PAIRS)):
            found = [compare(*(t.as_py() for t in row)) for row in zip(*b.columns[:n])]
            columns = [pa.array([f[k] for f in found], pa.float64() if t == "double" else pa.int64()) for k, t in enumerate(made.values())]
            yield pa.RecordBatch.from_arrays([*b.columns[n:], *columns], [*b.schema.names[n:], *made])

    sent = pairs.select(*(t.alias(f"_text{i}") for i, t in enumerate(texts)), *keep)
    return sent.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in (*sent.dtypes[n:], *made.items())))


def pair_jaccard(pairs: DataFrame) -> DataFrame:
    """``pairs`` (text_a, text_b) with the Jaccard similarity of their identifiers, in place of the texts; no diff is made."""
    return _compared(pairs, [_lower("text_a"), _lower("text_b")], {"jaccard": "double"}, lambda a, b: (_alike(a, b),))


def changed_lines(a: str | None, b: str | None) -> tuple[int, int]:
    """How many lines a diff of two texts adds and drops, without writing it."""
    import difflib

    steps = difflib.SequenceMatcher(None, (a or "").split("\n"), (b or "").split("\n")).get_opcodes()
    changed = [s for s in steps if s[0] != "equal"]
    return sum(j2 - j1 for *_, j1, j2 in changed), sum(i2 - i1 for _, i1, i2, *_ in changed)


def explain_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` (text_a, text_b) with identifier Jaccard and the lines that a diff adds and drops, in place of the texts."""
    texts = [F.col("text_a"), F.col("text_b"), _lower("text_a"), _lower("text_b")]
    return _compared(pairs, texts, {"jaccard": "double", "added": "long", "removed": "long"}, lambda a, b, x, y: (_alike(x, y), *changed_lines(a, b)))
