"""Approximate nearest neighbours by collision-counting hashing.

Vectors are projected on ``PROJECTIONS`` random lines; on each line the block's vectors
are a sorted array. A query opens a narrow window around its own projection on every line
and widens all windows alike (virtual rehashing: the hash's radius grows, nothing is hashed
anew; only what a window gains is counted). Vectors that fall into enough of the windows
are verified by their exact inner product on the original components.

Two vectors at distance d lie within h of each other on a line with probability
2 Phi(h / d) - 1. The vectors that collide most are verified at once; the k-th best distance
d_k among them says how often a vector that is nearer must collide, and windows of ``STOP`` times d_k are wide
enough to tell: windows are widened to that, or not at all if they are wider, and every
vector is verified that collides no more than ``sigmas`` standard deviations less often than
one at d_k would. How many that
are follows from the data: few in clusters, half of all where all vectors are about as
far apart (and there no index saves much). No number of candidates is set, and none is cut.
``sigmas=inf`` verifies every vector, which is exact.

Largest inner product is turned into least distance by one more component, which fills
every vector up to the greatest norm.

All rows are indexed, in blocks of ``BLOCK``; all queries meet all blocks, so neighbours
are never lost to a block's border.

Edges. Vectors that are null, empty, zero, or hold nulls or non-finite numbers take no
part, as candidates or queries; a null id takes none either. Vectors of another dimension
than the query's are no candidates. Fewer candidates than asked for are all returned. A
query is never its own neighbour, nor is a repeated row of it. Repeated rows are one vector,
as query and as candidate; of different vectors of one id the least stands. Ties are by id.
An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import prepare, stash

PROJECTIONS = 64
BLOCK = 16384
QUERIES = 4096
#: Half a window, over the k-th best distance, at which widening stops: 80 % of collisions.
STOP = 1.2816
#: Half of the first windows, over the greatest norm; and how many times k vectors are verified at once.
START = 0.1
FIRST = 4
SIGMAS = 2.0
SEED = 20
#: Queries whose windows a task holds at a time.
AT_ONCE = 256


def distinct(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One vector of each id, the least, in the order of ids."""
    if len(np.unique(ids)) < len(ids):
        order = np.lexsort((*vectors.T[::-1], ids))
        ids, vectors = ids[order], vectors[order]
    found, first = np.unique(ids, return_index=True)
    return found, vectors[first]


class Block:
    """Sorted arrays of a block's projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, reach: float, sigmas: float = SIGMAS):
        self.ids, self.vectors, self.reach, self.sigmas = ids, vectors, reach, sigmas
        lines = np.random.default_rng(SEED).standard_normal((vectors.shape[1] + 1, PROJECTIONS))
        self.lines = lines[:-1]
        fill = np.sqrt(np.maximum(reach * reach - (vectors * vectors).sum(axis=1), 0.0))
        at = vectors @ self.lines + fill[:, None] * lines[-1]
        self.order = np.ascontiguousarray(np.argsort(at, axis=0, kind="stable").T)
        self.values = np.ascontiguousarray(np.take_along_axis(at, self.order.T, axis=0).T)

    def places(self, queries: np.ndarray) -> np.ndarray:
        """Where each query, as long as the longest vector, falls on each line."""
        return (queries * (self.reach / np.sqrt((queries * queries).sum(axis=1)))[:, None]) @ self.lines

    def windows(self, places: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place in the sorted arrays of every query's window on every line."""
        columns = list(zip(self.values, places.T))
        lo = np.stack([np.searchsorted(v, p - half) for v, p in columns], axis=1)
        return lo, np.stack([np.searchsorted(v, p + half, "right") for v, p in columns], axis=1)

    def widen(self, hits: np.ndarray, lo: np.ndarray, hi: np.ndarray, was_lo: np.ndarray, was_hi: np.ndarray) -> np.ndarray:
        """In how many windows each vector falls, from what narrower ones held; counted from the emptier side."""
        n = len(self.ids)
        inside = int((hi - lo - was_hi + was_lo).sum())
        outside = n * PROJECTIONS - int((hi - lo).sum())
        if inside <= outside:
            parts = [x for o, a, b, c, d in zip(self.order, lo.tolist(), hi.tolist(), was_lo.tolist(), was_hi.tolist()) for x in (o[a:c], o[d:b])]
            return hits + np.bincount(np.concatenate(parts), minlength=n)
        parts = [x for o, a, b in zip(self.order, lo.tolist(), hi.tolist()) for x in (o[:a], o[b:])]
        return PROJECTIONS - np.bincount(np.concatenate(parts), minlength=n)

    def distance(self, score: float, norm: float) -> float:
        """The distance that an inner product with a query of this norm stands for."""
        return math.sqrt(max(0.0, 2 * self.reach * (self.reach - score / norm)))

    def least_hits(self, half: float, distance: float) -> float:
        """Collisions that a vector at this distance reaches, but for the chance of ``sigmas``."""
        if not math.isfinite(self.sigmas):
            return 0.0
        p = math.erf(half / distance / math.sqrt(2)) if distance > 0 else 1.0
        return PROJECTIONS * p - self.sigmas * math.sqrt(PROJECTIONS * p * (1 - p))

    def search(self, owners: np.ndarray, queries: np.ndarray, k: int):
        """(query's number, ids, scores) of the ``k`` best found for each query, best first."""
        if not math.isfinite(self.sigmas):
            everything = np.arange(len(self.ids))
            for i, query in enumerate(queries):
                yield i, *self.nearest(int(owners[i]), query, everything, k)
            return
        n = len(self.ids)
        places, norms = self.places(queries), np.sqrt((queries * queries).sum(axis=1))
        half = np.full(len(queries), START * self.reach)
        held = self.windows(places, np.zeros(len(queries)))[0]
        was_lo, was_hi = held, held.copy()
        hits: dict[int, np.ndarray] = {}
        best: dict[int, float] = {}  # the k-th best distance verified so far
        open_ = np.arange(len(queries))
        while len(open_):
            lo, hi = self.windows(places[open_], half[open_])
            again = []
            for at, i in enumerate(open_.tolist()):
                seen = self.widen(hits.pop(i, 0), lo[at], hi[at], was_lo[i], was_hi[i])
                was_lo[i], was_hi[i] = lo[at], hi[at]
                whole = int((hi[at] - lo[at]).min()) == n
                # The vectors that collide most are verified first: they tell how wide windows need to be.
                most = np.argpartition(seen, n - FIRST * k)[n - FIRST * k :] if n > FIRST * k else np.arange(n)
                scores = self.vectors[most[self.ids[most] != owners[i]]] @ queries[i]
                far = best.get(i, math.inf)
                if len(scores) >= k:
                    far = best[i] = min(far, self.distance(float(np.partition(scores, len(scores) - k)[len(scores) - k]), norms[i]))
                if not whole and half[i] < STOP * far:
                    # The k-th best can only come nearer: no window needs to be wider than it says now.
                    half[i] = STOP * far if math.isfinite(far) else 2 * half[i]
                    hits[i] = seen
                    again.append(i)
                    continue
                rows = np.arange(n) if not math.isfinite(far) else np.flatnonzero(seen >= self.least_hits(half[i], far))
                yield i, *self.nearest(int(owners[i]), queries[i], rows, k)
            open_ = np.array(again, np.int64)

    def nearest(self, own: int, query: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the ``k`` best of the candidate rows, best first."""
        rows = rows[self.ids[rows] != own]
        if len(rows) > k:
            rough = self.vectors[rows] @ query
            cut = np.partition(rough, len(rows) - k)[len(rows) - k]
            rows = rows[rough >= cut - 1e-9 * self.reach * np.sqrt(query @ query)]
        # Summed along each row, so that equal vectors get equal products.
        scores = (self.vectors[rows] * query).sum(axis=1)
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[best]], scores[best]


def _search(k: int, sigmas: float):
    names = ["query_id", "vec_id", "score"]
    kinds = [pa.int64(), pa.int64(), pa.float64()]

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vectors = flat.astype(np.float64).reshape(len(ids), -1)
        out: list[list[np.ndarray]] = [[], [], []]
        if asks.any() and not asks.all():
            block = Block(*distinct(ids[~asks], vectors[~asks]), float(table.column("reach")[0].as_py()), sigmas)
            owners, queries = distinct(ids[asks], vectors[asks])
            for lo in range(0, len(owners), AT_ONCE):
                part = slice(lo, lo + AT_ONCE)
                for i, found, scores in block.search(owners[part], queries[part], k):
                    for column, x in zip(out, (np.full(len(found), owners[lo + i]), found, scores)):
                        column.append(x)
        return pa.Table.from_arrays([pa.array(np.concatenate(x) if x else [], t) for x, t in zip(out, kinds)], names)

    return run


def search(vectors: DataFrame, is_query, k: int = 20, sigmas: float = SIGMAS) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` nearest rows found for each row that ``is_query`` (a Column) marks.

    More ``sigmas`` find more of the true neighbours and verify more vectors; ``inf`` finds all.
    """
    spark = vectors.sparkSession
    prepare(spark)
    usable = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(
        "vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0"
        " AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
        " AND exists(embedding, x -> x <> 0)"
    )
    usable = usable.withColumn("asks", is_query).withColumn("dim", F.size("embedding"))
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    dims = (
        usable.groupBy("dim")
        .agg(F.sqrt(F.max(norm)).alias("reach"), F.count("*").alias("n"), F.sum(F.col("asks").cast("int")).alias("q"))
        .select("dim", "reach", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("q") / QUERIES).cast("int").alias("asked"))
    )
    spread = usable.join(stash(dims, "dims").where("asked > 0"), "dim")
    deal = lambda salt, n: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = spread.select("dim", deal(1, "blocks").alias("block"), every("asked").alias("part"), "vec_id", "embedding", "reach", F.lit(False).alias("asks"))
    asked = spread.where("asks").select("dim", every("blocks").alias("block"), deal(2, "asked").alias("part"), "vec_id", "embedding", "reach", F.lit(True).alias("asks"))
    found = (
        base.unionByName(asked).groupBy("dim", "block", "part").applyInArrow(_search(k, sigmas), "query_id long, vec_id long, score double")
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
