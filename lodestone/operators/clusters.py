"""Communities of a symbol graph: projection, Leiden under the constant Potts model, reports."""

from __future__ import annotations

from collections import deque
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Weights of a site by kind, the cap on a pair, and the resolution as a fraction.
SITE_WEIGHT = {"call": 2, "ref_call": 2, "ref": 1, "hierarchy": 1}
PAIR_CAP = 8
GAMMA = (1, 8)
MAX_RUNS, MAX_LEVELS = 4, 32


def project(sites: DataFrame) -> DataFrame:
    """(a, b, w): undirected weights from sites (from_sym, to_sym, path, line, source, seq).

    One site of a file, line and target counts once, the earliest first; hierarchy edges are
    not weighed against sites. Loops drop; a pair weighs ``PAIR_CAP`` at most.
    """
    weight = F.lit(0)
    for kind, w in SITE_WEIGHT.items():
        weight = F.when(F.col("source") == kind, w).otherwise(weight)
    spots = sites.where("source <> 'hierarchy'").groupBy("path", "line", "to_sym").agg(F.min_by(F.struct("from_sym", "source"), "seq").alias("s"))
    rows = spots.select("s.from_sym", "to_sym", "s.source").unionByName(sites.where("source = 'hierarchy'").select("from_sym", "to_sym", "source"))
    pair = rows.where("from_sym <> to_sym").select(F.least("from_sym", "to_sym").alias("a"), F.greatest("from_sym", "to_sym").alias("b"), weight.alias("w"))
    return pair.groupBy("a", "b").agg(F.least(F.sum("w"), F.lit(PAIR_CAP)).alias("w"))


class _Level:
    """A weighted graph whose nodes stand for ``size`` original ones; all arithmetic is integer.

    Neighbours of a node are ``near[start[v] : start[v + 1]]`` in order, with weights beside them.
    """

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, size: np.ndarray):
        """Edges must be there in both directions; repeated ones add up."""
        key = a.astype(np.int64) * n + b
        order = np.argsort(key, kind="stable")
        key, w = key[order], w[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.n, self.size = n, size
        self.near, self.weight = (key[first] % n).astype(np.int32 if n < 1 << 31 else np.int64), np.add.reduceat(w, first) if len(key) else w
        self.row = key[first] // n
        self.start = np.searchsorted(self.row, np.arange(n + 1))

    def move(self, part: list[int]) -> list[int]:
        """Move nodes, first come first served, to the community that gains most, the least one of equals."""
        num, den = GAMMA
        total = np.bincount(np.asarray(part, np.int64), self.size, self.n).astype(np.int64).tolist()
        size, start, near, weight = self.size.tolist(), self.start.tolist(), memoryview(self.near), memoryview(self.weight)
        waiting, queued = deque(range(self.n)), bytearray(b"\1") * self.n
        empty = [c for c in range(self.n) if total[c] == 0]  # in order, so a heap
        while waiting:
            v = waiting.popleft()
            queued[v] = 0
            own, s = part[v], size[v]
            at, stop = start[v], start[v + 1]
            around = near[at:stop].tolist()
            to: dict[int, int] = {}
            for u, w in zip(around, weight[at:stop].tolist()):
                c = part[u]
                to[c] = to.get(c, 0) + w
            while empty and total[empty[0]]:
                heappop(empty)
            cost = num * s
            # What the own community is worth without the node; others must be worth more.
            best, worth = own, den * to.pop(own, 0) - cost * (total[own] - s)
            if empty and worth < 0:
                best, worth = empty[0], 0
            for c, w in to.items():
                g = den * w - cost * total[c]
                if g > worth or (g == worth and best != own and c < best):
                    best, worth = c, g
            if best != own:
                total[own] -= s
                total[best] += s
                part[v] = best
                if total[own] == 0:
                    heappush(empty, own)
                for u in around:
                    if part[u] != best and not queued[u]:
                        waiting.append(u)
                        queued[u] = 1
        return part

    def refine(self, part: list[int]) -> list[int]:
        """Within each community, merge lone well-connected nodes into well-connected groups."""
        num, den = GAMMA
        fine, of = list(range(self.n)), np.asarray(part, np.int64)
        same = of[self.row] == of[self.near]
        inside = np.bincount(self.row[same], self.weight[same], self.n).astype(np.int64).tolist()
        whole = np.bincount(of, self.size, self.n).astype(np.int64)[of].tolist()
        size, start, near, weight = self.size.tolist(), self.start.tolist(), memoryview(self.near), memoryview(self.weight)
        total, count, cut = list(size), bytearray(b"\1") * self.n, list(inside)
        # Only a lone node (1) moves; a group (2) and a node that has gone (0) stay.
        for v in np.argsort(of, kind="stable").tolist():
            s, c = size[v], part[v]
            if count[v] != 1 or den * inside[v] < num * s * (whole[v] - s):
                continue
            to: dict[int, int] = {}
            at, stop = start[v], start[v + 1]
            for u, w in zip(near[at:stop].tolist(), weight[at:stop].tolist()):
                if part[u] == c:
                    t = fine[u]
                    to[t] = to.get(t, 0) + w
            best, gain = None, -1
            for t, w in to.items():
                if den * cut[t] >= num * total[t] * (whole[v] - total[t]):
                    g = den * w - num * s * total[t]
                    if g >= 0 and (g > gain or (g == gain and t < best)):
                        best, gain = t, g
            if best is not None:
                fine[v] = best
                total[best] += s
                count[best], count[v] = 2, 0
                cut[best] += inside[v] - 2 * to[best]
        return fine

    def shrink(self, fine: list[int], part: list[int]) -> tuple["_Level", np.ndarray, list[int]]:
        """The graph of refined groups, where each node went, and the unrefined partition on it."""
        at = _numbered(fine)
        n = int(at.max()) + 1
        a, b = at[self.row], at[self.near]
        apart = a != b
        size = np.bincount(at, self.size, n).astype(np.int64)
        of = np.asarray(part, np.int64)
        seed = np.zeros(n, np.int64)
        seed[at] = at[_first(of)[of]]
        return _Level(n, a[apart], b[apart], self.weight[apart], size), at, seed.tolist()


def _first(groups: np.ndarray) -> np.ndarray:
    """By group, which is a number below their count, the first place of it."""
    out = np.zeros(len(groups), np.int64)
    out[groups[::-1]] = np.arange(len(groups))[::-1]
    return out


def _numbered(groups: list[int]) -> np.ndarray:
    """Groups numbered in order of first sight."""
    of = np.asarray(groups, np.int64)
    head = _first(of)[of] == np.arange(len(of))
    return (np.cumsum(head) - 1)[_first(of)[of]]


def leiden(n: int, edges: list[tuple[int, int, int]] | np.ndarray) -> list[int]:
    """Community (least member) of each of ``n`` nodes; the same for the same graph, always.

    A step costs what its neighbours are many, and a logarithm for the least empty community,
    so that a run is in proportion to the edges, but for the number of moves.
    """
    e = np.asarray(edges, np.int64).reshape(-1, 3)
    e = e[e[:, 0] != e[:, 1]]
    whole = _Level(n, np.r_[e[:, 0], e[:, 1]], np.r_[e[:, 1], e[:, 0]], np.r_[e[:, 2], e[:, 2]], np.ones(n, np.int64))
    part = list(range(n))
    for _ in range(MAX_RUNS):
        level, at, now = whole, np.arange(n), list(part)
        for _ in range(MAX_LEVELS):
            now = level.move(now)
            if len(set(now)) == level.n:
                break
            nxt, up, seed = level.shrink(level.refine(now), now)
            if nxt.n == level.n:
                break
            at = up[at]
            level, now = nxt, seed
        found = np.asarray(now, np.int64)[at]
        after = _first(found)[found].tolist()
        if after == part:
            break
        part = after
    return part


def _run_leiden(table: pa.Table) -> pa.Table:
    a, b, w = (table.column(c).to_numpy() for c in ("a", "b", "w"))
    nodes = np.unique(np.r_[a, b])
    part = leiden(len(nodes), np.stack([np.searchsorted(nodes, a), np.searchsorted(nodes, b), w], axis=1))
    return pa.table({"sym_id": nodes, "community": nodes[part]})


def communities(graph: DataFrame, by_component: bool = False) -> DataFrame:
    """(sym_id, community) of a projected graph (a, b, w).

    The whole graph goes to one task, as its order of moves is one sequence. With
    ``by_component`` each connected component is a task of its own, which scales with the
    number of components; results are as good but need not be the same.
    """
    out = "sym_id long, community long"
    if not by_component:
        return graph.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(_run_leiden, out)
    from lodestone.operators.graph import connected_components

    roots = connected_components(graph.select("a", "b")).select(F.col("node").alias("a"), "root")
    return graph.join(roots, "a").groupBy("root").applyInArrow(lambda table: _run_leiden(table), out)


def finalise(found: DataFrame) -> DataFrame:
    """(sym_id, cluster_id, status): communities of two or more, numbered by their least member."""
    size = F.count("*").over(W.partitionBy("community"))
    sized = found.withColumn("n", size)
    big = sized.where("n > 1").select("community").distinct()
    numbered = big.withColumn("cluster_id", F.row_number().over(W.orderBy("community")) - 1)  # clusters, not symbols
    return sized.join(numbered, "community", "left").select(
        "sym_id", "cluster_id", F.when(F.col("n") > 1, "clustered").otherwise("unclustered").alias("status")
    )


def cluster_weights(graph: DataFrame, assigned: DataFrame) -> DataFrame:
    """(cluster_id, size, internal, cut, cohesion) of every cluster."""
    a = assigned.where("cluster_id IS NOT NULL").select("sym_id", "cluster_id")
    ends = graph.join(assigned.select(F.col("sym_id").alias("a"), F.col("cluster_id").alias("ca")), "a", "left").join(
        assigned.select(F.col("sym_id").alias("b"), F.col("cluster_id").alias("cb")), "b", "left"
    )
    same = F.col("ca") == F.col("cb")
    inner = ends.where(same).groupBy(F.col("ca").alias("cluster_id")).agg(F.sum("w").alias("internal"))
    across = ends.where(F.coalesce(~same, F.lit(True)))
    cut = (
        across.select(F.col("ca").alias("cluster_id"), "w").unionByName(across.select(F.col("cb").alias("cluster_id"), "w"))
        .where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.sum("w").alias("cut"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = a.groupBy("cluster_id").agg(F.count("*").alias("size")).join(inner, "cluster_id", "left").join(cut, "cluster_id", "left")
    out = out.select("cluster_id", "size", zero("internal"), zero("cut"))
    return out.withColumn("cohesion", cohesion(F.col("internal"), F.col("cut")))


def cohesion(internal, cut):
    """The share of a cluster's weight that stays inside, to four places; 0 without any weight."""
    return F.when(internal + cut == 0, F.lit(0.0)).otherwise(F.round(internal / F.when(internal + cut > 0, internal + cut), 4))


def hubs(graph: DataFrame, assigned: DataFrame, n: int = 3) -> DataFrame:
    """(cluster_id, sym_id, rank): the members with most weight inside their cluster."""
    both = graph.select("a", "b", "w").unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    a, b = (assigned.select(F.col("sym_id").alias(c), F.col("cluster_id").alias(f"c{c}")) for c in "ab")
    inner = both.join(a, "a").join(b, "b").where("ca = cb").groupBy("ca", "a").agg(F.sum("w").alias("w"))
    order = W.partitionBy("ca").orderBy(F.desc("w"), "a")
    return inner.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(
        F.col("ca").alias("cluster_id"), F.col("a").alias("sym_id"), "rank"
    )


def labels(assigned: DataFrame, symbols: DataFrame) -> DataFrame:
    """(cluster_id, label): the deepest directory of three fifths of the members, else the top one, mixed."""
    from lodestone.functions.text import ancestors

    m = assigned.where("cluster_id IS NOT NULL").join(symbols.select("sym_id", "path"), "sym_id")
    size = m.groupBy("cluster_id").agg(F.count("*").alias("n"))
    held = (
        m.select("cluster_id", F.explode(ancestors(F.col("path"))).alias("dir")).where("dir <> '.'").groupBy("cluster_id", "dir").agg(F.count("*").alias("k"))
    )
    depth = F.size(F.split("dir", "/"))
    deep = held.join(size, "cluster_id").where("5 * k >= 3 * n").groupBy("cluster_id").agg(F.max_by("dir", F.struct(depth, "k", "dir")).alias("deep"))
    top = held.where(depth == 1).groupBy("cluster_id").agg(F.min_by("dir", F.struct(-F.col("k"), "dir")).alias("top"))
    out = size.join(deep, "cluster_id", "left").join(top, "cluster_id", "left")
    return out.select("cluster_id", F.coalesce("deep", F.concat(F.lit("(mixed) "), "top", F.lit("/")), F.lit("(mixed) ./")).alias("label"))


def carry_forward(old: DataFrame, symbols: DataFrame) -> DataFrame:
    """Assignments (path, name, kind, cluster_id) on the symbols of now; new symbols are ``new``."""
    key = ["path", "name", "kind"]
    one = old.groupBy(*key).agg(F.min("cluster_id").alias("cluster_id"), F.lit(True).alias("known"))
    return symbols.join(one, key, "left").select(
        "sym_id",
        "cluster_id",
        F.when(F.col("known").isNull(), "new").when(F.col("cluster_id").isNull(), "unclustered").otherwise("clustered").alias("status"),
    )


def modules(summary: DataFrame, min_size: int = 3, by: str = "size") -> DataFrame:
    """Clusters of enough members by size, or by cohesion compared as exact fractions."""
    rows = summary.where(F.col("size") >= min_size)
    if by == "size":
        return rows.orderBy(F.desc("size"), "cluster_id")
    whole = F.col("internal") + F.col("cut")
    exact = F.when(whole > 0, F.col("internal").cast("decimal(20,0)") / whole.cast("decimal(20,0)")).otherwise(F.lit(0))
    return rows.orderBy(F.desc(exact), "cluster_id")
