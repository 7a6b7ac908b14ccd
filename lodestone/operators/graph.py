"""Graph operators over edge tables.

Frontiers, visited sets and paths are tables; each hop is one join, written out, so that a
long walk neither grows its plan nor redoes earlier hops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.storage import stash


def callers(edges: DataFrame, definitions: DataFrame, name: str) -> DataFrame:
    """Definitions that call ``name`` (any case): (name, path, def_line, line of the first call site)."""
    hits = edges.where(F.lower("callee") == name.lower())
    joined = hits.join(definitions, hits["caller_id"] == definitions["def_id"])
    return joined.groupBy("name", "path", "def_line").agg(F.min_by("line", "edge_id").alias("line"))


def callees(edges: DataFrame, definitions: DataFrame, name: str) -> DataFrame:
    """Definitions of what any definition called ``name`` calls."""
    own = definitions.where(F.lower("name") == name.lower()).select(F.col("def_id").alias("caller_id"))
    called = edges.join(own, "caller_id", "left_semi").select(F.lower("callee").alias("key")).distinct()
    return definitions.withColumn("key", F.lower("name")).join(called, "key", "left_semi").select("name", "path", "def_line")


def indegree(edges: DataFrame, definitions: DataFrame, top: int | None = None) -> DataFrame:
    """Definitions by the number of distinct callers of their name."""
    counts = edges.groupBy("callee").agg(F.countDistinct("caller_id").alias("indegree"))
    joined = counts.withColumn("key", F.lower("callee")).join(definitions.withColumn("key", F.lower("name")), "key")
    out = joined.select("name", "path", "def_line", "indegree")
    return out.orderBy(F.desc("indegree"), "name", "path", "def_line").limit(top) if top else out


def reach(edges: DataFrame, start: DataFrame, max_depth: int, min_depth: int = 1) -> DataFrame:
    """(node, depth): nodes that ``edges`` (src, dst) lead to from ``start`` (node), at first discovery.

    The starts themselves are left out. Every hop drops what was seen before.
    """
    e = edges.select("src", "dst").distinct()
    seen = stash(start.select("node").distinct().withColumn("depth", F.lit(0)), "reach")
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.select(F.col("node").alias("src")).join(e, "src").select(F.col("dst").alias("node")).distinct()
        frontier = stash(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "hop")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where(F.col("depth") >= min_depth)


def reachable(edges: DataFrame, target, max_depth: int = 6, limit: int | None = 200) -> DataFrame:
    """(node, depth): everything that calls ``target`` directly or over others."""
    spark = edges.sparkSession
    flip = edges.select(F.col("callee").alias("src"), F.col("caller").alias("dst"))
    start = spark.range(1).select(F.lit(target).alias("node"))
    out = reach(flip, start, max_depth)
    return out.orderBy("depth", "node").limit(limit) if limit is not None else out


def simple_paths(edges: DataFrame, source, target, max_hops: int = 6, max_paths: int | None = 50) -> DataFrame:
    """(path, hops): chains of calls from ``source`` to ``target`` without a repeated node."""
    e = edges.select(F.col("caller").alias("a"), F.col("callee").alias("b")).distinct()
    if source == target:
        return e.select(F.array("a").alias("path"), F.lit(0).alias("hops")).limit(0)
    # Only nodes from which the target can still be reached in the hops left are walked.
    back = edges.select(F.col("callee").alias("src"), F.col("caller").alias("dst"))
    far = reach(back, e.sparkSession.range(1).select(F.lit(target).alias("node")), max_hops, 0).select(F.col("node").alias("b"), "depth")
    useful = stash(e.join(far, "b"), "useful")
    paths = useful.where(F.col("a") == F.lit(source)).select(F.array("a", "b").alias("path"), F.col("b").alias("tail"), "depth")
    found = None
    for hops in range(1, max_hops + 1):
        paths = stash(paths.where(F.col("depth") <= max_hops - hops), "paths")
        done = paths.where(F.col("tail") == F.lit(target)).select("path", F.lit(hops).alias("hops"))
        found = done if found is None else found.unionByName(done)
        paths = (
            paths.where(F.col("tail") != F.lit(target)).select("path", F.col("tail").alias("a")).join(useful, "a")
            .where(~F.array_contains("path", F.col("b")))
            .select(F.concat("path", F.array("b")).alias("path"), F.col("b").alias("tail"), "depth")
        )
    return found.orderBy("hops", "path").limit(max_paths) if max_paths is not None else found


def subtypes(hierarchy: DataFrame, parent, max_depth: int = 64) -> DataFrame:
    """(node, depth): types below ``parent`` by extension or implementation, not by use."""
    e = hierarchy.where("kind <> 'uses'").select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    return reach(e, e.sparkSession.range(1).select(F.lit(parent).alias("node")), max_depth)


def implementations(hierarchy: DataFrame, parent) -> DataFrame:
    """(child, relation): direct children of a type, uses included."""
    label = F.when(F.col("kind") == "uses", "uses").when(F.col("kind") == "implements", "implements").otherwise("extends")
    return hierarchy.where(F.col("parent") == F.lit(parent)).select("child", label.alias("relation"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that every node of ``edges`` (a, b) reaches.

    Alternating star contraction: larger neighbours, then smaller ones, are hung on a node's
    least neighbour, until nothing changes. Joins read plain tables, so that a hub's
    neighbours can be split between tasks.
    """

    def contract(e: DataFrame, large: bool) -> DataFrame:
        pairs = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = stash(pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        seen = pairs.join(least, "a")
        if large:
            out = seen.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = seen.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return stash(out.where("a <> b").distinct(), "star")

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = stash(ordered, "edges")
    before = sign(e)
    while before[0]:
        e = contract(contract(e, True), False)
        after = sign(e)
        if after == before:
            break
        before = after
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
