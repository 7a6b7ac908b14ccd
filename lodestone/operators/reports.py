"""Composite reports: usages, impact, bundles, coverage, workspaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import framework, is_doc_path, is_test_path
from lodestone.functions.text import ancestors, looks_like_test
from lodestone.operators import graph


def usages(refs: DataFrame, symbols: DataFrame, name: str, docs: bool = False, limit: int | None = 50) -> DataFrame:
    """(path, line, context): references of a name, without its definition's own lines and prose."""
    rows = refs.where(F.col("name") == name)
    if not docs:
        rows = rows.where(~is_doc_path(F.col("path")))
    sites = symbols.where(F.col("name") == name).select("path", "line").distinct()
    rows = rows.join(sites, ["path", "line"], "left_anti").select("path", "line", "context")
    return rows.orderBy("path", "line").limit(limit) if limit is not None else rows


def usage_suggestions(refs: DataFrame, prefix: str, limit: int = 5) -> DataFrame:
    """Names of references that start with ``prefix``, for when a name has no usages."""
    return refs.where(F.col("name").startswith(prefix)).select("name").distinct().orderBy("name").limit(limit)


def verdict(channels: DataFrame, binder_available: bool) -> DataFrame:
    """One row (binder_hits, text_hits, verdict) from channel rows (channel, tier).

    Hits of the binder's tier make a change unsafe; hits of text alone, or no binder at all,
    leave it uncertain.
    """
    hit = lambda tier: F.coalesce(F.sum(F.when(F.col("tier") == tier, 1).otherwise(0)), F.lit(0))
    got = channels.agg(hit("binder").alias("binder_hits"), hit("text").alias("text_hits"))
    return got.withColumn(
        "verdict",
        F.when(F.col("binder_hits") > 0, "unsafe").when((F.col("text_hits") > 0) | F.lit(not binder_available), "uncertain").otherwise("safe"),
    )


def impact(channels: dict[str, tuple[str, DataFrame]], binder_available: bool = True) -> tuple[DataFrame, DataFrame]:
    """(per-channel counts, verdict) from channels: name -> (tier, rows with path and line)."""
    every = None
    for name, (tier, rows) in channels.items():
        one = rows.select(F.lit(name).alias("channel"), F.lit(tier).alias("tier"), "path", F.col("line").cast("long").alias("line"))
        every = one if every is None else every.unionByName(one)
    counts = every.groupBy("channel", "tier").agg(F.count("*").alias("hits"), F.min(F.struct("path", "line")).alias("sample"))
    return counts, verdict(every, binder_available)


def tests_for(edges: DataFrame, definitions: DataFrame, target, max_depth: int = 6, fixtures: bool = False) -> DataFrame:
    """(node, path, framework, depth): tests that reach ``target``; with ``fixtures`` what they call in test paths too.

    ``definitions`` has node, name and path; ``edges`` caller and callee nodes.
    """
    found = graph.reachable(edges, target, max_depth, None).join(definitions, "node").where(is_test_path(F.col("path")))
    tests = found.where(looks_like_test(F.col("name")))
    out = tests.select("node", "path", framework(F.col("path")).alias("framework"), "depth")
    if fixtures:
        called = edges.join(tests.select(F.col("node").alias("caller"), "depth"), "caller").select(F.col("callee").alias("node"), (F.col("depth") + 1).alias("depth"))
        helpers = called.join(definitions, "node").where(is_test_path(F.col("path"))).join(tests.select("node"), "node", "left_anti")
        helpers = helpers.groupBy("node", "path").agg(F.min("depth").alias("depth"))
        out = out.unionByName(helpers.select("node", "path", framework(F.col("path")).alias("framework"), "depth"))
    return out


def directory_tree(symbols: DataFrame) -> DataFrame:
    """(dir, symbols): how many symbols lie at or below every directory."""
    return symbols.groupBy("path").agg(F.count("*").alias("n")).select(F.explode(ancestors(F.col("path"))).alias("dir"), "n").groupBy("dir").agg(
        F.sum("n").alias("symbols")
    )


def coverage(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """(lang, files, indexed, missing): files by language and how many of them are indexed."""
    known = indexed.select("path").distinct().withColumn("known", F.lit(1))
    return files.join(known, "path", "left").groupBy("lang").agg(
        F.count("*").alias("files"), F.count("known").alias("indexed"), (F.count("*") - F.count("known")).alias("missing")
    )


def bundle_symbol(parts: dict[str, DataFrame], limit: int = 20) -> DataFrame:
    """(role, name, path, line, more): up to ``limit`` rows of each role, and whether there were more."""
    out = None
    for role, rows in parts.items():
        probe = rows.select(F.lit(role).alias("role"), "name", "path", F.col("line").cast("long").alias("line")).orderBy("name", "path", "line").limit(limit + 1)
        out = probe if out is None else out.unionByName(probe)
    from pyspark.sql import Window as W

    # At most limit + 1 rows of each role are left here.
    w = W.partitionBy("role")
    n = F.row_number().over(w.orderBy("name", "path", "line"))
    more = F.count("*").over(w) > limit
    return out.select("*", n.alias("n"), more.alias("more")).where(F.col("n") <= limit).drop("n")


def pr_impact(changed: DataFrame, edges: DataFrame, definitions: DataFrame, max_depth: int = 2, budget: int = 5000) -> DataFrame:
    """(node, path, depth, is_test): what reaches the definitions (node, path) of changed paths."""
    start = definitions.join(changed, "path", "left_semi").select("node")
    flip = edges.select(F.col("callee").alias("src"), F.col("caller").alias("dst"))
    found = graph.reach(flip, start, max_depth).orderBy("depth", "node").limit(budget)
    return found.join(definitions, "node").select("node", "path", "depth", is_test_path(F.col("path")).alias("is_test"))


def workspace(members: dict[str, DataFrame]) -> DataFrame:
    """The union of the members' rows with the member's name in ``repo``."""
    out = None
    for repo, rows in members.items():
        one = rows.withColumn("repo", F.lit(repo))
        out = one if out is None else out.unionByName(one)
    return out


def status(relations: dict[str, DataFrame]) -> DataFrame:
    """(relation, rows): the size of every relation."""
    out = None
    for name, df in relations.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("relation"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


#: What a caller may rely on.
CAPABILITIES = ("search", "usages", "grep", "pattern", "callers", "callees", "reachable", "paths", "subtypes", "implementations", "modules", "similar", "duplicates", "history", "diff", "impact", "bundle", "eval", "watch")


def capabilities(spark) -> DataFrame:
    return spark.createDataFrame([(c,) for c in CAPABILITIES], "capability string")


def envelope(rows: DataFrame, command: str) -> DataFrame:
    """Each row as a JSON line with protocol, command and row."""
    return rows.select(F.to_json(F.struct(F.lit(1).alias("protocol"), F.lit(command).alias("command"), F.struct(*rows.columns).alias("row"))).alias("json"))


def compact(rows: DataFrame) -> DataFrame:
    """Each result as one short line: kind's letter, name, path:line."""
    letter = F.upper(F.substring(F.coalesce("kind", F.lit("?")), 1, 1))
    return rows.select(F.concat_ws(" ", letter, "name", F.concat("path", F.lit(":"), F.col("line").cast("string"))).alias("line"))
