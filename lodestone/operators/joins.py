"""The joins that resolve names: gates on candidate counts, preferences, as-of, spills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def resolve_callers(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Call edges (path, caller_name, caller_line, ...) with the caller's id; unmatched ones drop.

    Where several symbols share path, name and line, the first counts.
    """
    first = symbols.groupBy("path", F.col("name").alias("caller_name"), F.col("line").alias("caller_line")).agg(F.min("sym_id").alias("caller_id"))
    return calls.join(first, ["path", "caller_name", "caller_line"])


def candidates_by_name(symbols: DataFrame) -> DataFrame:
    """(name, first, n): how many symbols bear a name and the first of them."""
    return symbols.groupBy("name").agg(F.min("sym_id").alias("first"), F.count("*").alias("n"))


def resolve_refs(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Refs (name, binding, ...) with ``to_sym`` and ``ambiguous``.

    Imported names take the first candidate and are ambiguous if there are more; unresolved
    ones need a unique name; local ones drop.
    """
    j = refs.where("binding <> 'local'").join(candidates_by_name(symbols), "name")
    return j.where("binding = 'imported' OR n = 1").select(
        *refs.columns, F.col("first").alias("to_sym"), (F.col("n") > 1).alias("ambiguous")
    )


def resolve_with_path(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Refs (name, target_path, ...): the symbol of that name in that file, else the first of that name."""
    exact = symbols.groupBy("name", F.col("path").alias("target_path")).agg(F.min("sym_id").alias("near"))
    far = candidates_by_name(symbols).select("name", "first")
    return refs.join(exact, ["name", "target_path"], "left").join(far, "name", "left").select(
        *refs.columns, F.coalesce("near", "first").alias("to_sym")
    )


def unresolved(refs: DataFrame, symbols: DataFrame, meaningful) -> DataFrame:
    """Refs whose name no symbol bears, where ``meaningful`` (a Column) holds."""
    return refs.where(meaningful).join(symbols.select("name").distinct(), "name", "left_anti")


def resolve_hierarchy(captures: DataFrame, symbols: DataFrame, kinds=("class", "struct", "interface", "trait", "enum", "type")) -> tuple[DataFrame, DataFrame]:
    """Edges and unresolved parents of captures (path, child_name, parent_name, line, kind).

    The child is the first type of its name in the same file, else the capture drops. One
    candidate for the parent makes an edge, none is spilled, several drop.
    """
    types = symbols.where(F.col("kind").isin(*kinds))
    own = types.groupBy("path", F.col("name").alias("child_name")).agg(F.min("sym_id").alias("child_sym"))
    found = captures.join(own, ["path", "child_name"]).join(
        candidates_by_name(types).select(F.col("name").alias("parent_name"), F.col("first").alias("parent_sym"), "n"), "parent_name", "left"
    )
    edges = found.where("n = 1").select("parent_sym", "child_sym", "path", "line", "kind")
    return edges, found.where("n IS NULL").select("parent_name", "child_sym", "path", "line", "kind")


def resolve_includes(includes: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst) for includes (path, target): the relative path if it exists, else by base name.

    Among files of one base name: the includer's directory first, then the fewest slashes,
    then the alphabet.
    """
    here = F.regexp_replace("path", r"[^/]*$", "")
    asked = includes.select(F.col("path").alias("src"), "target", F.concat(here, "target").alias("dst"), here.alias("here"))
    direct = asked.join(files.select(F.col("path").alias("dst")), "dst").select("src", "target", "dst")
    rest = asked.join(direct.select("src", "target"), ["src", "target"], "left_anti").drop("dst")
    base = lambda c: F.regexp_replace(c, r"^.*/", "")
    named = rest.withColumn("base", base("target")).join(files.select(F.col("path").alias("dst"), base("path").alias("base")), "base")
    slashes = F.length("dst") - F.length(F.replace("dst", F.lit("/"), F.lit("")))
    same = F.regexp_replace("dst", r"[^/]*$", "") == F.col("here")
    best = named.groupBy("src", "target").agg(F.min_by("dst", F.struct((~same).cast("int"), slashes, "dst")).alias("dst"))
    return direct.unionByName(best).select("src", "target", "dst")


def nearest_preceding(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Refs (path, line, ref_id) with the last symbol of the file at or before their line.

    One window over the union of both tables: an as-of join without a range comparison.
    """
    rows = symbols.select("path", "line", F.col("sym_id"), F.lit(None).cast("long").alias("ref_id"), F.lit(0).alias("is_ref")).unionByName(
        refs.select("path", "line", F.lit(None).cast("long").alias("sym_id"), F.col("ref_id"), F.lit(1).alias("is_ref"))
    )
    order = W.partitionBy("path").orderBy("line", "is_ref", "sym_id").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("near", F.last("sym_id", ignorenulls=True).over(order)).where("is_ref = 1 AND near IS NOT NULL").select(
        "ref_id", "path", "line", F.col("near").alias("sym_id")
    )


def resolve_callees(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls (path, callee, ...): the first such name in the same file, else the only one anywhere."""
    local = symbols.groupBy("path", F.col("name").alias("callee")).agg(F.min("sym_id").alias("near"))
    only = candidates_by_name(symbols).where("n = 1").select(F.col("name").alias("callee"), F.col("first").alias("far"))
    j = calls.join(local, ["path", "callee"], "left").join(only, "callee", "left")
    return j.select(*calls.columns, F.coalesce("near", "far").alias("to_sym")).where("to_sym IS NOT NULL")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, name, kind, change, line, old_line) between snapshots (path, name, kind, line, body_hash).

    A name that is there once on each side is unchanged (dropped), moved, or body_changed; any
    other multiplicity gives all removals and all additions.
    """
    key = ["path", "name", "kind"]
    count = lambda df, n: df.groupBy(*key).agg(
        F.count("*").alias(n), F.min("line").alias(f"{n}_line"), F.min("body_hash").alias(f"{n}_hash")
    )
    j = count(before, "b").join(count(after, "a"), key, "full_outer")
    single = j.where("b = 1 AND a = 1")
    change = F.when(F.col("b_hash") != F.col("a_hash"), "body_changed").when(F.col("b_line") != F.col("a_line"), "moved")
    kept = single.withColumn("change", change).where("change IS NOT NULL").select(
        *key, "change", F.col("a_line").alias("line"), F.col("b_line").alias("old_line")
    )
    odd = j.where("NOT (coalesce(b, 0) = 1 AND coalesce(a, 0) = 1)").select(*key)
    none = F.lit(None).cast("int")
    removed = before.join(odd, key, "left_semi").select(*key, F.lit("removed").alias("change"), F.col("line"), none.alias("old_line"))
    added = after.join(odd, key, "left_semi").select(*key, F.lit("added").alias("change"), F.col("line"), none.alias("old_line"))
    return kept.unionByName(removed).unionByName(added)


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status): new, changed, deleted or unchanged, by content hash."""
    o, n = old.select("path", F.col("content_hash").alias("o")), new.select("path", F.col("content_hash").alias("n"))
    status = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "deleted").when(F.col("o") != F.col("n"), "changed")
    return o.join(n, "path", "full_outer").select("path", status.otherwise("unchanged").alias("status"))


def cross_repo(unresolved_refs: DataFrame, definitions: DataFrame, name: str) -> DataFrame:
    """Unresolved refs (repo, name_lc, path, line) of a name in repositories that do not define it."""
    owners = definitions.where(F.lower("name") == name.lower()).select("repo").distinct()
    return unresolved_refs.where(F.col("name_lc") == name.lower()).join(owners, "repo", "left_anti")
