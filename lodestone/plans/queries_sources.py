"""Queries of sources, sinks, caches, patterns and refresh on the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.operators import grep, lookup, pattern
from lodestone.plans import corpora
from lodestone.plans.corpora import table, truth_sql
from lodestone.plans.queries_history import EXTENSIONS, parsed, parsed_sql
from lodestone.plans.queries_search import INDEX, name_index
from lodestone.plans.registry import query
from lodestone.sources import files as sources
from lodestone.sources import parser
from lodestone.sources.storage import Catalog, shared_dir
from lodestone.streaming import refresh


def folder(spark, tag):
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@query("SELECT 'part=' || (doc_id % 3) || '/doc=f' || doc_id AS path FROM documents WHERE doc_id % 3 <> 1")
def s1_walk(spark, sf_dir):
    root = folder(spark, "walk")
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 3).alias("part"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("doc"), "text")
    d.repartition(8, "doc").write.partitionBy("part", "doc").text(root)  # a folder with one file for each document
    return sources.walk(spark, root, exclude=("part=1/**", "_SUCCESS")).select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct()


@query(truth_sql(EXTENSIONS, "path", "lang").replace("FROM (SELECT doc_id FROM documents)", "FROM (SELECT doc_id, n_chars FROM documents)") + " WHERE lang IS NOT NULL AND n_chars * 100 <= 1048576")
def s2_discover(spark, sf_dir):
    files = corpora.named(spark, sf_dir, EXTENSIONS, "path").join(table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 100).alias("length")), "doc_id")
    return sources.discover(files).select("doc_id", "path", "lang")


@query("SELECT doc_id, doc_id % 4 = 0 AND doc_id % 3 <> 0 AS reused FROM documents")
def s7_stat_cache(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    at = F.when(F.col("doc_id") % 3 == 0, 200).otherwise(50)
    listing = d.select("doc_id", F.col("doc_id").cast("string").alias("path"), "n_chars", at.alias("mtime"), F.col("text").cast("binary").alias("content")).withColumnRenamed("n_chars", "length")
    manifest = listing.select("path", F.when(F.expr("int(path) % 4 = 0"), F.col("length")).otherwise(F.col("length") + 1).alias("length"), "mtime", F.lit(7).cast("long").alias("content_hash"))
    hashed = sources.hash_with_cache(listing, manifest, 100)
    return hashed.select(F.col("path").cast("long").alias("doc_id"), (F.col("content_hash") == 7).alias("reused"))


@query(parsed_sql("('m.py', 4, 4), ('p.rs', 3, 1), ('r.md', 3, 0), ('m.cpp', 1, 1)", "n_symbols, n_calls"))
def s8_parse(spark, sf_dir):
    _, p = parsed(spark, sf_dir)
    return p.select("path", F.size("symbols").alias("n_symbols"), F.size("call_edges").alias("n_calls"))


@query(parsed_sql("('m.py', 'area', 'helper_one'), ('m.py', 'helper_one', 'Shape')", "name, token"))
def s11_body_tokens(spark, sf_dir):
    p, rows = parsed(spark, sf_dir)
    s = p.relation(rows, "symbols").where("name IN ('area', 'helper_one')")
    return s.select("path", "name", F.explode(F.split("body_tokens", " ")).alias("token")).where("token IN ('helper_one', 'Shape')").distinct()


@query(parsed_sql("('m.cpp', 'a/b.h', 2), ('m.cpp', 'c.h', 3)", "target, line"))
def s17_includes(spark, sf_dir):
    p, rows = parsed(spark, sf_dir)
    return p.relation(rows, "includes").where(F.col("path").endswith(".cpp")).select("path", "target", "line")


@query("SELECT source, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY source")
def s21_versioned_relations(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    catalog = Catalog(spark, folder(spark, "catalog"))
    first = catalog.commit({"docs": d, "even": d.where("doc_id % 2 = 0")})
    catalog.commit({"docs": d.where("doc_id < 5")})
    assert catalog.current()["version"] == first + 1
    return catalog.read("even").groupBy("source").agg(F.count("*").alias("n"))


def small_files(spark, sf_dir, where):
    d = table(spark, sf_dir, "documents").where(where)
    edit = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("# Head\n"), "text")).otherwise(F.concat(F.lit("# Other\n"), "text"))
    return d.select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit("markdown").alias("lang"), edit.alias("text"))


@query("SELECT 'f' || doc_id || '.md' AS path, CASE WHEN doc_id % 5 = 0 THEN 'Head' ELSE 'Other' END AS name FROM documents")
def s23_parse_cache(spark, sf_dir):
    known = parser.parse_cached(small_files(spark, sf_dir, "doc_id % 2 = 0"), None)
    again = parser.parse_cached(small_files(spark, sf_dir, "true"), known)
    return parser.relation(again, "symbols").where("name IN ('Head', 'Other')").select("path", "name")


@query("SELECT 'f' || doc_id || '.md' AS path, CASE WHEN doc_id = 7 THEN 'New' WHEN doc_id % 5 = 0 THEN 'Head' ELSE 'Other' END AS name FROM documents WHERE doc_id <> 9")
def x2_incremental_update(spark, sf_dir):
    catalog = Catalog(spark, folder(spark, "refresh"))
    refresh.update(catalog, small_files(spark, sf_dir, "true").withColumn("deleted", F.lit(False)), 0)
    batch = spark.createDataFrame([("f7.md", "markdown", "# New\n", False), ("f9.md", "markdown", "", True)], "path string, lang string, text string, deleted boolean")
    after = refresh.update(catalog, batch, 1)
    assert refresh.update(catalog, batch, 1) == after
    return catalog.read("symbols").where("name IN ('Head', 'Other', 'New')").select("path", "name")


@query("SELECT 'f' || doc_id || '.md' AS path, CASE WHEN doc_id % 5 = 0 THEN 'Head' ELSE 'Other' END AS name FROM documents")
def x1_watch(spark, sf_dir):
    root = folder(spark, "watch")
    events = small_files(spark, sf_dir, "true").withColumn("deleted", F.lit(False)).withColumn("seq", F.lit(1).cast("long"))
    events.write.json(f"{root}/events")
    catalog = Catalog(spark, f"{root}/catalog")
    run = refresh.watch(spark, f"{root}/events", catalog, f"{root}/checkpoint", {"availableNow": True})
    run.awaitTermination()
    return catalog.read("symbols").where("name IN ('Head', 'Other')").select("path", "name")


@query("SELECT * FROM (VALUES (0, 0, 'a('), (0, 1, '$X'), (0, 2, ')'), (1, 0, 'b'), (2, 0, 'c'), (2, 1, '$$$')) v(alt, place, token)")
def p1_parse_pattern(spark, sf_dir):
    show = lambda t: t.text if isinstance(t, pattern.Literal) else ("$$$" if t.many else "$") + (t.name or "")
    rows = [(i, k, show(t)) for i, alt in enumerate(pattern.parse("a($X) || b || c $$$")) for part in alt for k, t in enumerate(part)]
    return spark.createDataFrame(rows, "alt int, place int, token string")


NODES = [("a.rs", 1, "fn one(x: i32) -> Result<i32> {"), ("a.rs", 5, "fn two() {"), ("b.rs", 2, "struct One {"), ("b.rs", 9, "call(one, one)"), ("b.rs", 10, "call(one, two)"), ("c.rs", 3, "fn one(a: u8)  -> Result {")]


def nodes(spark, sf_dir):
    """Documents as nodes of source files in turn, six documents to a folder."""
    k = (F.col("doc_id") % len(NODES) + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*(F.lit(n[i]) for n in NODES)), k)
    home = F.concat(F.lit("d"), F.floor(F.col("doc_id") / len(NODES)).cast("string"), F.lit("/"))
    return table(spark, sf_dir, "documents").select(F.concat(home, pick(0)).alias("path"), pick(1).cast("int").alias("line"), pick(2).alias("node_text"))


def nodes_sql(rows: str, columns: str, where: str = "true") -> str:
    """What is found in the nodes, for every document that stands for them: rows are (place in NODES, path, columns...)."""
    return f"SELECT 'd' || (doc_id // {len(NODES)}) || '/' || file AS path, {columns} FROM documents d JOIN (VALUES {rows}) v(k, file, {columns}) ON k = doc_id % {len(NODES)} WHERE {where}"


@query(nodes_sql("(0, 'a.rs', 1, 'one'), (5, 'c.rs', 3, 'one')", "line, name"))
def p3_root_kind_prefilter(spark, sf_dir):
    n = nodes(spark, sf_dir)
    skeletons = n.select("path", F.when(F.col("path").endswith("b.rs"), "struct").otherwise("function").alias("kind")).distinct()
    found = pattern.find(n, "fn $NAME($$$) -> Result", skeletons)
    return found.select("path", "line", F.col("captures")["NAME"].alias("name"))


@query(nodes_sql("(3, 'b.rs', 9)", "line"))
def p2_back_references(spark, sf_dir):
    return pattern.find(nodes(spark, sf_dir), "call($A, $A)").select("path", "line")


@query(nodes_sql("(0, 'a.rs', 1, 'one')", "line, name", f"EXISTS (SELECT 1 FROM documents o WHERE o.doc_id = d.doc_id + 1)"))
def j20_conjunction(spark, sf_dir):
    found = pattern.find(nodes(spark, sf_dir), "fn $NAME($$$) -> Result && fn two()")
    return found.select("path", "line", F.col("captures")["NAME"].alias("name"))


@query(f"WITH {INDEX} SELECT token, count(*) AS n FROM idx WHERE token = 'the' OR starts_with(token, 'tha') GROUP BY token")
def l9_inverted_index(spark, sf_dir):
    index = name_index(spark, sf_dir)
    both = lookup.find_exact(index, "the").unionByName(lookup.find_prefix(index, "tha")).distinct()
    return both.groupBy("token").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def s25_small_inputs(spark, sf_dir):
    wanted = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id").join(wanted, "doc_id", "left_semi")


@query("SELECT doc_id, doc_id % 2 = 0 AND doc_id % 3 > 0 AS kept FROM documents")
def s19_changed_scope(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"))
    changed = d.where("doc_id % 2 = 0").select("path")
    kept = paths.in_changed(d, changed).where("doc_id % 3 > 0").select("doc_id", F.lit(True).alias("hit"))
    return d.join(kept, "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("kept"))


@query("SELECT doc_id % 4 AS k, count(*) AS files FROM documents WHERE contains(text, 'Apache') GROUP BY ALL")
def g2_bloom_has_no_false_negative(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), "text")
    kept = grep.trigram_index(d.select("path", "text")).where(grep.may_match(F.col("bloom"), "Apache")).select("path")
    return d.join(kept, "path", "left_semi").where(F.contains("text", F.lit("Apache"))).groupBy((F.col("doc_id") % 4).alias("k")).agg(F.count("*").alias("files"))
