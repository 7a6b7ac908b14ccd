"""Queries of graphs, name resolution and clusters on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.paths import is_test_path
from lodestone.operators import clusters, graph, joins, reports
from lodestone.plans import corpora
from lodestone.plans.corpora import CALLS, FUNCTIONS, HIERARCHY, NAMED_CALLS, SYMBOLS
from lodestone.plans.registry import query

NAMED = f"{CALLS}, {FUNCTIONS}, {NAMED_CALLS}"


@query(f"""WITH {NAMED} SELECT f.name, f.path, f.def_line, arg_min(c.line, c.edge_id) AS line
FROM ncalls c JOIN fns f ON f.def_id = c.caller_id WHERE lower(c.callee) = 'fn24' GROUP BY f.name, f.path, f.def_line""")
def n1_callers(spark, sf_dir):
    return graph.callers(corpora.named_calls(spark, sf_dir), corpora.functions(spark, sf_dir), "FN24")


@query(f"""WITH {NAMED}, own AS (SELECT def_id FROM fns WHERE lower(name) = 'fn24')
SELECT name, path, def_line FROM fns WHERE lower(name) IN (SELECT lower(callee) FROM ncalls WHERE caller_id IN (SELECT def_id FROM own))""")
def n1_callees(spark, sf_dir):
    return graph.callees(corpora.named_calls(spark, sf_dir), corpora.functions(spark, sf_dir), "Fn24")


INDEGREE = "deg AS (SELECT callee, count(DISTINCT caller_id) AS indegree FROM ncalls GROUP BY callee)"


@query(f"WITH {NAMED}, {INDEGREE} SELECT name, path, def_line, indegree FROM deg JOIN fns ON lower(fns.name) = lower(callee)")
def a4_indegree(spark, sf_dir):
    return graph.indegree(corpora.named_calls(spark, sf_dir), corpora.functions(spark, sf_dir))


@query(f"WITH {NAMED}, {INDEGREE} SELECT name, path, def_line, indegree FROM deg JOIN fns ON lower(fns.name) = lower(callee) ORDER BY indegree DESC, name, path, def_line LIMIT 15")
def n7_top_indegree(spark, sf_dir):
    return graph.indegree(corpora.named_calls(spark, sf_dir), corpora.functions(spark, sf_dir), 15)


REACH = """
walk AS (
  SELECT 5::BIGINT AS node, 0 AS depth UNION
  SELECT c.caller, depth + 1 FROM walk JOIN calls c ON c.callee = walk.node WHERE depth < 6),
reached AS (SELECT node, min(depth)::INT AS depth FROM walk GROUP BY node HAVING min(depth) > 0)
"""


@query(f"WITH RECURSIVE {CALLS}, {REACH} SELECT node, depth FROM reached")
def n2_reachable(spark, sf_dir):
    return graph.reachable(corpora.calls(spark, sf_dir), 5, 6, None)


@query(f"""WITH RECURSIVE {CALLS}, e AS (SELECT DISTINCT caller AS a, callee AS b FROM calls),
walk AS (
  SELECT [a, b] AS path, b AS tail, 1 AS hops FROM e WHERE a = (SELECT min(caller) FROM calls)
  UNION ALL SELECT list_append(path, b), b, hops + 1 FROM walk JOIN e ON e.a = tail WHERE hops < 5 AND tail <> 5 AND NOT list_contains(path, b))
SELECT array_to_string(path, '>') AS path, hops FROM walk WHERE tail = 5""")
def n3_simple_paths(spark, sf_dir):
    calls = corpora.calls(spark, sf_dir)
    source = calls.agg(F.min("caller").alias("m")).first().m
    found = graph.simple_paths(calls, source, 5, 5, None)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "hops")


@query(f"""WITH RECURSIVE {HIERARCHY}, walk AS (
  SELECT 'region1' AS node, 0 AS depth UNION SELECT child, depth + 1 FROM walk JOIN hier ON parent = node AND kind <> 'uses' WHERE depth < 64)
SELECT node, min(depth)::INT AS depth FROM walk GROUP BY node HAVING min(depth) > 0""")
def n4_subtypes(spark, sf_dir):
    return graph.subtypes(corpora.hierarchy(spark, sf_dir), "region1")


@query(f"WITH {HIERARCHY} SELECT child, kind AS relation FROM hier WHERE parent = 'nation3'")
def n5_implementations(spark, sf_dir):
    return graph.implementations(corpora.hierarchy(spark, sf_dir), "nation3")


@query(f"""WITH RECURSIVE {CALLS}, {FUNCTIONS}, {REACH}
SELECT r.node, path, 'pytest' AS framework, depth FROM reached r JOIN fns USING (node) WHERE contains(path, '/tests/') AND name LIKE 'test_%' """)
def n6_tests_for(spark, sf_dir):
    return reports.tests_for(corpora.calls(spark, sf_dir), corpora.functions(spark, sf_dir), 5)


@query(f"""WITH RECURSIVE {CALLS}, e AS (SELECT caller AS a, callee AS b FROM calls), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS node, a AS seen FROM both_ UNION SELECT node, b FROM reach JOIN both_ ON a = seen)
SELECT node, min(seen) AS root FROM reach GROUP BY node""")
def n13_components(spark, sf_dir):
    e = corpora.calls(spark, sf_dir)
    return graph.connected_components(e.select(F.col("caller").alias("a"), F.col("callee").alias("b")))


@query(f"WITH {CALLS} SELECT caller AS node, array_to_string(list_sort(list(DISTINCT callee)), ',') AS adjacent FROM calls GROUP BY caller")
def n14_adjacency(spark, sf_dir):
    near = F.array_sort(F.collect_set("callee"))
    return corpora.calls(spark, sf_dir).groupBy(F.col("caller").alias("node")).agg(near.alias("near")).select(
        "node", F.array_join(F.transform("near", lambda x: x.cast("string")), ",").alias("adjacent")
    )


SITES = f"""{CALLS},
sites AS (
  SELECT caller AS from_sym, callee AS to_sym, 'f' || (caller // 10) AS path, line, CASE WHEN edge_id % 3 = 0 THEN 'call' WHEN edge_id % 3 = 1 THEN 'ref' ELSE 'hierarchy' END AS source, edge_id AS seq FROM calls),
spot AS (SELECT arg_min(from_sym, seq) AS from_sym, to_sym, arg_min(source, seq) AS source FROM sites WHERE source <> 'hierarchy' GROUP BY path, line, to_sym),
rows_ AS (SELECT from_sym, to_sym, source FROM spot UNION ALL SELECT from_sym, to_sym, source FROM sites WHERE source = 'hierarchy'),
graph AS (
  SELECT least(from_sym, to_sym) AS a, greatest(from_sym, to_sym) AS b, least(sum(CASE WHEN source = 'call' THEN 2 ELSE 1 END), 8)::BIGINT AS w
  FROM rows_ WHERE from_sym <> to_sym GROUP BY ALL)
"""


def sites(spark, sf_dir):
    c = corpora.calls(spark, sf_dir)
    source = F.when(F.col("edge_id") % 3 == 0, "call").when(F.col("edge_id") % 3 == 1, "ref").otherwise("hierarchy")
    return c.select(F.col("caller").alias("from_sym"), F.col("callee").alias("to_sym"), F.concat(F.lit("f"), F.floor(F.col("caller") / 10).cast("string")).alias("path"), "line", source.alias("source"), F.col("edge_id").alias("seq"))


@query(f"WITH {SITES} SELECT a, b, w FROM graph")
def n8_projection(spark, sf_dir):
    return clusters.project(sites(spark, sf_dir))


@query(f"WITH {SITES} SELECT from_sym, to_sym, source FROM spot")
def a7_site_dedup(spark, sf_dir):
    s = sites(spark, sf_dir).where("source <> 'hierarchy'")
    return s.groupBy("path", "line", "to_sym").agg(F.min_by(F.struct("from_sym", "source"), "seq").alias("s")).select("s.from_sym", "to_sym", "s.source")


@query(f"WITH {SITES} SELECT w, count(*) AS pairs FROM graph GROUP BY w")
def a8_pair_weights(spark, sf_dir):
    return clusters.project(sites(spark, sf_dir)).groupBy("w").agg(F.count("*").alias("pairs"))


def assigned(spark, sf_dir):
    return clusters.finalise(clusters.communities(clusters.project(sites(spark, sf_dir))))


@query()
def n9_leiden(spark, sf_dir):
    return clusters.communities(clusters.project(sites(spark, sf_dir)))


@query()
def n9_leiden_by_component(spark, sf_dir):
    return clusters.communities(clusters.project(sites(spark, sf_dir)), by_component=True)


# Clusters that SQL can tell too: thirty nodes each, one of a hundredth left out.
FIXED = f"{SITES}, asg AS (SELECT DISTINCT n AS sym_id, CASE WHEN n % 100 = 7 THEN NULL ELSE n // 30 END AS cluster_id FROM (SELECT a AS n FROM graph UNION SELECT b FROM graph))"


def fixed(spark, sf_dir):
    g = clusters.project(sites(spark, sf_dir))
    n = g.select(F.col("a").alias("sym_id")).union(g.select("b")).distinct()
    return g, n.withColumn("cluster_id", F.when(F.col("sym_id") % 100 != 7, F.floor(F.col("sym_id") / 30)))


@query(f"""WITH {SITES}, f AS (SELECT n AS sym_id, n // 2 AS community FROM (SELECT a AS n FROM graph UNION SELECT b FROM graph)),
z AS (SELECT *, count(*) OVER (PARTITION BY community) AS k FROM f), big AS (SELECT community, (row_number() OVER (ORDER BY community) - 1)::INT AS cluster_id FROM z WHERE k > 1 GROUP BY community)
SELECT sym_id, cluster_id, CASE WHEN k > 1 THEN 'clustered' ELSE 'unclustered' END AS status FROM z LEFT JOIN big USING (community)""")
def n10_finalise(spark, sf_dir):
    g = clusters.project(sites(spark, sf_dir))
    n = g.select(F.col("a").alias("sym_id")).union(g.select("b")).distinct()
    return clusters.finalise(n.withColumn("community", F.floor(F.col("sym_id") / 2)))


WEIGHTS = f"""{FIXED},
ends AS (SELECT w, x.cluster_id AS ca, y.cluster_id AS cb FROM graph LEFT JOIN asg x ON x.sym_id = a LEFT JOIN asg y ON y.sym_id = b),
inner_ AS (SELECT ca AS cluster_id, sum(w) AS internal FROM ends WHERE ca = cb GROUP BY ca),
cut_ AS (SELECT cluster_id, sum(w) AS cut FROM (SELECT ca AS cluster_id, w FROM ends WHERE ca IS DISTINCT FROM cb OR ca IS NULL UNION ALL SELECT cb, w FROM ends WHERE ca IS DISTINCT FROM cb OR ca IS NULL) WHERE cluster_id IS NOT NULL GROUP BY cluster_id),
summary AS (SELECT cluster_id, count(*) AS size, coalesce(any_value(internal), 0)::BIGINT AS internal, coalesce(any_value(cut), 0)::BIGINT AS cut FROM asg LEFT JOIN inner_ USING (cluster_id) LEFT JOIN cut_ USING (cluster_id) WHERE cluster_id IS NOT NULL GROUP BY cluster_id)
"""


@query(f"WITH {WEIGHTS} SELECT cluster_id, size, internal, cut FROM summary")
def a9_cluster_weights(spark, sf_dir):
    return clusters.cluster_weights(*fixed(spark, sf_dir)).drop("cohesion")


@query(f"WITH {WEIGHTS} SELECT cluster_id, CASE WHEN internal + cut = 0 THEN 0.0 ELSE round(internal::DOUBLE / (internal + cut), 4) END AS cohesion FROM summary")
def a12_cohesion(spark, sf_dir):
    return clusters.cluster_weights(*fixed(spark, sf_dir)).select("cluster_id", "cohesion")


@query(f"""WITH {FIXED}, both_ AS (SELECT a, b, w FROM graph UNION ALL SELECT b, a, w FROM graph),
i AS (SELECT x.cluster_id, a AS sym_id, sum(w) AS w FROM both_ JOIN asg x ON x.sym_id = a JOIN asg y ON y.sym_id = b WHERE x.cluster_id = y.cluster_id GROUP BY ALL)
SELECT cluster_id, sym_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY w DESC, sym_id) AS rank FROM i) WHERE rank <= 3""")
def a10_hubs(spark, sf_dir):
    return clusters.hubs(*fixed(spark, sf_dir))


@query(f"""WITH {FUNCTIONS}, asg AS (SELECT node AS sym_id, node // 30 AS cluster_id, path FROM fns),
dirs AS (SELECT cluster_id, unnest(CASE WHEN contains(path, '/tests/') THEN ['pkg', 'pkg/tests'] ELSE ['pkg', 'pkg/src'] END) AS dir FROM asg),
k AS (SELECT cluster_id, dir, count(*) AS k, len(string_split(dir, '/')) AS depth FROM dirs GROUP BY ALL),
n AS (SELECT cluster_id, count(*) AS n FROM asg GROUP BY cluster_id)
SELECT cluster_id, arg_max(dir, depth * 1000 + k) AS label FROM k JOIN n USING (cluster_id) WHERE 5 * k >= 3 * n GROUP BY cluster_id""")
def a11_labels(spark, sf_dir):
    f = corpora.functions(spark, sf_dir)
    a = f.select(F.col("node").alias("sym_id"), F.floor(F.col("node") / 30).alias("cluster_id"))
    return clusters.labels(a, f.select(F.col("node").alias("sym_id"), "path"))


@query(f"WITH {WEIGHTS} SELECT cluster_id, size FROM summary WHERE size >= 3")
def n11_modules(spark, sf_dir):
    return clusters.modules(clusters.cluster_weights(*fixed(spark, sf_dir))).select("cluster_id", "size")


@query(f"WITH {WEIGHTS} SELECT cluster_id FROM (SELECT *, row_number() OVER (ORDER BY internal::DOUBLE / (internal + cut) DESC, cluster_id) AS k FROM summary WHERE size >= 3) WHERE k <= 5")
def t5_modules_by_cohesion(spark, sf_dir):
    return clusters.modules(clusters.cluster_weights(*fixed(spark, sf_dir)), by="cohesion").limit(5).select("cluster_id")


@query(f"""WITH {SYMBOLS}, old AS (SELECT path, name, kind, min(CASE WHEN sym_id % 4 = 1 THEN NULL ELSE sym_id // 100 END) AS cluster_id FROM sym WHERE sym_id % 5 <> 0 GROUP BY ALL)
SELECT sym_id, cluster_id, CASE WHEN old.path IS NULL THEN 'new' WHEN cluster_id IS NULL THEN 'unclustered' ELSE 'clustered' END AS status
FROM sym LEFT JOIN old ON old.path = sym.path AND old.name = sym.name AND old.kind = sym.kind""")
def n12_carry_forward(spark, sf_dir):
    s = corpora.symbols(spark, sf_dir)
    old = s.where("sym_id % 5 <> 0").select("path", "name", "kind", F.when(F.col("sym_id") % 4 != 1, F.floor(F.col("sym_id") / 100)).alias("cluster_id"))
    return clusters.carry_forward(old, s)


REFS = SYMBOLS + """,
refs AS (
  SELECT sym_id AS ref_id, (CASE WHEN sym_id % 6 = 0 THEN 'missing_' || sym_id ELSE name END) AS name, path, line + 7 AS line, kind,
    (['local', 'imported', 'unresolved'])[sym_id % 3 + 1] AS binding FROM sym)
"""


def refs(spark, sf_dir):
    s = corpora.symbols(spark, sf_dir)
    binding = F.element_at(F.array(*map(F.lit, ("local", "imported", "unresolved"))), (F.col("sym_id") % 3 + 1).cast("int"))
    name = F.when(F.col("sym_id") % 6 == 0, F.concat(F.lit("missing_"), F.col("sym_id").cast("string"))).otherwise(F.col("name"))
    return s.select(F.col("sym_id").alias("ref_id"), name.alias("name"), "path", (F.col("line") + 7).cast("int").alias("line"), "kind", binding.alias("binding"))


CAND = "cand AS (SELECT name, min(sym_id) AS first, count(*) AS n FROM sym GROUP BY name)"


@query(f"""WITH {SYMBOLS}, c AS (SELECT sym_id AS call_id, path, name, line FROM sym WHERE sym_id % 4 <> 0),
f AS (SELECT path, name, line, min(sym_id) AS caller_id FROM sym WHERE kind <> 'class' GROUP BY ALL) SELECT call_id, caller_id FROM c JOIN f USING (path, name, line)""")
def j1_resolve_callers(spark, sf_dir):
    s = corpora.symbols(spark, sf_dir)
    c = s.where("sym_id % 4 <> 0").select(F.col("sym_id").alias("call_id"), "path", F.col("name").alias("caller_name"), F.col("line").alias("caller_line"))
    return joins.resolve_callers(c, s.where("kind <> 'class'")).select("call_id", "caller_id")


@query(f"WITH {NAMED} SELECT edge_id, def_id FROM ncalls JOIN fns ON lower(fns.name) = lower(callee)")
def j2_callee_definitions(spark, sf_dir):
    f = corpora.functions(spark, sf_dir).select("def_id", F.lower("name").alias("key"))
    return corpora.named_calls(spark, sf_dir).withColumn("key", F.lower("callee")).join(f, "key").select("edge_id", "def_id")


@query(f"""WITH {NAMED} SELECT lower(c.callee) AS callee, f.name, f.path, f.def_line, arg_min(c.line, c.edge_id) AS line
FROM ncalls c JOIN fns f ON f.def_id = c.caller_id GROUP BY lower(c.callee), f.name, f.path, f.def_line""")
def j3_all_callers(spark, sf_dir):
    c = corpora.named_calls(spark, sf_dir).withColumn("callee", F.lower("callee"))
    j = c.join(corpora.functions(spark, sf_dir), F.col("caller_id") == F.col("def_id"))
    return j.groupBy("callee", "name", "path", "def_line").agg(F.min_by("line", "edge_id").alias("line"))


@query(f"WITH {REFS}, {CAND} SELECT ref_id, first AS to_sym, n > 1 AS ambiguous FROM refs JOIN cand USING (name) WHERE binding <> 'local' AND (binding = 'imported' OR n = 1)")
def j4_resolve_refs(spark, sf_dir):
    return joins.resolve_refs(refs(spark, sf_dir), corpora.symbols(spark, sf_dir)).select("ref_id", "to_sym", "ambiguous")


@query(f"""WITH {REFS}, {CAND}, near AS (SELECT name, path, min(sym_id) AS near FROM sym GROUP BY ALL)
SELECT ref_id, coalesce(near, first) AS to_sym FROM refs LEFT JOIN near USING (name, path) LEFT JOIN cand USING (name)""")
def j5_resolve_with_path(spark, sf_dir):
    r = refs(spark, sf_dir).withColumnRenamed("path", "target_path")
    return joins.resolve_with_path(r, corpora.symbols(spark, sf_dir)).select("ref_id", "to_sym")


@query(f"WITH {REFS} SELECT ref_id, name FROM refs WHERE length(name) >= 3 AND contains(name, '_') AND name NOT IN (SELECT name FROM sym)")
def j6_unresolved(spark, sf_dir):
    return joins.unresolved(refs(spark, sf_dir), corpora.symbols(spark, sf_dir), F.expr("length(name) >= 3 AND contains(name, '_')")).select("ref_id", "name")


HIER = SYMBOLS + """,
types AS (SELECT * FROM sym WHERE kind IN ('class', 'struct')),
capt AS (SELECT path, name AS child_name, CASE WHEN sym_id % 3 = 0 THEN 'Nothing' || sym_id ELSE (SELECT min(name) FROM types t WHERE t.sym_id = sym.sym_id + 1) END AS parent_name, line, 'extends' AS kind FROM sym),
own AS (SELECT path, name AS child_name, min(sym_id) AS child_sym FROM types GROUP BY ALL),
tc AS (SELECT name AS parent_name, min(sym_id) AS parent_sym, count(*) AS n FROM types GROUP BY name)
"""


def captures(spark, sf_dir):
    s = corpora.symbols(spark, sf_dir)
    nxt = s.where("kind IN ('class', 'struct')").select((F.col("sym_id") - 1).alias("sym_id"), F.col("name").alias("nxt"))
    parent = F.when(F.col("sym_id") % 3 == 0, F.concat(F.lit("Nothing"), F.col("sym_id").cast("string"))).otherwise(F.col("nxt"))
    return s.join(nxt, "sym_id", "left").select("path", F.col("name").alias("child_name"), parent.alias("parent_name"), "line", F.lit("extends").alias("kind"))


@query(f"WITH {HIER} SELECT parent_sym, child_sym, path, line FROM capt JOIN own USING (path, child_name) JOIN tc USING (parent_name) WHERE n = 1")
def j7_resolve_hierarchy(spark, sf_dir):
    return joins.resolve_hierarchy(captures(spark, sf_dir), corpora.symbols(spark, sf_dir))[0].drop("kind")


@query(f"WITH {HIER} SELECT capt.parent_name, child_sym, path, line FROM capt JOIN own USING (path, child_name) LEFT JOIN tc USING (parent_name) WHERE n IS NULL")
def j7_unresolved_hierarchy(spark, sf_dir):
    return joins.resolve_hierarchy(captures(spark, sf_dir), corpora.symbols(spark, sf_dir))[1].drop("kind")


INCLUDES = f"""{FUNCTIONS},
size AS (SELECT greatest(40, count(*) // 8) AS h FROM part),
hs AS (SELECT DISTINCT concat(CASE WHEN n % 3 = 0 THEN 'a/' WHEN n % 3 = 1 THEN 'a/b/' ELSE 'c/' END, 'h', n // 3 % h, '.h') AS path FROM (SELECT node AS n FROM fns), size),
inc AS (SELECT DISTINCT concat(CASE WHEN n % 2 = 0 THEN 'a/' ELSE 'c/' END, 'h', n % h, '.h') AS src, concat(CASE WHEN n % 5 = 0 THEN 'b/' ELSE '' END, 'h', (n * 7) % (h + 10), '.h') AS target FROM (SELECT node AS n FROM fns), size),
direct AS (SELECT src, target, path AS dst FROM inc JOIN hs ON path = regexp_replace(src, '[^/]*$', '') || target),
rest AS (SELECT * FROM inc WHERE (src, target) NOT IN (SELECT src, target FROM direct)),
named AS (SELECT src, target, path AS dst, row_number() OVER (PARTITION BY src, target ORDER BY (regexp_replace(path, '[^/]*$', '') <> regexp_replace(src, '[^/]*$', ''))::INT, length(path) - length(replace(path, '/', '')), path) AS k
  FROM rest JOIN hs ON regexp_replace(path, '^.*/', '') = regexp_replace(target, '^.*/', '')),
incl AS (SELECT * FROM direct UNION ALL SELECT src, target, dst FROM named WHERE k = 1)
"""


def includes(spark, sf_dir):
    parts = corpora.functions(spark, sf_dir).select(F.col("node").alias("n"))
    h, n = max(40, parts.count() // 8), F.col("n")
    at = lambda c, *dirs: F.element_at(F.array(*map(F.lit, dirs)), (c % len(dirs) + 1).cast("int"))
    text = lambda c: c.cast("string")
    files = parts.select(F.concat(at(n, "a/", "a/b/", "c/"), F.lit("h"), text(F.floor(n / 3) % h), F.lit(".h")).alias("path")).distinct()
    asked = parts.select(
        F.concat(at(n, "a/", "c/"), F.lit("h"), text(n % h), F.lit(".h")).alias("path"),
        F.concat(F.when(n % 5 == 0, "b/").otherwise(""), F.lit("h"), text(n * 7 % (h + 10)), F.lit(".h")).alias("target"),
    )
    return joins.resolve_includes(asked.distinct(), files)


@query(f"WITH {INCLUDES} SELECT src, target, dst FROM incl")
def j8_resolve_includes(spark, sf_dir):
    return includes(spark, sf_dir)


@query(f"""WITH RECURSIVE {INCLUDES}, walk AS (SELECT 'a/h0.h' AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM walk JOIN incl ON src = node WHERE depth < 5)
SELECT node, min(depth)::INT AS depth FROM walk GROUP BY node""")
def j9_include_reach(spark, sf_dir):
    start = spark.range(1).select(F.lit("a/h0.h").alias("node"))
    return graph.reach(includes(spark, sf_dir).select("src", "dst"), start, 5, 0)


@query(f"""WITH {REFS} SELECT r.ref_id, (SELECT arg_max(s.sym_id, s.line::BIGINT * 100000000 + s.sym_id) FROM sym s WHERE s.path = r.path AND s.line <= r.line) AS sym_id
FROM refs r WHERE EXISTS (SELECT 1 FROM sym s WHERE s.path = r.path AND s.line <= r.line)""")
def j10_nearest_preceding(spark, sf_dir):
    return joins.nearest_preceding(corpora.symbols(spark, sf_dir), refs(spark, sf_dir)).select("ref_id", "sym_id")


@query(f"""WITH {REFS}, {CAND}, near AS (SELECT name, path, min(sym_id) AS near FROM sym GROUP BY ALL)
SELECT ref_id, coalesce(near, CASE WHEN n = 1 THEN first END) AS to_sym FROM refs LEFT JOIN near USING (name, path) LEFT JOIN cand USING (name) WHERE coalesce(near, CASE WHEN n = 1 THEN first END) IS NOT NULL""")
def j11_resolve_callees(spark, sf_dir):
    c = refs(spark, sf_dir).withColumnRenamed("name", "callee")
    return joins.resolve_callees(c, corpora.symbols(spark, sf_dir)).select("ref_id", "to_sym")


@query(f"WITH {SYMBOLS} SELECT sym_id, source FROM sym WHERE path IN (SELECT path FROM sym WHERE sym_id % 50 = 3)")
def j18_semi_join_scope(spark, sf_dir):
    from lodestone.functions.paths import in_changed

    s = corpora.symbols(spark, sf_dir)
    return in_changed(s, s.where("sym_id % 50 = 3").select("path")).select("sym_id", "source")


@query(f"""WITH {SYMBOLS}, owner AS (SELECT DISTINCT source FROM sym WHERE lower(name) = 'theand')
SELECT sym_id, source AS repo FROM sym WHERE lower(name) = 'theand' AND sym_id % 2 = 0 AND source NOT IN (SELECT source FROM sym WHERE lower(name) = 'theand' AND sym_id % 4 = 1)""")
def j19_cross_repo(spark, sf_dir):
    s = corpora.symbols(spark, sf_dir)
    unresolved = s.where("sym_id % 2 = 0").select("sym_id", F.col("source").alias("repo"), F.lower("name").alias("name_lc"), "path", "line")
    defs = s.where("sym_id % 4 = 1").select(F.col("source").alias("repo"), "name")
    return joins.cross_repo(unresolved, defs, "TheAnd").select("sym_id", "repo")


@query(f"WITH {FUNCTIONS} SELECT node, contains(path, '/tests/') AS test FROM fns")
def f4_test_paths(spark, sf_dir):
    return corpora.functions(spark, sf_dir).select("node", is_test_path(F.col("path")).alias("test"))


CHANNELS = f"""{NAMED}, walk AS (SELECT 24::BIGINT AS node, 0 AS depth UNION SELECT c.caller, depth + 1 FROM walk JOIN calls c ON c.callee = walk.node WHERE depth < 3),
ch AS (
  SELECT 'callers' AS channel, 'binder' AS tier, f.path, c.line::BIGINT AS line FROM calls c JOIN fns f ON f.node = c.caller WHERE c.callee = 24
  UNION ALL SELECT 'transitive', 'text', f.path, depth FROM (SELECT node, min(depth) AS depth FROM walk GROUP BY node HAVING min(depth) >= 2) JOIN fns f USING (node))
"""


def impact_channels(spark, sf_dir):
    calls, fns = corpora.calls(spark, sf_dir), corpora.functions(spark, sf_dir)
    direct = calls.where("callee = 24").join(fns, F.col("node") == F.col("caller")).select("path", "line")
    far = graph.reachable(calls, 24, 3, None).where("depth >= 2").join(fns, "node").select("path", F.col("depth").alias("line"))
    return reports.impact({"callers": ("binder", direct), "transitive": ("text", far)})


@query(f"WITH RECURSIVE {CHANNELS} SELECT channel, tier, count(*) AS hits FROM ch GROUP BY ALL")
def c2_impact_counts(spark, sf_dir):
    return impact_channels(spark, sf_dir)[0].drop("sample")


@query(f"""WITH RECURSIVE {CHANNELS}, s AS (SELECT coalesce(sum((tier = 'binder')::INT), 0)::BIGINT AS binder_hits, coalesce(sum((tier = 'text')::INT), 0)::BIGINT AS text_hits FROM ch)
SELECT *, CASE WHEN binder_hits > 0 THEN 'unsafe' WHEN text_hits > 0 THEN 'uncertain' ELSE 'safe' END AS verdict FROM s""")
def a18_verdict(spark, sf_dir):
    return impact_channels(spark, sf_dir)[1]


@query(f"""WITH {NAMED}, p AS (
  SELECT 'caller' AS role, f.name, f.path, c.line::BIGINT AS line FROM calls c JOIN fns f ON f.node = c.caller WHERE c.callee < 40
  UNION ALL SELECT 'callee', f.name, f.path, f.def_line FROM calls c JOIN fns f ON f.node = c.callee WHERE c.caller = 24),
r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY name, path, line) AS k, count(*) OVER (PARTITION BY role) > 20 AS more FROM p)
SELECT role, name, path, line, more FROM r WHERE k <= 20""")
def c3_bundle_symbol(spark, sf_dir):
    calls, fns = corpora.calls(spark, sf_dir), corpora.functions(spark, sf_dir)
    callers = calls.where("callee < 40").join(fns, F.col("node") == F.col("caller")).select("name", "path", "line")
    callees = calls.where("caller = 24").join(fns, F.col("node") == F.col("callee")).select("name", "path", F.col("def_line").alias("line"))
    return reports.bundle_symbol({"caller": callers, "callee": callees})


@query(f"WITH {NAMED} SELECT least(count(*), 20)::BIGINT AS shown, count(*) > 20 AS more FROM calls WHERE callee < 40")
def t4_probe_and_truncate(spark, sf_dir):
    probe = corpora.calls(spark, sf_dir).where("callee < 40").limit(21)
    return probe.agg(F.least(F.count("*"), F.lit(20)).alias("shown"), (F.count("*") > 20).alias("more"))


@query(f"""WITH RECURSIVE {NAMED}, chg AS (SELECT 'pkg/src/m2.py' AS path), walk AS (
  SELECT node, 0 AS depth FROM fns JOIN chg USING (path) UNION SELECT c.caller, depth + 1 FROM walk JOIN calls c ON c.callee = walk.node WHERE depth < 2)
SELECT node, path, depth, contains(path, '/tests/') AS is_test FROM (SELECT node, min(depth)::INT AS depth FROM walk GROUP BY node HAVING min(depth) > 0) JOIN fns USING (node)""")
def c4_pr_impact(spark, sf_dir):
    changed = spark.range(1).select(F.lit("pkg/src/m2.py").alias("path"))
    return reports.pr_impact(changed, corpora.calls(spark, sf_dir), corpora.functions(spark, sf_dir))
