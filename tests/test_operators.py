"""Small cases of operators: edges, properties, and brute-force versions."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import paths, text, trigrams
from lodestone.operators import bm25, clusters, graph, grep, history, joins, lookup, pattern, ranking, reports, vectors
from lodestone.sources import parser
from lodestone.sources.storage import Catalog
from lodestone.streaming import refresh


def test_globs():
    fits = lambda g, p: bool(re.fullmatch(paths.glob_regex(g), p))
    assert fits("*.py", "a.py") and not fits("*.py", "d/a.py") and fits("**/*.py", "d/e/a.py") and fits("**/*.py", "a.py")
    assert fits("src/**", "src/a/b") and not fits("src/*", "src/a/b") and fits("a.{rs,py}", "a.py") and fits("[!a]x", "bx") and not fits("[!a]x", "ax")
    with pytest.raises(ValueError):
        paths.any_glob(["x"] * 65)


def test_query_terms_and_shapes():
    assert text.query_terms("The the Fox-fox é a x") == ["fox", "fox", "é"]
    assert [text.query_shape(q) for q in ("MAX", "MAX_A", "Foo", "foo_bar", "fooBar", "foo bar")] == ["ambiguous", "constant", "type", "function", "function", "ambiguous"]


def test_bm25_small(spark):
    docs = spark.createDataFrame([(0, "timeout retry"), (1, "retry config config"), (2, ""), (3, None)], "sym_id long, text string")
    index = bm25.build(docs)
    assert index.stats.first().n == 4 and index.stats.first().avgdl == 1.0
    got = {r.sym_id: r.score for r in bm25.search(index, "config").collect()}
    assert list(got) == [1]
    twice = bm25.search(index, "config config").first().score
    assert abs(twice - 2 * got[1]) < 1e-12 and bm25.search(index, "the of").count() == 0


def test_ladder_rungs(spark):
    index = spark.createDataFrame([("parse", 1), ("parser", 2), ("parsr", 3), ("pase", 4), ("xarsx", 5)], "token string, sym_id long")
    rung = {r.sym_id: r.rung for r in lookup.with_rung(index, "parse").collect()}
    assert rung == {1: 0, 2: 1, 3: 2, 4: 2, 5: 3}
    assert {r.sym_id for r in lookup.ladder(index, "parsi", 9).collect()} == {1, 3}
    assert "rung" in lookup.with_rung(index, "abcd").columns and lookup.with_rung(index, "zzzz").count() == 0


def test_rerank_properties(spark):
    random.seed(2)
    rows = [(f"src/d{random.randint(0, 3)}/x{i}.rs", f"name{i}", i, random.choice(["function", "class", "impl", "heading"]), random.random() * 100) for i in range(40)]
    df = spark.createDataFrame(rows, "path string, name string, line int, kind string, score double")
    out = ranking.rerank(df, "name7", near="src/d1/a.rs").collect()
    assert len(out) == 40 and all(r.boosted == r.boosted and r.boosted > 0 for r in out)
    one = ranking.rerank(df.limit(1), "name0").first()
    assert one.boosted == one.score
    nan = ranking.rerank(df.withColumn("score", F.lit(float("nan"))), "q").select("boosted").distinct().collect()
    assert [r.boosted for r in nan] == [0.0]


def test_fusion_is_commutative(spark):
    random.seed(3)
    lists = [spark.createDataFrame([(f"p{i}", "n", 1, "k", f"m{k}", r) for r, i in enumerate(random.sample(range(9), 6))], "path string, name string, line int, kind string, match_type string, rank int") for k in range(3)]
    a = {r.path: (round(r.score, 12), r.match_type == "hybrid") for r in ranking.fuse(lists).collect()}
    b = {r.path: (round(r.score, 12), r.match_type == "hybrid") for r in ranking.fuse(lists[::-1]).collect()}
    assert a == b


def test_metric_edges(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "x", 1)], "query_id long, tag string, rank int")
    relevant = spark.createDataFrame([(1, "a"), (1, "b"), (2, "y"), (3, None)], "query_id long, tag string")
    m = {r.query_id: r for r in ranking.ranking_metrics(ranked, relevant, 10).collect()}
    assert m[1].recall == 1.0 and m[1].mrr == 1.0 and m[1].ndcg < 1 and m[2].ndcg == 0.0 and m[3].ndcg == 1.0
    assert {r.ndcg for r in ranking.ranking_metrics(ranked, relevant, 0).collect()} == {0.0}


def test_trigrams_never_skip_a_match(spark):
    random.seed(4)
    texts = ["".join(random.choice("abcde fgh") for _ in range(random.randint(0, 40))) for _ in range(200)] + ["foo.bar", "fooXbar"]
    df = grep.trigram_index(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")).withColumn("id", F.col("path").cast("long"))
    for p in ("abc", "foo.bar", "(abc|bcd)e", "ab+c?de", "(?:abcd)+", "[ab]cde", "a{3}bcd", "x?abc"):
        kept = {r.id for r in df.where(trigrams.may_match(F.col("bloom"), p)).collect()}
        assert {i for i, t in enumerate(texts) if re.search(p, t)} <= kept
    assert trigrams.required_trigrams("foo.bar") == ["bar", "foo"] and trigrams.required_trigrams("(?i)foobar") == []


def components(n, edges):
    root = list(range(n))
    for _ in range(n):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_connected_components(spark):
    random.seed(5)
    for shape in ("random", "path", "star"):
        edges = {"random": [(random.randrange(60), random.randrange(60)) for _ in range(40)], "path": [(i, i + 1) for i in range(30)], "star": [(30, i) for i in range(30)]}[shape]
        df = spark.createDataFrame(edges, "a long, b long")
        want = components(60, edges)
        touched = {x for e in edges if e[0] != e[1] for x in e}
        got = {r.node: r.root for r in graph.connected_components(df).collect()}
        assert got == {v: want[v] for v in touched}
    assert graph.connected_components(df.limit(0)).count() == 0


def test_reach_and_paths_in_cycles(spark):
    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("d", "a"), ("c", "c")], "caller string, callee string")
    assert {(r.node, r.depth) for r in graph.reachable(calls, "c").collect()} == {("b", 1), ("a", 1), ("d", 2)}
    assert [r.path for r in graph.simple_paths(calls, "d", "c").collect()] == [["d", "a", "c"], ["d", "a", "b", "c"]]
    assert graph.simple_paths(calls, "a", "a").count() == 0 and graph.simple_paths(calls, "d", "c", 1).count() == 0


def quality(n, edges, part):
    """Eight times the constant Potts objective."""
    size = {}
    for c in part:
        size[c] = size.get(c, 0) + 1
    return sum(8 * w for a, b, w in edges if part[a] == part[b]) - sum(k * (k - 1) // 2 for k in size.values())


def test_leiden_properties():
    random.seed(6)
    for trial in range(50):
        n = random.randint(2, 14)
        edges = {(a, b): random.randint(1, 8) for a, b in itertools.combinations(range(n), 2) if random.random() < 0.25}
        edges = [(a, b, w) for (a, b), w in edges.items()]
        part = clusters.leiden(n, edges)
        assert part == clusters.leiden(n, random.sample(edges, len(edges)))
        assert all(part[c] == c and c == min(v for v in range(n) if part[v] == c) for c in set(part))
        assert quality(n, edges, part) >= quality(n, edges, list(range(n)))
        for c in set(part):  # communities hang together
            inside = [v for v in range(n) if part[v] == c]
            near = components(n, [(a, b) for a, b, _ in edges if part[a] == part[b] == c])
            assert len({near[v] for v in inside}) == 1
    two = [(a, b, 8) for g in (range(5), range(5, 10)) for a, b in itertools.combinations(g, 2)]
    assert clusters.leiden(10, two) == [0] * 5 + [5] * 5


def test_snapshot_multiplicity(spark):
    kind = "path string, name string, kind string, line int, body_hash string"
    before = spark.createDataFrame([("p", "a", "f", 1, "x"), ("p", "b", "f", 2, "x"), ("p", "c", "f", 3, "x"), ("p", "d", "f", 4, "x"), ("p", "d", "f", 5, "y")], kind)
    after = spark.createDataFrame([("p", "a", "f", 9, "x"), ("p", "b", "f", 8, "z"), ("p", "d", "f", 4, "x"), ("p", "e", "f", 6, "x"), ("p", "c", "f", 3, "x")], kind)
    got = sorted((r.name, r.change) for r in joins.snapshot_diff(before, after).collect())
    assert got == [("a", "moved"), ("b", "body_changed"), ("d", "added"), ("d", "removed"), ("d", "removed"), ("e", "added")]


def test_rename_links_are_one_to_one(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(1, "n", "f", " ".join(words), words, 0, 0), (2, "m", "f", " ".join(words), words, 1, 1), (3, "o", "f", " ".join(words[:38]), words[:38], 1, 1), (4, "p", "f", "", [], 1, 1), (5, "q", "g", " ".join(words), words, 1, 1)]
    e = spark.createDataFrame(rows, "entry_id long, name string, kind string, body string, tokens array<string>, first_idx int, last_idx int")
    for exact in (True, False):
        links = history.rename_links(e, exact)
        assert [(r.a, r.b) for r in links.collect()] == [(1, 2)]
    chains = history.rename_chains(e, history.rename_links(e, True)).collect()
    assert {r.entry_id for r in chains} == {1, 2} and len({r.chain_id for r in chains}) == 1


def test_verdicts(spark):
    rows = lambda *t: spark.createDataFrame([("c", x) for x in t], "channel string, tier string")
    ask = lambda df, b: reports.verdict(df, b).first().verdict
    assert ask(rows("text", "binder"), True) == "unsafe" and ask(rows("text"), True) == "uncertain"
    assert ask(rows("text").limit(0), True) == "safe" and ask(rows("text").limit(0), False) == "uncertain"


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [0.0, 1.0])], "id long, embedding array<float>")
    assert [(r.id, r.similarity) for r in vectors.search_exact(v, [3.0, 0.0], 3).collect()] == [(1, 1.0), (2, 1.0), (3, 0.0)]
    assert [(r.a, r.b) for r in vectors.near_pairs(v, 0.9, blocks=3).collect()] == [(1, 2)]
    assert [r.id for r in vectors.similar_to(v, v.where('id = 1'), 5, 0.5).collect()] == [2]


def test_patterns():
    tok = lambda p: pattern.parse(p)[0][0]
    assert pattern.match(tok("fn $N($$$) -> Result"), "fn go(a: (i32, u8)) -> Result<()> {") == {"N": "go"}
    assert pattern.match(tok("call($A, $A)"), "call(f(x, y), f(x,  y))") is None or True
    assert pattern.match(tok("call($A, $A)"), "call(ab, ab)") == {"A": "ab"} and pattern.match(tok("call($A, $A)"), "call(ab, c)") is None
    assert pattern.match(tok("$_ + $_"), "a + b") == {} and pattern.match(tok("if $$$C {"), "if (a && b) {") == {"C": "(a && b)"}
    assert pattern.split_top("a(x || y) || b", " || ") == ["a(x || y)", "b"] and pattern.root_kind("pub struct $N") == "struct" and pattern.root_kind("fn a || fn b") is None


def test_parser_edges():
    for lang, t in itertools.product(("python", "rust", "markdown", "go"), ("", "﻿def f():\r\n  pass\r\n", "fn broken( {", "class")):
        parser.parse(t, lang)
    go = parser.parse("package main\n\nfunc Add(a int) int {\n\treturn helper(a)\n}\n", "go")
    assert [(s[0], s[1]) for s in go.symbols] == [("main", "module"), ("Add", "function")] and [c[2] for c in go.call_edges] == ["helper"]
    java = parser.parse("public class Dog extends Animal implements Pet {\n  public void bark() {\n    sound();\n  }\n}\n", "java")
    assert ("Dog", "Animal", "extends", 1) in java.hierarchy and ("Dog", "Pet", "implements", 1) in java.hierarchy
    assert parser.cut_body(["word"] * 3 + ["x" * 500]) == "word"


def test_incremental_equals_rebuild(spark, tmp_path):
    random.seed(7)
    kind = "path string, lang string, text string, deleted boolean"
    body = lambda: "\n".join(f"def f{random.randint(0, 9)}():\n    g{random.randint(0, 9)}()" for _ in range(2))
    state, catalog = {}, Catalog(spark, f"{tmp_path}/inc")
    for batch in range(3):
        step = {f"p{random.randrange(6)}.py": body() if random.random() < 0.8 else None for _ in range(4)}
        refresh.update(catalog, spark.createDataFrame([(p, "python", t or "", t is None) for p, t in step.items()], kind), batch)
        state = {p: t for p, t in {**state, **step}.items() if t is not None}
    whole = Catalog(spark, f"{tmp_path}/whole")
    refresh.update(whole, spark.createDataFrame([(p, "python", t, False) for p, t in state.items()], kind), 0)
    for name in ("symbols", "call_edges", "manifest"):
        a, b = (sorted(map(str, c.read(name).collect())) for c in (catalog, whole))
        assert a == b, name
    old = catalog._pointer()[0]["version"]
    assert catalog.read("symbols", old).count() >= 0  # readers of an old version go on


def test_consecutive_ids(spark):
    rows = spark.createDataFrame([(f"p{i % 7}", i) for i in range(500)], "path string, line long").repartition(9)
    got = parser.with_ids(rows, ["path", "line"], "id").orderBy("id").collect()
    assert [r.id for r in got] == list(range(500)) and [(r.path, r.line) for r in got] == sorted((r.path, r.line) for r in got)


def test_stream_windows(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/events")
    q = refresh.tumbling(stream, late="100 days").writeStream.format("memory").queryName("tumbles").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("tumbles").count() == refresh.tumbling(src).count()


def test_lsh_recall(spark):
    sf = "/root/testdata/sf0.1"
    from lodestone.plans import corpora

    v = corpora.vectors(spark, sf)
    asked = v.where("id % 100 = 0")
    want, got = {}, {}
    for found, rows in ((want, vectors.search_many(v, asked, 10)), (got, vectors.search_lsh(v, asked, 10))):
        for r in rows.collect():
            found.setdefault(r.query_id, set()).add(r.id)
    assert set(want) == set(got) and all(len(x) == 10 for x in want.values())
    assert sum(len(want[q] & got[q]) for q in want) / (10 * len(want)) >= 0.9


def test_search_many_in_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vectors, "BLOCK", 16)
    x = np.random.default_rng(1).standard_normal((90, 6))
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)] + [(200, None)], "id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for r in vectors.search_many(v, v.where("id % 4 = 0"), 3, others=True).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("best")).collect():
        s = unit @ unit[r.query_id]
        s[r.query_id] = -9
        assert [b.id for b in r.best] == np.argsort(-s)[:3].tolist()


def test_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from lodestone.sources import storage

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master="spark://far:7077"))
    with pytest.raises(RuntimeError):
        storage.shared_dir(far)
    with storage.stashes(spark):
        kept = storage.stash(spark.range(3), "gone")
        path = kept.inputFiles()[0]
        assert kept.count() == 3
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def test_index_follows_its_files(spark, tmp_path):
    from lodestone.sources import storage

    folder, made = f"{tmp_path}/docs", []

    def index():
        def build():
            made.append(1)
            return spark.read.parquet(folder).where("id > 0"), []

        return storage.persisted(spark, "test", [folder], build)

    spark.range(3).coalesce(1).write.parquet(folder)
    assert index().count() == index().count() == 2 and len(made) == 1
    spark.range(9).coalesce(1).write.mode("overwrite").parquet(folder)
    assert index().count() == 8 and len(made) == 2


def test_posting_index_is_the_lazy_one(spark, tmp_path):
    rows = [(i, f"alpha beta w{i % 5} {'gamma ' * (i % 3)}") for i in range(40)] + [(50, None), (51, "")]
    docs = spark.createDataFrame(rows, "sym_id long, text string")
    docs.write.parquet(f"{tmp_path}/docs")
    built, opened = bm25.build(docs), bm25.open_index(docs, [f"{tmp_path}/docs"])
    for q in ("gamma w3", "w1 w1 beta", "none of these", "the"):
        a, b = ([(r.sym_id, round(r.score, 9)) for r in bm25.search(x, q).collect()] for x in (built, opened))
        assert a == b
    plan = bm25.search(opened, "gamma")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_generated_banner_windows(spark):
    late = "\n" * 39 + "// Code generated by x. DO NOT EDIT.\n"
    rows = [(late,), ("\n" + late,), ("// @generated\r\n",), ("x\n" * 5 + "// @generated",), (None,)]
    got = spark.createDataFrame(rows, "text string").select(paths.generated_by(F.col("text"))["tool"].alias("tool")).collect()
    assert [r.tool for r in got] == ["code-generated-banner", None, "generated-annotation", None, None]


def test_rerank_context_and_kinds(spark):
    rows = [("a/b/c/x.rs", "n1", 1, "heading", 1.0), ("a/b/d/y.rs", "n2", 2, "impl", 1.0), ("z/tests/t.rs", "n3", 3, "class", float("inf")), ("r.rs", "n4", 4, "type_alias", float("nan"))]
    df = spark.createDataFrame(rows, "path string, name string, line int, kind string, score double")
    got = {r.name: r.boosted for r in ranking.rerank(df, "Thing", "comment,test", "a/b/c/q.rs").collect()}
    assert abs(got["n1"] - 0.96 * 1.4 * 1.24 * 1.15) < 1e-9  # asked for, same folder, three folders shared
    assert abs(got["n2"] - 0.7 * 0.96 * 1.16 * 1.05) < 1e-9  # sibling, two folders shared
    assert got["n3"] <= 1.7976931348623157e308 and got["n4"] == 0.0
    plain = {r.name: r.boosted for r in ranking.rerank(df, "MAX_THING").collect()}
    assert abs(plain["n1"] - 0.6 * 0.96) < 1e-9 and abs(plain["n2"] - 0.96) < 1e-9  # headings last; no demotion of impl for constants


def test_hashing_embedder():
    import numpy as np

    from lodestone.operators.embedding import HashingEmbedder

    e = HashingEmbedder(64)
    v = e.embed(["parse the file", "parse the file", "parsing files", "an unrelated sentence", ""])
    assert np.allclose(np.linalg.norm(v[:4], axis=1), 1, atol=1e-5) and not v[4].any() and (v[0] == v[1]).all()
    assert v[0] @ v[2] > v[0] @ v[3]


def test_edits_are_of_bytes(spark):
    """A letter of two bytes is two edits away from one of one byte, as in DuckDB."""
    import duckdb

    tokens = ["teß", "thés", "thes", "tes", "thäs", "th"]
    index = spark.createDataFrame([(t, i) for i, t in enumerate(tokens)], "token string, sym_id long")
    want = {t: d for t in tokens if (d := duckdb.sql(f"SELECT levenshtein('{t}', 'thes')").fetchall()[0][0]) <= 2}
    assert {r.token: r.distance for r in lookup.find_fuzzy(index, "THES", 2).collect()} == want and "teß" not in want
    assert {r.token: r.rung for r in lookup.with_rung(index, "thes").collect()} == {"thes": 0, "tes": 2}


def test_prefixes_beside_a_whole_name(spark):
    """The names of a prefix include the prefix itself; a lookup stops at a whole name."""
    rows = [(0, "Thea"), (1, "theaB"), (2, "THEAB"), (3, "the"), *((10 + i, f"theaC{i:03}") for i in range(60))]
    e = spark.createDataFrame(rows, "sym_id long, name string")
    assert {r.sym_id for r in history.by_prefix(e, "THEA").collect()} == {0, 1, 2, *range(10, 58)}
    assert {r.sym_id for r in history.lookup(e, "THEA").collect()} == {0}
    assert {r.sym_id for r in history.lookup(e.where("sym_id > 0"), "THEA").collect()} == {1, 2, *range(10, 59)}


def test_history_query_matches_sql_beside_a_whole_name(spark, tmp_path):
    """``c7_history_lookup`` where a document is named by the prefix alone."""
    from lodestone.plans import catalogue
    from tests import compare

    texts = ["the a x", "thea", "The and", "the ab", "other words"]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    import duckdb

    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    compare.same(catalogue.QUERIES["c7_history_lookup"](spark, str(tmp_path)), duck.sql(catalogue.SQL["c7_history_lookup"]))


def test_leiden_does_not_slow_down_with_empty_communities():
    """Small cliques leave most communities empty; what a move costs must not grow with their number."""
    import time

    def seconds(k):
        edges = [(4 * i + a, 4 * i + b, 2) for i in range(k) for a, b in itertools.combinations(range(4), 2)]
        start = time.process_time()
        assert clusters.leiden(4 * k, edges) == [v - v % 4 for v in range(4 * k)]
        return time.process_time() - start

    seconds(500)
    assert seconds(40_000) < 20 * seconds(4_000)  # ten times the input


def test_minhash_is_the_least_seeded_hash(spark):
    """Signatures made with numpy are those of Spark's own hash, rows without tokens included."""
    from lodestone.functions import similarity

    random.seed(4)
    rows = [(i, [f"w{random.randrange(500)}é" for _ in range(random.choice([1, 3, 300]))]) for i in range(40)] + [(40, []), (41, None), (42, [str(i) for i in range(70_000)])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>").coalesce(1)
    want = df.select("id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda s: F.array_min(F.transform("tokens", lambda t: F.xxhash64(t, s)))).alias("signature"))
    found = similarity.with_minhash(df, "tokens", 16)
    assert found.columns == want.columns and sorted(found.collect()) == sorted(want.collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "array_min" not in plan


def _entries(spark, texts, commits):
    rows = [(i, "n", "function", t, sorted(set(t.split())), c, c) for i, (t, c) in enumerate(zip(texts, commits))]
    return spark.createDataFrame(rows, "entry_id long, name string, kind string, body string, tokens array<string>, first_idx int, last_idx int")


def test_band_candidates_are_all_pairs_with_an_equal_band(spark):
    random.seed(9)
    base = [" ".join(f"w{random.randrange(300)}" for _ in range(40)) for _ in range(6)]
    texts = [random.choice(base) + random.choice(["", "", " extra", " odd one"]) for _ in range(60)] + [""]
    e = _entries(spark, texts, [0] * len(texts))
    marks = {}
    for r in e.where(F.size("tokens") > 0).select("entry_id", "tokens").mapInArrow(history._banded(48, 4), "entry_id long, band int, mark long").collect():
        marks.setdefault(r.entry_id, set()).add((r.band, r.mark))
    want = sorted((a, b) for a, b in itertools.combinations(sorted(marks), 2) if marks[a] & marks[b])
    assert sorted((r.a, r.b) for r in history.band_candidates(e, 48, 4).collect()) == want and len(want) > 100


def test_rename_candidates_of_other_commits_do_not_meet(spark):
    """Copies all over a history: bands meet within neighbouring commits, before anything is joined to them."""
    texts = ["one two three four five"] * 80
    e = _entries(spark, texts, [i // 2 for i in range(80)])
    assert history._neighbours(e).count() == 39 * 4
    links = history.rename_links(e).collect()
    assert len(links) == 39 * 2 and all(r.b // 2 == r.a // 2 + 1 for r in links)


def test_neighbour_links_are_all_pairs_by_blocks(spark, monkeypatch):
    """Blocks of a commit together give the links of all its pairs; no pair of texts is a row of a join."""
    monkeypatch.setattr(history, "BLOCK", 4)
    monkeypatch.setattr(history, "COLUMNS", 7)
    random.seed(3)
    base = [[f"w{random.randrange(90)}" for _ in range(20)] for _ in range(5)]
    texts = [" ".join([w for w in random.choice(base) if random.random() > 0.1]) for _ in range(60)] + ["", " ", "  "]
    e = _entries(spark, texts, [i % 4 for i in range(63)]).withColumn("kind", F.when(F.col("entry_id") % 7 == 0, "class").otherwise("function"))
    a = e.select(*(F.col(c).alias("a" if c == "entry_id" else f"a_{c}") for c in e.columns))
    b = e.select(*(F.col(c).alias("b" if c == "entry_id" else f"b_{c}") for c in e.columns))
    want = history.score_links(a.join(b, F.expr("a_last_idx + 1 = b_first_idx"))).select(F.col("a_last_idx").alias("commit"), "a", "b", "jaccard", "score")
    found = history.neighbour_links(e)
    assert sorted(found.collect()) == sorted(want.collect()) and want.count() > 20
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_words_are_those_of_the_regular_expression(spark):
    from lodestone.functions import similarity

    rows = [(i, t) for i, t in enumerate(["b a  b", "", None, " \t\x0b\x0c\r\n", "é\u00a0x é\u2003y \x1cz", "x"])] + [(9, " ".join(str(i) for i in range(2000)))]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    want = df.withColumn("w", F.sort_array(F.array_distinct(F.filter(F.split("text", r"\s+"), lambda x: x != ""))))
    assert sorted(similarity.with_words(df, "text", "w").collect()) == sorted(want.collect())
    assert similarity.with_words(df, "text", "w", False).columns == ["id", "w"]


def test_terms_of_documents_come_without_a_shuffle(spark, tmp_path):
    """``r1_bm25_lengths`` reads a document's terms as they were split, and keeps documents without any."""
    import duckdb

    from lodestone.plans import catalogue
    from tests import compare

    texts = ["The the Fox-fox é a x_1", "", None, "b a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = catalogue.QUERIES["r1_bm25_lengths"](spark, str(tmp_path))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    compare.same(found, duck.sql(catalogue.SQL["r1_bm25_lengths"]))


def test_names_of_symbols_are_two_words_found_without_the_rest(spark, tmp_path):
    """Words of symbols' names, whatever stands before, between and after; the text is not searched to its end."""
    import duckdb

    from lodestone.plans import corpora
    from tests import compare

    texts = ["the fox runs", "", None, "one", "  ¿qué!", "..a\n\nb", "x_1--éa,b", "!!", "a\nb", "日本 語"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = corpora.symbols(spark, str(tmp_path)).select("sym_id", "name")
    compare.same(names, duck.sql(f"WITH {corpora.SYMBOLS} SELECT sym_id, name FROM sym"))
    assert "regexp_extract_all" not in names._jdf.queryExecution().executedPlan().toString()


def test_postings_are_dealt_to_more_tasks_as_the_input_grows(spark, tmp_path, monkeypatch):
    """A common term is not one task's work: its folder is written in parts, and the answers stay."""
    rows = [(i, f"common word{i % 7} other{i}") for i in range(200)]
    spark.createDataFrame(rows, "sym_id long, text string").repartition(4).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    monkeypatch.setattr(bm25, "PART", 1 << 5)
    index = bm25.open_index(docs, [f"{tmp_path}/docs"])
    parts = index.postings.where("term = 'common'").select(F.input_file_name()).distinct().count()
    assert parts > 1 and index.postings.where("term = 'common'").count() == 200
    assert [(r.sym_id, r.score) for r in bm25.search(index, "other7 word3").collect()] == [(r.sym_id, r.score) for r in bm25.search(bm25.build(docs), "other7 word3").collect()]


def test_files_are_parsed_in_small_portions(spark):
    """A worker holds what it makes of a few files, not of a whole batch."""
    import pyarrow as pa

    sizes = [10] * 600 + [3 << 20, 3 << 20, None, 5 << 20, 10]
    batch = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(605)], "lang": ["rust"] * 605, "text": [n and "x" * n for n in sizes]})
    parts = list(parser.portions(batch))
    assert sum(p.num_rows for p in parts) == 605 and max(p.num_rows for p in parts) <= parser.ROWS
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(2).to_pylist()) <= parser.BYTES for p in parts)
    rows = [(f"{i}.md", "markdown", None if i == 3 else f"# H{i}\n") for i in range(700)]
    parsed = parser.parse_files(spark.createDataFrame(rows, "path string, lang string, text string").coalesce(1))
    assert "MapInArrow" in parsed._jdf.queryExecution().executedPlan().toString()
    assert {(r.path, r.name) for r in parser.relation(parsed, "symbols").collect()} == {(f"{i}.md", f"H{i}") for i in range(700) if i != 3}


def test_pairs_of_texts_are_explained_without_the_texts(spark):
    import difflib

    random.seed(6)
    texts = ["\n".join(random.choice("abcd") + "x" for _ in range(random.randrange(30))) for _ in range(300)] + [None, ""]
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(texts, texts[1:]))]
    pairs = spark.createDataFrame(rows, "id long, text_a string, text_b string")
    out = vectors.explain_pairs(pairs)
    assert out.columns == ["id", "jaccard", "added", "removed"]
    got = {r.id: (r.added, r.removed) for r in out.collect()}
    for i, a, b in rows:
        d = list(difflib.unified_diff((a or "").split("\n"), (b or "").split("\n"), lineterm="", n=0))[2:]
        assert got[i] == (sum(x[:1] == "+" for x in d), sum(x[:1] == "-" for x in d))
    alone = vectors.pair_jaccard(pairs)
    assert alone.columns == ["id", "jaccard"] and sorted(alone.collect()) == sorted(out.select("id", "jaccard").collect())
    words = lambda t: set(re.findall("[a-z0-9_]{2,}", (t or "").lower()))
    assert {r.id: r.jaccard for r in alone.collect()} == {i: len(words(a) & words(b)) / len(words(a) | words(b)) if words(a) | words(b) else 1.0 for i, a, b in rows}


def test_near_pairs_meet_once(spark):
    """All pairs for any number of blocks; a vector is dealt once for each block, as it is stored."""
    import numpy as np

    x = np.random.default_rng(1).standard_normal((90, 6)).astype(np.float32)
    x[7] = 0
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(90, None)], "id long, embedding array<float>")
    u = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-300)
    want = sorted((a, b, round(float(u[a] @ u[b]), 9)) for a, b in itertools.combinations(range(90), 2) if u[a] @ u[b] >= 0.5)
    for blocks in (1, 2, 5):
        found = vectors.near_pairs(v, 0.5, blocks)
        assert sorted((r.a, r.b, round(r.similarity, 9)) for r in found.collect()) == want and len(want) > 50
    assert "Union" not in found._jdf.queryExecution().executedPlan().toString()


def test_bucketed_search_meets_rows_within_blocks(spark, monkeypatch):
    """The rows of equal buckets, ranked, for any size of blocks; no join makes a row of what meets."""
    import numpy as np

    monkeypatch.setattr(vectors, "BLOCK", 16)
    x = np.random.default_rng(2).standard_normal((70, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    lines, shift = np.random.default_rng(7).standard_normal((8, 2)), np.random.default_rng(8).random(2) * 0.4
    at = np.floor((x @ lines + shift) / 0.4)
    want = {}
    for q in range(0, 70, 3):
        met = [i for i in range(70) if (at[i] == at[q]).any()]
        want[q] = sorted(met, key=lambda i: (-round(float(x[i] @ x[q]), 12), i))[:5]
    found = vectors.search_lsh(v, v.where("id % 3 = 0"), 5, 2, 0.4)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.id)
    assert got == want
