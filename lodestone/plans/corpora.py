"""The test tables as relations, and the same relations as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("function", "method", "class", "struct", "constant", "heading", "module")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as symbols: ten to a file, named by their first two words."""
    d = table(spark, sf_dir, "documents")
    skip, word = r"[^\p{L}\p{N}_]", r"[\p{L}\p{N}_]"  # possessive: a text is read to its second word and no further
    w1, w2 = (F.coalesce(F.regexp_extract("text", rf"\A{skip}*+{before}({word}++)", 1), F.lit("")) for before in ("", f"{word}++{skip}++"))
    upper = F.translate(F.substring(w2, 1, 1), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % len(KINDS) + 1).cast("int"))
    return d.select(
        F.col("doc_id").alias("sym_id"),
        F.concat(w1, upper, F.substring(w2, 2, 1000)).alias("name"),
        kind.alias("kind"),
        F.concat_ws("/", "source", "lang", F.concat(F.when(F.col("doc_id") % 40 < 10, "tests/f").otherwise("src/f"), F.floor(F.col("doc_id") / 10).cast("string"), F.lit(".txt"))).alias("path"),
        (F.col("doc_id") % 10 * 20 + 1).cast("int").alias("line"),
        F.element_at(F.split("text", "\n"), 1).alias("signature"),
        "text",
        "lang",
        "source",
    )


SYMBOLS = r"""
sym AS (
  SELECT doc_id AS sym_id,
    concat(w1, translate(substring(w2, 1, 1), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), substring(w2, 2, 1000)) AS name,
    (['function', 'method', 'class', 'struct', 'constant', 'heading', 'module'])[doc_id % 7 + 1] AS kind,
    concat(source, '/', lang, '/', CASE WHEN doc_id % 40 < 10 THEN 'tests/f' ELSE 'src/f' END, doc_id // 10, '.txt') AS path,
    (doc_id % 10 * 20 + 1)::INT AS line, string_split(text, chr(10))[1] AS signature, text, lang, source
  FROM (SELECT *, coalesce(w[1], '') AS w1, coalesce(w[2], '') AS w2
        FROM (SELECT *, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM documents)))
"""


def named(spark: SparkSession, sf_dir: str, truth: list[tuple], name: str) -> DataFrame:
    """Documents that bear the names of a truth table (name, what is true of it) in turn: doc_id, name, text."""
    names = F.array(*(F.lit(t[0]) for t in truth))
    return table(spark, sf_dir, "documents").select("doc_id", F.element_at(names, (F.col("doc_id") % len(truth) + 1).cast("int")).alias(name), "text")


def truth_sql(truth: list[tuple], *columns: str) -> str:
    """The same documents with the truth table's columns beside them."""
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {', '.join(map(show, t))})" for k, t in enumerate(truth))
    return f"SELECT doc_id, {', '.join(columns)} FROM (SELECT doc_id FROM documents) JOIN (VALUES {rows}) v(k, {', '.join(columns)}) ON k = doc_id % {len(truth)}"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one file each: (path, text, lang)."""
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text", "lang")


FILES = "files AS (SELECT 'f' || doc_id || '.txt' AS path, text, lang FROM documents)"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls from customers' functions to parts' functions: edge_id, caller, callee, line."""
    n = table(spark, sf_dir, "part").count()
    e = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("caller"), ((F.col("o_orderkey") * 7 + 3) % n).alias("callee"), (F.col("o_orderkey") % 50 + 1).cast("int").alias("line")
    )
    return e.where("caller <> callee")


CALLS = """
calls AS (
  SELECT * FROM (
    SELECT o_orderkey AS edge_id, o_custkey AS caller, (o_orderkey * 7 + 3) % (SELECT count(*) FROM part) AS callee, (o_orderkey % 50 + 1)::INT AS line
    FROM orders) WHERE caller <> callee)
"""


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the functions that calls name, two of thirty alike: def_id, node, name, path, def_line."""
    n = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        n.alias("def_id"), n.alias("node"), F.concat(F.when(n % 5 == 0, "test_fn").otherwise("Fn"), F.when(n % 30 == 29, n - 1).otherwise(n).cast("string")).alias("name"),
        F.concat(F.when(n % 5 == 0, "pkg/tests/test_m").otherwise("pkg/src/m"), F.floor(n / 10).cast("string"), F.lit(".py")).alias("path"), (n % 10 * 10 + 1).cast("int").alias("def_line"),
    )


FUNCTIONS = """
fns AS (
  SELECT n AS def_id, n AS node, concat(CASE WHEN n % 5 = 0 THEN 'test_fn' ELSE 'Fn' END, CASE WHEN n % 30 = 29 THEN n - 1 ELSE n END) AS name,
    concat(CASE WHEN n % 5 = 0 THEN 'pkg/tests/test_m' ELSE 'pkg/src/m' END, n // 10, '.py') AS path, (n % 10 * 10 + 1)::INT AS def_line
  FROM (SELECT p_partkey AS n FROM part))
"""


def named_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by the callee's name: edge_id, caller_id, callee, line."""
    f = functions(spark, sf_dir).select(F.col("node").alias("callee"), F.col("name"))
    return calls(spark, sf_dir).join(f, "callee").select("edge_id", F.col("caller").alias("caller_id"), F.col("name").alias("callee"), "line")


NAMED_CALLS = "ncalls AS (SELECT edge_id, caller AS caller_id, fns.name AS callee, line FROM calls JOIN fns ON fns.node = calls.callee)"


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers and suppliers as types: parent, child, kind."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("parent"), F.concat(F.lit("nation"), F.col("n_nationkey").cast("string")).alias("child"), F.lit("extends").alias("kind"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("parent"), F.concat(F.lit("customer"), F.col("c_custkey").cast("string")).alias("child"), F.lit("implements").alias("kind"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("parent"), F.concat(F.lit("supplier"), F.col("s_suppkey").cast("string")).alias("child"), F.lit("uses").alias("kind"))
    return n.unionByName(c).unionByName(s)


HIERARCHY = """
hier AS (
  SELECT 'region' || n_regionkey AS parent, 'nation' || n_nationkey AS child, 'extends' AS kind FROM nation
  UNION ALL SELECT 'nation' || c_nationkey, 'customer' || c_custkey, 'implements' FROM customer
  UNION ALL SELECT 'nation' || s_nationkey, 'supplier' || s_suppkey, 'uses' FROM supplier)
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the symbols: some only before, some only after, some moved, some changed."""
    s = symbols(spark, sf_dir)
    before = s.where("sym_id % 10 < 8").select("path", "name", "kind", "line", F.md5("text").alias("body_hash"))
    moved = F.when(F.col("sym_id") % 7 == 3, F.col("line") + 5).otherwise(F.col("line")).cast("int")
    edited = F.md5(F.when(F.col("sym_id") % 11 == 4, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    after = s.where("sym_id % 10 > 1").select("path", "name", "kind", moved.alias("line"), edited.alias("body_hash"))
    return before, after


SNAPSHOTS = (
    SYMBOLS
    + """,
before_ AS (SELECT path, name, kind, line, md5(text) AS h FROM sym WHERE sym_id % 10 < 8),
after_ AS (
  SELECT path, name, kind, (CASE WHEN sym_id % 7 = 3 THEN line + 5 ELSE line END)::INT AS line,
    md5(CASE WHEN sym_id % 11 = 4 THEN text || '!' ELSE text END) AS h FROM sym WHERE sym_id % 10 > 1)
"""
)


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sightings of blobs at paths in commits: path, blob, commit_idx."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("p"), (F.col("o_custkey") % 50).cast("string")).alias("path"), F.col("o_orderstatus").alias("blob"), F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).alias("commit_idx")).distinct()


SIGHTINGS = "seen AS (SELECT DISTINCT 'p' || (o_custkey % 50) AS path, o_orderstatus AS blob, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::INT AS commit_idx FROM orders)"
