"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair.

A document's set holds its distinct 3-word shingles as 64-bit hashes. Shingles are put in
one global order, rare ones first, by counts over all documents. Two sets that reach the
threshold share a shingle in their prefixes, so sets meet on prefix shingles only:

1. Counts: every partition adds its shingles to a table of ``1 << BITS`` cells; the sum is
   as large for any input. A cell may mix shingles; that moves some in the order, which
   stays one order for all, so no pair is lost.
2. Every document gives its prefix. Documents with one set are one from here on.
3. Prefix shingles that two sets have are kept; their sets are dealt to square cells of
   about ``2 * CHUNK`` sets or ``2 * HELD`` shingles, whichever is less, so that a shingle of
   a third of all rows is shared out and cells of long texts hold fewer of them.
4. A cell lists its pairs by length, by place in the prefix, and only where the shingle is
   the first that the two prefixes share, so each pair is listed in one cell.
5. Cells that list pairs get the texts of those sets once, drop pairs by the suffix
   filter, verify the rest exactly and return links as one row per set and cell.
6. Links grow to components by repeated star contraction.

Edges. A null or empty text, or one of blanks, has an empty set and links with nothing; so
does a row with a null id, whose component is null. Fewer words than a shingle make one
shingle of the whole. Sets are named by their digest, so rows that share an id are judged
each by its own text; the component is the least id. Ties in the global order are broken by the hash. An empty table
gives an empty result. Extra columns are not read. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import add_arrays, hash_words, mix, prepare, roll, sliced, stash, text_bytes, tidy
from lodestone.operators.graph import connected_components

WIDTH = 3
BITS = 19
PIECES = 64
#: Sets, and shingles, that a side of a cell holds about.
CHUNK = 512
HELD = 1 << 21


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        hashes = hash_words(words)
        if len(words) < width:  # a set of its own, apart from shingles of whole width
            return mix(roll(hashes, len(words)) + np.uint64(len(words)))
        return np.unique(roll(hashes, width))


def prefix_size(n: int, percent: int) -> int:
    """A set of ``n`` must share one of its first so many elements with any partner."""
    return n - (percent * n + 99) // 100 + 1 if n else 0


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - BITS)).astype(np.int64)


def _counter(width: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS, np.int64)
        seen = False
        for b in sliced(batches, 0):
            sets = [_cell(shingle_set(x.as_py(), width)) for x in b.column(0)]
            if sets:
                table += np.bincount(np.concatenate(sets), minlength=1 << BITS)
                seen = True
        if seen:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * PIECES, pa.int32()),
                    pa.array(range(PIECES), pa.int32()),
                    pa.array([x.tobytes() for x in np.split(table, PIECES)], pa.binary()),
                ],
                ["part", "piece", "counts"],
            )

    return count


def shingle_counts(docs: DataFrame, width: int = WIDTH) -> np.ndarray:
    """How often each cell's shingles occur, over all documents: ``1 << BITS`` numbers."""
    parts = docs.select(text_bytes().alias("text")).mapInArrow(tidy(_counter(width)), "part int, piece int, counts binary")
    table = np.zeros((PIECES, (1 << BITS) // PIECES), np.int64)
    for r in add_arrays(parts).collect():  # PIECES rows
        table[r.piece] = np.frombuffer(r.counts, np.int64)
    return table.ravel()


def rare_first(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A sorted set in the global order: by count, then by hash."""
    return shingles[np.argsort(counts[_cell(shingles)], kind="stable")]


def _prefixer(counts, width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for b in sliced(batches, 1):
            sizes, marks, prefixes = [], [], []
            for x in b.column(1):
                s = shingle_set(x.as_py(), width)
                sizes.append(len(s))
                marks.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                prefixes.append(rare_first(s, table)[: prefix_size(len(s), percent)].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "mark", "prefix"],
            )

    return run


def need(a, b, percent: int):
    """The least intersection with which sets of sizes ``a`` and ``b`` reach the threshold."""
    return -(-percent * (a + b) // (100 + percent))


def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell (token, a, b), from batches sorted by these; a cell may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        if held and tuple(keys[:, 0]) != last:
            yield pa.Table.from_batches(held)
            held = []
        lo = 0
        for hi in cuts.tolist():
            yield pa.Table.from_batches([*held, b.slice(lo, hi - lo)])
            held, lo = [], hi
        held.append(b.slice(lo))
        last = tuple(keys[:, -1])
    if held:
        yield pa.Table.from_batches(held)


def list_pairs(n: list[int], at: list[int], side: list[int], before: list[list[int]], percent: int, within: bool):
    """Pairs of row numbers of one cell that pass the filters.

    For each row: n is the set's size, at the place of this shingle in the prefix, side its
    chunk, and before the shared shingles earlier in the prefix. Pairs of one chunk are
    listed where ``within``; else pairs across the two chunks.
    """
    if len(n) <= 12:
        for i in range(len(n)):
            for j in range(i + 1, len(n)):
                if (
                    (within or side[i] != side[j])
                    and 100 * min(n[i], n[j]) >= percent * max(n[i], n[j])
                    and min(n[i] - at[i], n[j] - at[j]) >= need(n[i], n[j], percent)
                    and not (before[i] and before[j] and not set(before[i]).isdisjoint(before[j]))
                ):
                    yield i, j
        return
    size, place, chunk = np.array(n), np.array(at), np.array(side)
    ok = np.triu(np.ones((len(n), len(n)), bool), 1)
    if not within:
        ok &= chunk[:, None] != chunk[None, :]
    ok &= 100 * np.minimum(size[:, None], size[None, :]) >= percent * np.maximum(size[:, None], size[None, :])  # length
    room = np.minimum((size - place)[:, None], (size - place)[None, :])
    ok &= room >= need(size[:, None], size[None, :], percent)  # place: this shingle is the first one shared
    where: dict[int, list[int]] = {}
    for i, ahead in enumerate(before):
        for s in ahead:
            where.setdefault(s, []).append(i)
    for hits in where.values():
        if len(hits) > 1:
            ok[np.ix_(hits, hits)] = False  # listed under an earlier shingle
    yield from zip(*(x.tolist() for x in np.nonzero(ok)))


def _lister(percent: int):
    names = ["token", "a", "b", "mark", "partners"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]
        for cell in by_cell(batches):
            if cell.num_rows < 2:
                continue
            token, a, b = (cell.column(k)[0].as_py() for k in range(3))
            marks, n, at, side, before = (cell.column(k).to_pylist() for k in range(3, 8))
            partners: dict[int, list[bytes]] = {}
            for i, j in list_pairs(n, at, side, before, percent, a == b):
                partners.setdefault(i, []).append(marks[j])
                partners.setdefault(j, [])
            for i, with_i in partners.items():
                for column, value in zip(out, (token, a, b, marks[i], b"".join(with_i))):
                    column.append(value)
            if len(out[0]) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names)
                out = [[] for _ in names]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names)

    return run


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 2) -> int:
    """No fewer than the elements that two sorted sets share: halves are compared by size."""
    if depth == 0 or not len(x) or not len(y):
        return min(len(x), len(y))
    mid = len(y) // 2
    cut = int(np.searchsorted(x, y[mid]))
    same = int(cut < len(x) and x[cut] == y[mid])
    return suffix_bound(x[:cut], y[:mid], depth - 1) + same + suffix_bound(x[cut + same :], y[mid + 1 :], depth - 1)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold: the suffix filter, then the exact count."""
    least = need(len(x), len(y), percent)
    if suffix_bound(x, y) < least:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verifier(width: int, percent: int, degrees: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in by_cell(batches):
            marks, partners, copies, texts = (cell.column(k).to_pylist() for k in range(3, 7))
            sets, pairs, weight = {}, {}, {}
            for m, p, c, t in zip(marks, partners, copies, texts):
                s = shingle_set(t, width)
                if m not in sets and hashlib.md5(s.tobytes()).digest() == m:  # rows may share an id
                    sets[m], pairs[m], weight[m] = s, p, c
            up = {m: m for m in sets}
            degree, met = dict.fromkeys(sets, 0), set()

            def root(m: bytes) -> bytes:
                while up[m] != m:
                    up[m] = up[up[m]]
                    m = up[m]
                return m

            for m, raw in pairs.items():
                for k in range(0, len(raw), 16):
                    other = raw[k : k + 16]
                    low, high = sorted((root(m), root(other)))
                    if low == high and not degrees:  # the two are of one class already
                        continue
                    if linked(sets[m], sets[other], percent):
                        degree[m] += weight[other]
                        degree[other] += weight[m]
                        met.update((m, other))
                        up[high] = low
            found = [(m, root(m), degree[m]) for m in met]
            if found:
                kinds = (pa.binary(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), kinds)], ["mark", "root", "links"])

    return run


def join_similar(docs: DataFrame, percent: int = 90, width: int = WIDTH, degrees: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (documents linked with it) of every row.

    Without ``degrees``, n_links is null, and pairs that others have joined already are not
    verified: groups of n near copies then cost about n comparisons in each cell, not n * n.
    """
    spark = docs.sparkSession
    prepare(spark)
    counts = spark.sparkContext.broadcast(shingle_counts(docs, width))  # 1 << BITS numbers, 4 MB
    texts = docs.select("doc_id", text_bytes().alias("text"))
    # Both sides of the joins below grow with the input. They are merged at every size, so that
    # what a small input tells of the plan holds for a large one.
    sets = stash(
        texts.mapInArrow(tidy(_prefixer(counts, width, percent)), "doc_id long, n_shingles long, mark binary, prefix array<long>"), "sets"
    )
    marked = sets.where("doc_id IS NOT NULL AND mark IS NOT NULL")
    # Sets are named by their least id, and a number where several share it, as long as there
    # are rows for each shingle: small numbers shrink when they are shuffled, digests don't.
    numbered = F.row_number().over(W.partitionBy("doc_id").orderBy("mark")) - 1
    groups = stash(
        marked.groupBy("mark").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).withColumn("tie", numbered), "groups"
    )

    # One document stands for each distinct set; repeated rows of it count once.
    reps = stash(
        marked.select("doc_id", "mark", F.col("n_shingles").cast("int").alias("n"), "prefix")
        .join(groups.hint("merge"), ["doc_id", "mark"])
        .dropDuplicates(["doc_id", "mark"])
        .select("doc_id", "tie", "n", "prefix"),
        "reps",
    )
    spread = reps.select("doc_id", "tie", "n", F.posexplode("prefix").alias("at", "token"))
    # Shingles that the same sets share lead to the same pairs: the first of them stands for
    # all. Such groups of sets are told by their number and a digest of their names.
    chunks = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / HELD)).cast("int")
    group = (F.count("*").alias("df"), chunks.alias("chunks"), F.bit_xor(F.xxhash64("doc_id", "tie")).alias("who"))
    shared = stash(spread.groupBy("token").agg(*group).where("df > 1"), "shared")
    hits = (
        spread.join(shared.hint("merge"), "token")
        .repartition("doc_id", "tie")
        .groupBy("doc_id", "tie", "n", "df", "chunks", "who")
        .agg(F.min(F.struct("at", "token")).alias("hit"))
        .groupBy("doc_id", "tie", "n")
        .agg(F.array_sort(F.collect_list(F.struct("hit.at", "hit.token", "chunks"))).alias("hits"))
    )  # no more than a document's own prefix
    hits = stash(hits.join(groups.hint("merge"), ["doc_id", "tie"]).select("mark", "n", "hits"), "hits")
    dealt = (
        hits.select("mark", "n", "hits", F.posexplode("hits").alias("k", "hit"))
        .select(
            F.col("hit.token").alias("token"), "mark", "n", F.col("hit.at").alias("at"),
            F.expr("transform(slice(hits, 1, k), x -> x.token)").alias("before"),
            F.col("hit.chunks").alias("chunks"),
        )
        .withColumn("side", F.pmod(F.xxhash64("mark"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("token", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "mark", "n", "at", "side", "before")
    )
    cell = ["token", "a", "b"]
    listed = stash(
        dealt.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(tidy(_lister(percent)), "token long, a int, b int, mark binary, partners binary"),
        "listed",
    )
    # Texts come to the listed rows by id and go straight on to their cells.
    wanted = stash(listed.join(groups.hint("merge"), "mark"), "wanted")
    links = stash(
        texts.join(wanted.hint("merge"), "doc_id")
        .select(*cell, "mark", "partners", "copies", "text")
        .repartition(*cell)
        .sortWithinPartitions(*cell)
        .mapInArrow(tidy(_verifier(width, percent, degrees)), "mark binary, root binary, links long"),
        "links",
    )
    found = connected_components(links.select(F.col("mark").alias("a"), F.col("root").alias("b")))
    members = stash(found.withColumnRenamed("node", "mark"), "members")
    least = stash(members.join(groups, "mark").groupBy("root").agg(F.min("doc_id").alias("component")), "least")
    degrees = links.groupBy("mark").agg(F.sum("links").alias("links"))
    placed = stash(members.join(least, "root").join(degrees, "mark", "left").select("mark", "component", "links"), "placed")
    classes = stash(
        groups.join(placed, "mark", "left").select(
            "mark", F.coalesce("component", "doc_id").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0)) if degrees else F.lit(None).cast("long")).alias("n_links")
        ),
        "classes",
    )
    alone = sets.where("doc_id IS NULL OR mark IS NULL").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0 if degrees else None).cast("long").alias("n_links")
    )
    return (
        sets.where("doc_id IS NOT NULL AND mark IS NOT NULL")
        .join(classes, "mark")
        .select("doc_id", "n_shingles", F.col("component").alias("component_id"), "n_links")
        .unionByName(alone)
    )


def drop_similar(docs: DataFrame, percent: int = 90, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` with one document of each component: that of the least id.

    Rows repeated with their text are one document. Rows that share an id but not the text
    stay apart. Rows without an id stay, all of them, and so do those without words. Columns of
    any name stay as they are. An empty table stays empty.
    """
    found = join_similar(docs, percent, width, degrees=False)
    kept = stash(
        found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("least"), F.count("*").alias("rows")).where("least = doc_id"), "kept"
    ).select("doc_id", "rows")
    # The whole row travels as one column, so that none of its names can clash with ours.
    held = docs.where("doc_id IS NOT NULL").select("doc_id", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    stays = held.join(kept.hint("merge"), "doc_id")  # as many rows as documents
    once = stays.where("rows = 1").select("row.*")
    many = stays.where("rows > 1").withColumn("digest", F.sha2(text_bytes("row.text"), 256)).dropDuplicates(["doc_id", "digest"]).select("row.*")
    return once.unionByName(many).unionByName(docs.where("doc_id IS NULL"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS src, doc_id AS node FROM documents UNION SELECT src, b FROM reach JOIN e ON e.a = reach.node),
root AS (SELECT src AS doc_id, min(node) AS component_id FROM reach GROUP BY src),
deg AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.component_id, coalesce(g.n_links, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN n USING (doc_id) JOIN root r USING (doc_id) LEFT JOIN deg g USING (doc_id)
"""
