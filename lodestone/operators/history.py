"""Version spans, presence, diffs over time, and chains of renames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.similarity import jaccard
from lodestone.operators.graph import connected_components
from lodestone.sources.storage import stash

#: Fixed values of rename scoring.
MIN_LENGTH_RATIO, MIN_JACCARD, MIN_SCORE = 0.60, 0.70, 0.65
WITH_COSINE, WITHOUT_COSINE = (0.70, 0.20, 0.10), (0.78, 0.22)
SLOTS, BAND_ROWS = 240, 12
MAX_PREFIX_NAMES = 50
#: Entries that are worked on together in Python, entries of a block, and words that a product of matrices takes at once.
ROWS, BLOCK, COLUMNS = 512, 512, 4096


def spans(sightings: DataFrame, key: list[str]) -> DataFrame:
    """First and last commit of every entry of ``sightings`` (key..., commit_idx)."""
    return sightings.groupBy(*key).agg(F.min("commit_idx").alias("first_idx"), F.max("commit_idx").alias("last_idx"))


def merge_spans(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """One history of several: the hull of each entry's spans."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*key).agg(F.min("first_idx").alias("first_idx"), F.max("last_idx").alias("last_idx"))


def presence(entries: DataFrame, tree: DataFrame, cap: int = 500) -> DataFrame:
    """(entry_id, commits, truncated): the commits whose blob at the entry's path is the entry's.

    An entry's span is a hull, so it may cover commits without it; ``tree`` (path, blob,
    commit_idx) tells. If there are more commits than ``cap`` in a span, none is listed.
    """
    wide = entries.withColumn("truncated", F.col("last_idx") - F.col("first_idx") + 1 > cap)
    hits = wide.where("NOT truncated").join(tree, ["path", "blob"]).where("commit_idx BETWEEN first_idx AND last_idx")
    found = hits.groupBy("entry_id").agg(F.array_sort(F.collect_set("commit_idx")).alias("commits"))
    return wide.select("entry_id", "truncated").join(found, "entry_id", "left").select(
        "entry_id", F.coalesce("commits", F.array().cast("array<int>")).alias("commits"), "truncated"
    )


def filter_history(rows: DataFrame, since: str | None = None, until: str | None = None, author: str | None = None, kind: str | None = None) -> DataFrame:
    """Rows (day, author, kind): inclusive ISO dates, part of the author's name, exact kind."""
    for day in (since, until):
        if day is not None:
            pd.Timestamp(day)  # a calendar date or an error
    if since:
        rows = rows.where(F.col("day") >= since)
    if until:
        rows = rows.where(F.col("day") <= until)
    if author:
        rows = rows.where(F.lower("author").contains(author.lower()))
    return rows.where(F.col("kind") == kind) if kind else rows


def by_prefix(entries: DataFrame, prefix: str) -> DataFrame:
    """Entries of the first ``MAX_PREFIX_NAMES`` names, in order, that start with a prefix in any case, itself included."""
    names = entries.where(F.lower("name").startswith(prefix.lower())).select(F.lower("name").alias("key")).distinct().orderBy("key").limit(MAX_PREFIX_NAMES)
    return entries.withColumn("key", F.lower("name")).join(F.broadcast(names), "key").drop("key")


def lookup(entries: DataFrame, name: str) -> DataFrame:
    """Entries of a name in any case; without any, of names that start with it.

    The prefix needs an identifier of three characters or more.
    """
    key = name.lower()
    exact = entries.where(F.lower("name") == key)
    usable = len(key.encode()) >= 3 and key.replace("_", "a").isalnum() and not key[0].isdigit()
    if not usable:
        return exact
    none = exact.agg(F.count("*").alias("hits")).where("hits = 0")
    prefix = by_prefix(entries, key).join(F.broadcast(none.select("hits")), how="cross")
    return exact.unionByName(prefix.drop("hits"))


def versions(rows: DataFrame) -> DataFrame:
    """Rows (name, kind, commit_idx, signature) with the signature before and whether it changed."""
    order = W.partitionBy("name", "kind").orderBy("commit_idx", "entry_id")
    before = F.lag("signature").over(order)
    return rows.withColumn("before", before).withColumn("changed", F.coalesce(before != F.col("signature"), F.lit(False)))


def unified_diffs(rows: DataFrame) -> DataFrame:
    """``rows`` (before, after) with a unified diff."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import difflib

        for pdf in batches:
            made = ["\n".join(difflib.unified_diff((a or "").split("\n"), (b or "").split("\n"), lineterm="")) for a, b in zip(pdf["before"], pdf["after"])]
            yield pdf.assign(diff=made)

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInPandas(run, f"{kinds}, diff string")


def _banded(slots: int, rows: int):
    """Arrow batches of (entry_id, tokens, others...) to (entry_id, band, mark, others...): MinHash by seeded affine maps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seeds = np.random.default_rng(1).integers(1, 1 << 63, (2, slots), np.int64).astype(np.uint64)
        odd, add = (seeds[0] | np.uint64(1))[:, None], seeds[1][:, None]
        n = slots // rows
        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            marks = []
            for tokens in b.column(1).to_pylist():
                h = np.array([xxhash.xxh3_64_intdigest(t) for t in tokens], np.uint64)
                with np.errstate(over="ignore"):
                    low = np.full(slots, np.iinfo(np.uint64).max)
                    for at in range(0, len(h), 4096):
                        low = np.minimum(low, ((h[at : at + 4096] * odd + add) >> np.uint64(1)).min(axis=1))
                marks += [xxhash.xxh3_64_intdigest(low[k * rows : (k + 1) * rows].tobytes()) >> 1 for k in range(n)]
            each = pa.array(np.repeat(np.arange(b.num_rows), n))
            others = [c.take(each) for c in b.columns[2:]]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(each), pa.array(np.tile(np.arange(n, dtype=np.int32), b.num_rows)), pa.array(marks, pa.int64()), *others],
                ["entry_id", "band", "mark", *b.schema.names[2:]],
            )

    return run


def _marked(entries: DataFrame, slots: int, rows: int, *others: str) -> DataFrame:
    """(entry_id, band, mark, others...): the bands of the signatures of entries that have tokens.

    Signatures are made with numpy: hundreds of slots a token are too slow in interpreted
    lambdas (measured at sf0.01: 10 s against 1 s).
    """
    some = entries.where(F.size("tokens") > 0).select("entry_id", "tokens", *others)
    kinds = "".join(f", {c} {t}" for c, t in some.dtypes[2:])
    return some.mapInArrow(_banded(slots, rows), f"entry_id long, band int, mark long{kinds}")


def band_candidates(entries: DataFrame, slots: int = SLOTS, rows: int = BAND_ROWS) -> DataFrame:
    """(a, b): pairs of entries (entry_id, tokens) with an equal band of their signatures.

    Entries with all bands equal, as copies have, are one entry while bands meet, so that their
    pairs are made once and not once a band, and are told apart again at the end.
    """
    marked = stash(_marked(entries, slots, rows), "bands")
    alike = marked.groupBy("entry_id").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("band", "mark"))), lambda x: x["mark"].cast("string")), ",")).alias("print"))
    first = alike.groupBy("print").agg(F.min("entry_id").alias("head"))
    kin = stash(alike.join(first, "print").select("head", "entry_id"), "alike")
    heads = marked.join(kin.where("head = entry_id").select("entry_id"), "entry_id", "left_semi")
    one, two = (heads.select(F.col("entry_id").alias(x), "band", "mark") for x in "xy")
    met = one.join(two, ["band", "mark"]).where("x < y").select("x", "y").distinct()
    a, b = (kin.select(F.col("head").alias(h), F.col("entry_id").alias(x)) for h, x in ("xa", "yb"))
    across = met.join(a, "x").join(b, "y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    within = a.join(b, F.col("x") == F.col("y")).where("a < b").select("a", "b")
    return across.unionByName(within)


def _neighbours(entries: DataFrame) -> DataFrame:
    """(a, b): pairs with an equal band where one ends with a commit and the other starts with the next.

    Commits are part of what bands meet by, so copies meet those of one commit only.
    """
    marked = stash(_marked(entries, SLOTS, BAND_ROWS, "first_idx", "last_idx"), "bands")
    a = marked.select(F.col("entry_id").alias("a"), "band", "mark", (F.col("last_idx") + 1).alias("at"))
    b = marked.select(F.col("entry_id").alias("b"), "band", "mark", F.col("first_idx").alias("at"))
    return a.join(b, ["at", "band", "mark"]).where("a <> b").select("a", "b").distinct()


def score_links(pairs: DataFrame) -> DataFrame:
    """Pairs (a_*, b_*: kind, body, tokens, name) that pass the gates, cheapest first, with a score."""
    ratio = F.least(F.octet_length("a_body"), F.octet_length("b_body")) / F.greatest(F.octet_length("a_body"), F.octet_length("b_body"), F.lit(1))
    near = jaccard(F.col("a_tokens"), F.col("b_tokens"))
    gated = pairs.where("a_kind = b_kind AND a_body <> '' AND b_body <> ''").where(ratio >= MIN_LENGTH_RATIO)
    scored = gated.withColumn("jaccard", near).where(F.col("jaccard") >= MIN_JACCARD)
    return scored.withColumn("score", WITHOUT_COSINE[0] * F.col("jaccard") + WITHOUT_COSINE[1] * ratio).where(F.col("score") >= MIN_SCORE)


def _score_blocks(table: pa.Table) -> pa.Table:
    """Links between the entries of two blocks: what they share is counted for all pairs by products of matrices."""
    sides = [table.filter(pc.equal(table.column("side"), k)).combine_chunks() for k in (0, 1)]
    kinds = pc.dictionary_encode(table.column("kind")).combine_chunks().dictionary
    flat = [x.column("tokens").combine_chunks() for x in sides]
    flat = [(pc.list_flatten(t), pc.list_parent_indices(t).to_numpy(), pc.list_value_length(t).to_numpy()) for t in flat]
    words = pa.chunked_array([f[0] for f in flat]).dictionary_encode()
    codes = [c.indices.to_numpy() for c in words.unify_dictionaries().chunks]
    both = np.intersect1d(*codes)
    shared = np.zeros([len(x) for x in sides], np.float32)
    for lo in range(0, len(both), COLUMNS):
        some = both[lo : lo + COLUMNS]
        held = []
        for code, (_, row, n) in zip(codes, flat):
            at = np.minimum(np.searchsorted(some, code), len(some) - 1)
            hit, m = some[at] == code, np.zeros((len(n), len(some)), np.float32)
            m[row[hit], at[hit]] = 1
            held.append(m)
        shared += held[0] @ held[1].T
    shared = shared.astype(np.int64)
    union = flat[0][2][:, None].astype(np.int64) + flat[1][2][None, :] - shared
    near = np.where(union == 0, 1.0, shared / np.maximum(union, 1))
    size, kind, ids = ([f(x) for x in sides] for f in (lambda x: x.column("bytes").to_numpy().astype(np.int64), lambda x: pc.index_in(x.column("kind"), kinds).to_numpy(), lambda x: x.column("entry_id").to_numpy()))
    ratio = np.minimum.outer(*size) / np.maximum.outer(*size)
    score = WITHOUT_COSINE[0] * near + WITHOUT_COSINE[1] * ratio
    i, j = np.nonzero((ratio >= MIN_LENGTH_RATIO) & (near >= MIN_JACCARD) & (score >= MIN_SCORE) & np.equal.outer(*kind) & np.not_equal.outer(*ids))
    commit = np.full(len(i), table.column("at")[0].as_py() - 1, np.int32)
    return pa.table({"commit": commit, "a": ids[0][i], "b": ids[1][j], "jaccard": near[i, j], "score": score[i, j]})


def neighbour_links(entries: DataFrame) -> DataFrame:
    """(commit, a, b, jaccard, score): all links between entries that end with a commit and those that start with the next.

    Exact, by the gates of ``score_links``. Both sides of a commit are dealt to blocks of about
    ``BLOCK`` entries; a task gets a block of each side, whatever the number of entries of a commit.
    """
    e = entries.where("kind IS NOT NULL AND body <> '' AND tokens IS NOT NULL").select("entry_id", "kind", "tokens", F.octet_length("body").alias("bytes"), "first_idx", "last_idx")
    e = stash(e, "sides")  # words are made once for both sides
    at = [(F.col("last_idx") + 1).alias("at"), F.col("first_idx").alias("at")]
    n = [e.groupBy(c).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(f"n{k}")) for k, c in enumerate(at)]
    blocks = n[0].join(n[1], "at")
    own = lambda m: F.pmod(F.xxhash64("entry_id"), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    show = lambda k, r, c: e.select("entry_id", "kind", "tokens", "bytes", at[k]).join(blocks, "at").select("at", r.alias("r"), c.alias("c"), F.lit(k).alias("side"), "entry_id", "kind", "tokens", "bytes")
    dealt = show(0, own("n0"), every("n1")).unionByName(show(1, every("n0"), own("n1")))
    return dealt.groupBy("at", "r", "c").applyInArrow(lambda table: _score_blocks(table), "commit int, a long, b long, jaccard double, score double")


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    used_a, used_b, keep = set(), set(), []
    for i, r in pdf.sort_values(["score", "a", "b"], ascending=[False, True, True]).iterrows():
        if r["a"] not in used_a and r["b"] not in used_b:
            used_a.add(r["a"])
            used_b.add(r["b"])
            keep.append(i)
    return pdf.loc[keep, ["commit", "a", "b", "score"]]


def rename_links(entries: DataFrame, exact: bool = False) -> DataFrame:
    """(commit, a, b, score): an entry that ends with a commit taken up by one that starts with the next.

    ``entries`` has entry_id, name, kind, body, tokens, first_idx, last_idx. Candidates meet by
    equal bands, or all of neighbouring commits with ``exact``. Each entry is taken once per
    commit, the best score first.
    """
    cols = ["entry_id", "kind", "body", "tokens", "first_idx", "last_idx"]
    a = entries.select(*(F.col(c).alias("a" if c == "entry_id" else f"a_{c}") for c in cols))
    b = entries.select(*(F.col(c).alias("b" if c == "entry_id" else f"b_{c}") for c in cols))
    if exact:
        scored = neighbour_links(entries).drop("jaccard")
    else:
        pairs = _neighbours(entries).join(a, "a").join(b, "b")
        scored = score_links(pairs).select(F.col("a_last_idx").alias("commit"), "a", "b", "score")
    return scored.groupBy("commit").applyInPandas(_greedy, "commit int, a long, b long, score double")


def rename_chains(entries: DataFrame, links: DataFrame) -> DataFrame:
    """(chain_id, entry_id, score): entries joined by links; the id is a digest of the root's tokens."""
    roots = connected_components(links.select("a", "b"))
    best = links.select(F.col("a").alias("entry_id"), "score").unionByName(links.select(F.col("b").alias("entry_id"), "score"))
    best = best.groupBy("entry_id").agg(F.max("score").alias("score"))
    mark = entries.select(F.col("entry_id").alias("root"), F.md5(F.array_join(F.array_sort("tokens"), " ").cast("binary")).alias("chain_id"))
    return roots.withColumnRenamed("node", "entry_id").join(best, "entry_id").join(mark, "root").select("chain_id", "entry_id", "score")
