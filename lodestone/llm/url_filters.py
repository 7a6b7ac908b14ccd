"""URL filters: host and path rules, then a ratio of two character language models.

URLs that the rules decide train two smoothed variable-order Markov models, one of
accepted and one of rejected URLs. Every other URL is judged by the difference of its
log-likelihoods under the two, divided by its length, against a threshold calibrated on
URLs that the rules decide and that the models were not trained on (one in ``FOLDS``, by a
hash of the URL).

A model gives every byte of a URL, and its end, a probability after the ``ORDER`` symbols
before it: the share of that byte among all seen after them, smoothed towards the estimate
after one symbol less, down to a uniform one. A context counts by how often it was seen, so
that how far back a model looks varies with what it has seen. Probabilities of all symbols
after any context add to 1.

Counts are exact, by whole runs of ``ORDER + 1`` symbols packed into one number: a table
with a row for each run that the input holds, which grows with the input and is never
gathered. It is summed up to shorter runs and joined back down to a log-ratio for each run.
A URL's ratio is the sum over its runs. Runs that make up more than ``1 / HOT`` of all
symbols, at most ``HOT`` by construction, go to the executors with the task; URLs meet all
others by a join, in which no run has more than that share of the rows.

Edges. A null URL, or one without ``://``, has an empty host and path, fits no rule, and
is judged by the models on what text it has (an empty one, a null one too, by its end
alone). Where the rules accept or reject nothing, the verdict is allow, and so it is where
the fold for calibration lacks one of the two. Repeated rows are judged alike. An empty
table gives an empty result; extra columns are not read. Very long URLs are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import prepare, stash

#: Fixed rules: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Symbols before a symbol that its probability depends on, at most.
ORDER = 4
#: Symbols are a byte plus 1; 0 stands before the start, and END closes a URL.
WIDTH, END = 9, 257
SYMBOLS = 257
#: A context seen this often counts as much as the shorter one that it backs off to.
BACKOFF = 4.0
HOT = 1024
FOLDS = 5
BINS = 400
SPAN = 4.0
#: Log-ratios are summed as whole numbers of this fineness, so that no order of rows shows.
FINE = 1 << 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host with A-Z lower-cased and the path; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matching_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, as text, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def runs(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All runs of ``ORDER + 1`` symbols of URLs, packed, and the URL that each is of."""
    sizes = np.array([len(u) for u in urls], np.int64) + ORDER + 1
    ends = np.cumsum(sizes)
    flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    flat[ends - 1] = END
    body = np.ones(len(flat), bool)
    body[ends - 1] = False
    for k in range(ORDER):
        body[ends - sizes + k] = False
    flat[body] = np.frombuffer(b"".join(urls), np.uint8).astype(np.int64) + 1
    packed = np.zeros_like(flat)
    for k in range(ORDER + 1):  # the symbol k before stands k places further up
        packed[k:] |= flat[: len(flat) - k] << (WIDTH * k)
    own = np.repeat(np.arange(len(urls)), sizes)
    real = np.arange(len(flat)) - (ends - sizes)[own] >= ORDER
    return packed[real], own[real]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        found, own = runs([x.as_py() for x in b.column(1)])
        side = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[own]
        distinct, at = np.unique(found, return_inverse=True)
        counts = [np.bincount(at[side == k], minlength=len(distinct)) for k in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(distinct), *map(pa.array, counts)], ["run", "other", "accepted", "rejected"])


def count_runs(urls: DataFrame) -> DataFrame:
    """run, accepted, rejected and total: how often each run occurs, from (side, url).

    Side 1 is accepted, 2 rejected, 0 neither; runs of those are there too, with no count.
    """
    parts = urls.select("side", "url").mapInArrow(_count, "run long, other long, accepted long, rejected long")
    return parts.groupBy("run").agg(
        F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"), F.sum(F.expr("other + accepted + rejected")).alias("total")
    )


def log_ratios(counted: DataFrame) -> DataFrame:
    """run and weight: the log of each run's last symbol under the accepted model, less that under the rejected one.

    ``pa`` and ``pr`` are its probabilities under the two. A run's counts are those of the longer
    runs that end in it; the counts of its context are those of all runs that share it.
    """
    levels = [counted.select("run", "accepted", "rejected")]
    for n in range(ORDER, 0, -1):
        short = F.col("run").bitwiseAND(F.lit((1 << (WIDTH * n)) - 1))
        levels.append(levels[-1].groupBy(short.alias("run")).agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")))
    below = None
    for n, level in enumerate(reversed(levels), 1):
        context = W.partitionBy(F.shiftright("run", WIDTH))  # no more rows than there are symbols
        level = level.withColumns({"ca": F.sum("accepted").over(context), "cr": F.sum("rejected").over(context)})
        if below is None:
            level = level.withColumns({"ba": F.lit(1 / SYMBOLS), "br": F.lit(1 / SYMBOLS)})
        else:
            tail = F.col("run").bitwiseAND(F.lit((1 << (WIDTH * (n - 1))) - 1))
            level = level.withColumn("tail", tail).join(below.select(F.col("run").alias("tail"), F.col("pa").alias("ba"), F.col("pr").alias("br")), "tail")
        below = level.select(
            "run",
            ((F.col("accepted") + F.col("ba") * BACKOFF) / (F.col("ca") + BACKOFF)).alias("pa"),
            ((F.col("rejected") + F.col("br") * BACKOFF) / (F.col("cr") + BACKOFF)).alias("pr"),
        )
    return below.select("run", "pa", "pr", F.round((F.log("pa") - F.log("pr")) * FINE).cast("long").alias("weight"))


def _spread(hot: dict[int, int]):
    keys = np.array(sorted(hot), np.int64)
    weights = np.array([hot[k] for k in sorted(hot)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            row = b.column(0).to_numpy()
            found, own = runs([x.as_py() for x in b.column(1)])
            sums = np.zeros(b.num_rows, np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                is_hot = keys[at] == found
                np.add.at(sums, own[is_hot], weights[at[is_hot]])
                found, own = found[~is_hot], own[~is_hot]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([row, row[own]])),
                    pa.array(np.concatenate([np.zeros(len(row), np.int64), found]), mask=np.arange(len(row) + len(own)) < len(row)),
                    pa.array(np.concatenate([sums, np.zeros(len(own), np.int64)])),
                ],
                ["row", "run", "known"],
            )

    return run


def score_urls(urls: DataFrame) -> DataFrame:
    """row and ratio of (row, side, url): log-likelihood under the accepted model less that under the rejected one, per symbol."""
    counted = stash(count_runs(urls), "runs")
    weights = stash(log_ratios(counted).join(counted.select("run", "total"), "run"), "ratios")
    total = counted.agg(F.sum("total")).first()[0] or 0
    # Fewer than HOT runs can each have more than 1 / HOT of all.
    hot = {r.run: r.weight for r in weights.where(F.col("total") * HOT > total).select("run", "weight").collect()}
    cold = weights.where(F.col("total") * HOT <= total).select("run", "weight")
    rows = urls.select("row", "url").mapInArrow(_spread(hot), "row long, run long, known long")
    sums = rows.join(cold, "run", "left").groupBy("row").agg(F.sum(F.col("known") + F.coalesce("weight", F.lit(0))).alias("weight"))
    return urls.select("row", F.octet_length("url").alias("n")).join(sums, "row").select("row", (F.col("weight") / FINE / (F.col("n") + 1)).alias("ratio"))


def calibrate(scored: DataFrame) -> float:
    """The threshold on the ratio with the best balanced accuracy on held-out URLs that rules decide."""
    bin_of = F.floor((F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN), "ratio")) + SPAN) / (2 * SPAN) * BINS).cast("int")
    rows = scored.where("ruled IS NOT NULL AND held_out").groupBy(bin_of.alias("bin"), "ruled").count().collect()  # 2 * (BINS + 1) at most
    allow, block = np.zeros(BINS + 2), np.zeros(BINS + 2)
    for r in rows:
        (allow if r.ruled == "allow" else block)[r.bin] += r["count"]
    if not allow.sum() or not block.sum():
        return -np.inf
    below = np.concatenate([[0], np.cumsum(block)])[: BINS + 1] / block.sum()
    above = 1 - np.concatenate([[0], np.cumsum(allow)])[: BINS + 1] / allow.sum()
    best = np.flatnonzero(below + above == (below + above).max())
    return float(best[len(best) // 2] / BINS * 2 * SPAN - SPAN)


def judge_urls(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and ratio of every URL."""
    prepare(pages.sparkSession)
    url = pages.select("page_id", "url")
    host, path = host_and_path(F.col("url"))
    parsed = url.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), "url")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    side = F.when(F.col("held_out") | F.col("ruled").isNull(), 0).when(F.col("ruled") == "allow", 1).otherwise(2)
    ruled = stash(
        parsed.select(
            F.monotonically_increasing_id().alias("row"), "page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"),
            F.coalesce(F.col("url").cast("binary"), F.lit(b"")).alias("url"),
        )
        .withColumn("held_out", F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0)
        .withColumn("side", side.cast("int")),
        "urls",
    )
    ratios = score_urls(ruled.select("row", "side", "url"))
    scored = stash(ruled.drop("url", "side").join(ratios, "row"), "ratios")
    cut = calibrate(scored)
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("ratio") >= cut, "allow").otherwise("block")).alias("verdict"), "ratio"
    )


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
