"""Quality rules with host-level verdicts.

Each document is tested by the rules of ``RULES``; the failures of every rule are summed by
host (the ``source`` column). For each rule a beta prior is fitted to the failure rates of
all hosts, and every host's rate is shrunk towards the rule's pooled rate by it: a host of
few documents stays near the pooled rate, and so does every host where the rates differ no
more than chance makes them. A host fails if its shrunk rate is above the rule's limit for
any rule; the verdict is joined back to its documents.

The prior is fitted by moments of the beta-binomial distribution. With n documents of a
host, N of all, p the pooled rate and q = 1 - p, the sum of n (rate - p)^2 over k hosts is
expected to be pq (k - 1) from chance alone, and pq (N - sum n^2 / N) if documents of a host
were all alike; where the sum lies between the two gives the correlation rho of documents of
one host, and the prior weighs 1 / rho - 1 documents.

Edges. A null text has no words and fails the rules on words and on length. A rule that all
documents or none fail has no prior to fit: every host has the pooled rate. A null source is a host of its own. Repeated
rows are judged one by one and each counts for its host. An empty table gives an empty
result. Extra columns of the input are not read. Very long texts are measured whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import hash_words, host_key, prepare, roll, stash, text_bytes

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Rule -> (what a document fails by, the shrunk rate above which a host fails).
RULES = {
    "base": ("n_words < 20 OR 100 * n_repeat_words > 30 * n_words", 0.5),
    "symbols": ("10 * n_symbols > n_words", 0.5),
    "word_length": ("word_chars < 2 * n_words OR word_chars > 40 * n_words OR n_words = 0", 0.5),
    "lines": ("20 * n_dup_lines > n_words", 0.5),
}
#: Weight of a prior where hosts differ no more than by chance.
AGREED = 1e9


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeat = 0
    if len(words) > WINDOW:
        runs = roll(hash_words(words), WINDOW)
        _, where, times = np.unique(runs, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(times[where] > 1)
        if len(twice):
            steps = np.zeros(len(words) + 1, np.int64)
            np.add.at(steps, twice, 1)
            np.add.at(steps, twice + WINDOW, -1)
            repeat = int((np.cumsum(steps) > 0).sum())
    return (
        len(words),
        len(b"".join(words).decode("utf-8", "replace")),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat,
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.array([measure(x.as_py()) for x in b.column(2)], np.int64).reshape(-1, 5)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), *(pa.array(found[:, k]) for k in range(5))],
            ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        )


def features(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, host, the five measures and base_failed."""
    prepare(docs.sparkSession)
    return (
        docs.select("doc_id", host_key().alias("host"), text_bytes().alias("text"))
        .mapInArrow(
            _measure,
            "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long",
        )
        .withColumns({f"{rule}_failed": F.expr(fails) for rule, (fails, _) in RULES.items()})
    )


def host_rates(feats: DataFrame) -> DataFrame:
    """host, n, and for each rule failed_<rule> and rate_<rule>: the host's failure rate, shrunk."""
    hosts = feats.groupBy("host").agg(
        F.count("*").cast("double").alias("n"), *(F.sum(F.col(f"{r}_failed").cast("int")).cast("double").alias(f"failed_{r}") for r in RULES)
    )
    sums = hosts.agg(
        F.count("*").cast("double").alias("k"),
        F.sum("n").alias("nn"),
        F.sum(F.expr("n * n")).alias("n2"),
        *(F.sum(f"failed_{r}").alias(f"ff_{r}") for r in RULES),
        *(F.sum(F.expr(f"failed_{r} * failed_{r} / n")).alias(f"sq_{r}") for r in RULES),
    )
    means = sums.withColumns({f"mean_{r}": F.expr(f"ff_{r} / nn") for r in RULES})
    chance = {f"pq_{r}": F.expr(f"mean_{r} * (1 - mean_{r})") for r in RULES}
    spread = {r: f"(sq_{r} - nn * mean_{r} * mean_{r} - pq_{r} * (k - 1)) / (pq_{r} * (nn - n2 / nn - (k - 1)))" for r in RULES}
    rho = {f"rho_{r}": F.expr(f"CASE WHEN pq_{r} > 0 AND nn - n2 / nn > k - 1 THEN {x} ELSE 0 END") for r, x in spread.items()}
    strength = {f"strength_{r}": F.expr(f"CASE WHEN rho_{r} > 1e-9 THEN greatest(1 / rho_{r} - 1, 0) ELSE {AGREED} END") for r in RULES}
    prior = means.withColumns(chance).withColumns(rho).withColumns(strength).select(*(f"{x}_{r}" for x in ("mean", "strength") for r in RULES))
    # One row, from the aggregate above, to every host.
    return hosts.crossJoin(F.broadcast(prior)).select(
        "host", "n", *(f"failed_{r}" for r in RULES),
        *(F.expr(f"(failed_{r} + mean_{r} * strength_{r}) / (n + strength_{r})").alias(f"rate_{r}") for r in RULES),
    )


def judge(docs: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """doc_id, the measures, base_failed, host_failed and kept of every document.

    A document is kept if it passes the base rules and its host fails by no rule; ``limits``
    replaces limits of ``RULES``.
    """
    feats = stash(features(docs), "quality")
    limit = {r: x for r, (_, x) in RULES.items()} | (limits or {})
    failed = F.expr(" OR ".join(f"rate_{r} > {float(limit[r])!r}D" for r in RULES))
    hosts = stash(host_rates(feats).select("host", failed.alias("host_failed")), "hosts")
    # Hosts are as many as the web has; the planner broadcasts them only below its own
    # threshold and else sorts and merges, splitting a host that has most of the rows.
    return feats.join(hosts, "host").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"), "host_failed",
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _each(item: str, glue: str = ", ") -> str:
    return glue.join(item.format(r=r, fails=fails, limit=limit) for r, (fails, limit) in RULES.items())


OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS n FROM pos),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win, range(0, 8) s(k) WHERE n > 1 GROUP BY doc_id),
f AS (
  SELECT d.doc_id, host, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, {_each("({fails}) AS {r}_failed")} FROM f),
h AS (SELECT host, count(*)::DOUBLE AS n, {_each("sum({r}_failed::INT)::DOUBLE AS f_{r}")} FROM b GROUP BY host),
t AS (SELECT count(*)::DOUBLE AS k, sum(n) AS nn, sum(n * n) AS n2, {_each("sum(f_{r}) / sum(n) AS p_{r}, sum(f_{r} * f_{r} / n) AS sq_{r}")} FROM h),
o AS (SELECT *, {_each("CASE WHEN p_{r} * (1 - p_{r}) > 0 AND nn - n2 / nn > k - 1 THEN (sq_{r} - nn * p_{r} * p_{r} - p_{r} * (1 - p_{r}) * (k - 1)) / (p_{r} * (1 - p_{r}) * (nn - n2 / nn - (k - 1))) ELSE 0 END AS rho_{r}")} FROM t),
m AS (SELECT *, {_each("CASE WHEN rho_{r} > 1e-9 THEN greatest(1 / rho_{r} - 1, 0) ELSE 1e9 END AS m_{r}")} FROM o),
v AS (SELECT host, {_each("(f_{r} + p_{r} * m_{r}) / (n + m_{r}) > {limit}", " OR ")} AS host_failed FROM h, m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT host_failed AS kept, host_failed
FROM b JOIN v USING (host)
"""
