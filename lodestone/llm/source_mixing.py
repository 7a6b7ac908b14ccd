"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length in words within their source. A source's target
is met by whole passes over the source and, for what remains, a choice of how many
documents of each length to take: an even share of every length, from the longest down,
each making good what the longer ones fell short, until two longest documents are left to
fill; then a bounded knapsack over the lengths for the rest. It is solved exactly, whatever
the lengths are. Seeded documents fill the counts.

Edges. A null text has size 0 and is never taken. A null source is a source of its own,
last in order. Equal lengths are told apart by a seeded hash of the id and, for repeated
rows, the row's place among its equals. An empty table gives an empty result. Extra
columns are not read, and only sizes travel, never texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, host_key, stash

#: Fixed values of the mix.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Slots that a hash deals the documents of one length to, so that no length is hot.
SLOTS = 512


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, src (a key that tells null from any name) and size in words."""
    return docs.select(
        "doc_id", host_key().alias("src"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    )


def targets(sized: DataFrame) -> DataFrame:
    """src, source_size and target: the budget poured over the sources by weight.

    A source fills up at ``MOST`` times its size; it does so exactly if the water, had it
    risen to the source's own brim, would hold no more than the budget.
    """
    per = sized.groupBy("src").agg(F.sum("size").alias("source_size"))
    # A table of sources, not of documents: one ordered pass over it places the weights.
    kind = F.when(F.col("src") == "n", 1).otherwise(0)
    ranked = per.withColumn("k", F.row_number().over(W.orderBy(kind, "src")) - 1)
    weighted = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("k") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    capped = weighted.withColumn("cap", F.col("source_size") * MOST).withColumn("brim", F.col("cap") / F.col("w"))
    rising = W.orderBy("brim", "k").rowsBetween(W.unboundedPreceding, 0)
    everything = W.partitionBy()
    poured = (
        capped.withColumn("budget", F.sum("source_size").over(everything) * SHARE)
        .withColumn("filled", F.sum("cap").over(rising))
        .withColumn("open", F.sum("w").over(everything) - F.sum("w").over(rising))
        .withColumn("full", F.col("filled") + F.col("brim") * F.col("open") <= F.col("budget"))
        .withColumn("done", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything))
        .withColumn("left", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(everything))
    )
    level = (F.col("budget") - F.col("done")) / F.when(F.col("left") > 0, F.col("left"))
    return poured.select(
        "src", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", level * F.col("w"))).alias("target")
    )


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest ``budget``.

    An even share of every length, longest first, stops short of the budget by two longest
    documents, and by less than three: what a length falls short of its share in whole
    documents goes to the next one. The bounded knapsack closes that gap with what is left,
    exactly, so the whole is off by no more than the best such choice.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros_like(counts)
    if budget >= total:
        return counts.copy()
    longest = int(lengths.max())
    even = max(0, budget - 2 * longest)
    take = np.zeros_like(counts)
    short = 0  # words that longer documents fell short, in parts of ``total``
    for i in np.argsort(-lengths, kind="stable"):
        n, size = int(counts[i]), int(lengths[i])
        wanted = short + even * n * size
        take[i] = min(n, wanted // (total * size))
        short = wanted - int(take[i]) * total * size
    gap = budget - int((take * lengths).sum())
    # Sums of twice the gap and more are no nearer than none, and without any one document a
    # sum above the gap by the longest would still reach it.
    return take + _knapsack(lengths, counts - take, gap, gap + min(gap, longest))


def _knapsack(lengths: np.ndarray, counts: np.ndarray, goal: int, top: int) -> np.ndarray:
    """Counts of each length whose sum is the reachable one nearest ``goal`` (the lower of two).

    Reachable sums are bits of one integer, and of every sum the part by which it was first
    reached is kept: four bytes for each of ``top`` sums, whatever the number of parts.
    """
    reach, mask = 1, (1 << (top + 1)) - 1
    by = np.full(top + 1, -1, np.int32)
    parts: list[tuple[int, int]] = []
    for i in np.argsort(lengths, kind="stable"):
        n, step = min(int(counts[i]), top // max(1, int(lengths[i]))), 1
        while n > 0 and not reach >> goal & 1:  # a bounded count in binary parts
            k = min(step, n)
            new = (reach << k * int(lengths[i])) & mask & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(top // 8 + 1, "little"), np.uint8), bitorder="little")
                by[np.flatnonzero(bits)] = len(parts)
                parts.append((int(i), k))
                reach |= new
            n -= k
            step *= 2
        if reach >> goal & 1:
            break
    low = (reach & ((1 << (goal + 1)) - 1)).bit_length() - 1
    above = reach >> goal
    high = goal + (above & -above).bit_length() - 1 if above else top + 1
    at = high if high <= top and high - goal < goal - low else low
    out = np.zeros(len(lengths), np.int64)
    while at:
        i, k = parts[by[at]]
        out[i] += k
        at -= k * int(lengths[i])
    return out


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    target, total = float(pdf["target"].iloc[0]), float(pdf["source_size"].iloc[0])
    passes = min(int(target // total) if total else 0, int(MOST))
    use = pdf[pdf["size"] > 0]
    take = fit(use["size"].to_numpy(np.int64), use["n"].to_numpy(np.int64), int(round(target - passes * total)) if passes < MOST else 0)
    return pd.DataFrame({"src": use["src"], "size": use["size"], "passes": passes, "take": take})


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), and copies."""
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    sized = stash(
        sizes(docs).withColumn("h", order).withColumn("slot", F.pmod(F.shiftrightunsigned("h", 40), F.lit(SLOTS)).cast("int")), "sizes"
    )
    goal = stash(targets(sized), "targets")
    # Counts by length and slot are what gathers; a source's lengths are as many as its
    # longest document has words at most, whatever the number of documents.
    slots = stash(sized.groupBy("src", "size", "slot").agg(F.count("*").alias("n")), "slots")
    counts = slots.groupBy("src", "size").agg(F.sum("n").alias("n"))
    plan = stash(
        counts.join(goal, "src").groupBy("src").applyInPandas(_fit_source, "src string, size long, passes int, take long"), "plan"
    )
    before = W.partitionBy("src", "size").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    cut = (
        slots.join(plan, ["src", "size"])
        .withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .select("src", "size", "slot", "passes", F.greatest(F.lit(0), F.least(F.col("n"), F.col("take") - F.col("ahead"))).alias("quota"))
    )
    cut = stash(cut, "cut")
    place = F.row_number().over(W.partitionBy("src", "size", "slot").orderBy("h", "doc_id"))
    chosen = (
        sized.withColumn("place", place)
        .join(cut, ["src", "size", "slot"], "left")
        .withColumn("copies", F.coalesce(F.col("passes") + (F.col("place") <= F.col("quota")).cast("int"), F.lit(0)))
    )
    # Few rows on the right; the planner sorts and merges beyond its threshold.
    return chosen.join(goal, "src").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def apply_mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns as they are.

    Rows that share id and size share out their copies among them by the order of their
    texts. A row of no words, or of a null text, is never taken. An empty table stays empty.
    """
    plan = stash(
        mix(docs, seed).groupBy("doc_id", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0"), "mix"
    )
    # The whole row travels as one column, so that none of its names can clash with ours.
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    held = docs.select(F.col("doc_id").alias("id"), size.alias("words"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    taken = held.join(plan.hint("merge"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("words") == F.col("size")))
    place = F.row_number().over(W.partitionBy("doc_id", "size").orderBy("row.text"))
    once = taken.where("rows = 1")
    many = taken.where("rows > 1").withColumn("place", place)
    many = many.withColumn("copies", F.expr("copies div rows + int(place <= copies % rows)")).where("copies > 0").drop("place")
    rows = once.unionByName(many)
    return rows.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
