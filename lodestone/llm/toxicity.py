"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all documents, without a look at their labels,
are the unlabelled text. Linear classifiers on the presence of words are trained with
numpy on a risk estimate that takes the positives hidden among the unlabelled into
account by the class prior (the share of toxic labels, or less where the texts
speak against it), and that is kept from falling below zero:
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``.

The unlabelled text is dealt to shards of about ``SHARD`` documents. Each shard trains one
classifier from all positives and its own unlabelled documents, and the model is the mean
of them, so every document of the corpus takes part, whatever its size. Words are features
if they stand out among the positives from the whole corpus, by counts over all of it.
Documents reach their shard as the features that they show, alike ones counted together.

Labels are learned from rows alone whose crc32 of the id as text leaves no 2 on division
by 4; documents of that fold are left out of training altogether. Scores depend on the text
and nothing else.

Bounds: at most ``MAX_POSITIVE`` confirmed documents (a parameter), chosen by a hash of the
id, are fitted to; as distinct hashed words, in ``1 << BITS`` cells, not texts, they come to
the driver. The features are some of their words, so the model is bounded too. Every
document is scored, whole.

Edges. A null or empty text has no words and gets the score of the bias alone. Without any
confirmed toxic document every score is 0. Copies, and rows that share an id, count once as
positives, so that a group of copies teaches no more than one document; among the unlabelled
text they count as often as they stand there. Repeated rows get equal scores. A null id is
held in, never learned from. An empty table gives an empty result. Extra columns and
clashing names are not read; ``drop_toxic`` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import add_arrays, prepare, sliced, stash, text_bytes, tidy

BITS = 22
MAX_POSITIVE = 3000
SHARD = 9000
THRESHOLD = 0.3
STEPS = 400
RATE = 0.1
DECAY = 3e-4
#: Weights are averaged as whole numbers of this fineness, so that no order of shards shows.
FINE = 1 << 32
#: Words that a task remembers the cells of.
MEMORY = 100_000
#: Letters are lowered, everything that is no ASCII letter or digit, nor part of a longer
#: UTF-8 sequence, separates words.
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))


def words(text: bytes) -> set[bytes]:
    return set(text.lower().translate(_TABLE).split())


class Cells:
    """The distinct hashed words of texts. Words are remembered as long as this lives: a task, not its worker."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> set[int]:
        import xxhash

        found = words(text)
        new = found.difference(self.known)
        if new:
            if len(self.known) + len(new) > MEMORY:
                self.known.clear()
                new = found
            digest = xxhash.xxh3_64_intdigest
            self.known.update((w, digest(w) >> (64 - BITS)) for w in new)
        return set(map(self.known.__getitem__, found))


@dataclass
class Model:
    """Weights of hashed words and a bias; ``bias`` of -inf scores everything 0."""

    weights: dict[int, float]
    bias: float

    def score(self, text: bytes, cells: Cells | None = None) -> float:
        if self.bias == -np.inf:
            return 0.0
        hit = (cells or Cells())(text).intersection(self.weights)
        z = self.bias + sum(self.weights[c] for c in sorted(hit))
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def candidates(pos: list[set[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Cells that enough positives show, in order, and how many do."""
    if not pos:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, times = np.unique(np.concatenate([np.fromiter(d, np.int64, len(d)) for d in pos]), return_counts=True)
    keep = times >= max(3, 0.002 * len(pos))
    return found[keep], times[keep]


def stand_out(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """Which words' share ``a / n`` among the positives stands out from ``b / m`` in the corpus, by z-score."""
    n, m = max(1, n), max(1, m)
    p, q = a / n, b / m
    pool = (a + b + 1) / (n + m + 2)
    z = (p - q) / np.sqrt(pool * (1 - pool) * (1 / n + 1 / m))
    return (z > 4) & (p > 2 * q)


@dataclass
class Shown:
    """Documents as the features that they show: (document, feature) pairs, and how often each document counts."""

    doc: np.ndarray
    feature: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, docs: list[np.ndarray], times: np.ndarray | None = None) -> Shown:
        sizes = [len(d) for d in docs]
        flat = np.concatenate([np.zeros(0, np.int64), *docs]).astype(np.int64)
        return cls(np.repeat(np.arange(len(docs)), sizes), flat, np.ones(len(docs)) if times is None else times.astype(float))

    def probability(self, w: np.ndarray) -> np.ndarray:
        z = np.bincount(self.doc, w[self.feature], len(self.times)) + w[-1]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))

    def mean(self, x: np.ndarray) -> float:
        return float((self.times * x).sum() / self.times.sum())

    def gradient(self, x: np.ndarray, size: int) -> np.ndarray:
        """The mean over documents of ``x`` times their features, the bias last."""
        x = x * self.times / self.times.sum()
        out = np.bincount(self.feature, x[self.doc], size).astype(float)
        out[-1] = x.sum()
        return out


def risk(pos: Shown, unl: Shown, w: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk with logistic losses: prior * R_p(+), and R_u(-) - prior * R_p(-)."""
    sp, su = pos.probability(w), unl.probability(w)
    no = lambda s: -np.log1p(-np.minimum(s, 1 - 1e-9))
    return prior * pos.mean(-np.log(sp)), unl.mean(no(su)) - prior * pos.mean(no(sp))


def slope(pos: Shown, unl: Shown, w: np.ndarray, prior: float) -> np.ndarray:
    """The direction to step against: the risk's gradient, or away from a negative part that fell below zero."""
    sp, su = pos.probability(w), unl.probability(w)
    negative = unl.gradient(su, len(w)) - prior * pos.gradient(sp, len(w))
    if risk(pos, unl, w, prior)[1] < 0:  # the estimate fits noise: step back on that part
        return -negative
    return prior * pos.gradient(sp - 1, len(w)) + negative


def fit(pos: Shown, unl: Shown, features: int, prior: float) -> np.ndarray:
    """Weights of the features, and the bias last, by Adam on the non-negative risk."""
    w = np.zeros(features + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    decay = np.full_like(w, DECAY)
    decay[-1] = 0
    for t in range(1, STEPS + 1):
        grad = slope(pos, unl, w, prior) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = Cells()
    for b in sliced(batches, 1):
        found = [np.sort(np.fromiter(c := cells(x.as_py()), np.int32, len(c))).tobytes() for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["doc_id", "cells"])


def _counter(wanted: np.ndarray):
    """Counts how many documents of a partition show each wanted cell, and, last, how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cells = {int(c): i for i, c in enumerate(wanted)}, Cells()
        keys = at.keys()
        total = np.zeros(len(wanted) + 1, np.int64)
        for b in sliced(batches, 1):
            hits = [at[c] for x in b.column(1) for c in keys & cells(x.as_py())]
            total[:-1] += np.bincount(np.array(hits, np.int64), minlength=len(wanted))
            total[-1] += b.num_rows
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "piece", "counts"])

    return run


def _shower(chosen: np.ndarray):
    """The features that each document shows, as the bytes of their sorted numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cells = {int(c): i for i, c in enumerate(chosen)}, Cells()
        keys = at.keys()
        for b in sliced(batches, 1):
            shown = [np.array(sorted(at[c] for c in keys & cells(x.as_py())), np.int32).tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shown, pa.binary())], ["doc_id", "shown"])

    return run


def _trainer(pos: list[np.ndarray], features: int, prior: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("shown")
        unl = Shown.of([np.frombuffer(x, np.int32) for x in table.column("shown").to_pylist()], table.column("times").to_numpy())
        w = np.rint(fit(Shown.of(pos), unl, features, prior) * FINE).astype(np.int64)
        part = table.column("shard")[0].as_py()
        return pa.table({"part": pa.array([part], pa.int32()), "piece": pa.array([0], pa.int32()), "counts": pa.array([np.append(w, 1).tobytes()], pa.binary())})

    return run


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, shard: int = SHARD) -> Model:
    """Fit a model to ``docs`` and the rows of ``labels`` (doc_id, toxic) outside the held-out fold."""
    prepare(docs.sparkSession)
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold() != 2).select("doc_id", "toxic")
    r = usable.agg(F.avg((F.col("toxic") == 1).cast("double")).alias("p")).first()
    prior = min(0.5, max(0.005, r.p or 0.0))
    unlabelled = docs.where("doc_id IS NOT NULL").where(fold() != 2).select("doc_id", text_bytes().alias("text"))
    picked = usable.where("toxic = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive)
    # The limit bounds the ids, and one row of each comes to the driver.
    rows = unlabelled.join(F.broadcast(picked), "doc_id").mapInArrow(tidy(_to_cells), "doc_id long, cells binary").groupBy("doc_id").agg(F.min("cells").alias("cells")).collect()
    pos = [set(np.frombuffer(x, np.int32).tolist()) for x in sorted({bytes(r.cells) for r in rows})]
    if not pos:
        return Model({}, -np.inf)
    wanted, times = candidates(pos)
    counted = add_arrays(unlabelled.mapInArrow(tidy(_counter(wanted)), "part int, piece int, counts binary")).collect()  # one row
    counts = np.frombuffer(counted[0].counts, np.int64)
    chosen = wanted[stand_out(times, len(pos), counts[:-1], int(counts[-1]))]
    at = {int(c): i for i, c in enumerate(chosen)}
    shown_pos = [np.array(sorted(at[c] for c in d & at.keys()), np.int64) for d in pos]
    shards = max(1, -(-int(counts[-1]) // shard))
    patterns = stash(
        unlabelled.mapInArrow(tidy(_shower(chosen)), "doc_id long, shown binary")
        .groupBy(F.pmod(F.xxhash64("doc_id", "shown"), F.lit(shards)).cast("int").alias("shard"), "shown")
        .agg(F.count("*").alias("times")),
        "patterns",
    )
    some = patterns.agg(F.sum(F.when(F.octet_length("shown") > 0, F.col("times")).otherwise(0)).alias("n")).first().n or 0
    # Labelled rows need not be a fair sample. As the positives are alike on both sides, no
    # more of the unlabelled are positive than show a chosen word, per positive that does.
    share = np.mean([len(d) > 0 for d in shown_pos])
    if share > 0:
        prior = min(prior, max(0.005, some / int(counts[-1]) / float(share)))
    fitted = patterns.groupBy("shard").applyInArrow(_trainer(shown_pos, len(chosen), prior), "part int, piece int, counts binary")
    total = np.frombuffer(add_arrays(fitted).collect()[0].counts, np.int64)  # one row
    w = total[:-1] / total[-1] / FINE
    return Model({int(c): float(x) for c, x in zip(chosen, w)}, float(w[-1]))


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells()
        for b in sliced(batches, 1):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([model.score(x.as_py(), cells) for x in b.column(1)], pa.float64())], ["doc_id", "score"]
            )

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    prepare(docs.sparkSession)
    return (
        docs.select("doc_id", text_bytes().alias("text"))
        .mapInArrow(tidy(_scorer(model)), "doc_id long, score double")
        .select(
            "doc_id",
            F.coalesce(fold() == 2, F.lit(False)).alias("held_out"),
            "score",
            (F.col("score") >= threshold).cast("int").alias("predicted"),
        )
    )


def _keeper(model: Model, threshold: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells()
        for b in sliced(batches, at):
            texts = (x.as_py() or "" for x in b.column(at))
            yield b.filter(pa.array([model.score(t.encode(), cells) < threshold for t in texts], pa.bool_()))

    return run


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, as they are, null texts and empty tables too."""
    prepare(docs.sparkSession)
    return docs.mapInArrow(tidy(_keeper(model, threshold, docs.columns.index("text"))), docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
