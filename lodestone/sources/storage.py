"""Stashed tables and versioned relations on storage that driver and executors share."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import pathlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []
_STASHED: list[str] = []


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    root = str(pathlib.Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; in local mode a folder of our own where that is unset.

    Executors of a cluster cannot see a folder of the driver's machine, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="lodestone-"))
    return _OWN_DIR[0]


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage and partitioning end there."""
    path = f"{shared_dir(df.sparkSession)}/stash-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STASHED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def stashes(spark: SparkSession):
    """Deletes what is stashed within, at the end: for results that are written by then."""
    before = len(_STASHED)
    try:
        yield
    finally:
        while len(_STASHED) > before:
            delete(spark, _STASHED.pop())


def listed(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """Names, lengths and times of the files below paths."""
    seen = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        listing = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True) if path else None
        while listing is not None and listing.hasNext():
            f = listing.next()
            seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(seen)


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the files below paths: their names, lengths and times."""
    return hashlib.md5(json.dumps(listed(spark, paths)).encode()).hexdigest()


def size(spark: SparkSession, paths: list[str]) -> int:
    """Bytes of the files below paths."""
    return sum(f[1] for f in listed(spark, paths))


def persisted(spark: SparkSession, tag: str, paths: list[str], build) -> DataFrame:
    """A relation made of the files below ``paths`` once, and opened from then on as long as they stay as they are.

    ``build`` gives the relation and the columns that its folders are divided by.
    """
    folder = f"{shared_dir(spark)}/index-{tag}-{fingerprint(spark, paths)}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        df, by = build()
        (df.write.partitionBy(*by) if by else df.write).mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


class Catalog:
    """Relations as Parquet folders under version folders, with a pointer to the current one.

    A writer fills a new version and then appends to the pointer; readers hold on to the
    version that they opened. Relations that an update leaves alone are named by the version
    that holds them, so they are not copied. A batch id recorded with a version makes a
    repeated commit of that batch a no-op.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self) -> list[dict]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_versions")
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            return []
        rows = self.spark.read.schema("value string").text(f"{self.root}/_versions").collect()  # one line a version
        return sorted((json.loads(r.value) for r in rows), key=lambda v: v["version"])

    def current(self) -> dict:
        return (self._pointer() or [{"version": 0, "relations": {}, "batch": None}])[-1]

    def commit(self, relations: dict[str, DataFrame], batch: int | None = None) -> int:
        """Write ``relations`` as one new version; others carry over."""
        now = self.current()
        if batch is not None and now["batch"] is not None and batch <= now["batch"]:
            return now["version"]
        version, held = now["version"] + 1, dict(now["relations"])
        for name, df in relations.items():
            path = f"{self.root}/v={version}/{name}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            held[name] = path
        line = json.dumps({"version": version, "relations": held, "batch": batch if batch is not None else now["batch"]})
        self.spark.range(1).select(F.lit(line).alias("value")).coalesce(1).write.mode("append").text(f"{self.root}/_versions")
        return version

    def read(self, name: str, version: int | None = None) -> DataFrame:
        at = next(v for v in self._pointer() if v["version"] == version) if version else self.current()
        return self.spark.read.parquet(at["relations"][name])

    def has(self, name: str) -> bool:
        return name in self.current()["relations"]
