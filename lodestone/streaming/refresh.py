"""Incremental refresh of relations, in batches or from a stream of files.

An update takes a batch of files (path, lang, text, deleted), finds what changed by content
hash, widens it to importers, parses that alone, and commits a new version in which rows of
untouched files are carried over by an anti-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.graph import reach
from lodestone.sources import parser
from lodestone.sources.storage import Catalog, stash

RELATIONS = ("symbols", "refs", "call_edges", "imports", "includes", "hierarchy", "skeletons", "bound_refs")
MAX_HOPS = 16


def importers(changed: DataFrame, imported_by: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(path) of ``changed`` and of every file that imports it over at most ``max_hops`` steps.

    ``imported_by`` has target_path and importer_path.
    """
    edges = imported_by.select(F.col("target_path").alias("src"), F.col("importer_path").alias("dst"))
    return reach(edges, changed.select(F.col("path").alias("node")), max_hops, 0).select(F.col("node").alias("path"))


def changes(files: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """Rows of a batch that are deleted or whose content the manifest does not have."""
    hashed = files.withColumn("content_hash", F.xxhash64("text", "lang"))
    if manifest is None:
        return hashed
    known = manifest.select("path", F.col("content_hash").alias("_known"))
    return hashed.join(known, "path", "left").where("deleted OR _known IS NULL OR _known <> content_hash").drop("_known")


def update(catalog: Catalog, files: DataFrame, batch: int | None = None) -> int:
    """Bring the relations of ``catalog`` up to a batch of files; the version after.

    A repeated batch, or one without changes, writes nothing.
    """
    now = catalog.current()
    if batch is not None and now["batch"] is not None and batch <= now["batch"]:
        return now["version"]
    manifest = catalog.read("manifest") if catalog.has("manifest") else None
    changed = stash(changes(files, manifest), "changed")
    if changed.isEmpty():
        return now["version"]
    parsed = stash(parser.parse_files(changed.where("NOT deleted")), "parsed")
    touched = changed.select("path").distinct()

    def merged(name: str, fresh: DataFrame) -> DataFrame:
        if not catalog.has(name):
            return fresh
        return catalog.read(name).join(touched, "path", "left_anti").unionByName(fresh)

    out = {name: merged(name, parser.relation(parsed, name)) for name in RELATIONS}
    out["manifest"] = merged("manifest", changed.where("NOT deleted").select("path", "content_hash"))
    return catalog.commit(out, batch)


def watch(spark: SparkSession, folder: str, catalog: Catalog, checkpoint: str, trigger: dict | None = None):
    """A streaming query that applies every micro-batch of JSON file events (path, lang, text, deleted).

    Within a batch the last event of a path counts. The batch id is kept with the version, so
    a batch that is replayed after a failure changes nothing twice.
    """
    events = spark.readStream.schema("path string, lang string, text string, deleted boolean, seq long").json(folder)

    def apply(df: DataFrame, batch: int) -> None:
        last = df.groupBy("path").agg(F.max_by(F.struct("lang", "text", "deleted"), "seq").alias("x")).select("path", "x.*")
        update(catalog, last.withColumn("deleted", F.coalesce("deleted", F.lit(False))), batch)

    writer = events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "500 milliseconds"})).start()


def _marked(events: DataFrame, late: str) -> DataFrame:
    """Events with a watermark if they stream; watermarks need times with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by window and type; works on streams and tables."""
    marked = _marked(events, late)
    return marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("window_start"), "event_type", "n", "total"
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of users (ts, user_id): events that follow each other within ``gap``."""
    marked = _marked(events, late)
    return marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(
        "user_id", F.col("w.start").alias("session_start"), "n"
    )
