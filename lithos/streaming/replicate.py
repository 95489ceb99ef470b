"""Replication of an event log and of what its transactions did, as a batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lithos.functions import scalars
from lithos.plans import edits
from lithos.plans.commit import Dataset


def pending(source: DataFrame, target: DataFrame, key: list[str], cursor: str = "eventid") -> DataFrame:
    """Source events that the target lacks: an anti-join keeps a repeated delivery from counting twice.
    Of the target only the range of the source's ids is read (a filter that reaches the scan)."""
    low, high = source.agg(F.min(cursor), F.max(cursor)).first()
    near = target.filter(F.lit(False)) if low is None else target.filter(F.col(cursor).between(low, high))
    return source.join(near.select(*key), key, "left_anti")


def after_cursor(source: DataFrame, target: DataFrame, collection: str = "collectionid", cursor: str = "eventid") -> DataFrame:
    """Source events after the target's last one in each collection; all if it has none."""
    last = target.groupBy(collection).agg(F.max(cursor).alias("_last"))
    return source.join(last, collection, "left").filter(F.col(cursor) > F.coalesce("_last", F.lit(-1))).drop("_last")


def applied(events: DataFrame, apply_releases: bool = False) -> DataFrame:
    """What a target does with events: created segments are stored, metadata is copied, releases are
    left out unless asked for."""
    kinds = ["C", "M", "T"] + ["R"] * apply_releases
    return events.filter(F.col("eventtype").isin(kinds))


def created_references(events: DataFrame, cas: DataFrame) -> DataFrame:
    """The references that events (collectionid, segment, segmentversion) of kind C made, each at
    exactly the event's version: collectionid, segment, segmentversion, sha1, len."""
    made = events.filter(F.col("eventtype") == "C").select("collectionid", "segment", "segmentversion").distinct()
    return made.join(cas, edits.KEYS["cas"]).select(*edits.KEYS["cas"], *edits.ID)


def created_segments(events: DataFrame, cas: DataFrame, data: DataFrame) -> DataFrame:
    """The created references with their contents: collectionid, segment, segmentversion, sha1, len, content."""
    return created_references(events, cas).join(data, edits.ID).select(*edits.KEYS["cas"], *edits.ID, "content")


def apply_transactions(source: Dataset, target: Dataset, servernum: int, now_millis: int, apply_releases: bool = False) -> int | None:
    """Applies what a source committed since the target's last replicated event, in one commit of the
    target: new collections with their metadata, created segments at their exact versions, the metadata
    of collections that say so, and the events under their own ids. Returns the target's version, None
    if there was nothing. Running it again changes nothing.

    Tables of the source: collections (collectionid, metadata), events (collectionid, eventid,
    transactionid, eventtype, segment, segmentversion), cas, data. The target has replicated_events
    (servernum and the columns of events) besides."""
    log, done = source.table("events"), target.table("replicated_events")
    if log is None:
        return None
    committed = log.filter(F.col("eventtype") == "T").select("collectionid", "transactionid").distinct()
    log = log.join(committed, ["collectionid", "transactionid"], "left_semi")
    if done is not None:
        log = after_cursor(log, done.filter(F.col("servernum") == servernum))
    log = applied(log, apply_releases)
    kinds = {r["eventtype"] for r in log.select("eventtype").distinct().collect()}  # four at most
    if not kinds:
        return None
    tx = target.begin(now_millis)
    collections, there = source.table("collections"), target.table("collections")
    changed = collections.join(log.select("collectionid").distinct(), "collectionid", "left_semi")
    if there is None:
        tx.append("collections", changed)
    else:
        copied = log.filter(F.col("eventtype") == "M").select("collectionid").distinct()
        tx.append("collections", changed.join(there.select("collectionid"), "collectionid", "left_anti"))
        tx.replace("collections", changed.join(copied, "collectionid", "left_semi").join(there.select("collectionid"), "collectionid", "left_semi"))
    if "C" in kinds or there is None:
        data = source.table("data")
        made = created_references(log, source.table("cas")).join(data.select(*edits.ID), edits.ID, "left_semi")
        edits.store(tx, made, data)
    if "R" in kinds:
        released = log.filter(F.col("eventtype") == "R").select(*edits.KEYS["cas"])
        if target.table("cas") is not None:
            edits.release(tx, released)
    tx.append("replicated_events", log.withColumn("servernum", F.lit(servernum)))
    return tx.commit()


def new_collections(server_events: DataFrame, collections: DataFrame, known: DataFrame, default_server: str | None = None, key: str = "replication-server") -> DataFrame:
    """Collections (collectionid, metadata) that server events of kind C made, that none of kind D
    destroyed later and that a target doesn't know yet; with a default server for those that name none."""
    last = server_events.groupBy("collectionid").agg(F.max_by("eventtype", "eventid").alias("_last")).filter("_last = 'C'")
    new = collections.join(last, "collectionid", "left_semi").join(known.select("collectionid"), "collectionid", "left_anti")
    return new if default_server is None else new.withColumn("metadata", scalars.metadata_default(F.col("metadata"), key, default_server))


def replicate_batch(source: DataFrame, target_path: str, key: list[str] | None = None) -> int:
    """Appends what the target lacks; the number of rows appended. Running it twice changes nothing."""
    spark, key = source.sparkSession, key or ["eventid"]
    try:
        target = spark.read.parquet(target_path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        target = None
    new = source.dropDuplicates(key)
    if target is not None:
        new = pending(new, target, key)
    seen = Observation()
    new.observe(seen, F.count("*").alias("n")).write.mode("append").parquet(target_path)
    return seen.get["n"]


def replicate_stream(spark: SparkSession, source_path: str, schema: str, target_path: str, checkpoint: str, *, key: list[str] | None = None, files_per_batch: int = 16, on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Tails a folder of event files and applies each batch once: batches may be delivered again,
    the anti-join makes that harmless. Ends when what is there has been read; run again to go on."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            replicate_batch(batch, target_path, key)
            if on_batch is not None:
                on_batch(batch, batch_id)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source_path)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def created_once(stream: DataFrame, keys: list[str], time: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    """At most one event for each combination of keys within the watermark; works on streams."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)
