"""The driver's tables seen as tables of the model."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lithos.functions import scalars
from lithos.sources.tables import table


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, as spark.checkpoint.dir names it;
    a session that has none (local, in tests) gets one."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = tempfile.mkdtemp(prefix="lithos-shared-")
        spark.sparkContext.setCheckpointDir(there)
    return f"{there.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def collections(spark: SparkSession, d: str) -> DataFrame:
    """id, internalid, metadataid, metadata of nations, each a collection; those of region 1 are no volumes."""
    region = F.col("n_regionkey").cast("string")
    metadata = F.when(F.col("n_regionkey") == 1, F.create_map(F.lit("region"), region)).otherwise(F.create_map(F.lit("volume"), F.trim("n_name"), F.lit("region"), region))
    return table(spark, d, "nation").select(F.trim("n_name").alias("id"), F.col("n_nationkey").alias("internalid"), F.col("n_regionkey").alias("metadataid"), metadata.alias("metadata"))


def contents(spark: SparkSession, d: str) -> DataFrame:
    """collection, segment, sha1, len, content of documents."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select(F.col("lang").alias("collection"), F.col("doc_id").alias("segment"), F.sha1(text).alias("sha1"), F.octet_length(text).cast("long").alias("len"), text.alias("content"))


def order_versions(spark: SparkSession, d: str) -> DataFrame:
    """segment, versionid, versiontime (µs), uniquifier, payload of orders: a customer is a segment,
    and orders of a moment are told apart by rank."""
    moment = Window.partitionBy("o_custkey", "o_orderdate").orderBy("o_orderkey")
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("segment"),
        F.col("o_orderkey").alias("versionid"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("versiontime"),
        (F.row_number().over(moment) - 1).cast("int").alias("uniquifier"),
        F.col("o_totalprice").alias("payload"),
    )


def events(spark: SparkSession, d: str) -> DataFrame:
    """The event log: a user is a collection, ten events are a transaction."""
    kind = F.col("event_type")
    letter = F.when(kind == "purchase", "T").when(kind == "signup", "C").when(kind == "error", "R").otherwise("M")
    return table(spark, d, "events").select(
        F.col("event_id").alias("eventid"),
        F.col("user_id").alias("collectionid"),
        letter.alias("eventtype"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.floor(F.col("event_id") / 10).cast("long").alias("transactionid"),
        F.col("event_type").alias("source_type"),
        "value",
        "props",
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    """parent, name, child: region → nation → customer."""
    region = table(spark, d, "region").select(F.lit("/").alias("parent"), F.trim("r_name").alias("name"), F.concat(F.lit("r"), F.col("r_regionkey")).alias("child"))
    nation = table(spark, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"), F.trim("n_name").alias("name"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("child"))
    customer = table(spark, d, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent"), F.trim("c_name").alias("name"), F.concat(F.lit("c"), F.col("c_custkey")).alias("child"))
    return region.unionByName(nation).unionByName(customer)


def fork_blocks(spark: SparkSession, d: str) -> DataFrame:
    """node, fork, block_index, content of conversations: a conversation is a fork, a turn a block."""
    return table(spark, d, "conversations").select(F.col("conv_id").alias("node"), F.lit("data").alias("fork"), F.col("turn").alias("block_index"), F.coalesce("text", F.lit("")).alias("content"))


def event_kinds(log: DataFrame) -> DataFrame:
    """The log with kinds, unknown ones skipped."""
    return log.withColumn("kind", scalars.event_kind(F.col("eventtype"))).filter(F.col("kind").isNotNull())
