"""Small helpers the corpus operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


#: Texts that go to a Python worker at a time, where the session says nothing else.
BATCH = 500


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for a Spark context, and keeps the
    batches of texts small: a worker and the JVM beside it each hold a batch or two."""
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's own default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    if getattr(context, "_lithos_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="lithos-"), "lithos.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    context._lithos_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    A local session that has none (in tests) gets a temporary folder; on a cluster its lack is an error,
    as what a task wrote to a folder of its own machine would be lost with it."""
    context = spark.sparkContext
    there = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("lithos.shared.dir", None)
    if not there:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = tempfile.mkdtemp(prefix="lithos-shared-")
        spark.conf.set("lithos.shared.dir", there)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(there)
    return there


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what `shared_path` named, in whatever store it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, keys: list[str], order: list[Column], spread: Column, out: str, buckets: int = 64) -> DataFrame:
    """Adds `out`: 0, 1, 2, … within each combination of `keys`, no combination in one task.

    Rows of a key are dealt to `buckets` by `spread`, counted there, and numbered within the
    bucket; the counts of the earlier buckets are the offset. The numbers follow (bucket, order).
    Rows that tie in `order` may swap numbers among themselves."""
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*[F.col(f"_k{i}") for i in range(len(keys))]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    df = df.withColumn("_within", F.row_number().over(within) - 1)
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_bucket") == F.col("_b")]
    joined = df.join(offsets, on)
    return joined.withColumn(out, (F.col("_offset") + F.col("_within")).cast("long")).drop("_bucket", "_within", "_offset", "_b", *[f"_k{i}" for i in range(len(keys))])
