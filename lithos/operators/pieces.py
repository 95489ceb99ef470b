"""Keys with more rows than a task should have, and plans with more steps than one should have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Rows from which on a key is split, and into how many pieces.
LARGE, PIECES = 10_000_000, 256


def cut(df: DataFrame) -> DataFrame:
    """The rows behind a checkpoint; without a folder for checkpoints they are kept by Spark's cache."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def pieced(rows: DataFrame, key: str, order: str, large: int = LARGE) -> DataFrame:
    """Adds _piece and _hot: keys of more than `large` rows are cut into ranges of the number `order`,
    nulls first; all others have one piece, 0. At most rows / large keys are that large, so that list
    is broadcast."""
    hot = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"), F.min(order).cast("double").alias("_low"), F.max(order).cast("double").alias("_high"))
    joined = rows.join(F.broadcast(hot.filter(F.col("_n") > large)), F.col(key).eqNullSafe(F.col("_key")), "left")
    place = F.floor((F.col(order) - F.col("_low")) / (F.col("_high") - F.col("_low")) * PIECES)
    piece = F.when(F.col("_high") > F.col("_low"), F.coalesce(F.least(place, F.lit(PIECES - 1)), F.lit(0))).otherwise(0)
    return joined.withColumns({"_piece": piece.cast("int"), "_hot": F.col("_n").isNotNull()}).drop("_key", "_n", "_low", "_high")


def numbered(rows: DataFrame, key: str, order: list[str], out: str, large: int = LARGE) -> DataFrame:
    """Adds `out`: 1, 2, … in order within each key. The first column of the order is a number."""
    columns = rows.columns
    rows = pieced(rows, key, order[0], large)
    within = Window.partitionBy(key, "_piece").orderBy(*order)
    before = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.filter("_hot").groupBy(F.col(key).alias("_k"), F.col("_piece").alias("_p")).agg(F.count("*").alias("_n"))
    counts = counts.select("_k", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = rows.withColumn("_place", F.row_number().over(within)).join(counts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_piece") == F.col("_p")), "left")
    return joined.select(*columns, (F.col("_place") + F.coalesce("_before", F.lit(0))).cast("long").alias(out))


def last_before(rows: DataFrame, key: str, order: list[str], state: str, large: int = LARGE) -> DataFrame:
    """Rows with `state` being the last one that isn't null, of the row itself or of those of its key
    before it in order. The first column of the order is a number."""
    columns = rows.columns
    rows = pieced(rows, key, order[0], large)
    upto = Window.partitionBy(key, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    ends = rows.filter("_hot").groupBy(F.col(key).alias("_k"), F.col("_piece").alias("_p")).agg(F.max_by(state, F.when(F.col(state).isNotNull(), place)).alias("_end"))
    ends = ends.select("_k", "_p", F.last("_end", True).over(before).alias("_carried"))
    joined = rows.withColumn("_last", F.last(state, True).over(upto)).join(ends, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_piece") == F.col("_p")), "left")
    return joined.withColumn(state, F.coalesce("_last", "_carried")).select(*columns)
