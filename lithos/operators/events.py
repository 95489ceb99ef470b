"""The ordered event log: cursors, pages, guarded latest ids, per-transaction dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lithos.operators import pieces

PAGE = 1000


def page(log: DataFrame, condition: Column, order: list[str], size: int = PAGE) -> DataFrame:
    """The first `size` rows that meet a condition, in a total order."""
    return log.filter(condition).orderBy(*order).limit(size)


def after_id(log: DataFrame, collection: int | None, first_id: int, size: int = PAGE) -> DataFrame:
    """Committed transactions from an id on, included."""
    condition = (F.col("eventtype") == "T") & (F.col("eventid") >= first_id)
    return page(log, condition if collection is None else condition & (F.col("collectionid") == collection), ["eventid"], size)


def after_time(log: DataFrame, time: int, size: int = PAGE) -> DataFrame:
    """Committed transactions strictly after a time, those of one time by id."""
    return page(log, (F.col("eventtype") == "T") & (F.col("timestamp") > time), ["timestamp", "eventid"], size)


def of_transaction(log: DataFrame, transaction: int, first_id: int = 0, size: int = PAGE) -> DataFrame:
    """All kinds of events of a transaction from an id on."""
    return page(log, (F.col("transactionid") == transaction) & (F.col("eventid") >= first_id), ["eventid"], size)


def server_after_id(log: DataFrame, first_id: int, size: int = PAGE) -> DataFrame:
    """Server events from an id on, in order of id."""
    return page(log, F.col("eventid") >= first_id, ["eventid"], size)


def keyset_page(log: DataFrame, cursor: int, size: int = PAGE, key: str = "eventid") -> DataFrame:
    """A page from `cursor` on with has_more: one row more than the page is read to know it."""
    rows = log.filter(F.col(key) >= cursor).orderBy(key).limit(size + 1)
    place = F.row_number().over(Window.orderBy(key))  # over size + 1 rows
    more = F.count("*").over(Window.partitionBy()) > size
    return rows.select("*", place.alias("_place"), more.alias("has_more")).filter(F.col("_place") <= size).drop("_place")


def last_or(log: DataFrame, keys: list[str], column: str = "eventid", name: str = "last_id") -> DataFrame:
    """Largest id and count for each key; -1 where there's no row."""
    n = F.count("*")
    return log.groupBy(*keys).agg(F.when(n > 0, F.max(column)).otherwise(F.lit(-1)).cast("long").alias(name), n.alias("n_events"))


def next_transaction(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.max("transactionid") + 1, F.lit(0)).cast("long").alias("next_transaction"))


def last_per_collection(log: DataFrame) -> DataFrame:
    """The last event of each collection, whole; the collection is matched inside and outside."""
    others = [c for c in log.columns if c not in ("collectionid", "eventid")]
    last = log.groupBy("collectionid").agg(F.max(F.struct("eventid", *others)).alias("last"))
    return last.select("collectionid", "last.eventid", *[F.col(f"last.{c}").alias(c) for c in others])


def last_uncorrelated(log: DataFrame, collection: int) -> DataFrame:
    """Rows, of any collection, with the last event id of one collection (as a scalar subquery)."""
    last = log.filter(F.col("collectionid") == collection).agg(F.max("eventid").alias("last_id"))
    return log.join(F.broadcast(last), F.col("eventid") == F.col("last_id")).drop("last_id")  # one row


def once_per_transaction(log: DataFrame, keys: list[str], order: str = "eventid") -> DataFrame:
    """The first event of each combination of keys."""
    others = [c for c in log.columns if c not in (*keys, order)]
    first = log.groupBy(*keys).agg(F.min(F.struct(order, *others)).alias("first"))
    return first.select(*keys, f"first.{order}", *[F.col(f"first.{c}").alias(c) for c in others])


def numbered(log: DataFrame, order: list[str]) -> DataFrame:
    """Dense ids from 0 within each collection, in commit order; large collections are numbered in pieces."""
    return pieces.numbered(log, "collectionid", order, "_place").withColumn("collection_eventid", F.col("_place") - 1).drop("_place")


def with_details(log: DataFrame) -> DataFrame:
    """Each committed transaction with the number of its events by kind."""
    heads = log.filter(F.col("eventtype") == "T").groupBy("transactionid").agg(F.max("eventid").alias("eventid"))
    count = lambda k: F.count(F.when(F.col("eventtype") == k, 1))
    details = log.groupBy("transactionid").agg(count("C").alias("n_created"), count("R").alias("n_released"), count("M").alias("n_metadata"))
    return heads.join(details, "transactionid")
