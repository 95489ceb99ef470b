"""Reference counts, release, garbage, reconciliation, stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.functions import scalars


def counts(data: DataFrame, references: DataFrame, key: str, ref: str) -> DataFrame:
    """Each data id with the number of its references, 0 without any."""
    n = references.groupBy(F.col(ref).alias(key)).agg(F.count("*").alias("n_refs"))
    return data.select(key).join(n, key, "left").withColumn("n_refs", F.coalesce("n_refs", F.lit(0)).cast("long"))


def orphans(data: DataFrame, references: DataFrame, key: str, ref: str) -> DataFrame:
    """Data that nothing refers to."""
    return data.join(references.select(F.col(ref).alias(key)), key, "left_anti")


def missing(data: DataFrame, references: DataFrame, key: str, ref: str) -> DataFrame:
    """References to data that isn't there."""
    return references.join(data.select(F.col(key).alias(ref)), ref, "left_anti")


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Deletion by keys: what stays, to be written in place of `rows`."""
    return rows.join(gone.select(*keys), keys, "left_anti")


def release(cas: DataFrame, data: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Releases all versions of segments (collectionid, segment): the references that stay, and the
    data that still has one, counted after the deletion."""
    left = without(cas, segments, ["collectionid", "segment"])
    return left, data.join(left.select("dataid"), "dataid", "left_semi")


def release_versions(cas: DataFrame, data: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for single versions (collectionid, segment, versionid)."""
    left = without(cas, versions, ["collectionid", "segment", "versionid"])
    return left, data.join(left.select("dataid"), "dataid", "left_semi")


def release_flags(cas: DataFrame, segments: DataFrame) -> DataFrame:
    """For each segment asked to be released whether it was there."""
    there = cas.select("collectionid", "segment").distinct().withColumn("_there", F.lit(True))
    return segments.join(there, ["collectionid", "segment"], "left").withColumn("released", F.col("_there").isNotNull()).drop("_there")


def freed(data: DataFrame, references: DataFrame, gone: DataFrame, key: str, ref: str) -> DataFrame:
    """Data whose last reference goes with `gone` (rows of references, by all their columns in common)."""
    keys = [c for c in references.columns if c in gone.columns]
    before = references.select(F.col(ref).alias(key)).distinct()
    after = without(references, gone, keys).select(F.col(ref).alias(key)).distinct()
    return data.join(before, key, "left_semi").join(after, key, "left_anti")


def delete_collection(collections: DataFrame, cas: DataFrame, data: DataFrame, collection: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without a collection: its references go, its row with its metadata, and the data that nothing
    refers to any more, by a reference or as a collection's metadata (metadataid)."""
    rows, left = collections.filter(F.col("internalid") != collection), cas.filter(F.col("collectionid") != collection)
    own = cas.filter(F.col("collectionid") == collection).select("dataid").union(collections.filter(F.col("internalid") == collection).select("metadataid"))
    still = left.select("dataid").union(rows.select("metadataid")).dropna()
    free = own.dropna().distinct().join(still, "dataid", "left_anti")
    return rows, left, data.join(free, "dataid", "left_anti")


def metadata(collections: DataFrame, data: DataFrame) -> DataFrame:
    """Each collection with the row of data that its metadataid names; those without one are left out."""
    return collections.join(data.withColumnRenamed("dataid", "metadataid"), "metadataid")


def used_again(data: DataFrame, ids: DataFrame) -> DataFrame:
    """Data with the usage of given ids (dataid) one higher, once for each time an id is given."""
    more = ids.groupBy("dataid").agg(F.count("*").alias("_more"))
    return data.join(more, "dataid", "left").withColumn("usage", (F.coalesce("usage", F.lit(0)) + F.coalesce("_more", F.lit(0))).cast("long")).drop("_more")


def reconcile(on_disk: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Disk against index: key, action. What is on disk alone is indexed, what is in the index alone
    is dropped, several files of a key leave duplicates to remove."""
    disk = on_disk.groupBy(key).agg(F.count("*").alias("n_files"))
    known = index.select(key).distinct().withColumn("indexed", F.lit(True))
    both = disk.join(known, key, "full_outer")
    action = F.when(F.col("n_files").isNull(), "drop_index").when(F.col("indexed").isNull(), "index_file").when(F.col("n_files") > 1, "remove_duplicate").otherwise("ok")
    return both.select(key, F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"), action.alias("action"))


def to_reload(on_disk: DataFrame, index: DataFrame, key: str, last_indexed: int, last_on_disk: int) -> DataFrame:
    """Ids on disk after the last indexed one that the index lacks."""
    return on_disk.filter((F.col(key) > last_indexed) & (F.col(key) <= last_on_disk)).join(index.select(key), key, "left_anti")


def needs_reload(on_disk: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Whether the last id on disk is missing from the index."""
    last = on_disk.agg(F.max(key).alias("last_on_disk")).crossJoin(index.agg(F.max(key).alias("last_indexed")))  # one row each
    return last.withColumn("needs_reload", F.coalesce(F.col("last_on_disk") > F.col("last_indexed"), F.col("last_on_disk").isNotNull()))


def rebuilt_index(files: DataFrame, key: str = "casid") -> DataFrame:
    """An index from segment files (dataid, casid, ...): one id for each content, the least."""
    return files.groupBy(key).agg(F.min("dataid").alias("dataid"))


def space(contents: DataFrame, key: str, length: str) -> DataFrame:
    """Segments and estimated bytes for each store."""
    return contents.groupBy(key).agg(F.count("*").alias("n_segments"), F.sum(scalars.space_used(F.col(length))).cast("long").alias("bytes_used"))


def store_for_writing(stores: DataFrame, need: int, sticky: int | None = None, reserve: int = 500 << 20) -> DataFrame:
    """The store to write to: the sticky one if it is ready and has room, else the first that has."""
    fits = stores.filter((F.col("status") == "Ready") & (F.col("free") > need + reserve))
    first = [] if sticky is None else [F.when(F.col("storenum") == sticky, 0).otherwise(1)]
    return fits.orderBy(*first, "storenum").limit(1)


#: The states of a store.
STORE_STATES = ("Starting", "Ready", "Closed", "Rebuilding", "NeedsRebuild", "NeedsReloadOfNewObjects", "ReadOnly")


def with_status(stores: DataFrame) -> DataFrame:
    """Stores (opened, closed, rebuilding, read_only: flags; last_on_disk, last_indexed: ids) with
    their status. Files without an index need a rebuild, files after its last id a reload."""
    indexed, there = F.col("last_indexed"), F.col("last_on_disk")
    status = (
        F.when(F.col("closed"), "Closed")
        .when(F.col("rebuilding"), "Rebuilding")
        .when(~F.col("opened"), "Starting")
        .when(there.isNotNull() & indexed.isNull(), "NeedsRebuild")
        .when(there > indexed, "NeedsReloadOfNewObjects")
        .when(F.col("read_only"), "ReadOnly")
        .otherwise("Ready")
    )
    return stores.withColumn("status", status)


def available(stores: DataFrame) -> DataFrame:
    """The stores that can be read; a manager waits until all can."""
    return stores.filter(F.col("status").isin("Ready", "ReadOnly"))
