"""Edits of a dataset's tables as rows and removals of a transaction.

Keys of the tables: `KEYS`. A version of a segment refers to its content by the content's id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.operators import content, tree
from lithos.operators.content import ID
from lithos.plans.commit import Transaction

KEYS = {
    "collections": ["collectionid"],
    "cas": ["collectionid", "segment", "segmentversion"],
    "data": ID,
    "edges": ["parent", "name"],
    "forks": ["node", "fork"],
    "blocks": ["node", "fork", "block_index"],
    "snapshots": ["volume", "name"],
    "stores": ["storenum"],
}


def store(tx: Transaction, segments: DataFrame, contents: DataFrame | None = None) -> None:
    """Stores segments (collectionid, segment, segmentversion, sha1, len, content): references that
    aren't there yet, and contents that nothing has yet. With `contents` (sha1, len, content) the segments
    need no content of their own. What is new is found by keys and ids; contents are shuffled once, one
    row for each id."""
    cas, data = tx.view("cas"), tx.view("data")
    one = segments.groupBy(*KEYS["cas"]).agg(F.min(F.struct(*ID)).alias("_id"))  # both tables see the same one
    new = one.select(*KEYS["cas"], *[F.col(f"_id.{k}").alias(k) for k in ID])
    if cas is not None:
        new = new.join(cas.select(*KEYS["cas"]), KEYS["cas"], "left_anti")
    ids = new.select(*ID).distinct()
    if data is not None:
        ids = ids.join(data.select(*ID), ID, "left_anti")
    held = (segments if contents is None else contents).select(*ID, "content").dropDuplicates(ID)
    tx.append("cas", new)
    tx.append("data", held.join(ids, ID, "left_semi"))


def release(tx: Transaction, segments: DataFrame) -> None:
    """Releases segments (collectionid, segment; with segmentversion only those versions), and drops
    the contents that nothing refers to afterwards."""
    cas = tx.view("cas")
    keys = [k for k in KEYS["cas"] if k in segments.columns]
    gone = cas.join(segments.select(*keys), keys, "left_semi")
    left = cas.join(segments.select(*keys), keys, "left_anti")
    tx.remove("data", gone.select(*ID).distinct().join(left.select(*ID), ID, "left_anti"))
    tx.remove("cas", gone)


def delete_collection(tx: Transaction, collections: DataFrame) -> None:
    """Deletes collections (collectionid) with their references, and the contents that are free then."""
    release(tx, tx.view("cas").join(collections, "collectionid", "left_semi").select(*KEYS["cas"]))
    tx.remove("collections", collections)


def set_metadata(tx: Transaction, collection: int, key: str, value: str | None) -> None:
    """Sets a metadata key of a collection, or removes it; without keys an empty map stays."""
    row = tx.view("collections").filter(F.col("collectionid") == collection)
    metadata = F.map_filter("metadata", lambda k, _: k != key)
    if value is not None:
        metadata = F.map_concat(metadata, F.create_map(F.lit(key), F.lit(value)))
    tx.replace("collections", row.withColumn("metadata", metadata))


def move(tx: Transaction, parent: str, name: str, to_parent: str, to_name: str) -> None:
    """Moves an edge: the old one goes and the new one comes with one commit."""
    edges = tx.view("edges")
    after = tree.moved(edges, parent, name, to_parent, to_name)
    tx.remove("edges", edges.filter((F.col("parent") == parent) & (F.col("name") == name)))
    tx.append("edges", after.filter((F.col("parent") == to_parent) & (F.col("name") == to_name)))


def delete_paths(tx: Transaction, paths: DataFrame, root: str = "/") -> None:
    """Deletes what absolute paths (path) lead to."""
    edges = tx.view("edges")
    tx.remove("edges", edges.join(tree.deleted_paths(edges, paths, root), ["parent", "name"], "left_anti"))


def _free(tx: Transaction, new: DataFrame) -> DataFrame:
    """The edges (parent, name, child), or an error if one of their names is taken."""
    edges = tx.view("edges")
    if edges is not None and not edges.join(new, ["parent", "name"], "left_semi").isEmpty():
        raise ValueError("the name is taken")
    return new


def create_file(tx: Transaction, new: DataFrame, blocks: DataFrame) -> None:
    """Files (parent, name, child) with the blocks of their forks (node, fork, block_index, content), at once."""
    tx.append("edges", _free(tx, new))
    tx.append("forks", blocks.select("node", "fork").distinct())
    tx.append("blocks", blocks)


def copy_file(tx: Transaction, source: int, target: int, edge: DataFrame) -> None:
    """A file with all forks of another one, at a free name (parent, name, child); its blocks are shared
    where they refer to segments."""
    tx.append("edges", _free(tx, edge))
    for name in ("forks", "blocks"):
        tx.append(name, content.copy_file(tx.view(name), source, target))


def replace_fork(tx: Transaction, node: int, fork: str, blocks: DataFrame) -> None:
    """A fork created, or replaced by new blocks (node, fork, block_index, content)."""
    here = (F.col("node") == node) & (F.col("fork") == fork)
    for name in ("forks", "blocks"):
        if tx.view(name) is not None:
            tx.remove(name, tx.view(name).filter(here))
    tx.append("forks", tx.dataset.spark.createDataFrame([(node, fork)], "node long, fork string"))
    tx.append("blocks", blocks)


def create_volume(tx: Transaction, collection: str, properties: dict[str, str]) -> None:
    """A collection whose metadata makes it a volume; `tables.volumes` lists them, `delete_collection` deletes one."""
    rows = tx.view("collections")
    if rows is not None and not rows.filter(F.col("collectionid") == collection).isEmpty():
        raise ValueError("the collection exists")
    schema = "collectionid string, metadata map<string,string>"
    tx.append("collections", tx.dataset.spark.createDataFrame([(collection, {"volume": "", **properties})], schema))
