"""Content-addressed operators: dedup, storing, chunking, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.functions import scalars

ID = ["sha1", "len"]


def dedup_summary(contents: DataFrame) -> DataFrame:
    """Rows, distinct contents, bytes in all and in distinct contents: one row from one row for each
    content, which partial aggregation makes before the shuffle."""
    one = contents.groupBy(*ID).agg(F.count("*").alias("n"))
    return one.agg(F.sum("n").cast("long").alias("n_segments"), F.count("*").cast("long").alias("n_contents"), F.sum(F.col("n") * F.col("len")).cast("long").alias("bytes_total"), F.sum("len").cast("long").alias("bytes_stored"))


def dedup_groups(contents: DataFrame, least: int = 2) -> DataFrame:
    """Contents that several segments have, with the first of them."""
    groups = contents.groupBy(*ID).agg(F.min("segment").alias("first_segment"), F.count("*").alias("n_refs"))
    return groups.filter(F.col("n_refs") >= least)


def references(contents: DataFrame, content_ids: DataFrame) -> DataFrame:
    """All references to given contents, over all collections."""
    return contents.join(content_ids.select(*ID).distinct(), ID, "left_semi")


def find_or_store(incoming: DataFrame, data: DataFrame) -> DataFrame:
    """The distinct incoming contents that `data` lacks; appending them is the store."""
    return incoming.dropDuplicates(ID).join(data.select(*ID), ID, "left_anti")


def find_or_store_status(incoming: DataFrame, data: DataFrame) -> DataFrame:
    """For each distinct incoming content whether it existed."""
    known = data.select(*ID).distinct().withColumn("known", F.lit(True))
    return incoming.select(*ID).distinct().join(known, ID, "left").withColumn("existed", F.col("known").isNotNull()).drop("known")


def new_references(incoming: DataFrame, cas: DataFrame) -> DataFrame:
    """References of incoming segments that aren't there yet: idempotent on (collection, segment)."""
    return incoming.select("collection", "segment", *ID).dropDuplicates(["collection", "segment"]).join(cas.select("collection", "segment"), ["collection", "segment"], "left_anti")


def store_status(contents: DataFrame) -> DataFrame:
    """What storing each segment without a name would say, segments taken in order: the first of a
    content anywhere and the first in its collection are created, further ones in it exist."""
    first = contents.groupBy("collection", *ID).agg(F.min("segment").alias("first_segment"))
    joined = contents.select("collection", "segment", *ID).join(first, ["collection", *ID])
    return joined.select("collection", "segment", F.when(F.col("segment") == F.col("first_segment"), "created").otherwise("exists").alias("status"))


def store_versioned(cas: DataFrame, incoming: DataFrame) -> DataFrame:
    """(segment, versionid, sha1, len, final) with incoming contents in place. A final version may
    not change (an error); the same content changes nothing, another one replaces it."""
    both = cas.alias("o").join(incoming.alias("n"), ["segment", "versionid"], "full_outer")
    differs = F.col("o.sha1").isNotNull() & F.col("n.sha1").isNotNull() & ((F.col("o.sha1") != F.col("n.sha1")) | (F.col("o.len") != F.col("n.len")))
    conflict = F.when(F.coalesce(F.col("o.final"), F.lit(False)) & differs, F.raise_error(F.lit("a final version can't change")))
    return both.select(
        "segment",
        "versionid",
        F.coalesce(conflict.cast("string"), F.col("n.sha1"), F.col("o.sha1")).alias("sha1"),
        F.coalesce(F.col("n.len"), F.col("o.len")).alias("len"),
        F.coalesce(F.col("o.final"), F.col("n.final"), F.lit(False)).alias("final"),
    )


def verify(contents: DataFrame) -> DataFrame:
    """Each segment with `ok`: its bytes have the hash and length that are recorded."""
    found = scalars.content_id(F.col("content"))
    return contents.select("collection", "segment", ((found["sha1"] == F.col("sha1")) & (found["len"] == F.col("len"))).alias("ok"))


def repair(local: DataFrame, master: DataFrame) -> DataFrame:
    """Local contents, bad ones replaced by the master's if that is good and records the same identity."""
    good = lambda c, s, n: (F.sha1(c) == s) & (F.octet_length(c) == n)
    both = local.alias("l").join(master.select("collection", "segment", *ID, "content").alias("m"), ["collection", "segment"], "left")
    bad = ~good(F.col("l.content"), F.col("l.sha1"), F.col("l.len"))
    helps = (F.col("l.sha1") == F.col("m.sha1")) & (F.col("l.len") == F.col("m.len")) & good(F.col("m.content"), F.col("m.sha1"), F.col("m.len"))
    fixed = bad & F.coalesce(helps, F.lit(False))
    return both.select("collection", "segment", F.col("l.sha1").alias("sha1"), F.col("l.len").alias("len"), F.when(fixed, F.col("m.content")).otherwise(F.col("l.content")).alias("content"), fixed.alias("repaired"))


def chunk(contents: DataFrame, block: int, column: str = "content") -> DataFrame:
    """segment, block_index, chunk: blocks of `block` characters of a string, or bytes of a binary;
    the last may be shorter and an empty content has none."""
    size = F.length(column)
    starts = F.sequence(F.lit(0), F.floor((size - 1) / block).cast("int"))
    rows = contents.filter(size > 0).select("segment", column, F.explode(starts).alias("block_index"))
    return rows.select("segment", F.col("block_index").cast("long").alias("block_index"), F.col(column).substr(F.col("block_index") * block + 1, F.lit(block)).alias("chunk"))


def reassemble(blocks: DataFrame, key: str | list[str] = "node", content: str = "content") -> DataFrame:
    """key, content, n_blocks: a fork's blocks put together in order, characters of strings or bytes
    of binaries. A null block is empty. The whole is one value (2 GB at most); `in_order` has no such bound."""
    keys = [key] if isinstance(key, str) else key
    empty = F.lit("").cast(blocks.schema[content].dataType)
    rows = blocks.select(*keys, "block_index", F.coalesce(content, empty).alias("_part"))
    whole = F.expr("listagg(_part) WITHIN GROUP (ORDER BY block_index)")
    return rows.groupBy(*keys).agg(whole.alias("content"), F.count("*").alias("n_blocks"))


def in_order(blocks: DataFrame, key: list[str]) -> DataFrame:
    """The blocks as an ordered stream: partitions in order of (key, block_index), and so are the rows
    of each. A large fork is spread over several partitions."""
    return blocks.repartitionByRange(*key, "block_index").sortWithinPartitions(*key, "block_index")


def copy_file(blocks: DataFrame, source: int, target: int) -> DataFrame:
    """Block rows of a copy, all forks of it: it shares the segments, no content is copied."""
    return blocks.filter(F.col("node") == source).withColumn("node", F.lit(target).cast("long"))


def fork_content_ids(blocks: DataFrame, contents: DataFrame) -> DataFrame:
    """The content ids of a fork in order."""
    return blocks.join(contents.select("segment", *ID), "segment").select("node", "fork", "block_index", *ID).orderBy("node", "fork", "block_index")


def by_content_id(contents: DataFrame, collection: str, sha1: str, length: int) -> DataFrame:
    """A content by its id, always within the collection."""
    return contents.filter((F.col("collection") == collection) & (F.col("sha1") == sha1) & (F.col("len") == length))
