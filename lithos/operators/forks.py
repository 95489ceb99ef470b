"""Forks: named files of a node, as rows of blocks (node, fork, block_index, content: binary), all full
but the last. Which forks there are is a table of its own (node, fork), as an empty one has no block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.functions.scalars import BLOCK

KEY = ["node", "fork"]


def names(forks: DataFrame, node: int) -> DataFrame:
    """The names of a node's forks, in order."""
    return forks.filter(F.col("node") == node).select("fork").orderBy("fork")


def got(forks: DataFrame, asked: DataFrame, create: bool = True) -> DataFrame:
    """Forks with those asked for (node, fork); without `create` one that isn't there is an error."""
    new = asked.select(*KEY).distinct().join(forks.select(*KEY), KEY, "left_anti")
    if not create:
        new = new.withColumn("fork", F.raise_error(F.concat(F.lit("no fork "), F.col("fork"))).cast("string"))
    return forks.select(*KEY).unionByName(new)


def dropped(forks: DataFrame, blocks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forks and blocks without some forks (node, fork)."""
    return forks.join(gone.select(*KEY), KEY, "left_anti"), blocks.join(gone.select(*KEY), KEY, "left_anti")


def replaced(forks: DataFrame, blocks: DataFrame, new: DataFrame, new_blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forks and blocks with new forks (node, fork) and their blocks in place of those of the same names."""
    left, kept = dropped(forks, blocks, new)
    return left.unionByName(new.select(*KEY).distinct()), kept.unionByName(new_blocks)


def length(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(*KEY).agg(F.sum(F.octet_length("content")).cast("long").alias("length"))


def read(blocks: DataFrame, node: int, fork: str, offset: int, size: int, block: int = BLOCK) -> DataFrame:
    """block_index and the bytes of each block in [offset, offset + size), in order, clamped to the
    end; no rows beyond it. Only the blocks of the range are read."""
    first, last = offset // block, (offset + size - 1) // block
    rows = blocks.filter((F.col("node") == node) & (F.col("fork") == fork) & F.col("block_index").between(first, last))
    start = F.greatest(F.lit(offset) - F.col("block_index") * block, F.lit(0)).cast("int")
    end = F.least(F.lit(offset + size) - F.col("block_index") * block, F.octet_length("content")).cast("int")
    return rows.filter(end > start).select("block_index", F.col("content").substr(start + 1, end - start).alias("data")).orderBy("block_index")


def zeros(n):
    return F.unhex(F.repeat(F.lit("00"), n))


def write(blocks: DataFrame, patches: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks with patches (node, fork, offset, data: one for each fork) laid over them; what a write
    beyond the end leaves between is zeros. Only touched blocks change."""
    end = F.col("offset") + F.octet_length("data")
    first = F.floor(F.col("offset") / block)
    cut = patches.filter(F.octet_length("data") > 0).select(*KEY, "offset", "data", F.explode(F.sequence(first, F.floor((end - 1) / block))).alias("block_index"))
    skip = F.greatest(F.col("block_index") * block - F.col("offset"), F.lit(0)).cast("int")
    at = F.greatest(F.col("offset") - F.col("block_index") * block, F.lit(0)).cast("int")
    pieces = cut.select(*KEY, "block_index", at.alias("at"), F.col("data").substr(skip + 1, (F.lit(block) - at).cast("int")).alias("piece"))
    grown = extend(blocks, patches.select(*KEY, F.col("offset").alias("length")), block)
    both = grown.join(pieces, [*KEY, "block_index"], "full_outer")
    old = F.coalesce("content", F.unhex(F.lit("")))
    after = F.col("at") + F.octet_length("piece")
    patched = F.concat(old.substr(F.lit(1), F.col("at")), F.col("piece"), old.substr(after + 1, F.greatest(F.octet_length(old) - after, F.lit(0))))
    return both.select(*KEY, "block_index", F.when(F.col("piece").isNull(), F.col("content")).otherwise(patched).alias("content"))


def append(blocks: DataFrame, more: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks with data (node, fork, data) behind each fork's end."""
    at = more.join(length(blocks), KEY, "left").select(*KEY, F.coalesce("length", F.lit(0)).cast("long").alias("offset"), "data")
    return write(blocks, at, block)


def extend(blocks: DataFrame, lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks with zeros up to a length (node, fork, length) where a fork is shorter."""
    want = lengths.filter(F.col("length") > 0).select(*KEY, F.col("length").cast("long").alias("want"))
    short = want.join(length(blocks), KEY, "left").withColumn("have", F.coalesce("length", F.lit(0)).cast("long")).filter(F.col("want") > F.col("have"))
    spans = short.select(*KEY, "want", F.explode(F.sequence(F.floor(F.col("have") / block), F.floor((F.col("want") - 1) / block))).alias("block_index"))
    full = F.least(F.lit(block), F.col("want") - F.col("block_index") * block).cast("int")
    targets = spans.select(*KEY, "block_index", full.alias("size"))
    joined = blocks.join(targets, [*KEY, "block_index"], "full_outer")
    old = F.coalesce("content", F.unhex(F.lit("")))
    padded = F.concat(old, zeros(F.greatest(F.col("size") - F.octet_length(old), F.lit(0))))
    return joined.select(*KEY, "block_index", F.when(F.col("size").isNull(), F.col("content")).otherwise(padded).alias("content"))


def truncate(blocks: DataFrame, node: int, fork: str, size: int, block: int = BLOCK) -> DataFrame:
    """Blocks with a fork cut to a length."""
    other = (F.col("node") != node) | (F.col("fork") != fork)
    kept = blocks.filter(other | (F.col("block_index") * block < size))
    room = (F.lit(size) - F.col("block_index") * block).cast("int")
    return kept.withColumn("content", F.when(other, F.col("content")).otherwise(F.col("content").substr(F.lit(1), room)))


def total_length(blocks: DataFrame) -> DataFrame:
    """node, length over all its forks."""
    return blocks.groupBy("node").agg(F.sum(F.octet_length("content")).cast("long").alias("length"))
