"""Shards of near equal bytes by best-fit-decreasing bin packing.

Indivisible groups (rows of equal text), largest first, enter the bin with the tightest remaining
capacity that holds them, found through a balanced tree. Groups of a size are interchangeable, so
only a histogram of sizes reaches the driver: sizes share a class when their leading 12 bits agree,
which bounds it at 4,096 classes and 2,048 more for each doubling (46,000 up to 4 GB), whatever
the input. What the packer returns are ranges of ranks within a class; groups are ranked and
matched to the ranges by Spark. Sizes of up to 4,095 bytes are exact; a larger group counts as its
class's mean, from which it differs by less than one part in 2,048, so a shard may exceed the capacity
by that part of the bytes of its larger groups, and by much less where many of them even out.

A group of more bytes than a shard's share can't stay whole if shards are to be equal: it is cut
at row boundaries into pieces of a share (fewer groups than shards are that large). Null and empty
texts have no bytes and form one group, very long ones are groups like others. Rows may repeat a
doc_id; each is a row of its own, and such rows may swap slots. Groups that tie in size are
interchangeable. Empty input gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithos.llm.common import checkpointed, numbered


class CapacityTree:
    """A treap of (remaining capacity, bin): the tightest bin that holds a size in O(log bins)."""

    def __init__(self) -> None:
        self.root, self.dice = None, random.Random(7)

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def _split(self, t, key):
        if t is None:
            return None, None
        if t[0] < key:
            t[3], right = self._split(t[3], key)
            return t, right
        left, t[2] = self._split(t[2], key)
        return left, t

    def add(self, key) -> None:
        a, b = self._split(self.root, key)
        self.root = self._merge(self._merge(a, [key, self.dice.random(), None, None]), b)

    def take(self, size: float):
        """Removes and returns the least key with a capacity of `size` or more."""
        a, b = self._split(self.root, (size, -1))
        if b is None:
            self.root = a
            return None
        path = b
        while path[2] is not None:
            path = path[2]
        key = path[0]
        _, rest = self._split(b, (key[0], key[1] + 1))
        self.root = self._merge(a, rest)
        return key


def pack(sizes: list[tuple[int, float, int]], bins: int, capacity: float) -> list[tuple[int, int, int, int]] | None:
    """Best fit decreasing of (class, size, count), largest size first, into `bins` bins.

    Returns (class, first rank, end rank, bin), or None if they don't fit. Equal items go to a bin
    together as long as it holds them, which is what one by one would do: a bin that just took an
    item is tighter still."""
    tree, out = CapacityTree(), []
    for b in range(bins):
        tree.add((capacity, b))
    for cls, size, count in sizes:
        at = 0
        while at < count:
            found = tree.take(size)
            if found is None:
                return None
            room, b = found
            n = min(count - at, int(room // size) or 1)
            out.append((cls, at, at + n, b))
            tree.add((room - n * size, b))
            at += n
    return out


def pack_tightest(sizes: list[tuple[int, float, int]], bins: int) -> list[tuple[int, int, int, int]]:
    """The packing of the least capacity, to one part in 4,096 of a share, that fits `bins` bins.

    An item beyond the share of the bins that are left has one of them to itself."""
    alone, sizes, total = [], list(sizes), sum(s * n for _, s, n in sizes)
    while sizes and bins > 1 and sizes[0][1] * bins > total:
        cls, size, count = sizes[0]
        bins, total, at = bins - 1, total - size, sum(e - b for c, b, e, _ in alone if c == cls)
        alone.append((cls, at, at + 1, bins))
        sizes[:1] = [(cls, size, count - 1)] if count > 1 else []
    taken = {c: sum(e - b for k, b, e, _ in alone if k == c) for c, _, _, _ in alone}
    return alone + [(c, a + taken.get(c, 0), z + taken.get(c, 0), b) for c, a, z, b in _tightest(sizes, bins, total)]


def _tightest(sizes: list[tuple[int, float, int]], bins: int, total: float) -> list[tuple[int, int, int, int]]:
    most, share = max((s for _, s, _ in sizes), default=1.0), max(total / bins, 1.0)
    low, high = max(share, most), max(share, most) * 2 + most
    best = pack(sizes, bins, high)
    while high - low > share / 4096:
        middle = (low + high) / 2
        found = pack(sizes, bins, middle)
        best, low, high = (found, low, middle) if found is not None else (best, middle, high)
    return best


def size_class(size: Column) -> Column:
    """The size with all but its leading 12 bits cleared."""
    drop = F.greatest(F.length(F.bin(size)) - 12, F.lit(0))
    step = F.pow(F.lit(2.0), drop).cast("long")
    return size - size % step


def shard_documents(documents: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 16), text_crc32, shard, slot (gapless from 0 in a shard)."""
    spark = documents.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = checkpointed(
        documents.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("group"))
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = total / shards
    groups = rows.groupBy("group").agg(F.first("size").alias("size"), F.count("*").alias("n")).withColumn("bytes", F.col("size") * F.col("n"))
    groups = checkpointed(groups)
    # Fewer than `shards` groups can exceed a share.
    large = [(bytearray(r["group"]), r["size"], r["n"], max(1, int(share // r["size"]))) for r in groups.filter((F.col("bytes") > share) & (F.col("n") > 1)).sort("group").collect()]
    piece_sizes: dict[int, list[tuple[bytearray, int, int]]] = {}
    for g, size, n, per in large:
        for k in range(0, n, per):
            piece_sizes.setdefault(size * min(per, n - k), []).append((g, k, min(n, k + per)))

    whole = groups.filter((F.col("bytes") <= share) | (F.col("n") == 1)).withColumn("class", size_class(F.col("bytes")))
    histogram = whole.groupBy("class").agg(F.count("*").alias("count"), F.sum("bytes").alias("sum")).collect()
    # A piece of a large group has a class of its own, below 0.
    pieces = [(-1 - i, float(size), piece) for i, (size, piece) in enumerate((s, p) for s, ps in sorted(piece_sizes.items()) for p in ps)]
    sizes = [(r["class"], r["sum"] / r["count"], r["count"]) for r in histogram] + [(c, s, 1) for c, s, _ in pieces]
    packed = pack_tightest(sorted(sizes, key=lambda x: (-x[1], x[0])), shards) if sizes else []

    ranges = spark.createDataFrame([p for p in packed if p[0] >= 0], "r_class long, r_from long, r_to long, shard int")
    ranked = numbered(whole, ["class"], [F.col("group")], F.col("group"), "rank")
    placed = ranked.join(F.broadcast(ranges), (F.col("class") == F.col("r_class")) & (F.col("rank") >= F.col("r_from")) & (F.col("rank") < F.col("r_to")))
    bin_of = {p[0]: p[3] for p in packed if p[0] < 0}
    cut = T.StructType([T.StructField("group", T.BinaryType()), T.StructField("r_from", T.LongType()), T.StructField("r_to", T.LongType()), T.StructField("shard", T.IntegerType())])
    cuts = spark.createDataFrame([(g, a, b, bin_of[c]) for c, _, (g, a, b) in pieces], cut)
    of_whole = rows.join(placed.select("group", "shard"), "group").select("doc_id", "size", "text_crc32", "shard")
    keys = F.broadcast(cuts.select("group").distinct())
    in_large = numbered(rows.join(keys, "group"), ["group"], [F.col("doc_id")], F.col("doc_id"), "rank")
    of_large = in_large.join(F.broadcast(cuts), "group").filter((F.col("rank") >= F.col("r_from")) & (F.col("rank") < F.col("r_to"))).select("doc_id", "size", "text_crc32", "shard")
    return numbered(checkpointed(of_whole.unionByName(of_large)), ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], F.col("doc_id"), "slot")
