"""Benchmark decontamination by SimHash over item-sized windows, with built-in functions only.

Windows of a benchmark item's number of words stand at every word from which on a text has so many
five-word shingles of items of that length that the threshold can be reached, in whatever order and
place; no other window can reach it. A window's fingerprint is the SimHash of its shingles. Windows
and items of a length are joined on the blocks of their fingerprints: RADIUS + 1 blocks, one of which
must agree if RADIUS bits or fewer differ, so that all pairs within the radius are found. The exact
weighted Jaccard similarity of the shingles, counts being weights, decides.

The radius is the one loss. At the threshold a bit differs with a probability of about 0.15, so that
beyond 22 of 64 bits lie some 2 in 100,000 of the pairs at 0.8, and fewer above (`tests/llm` measures
it at the threshold over random items with edits at the edges and in the middle).

An item of fewer than five words is one shingle, found where its words stand. An item without words
and a null or empty text match nothing. Very long texts are searched whole. Rows that repeat a doc_id
and a text give one result, as do repeated items; a null doc_id or item_id is a value like any other.
Of windows that tie the first is told. Items with the same words are all reported. An empty table on
either side gives an empty result. Only doc_id, text and item_id are read, whatever other columns are
named.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, THRESHOLD = 5, 0.8
#: Bits of 64 in which the fingerprints of a pair may differ, and the first bits of the blocks they are joined on.
RADIUS = 22
BLOCKS = [64 * b // (RADIUS + 1) for b in range(RADIUS + 2)]
#: The benchmark's shingles are broadcast up to this many (24 bytes each), its blocks up to this many (40 bytes each); beyond they are joined by a shuffle.
BROADCAST = 1_000_000
#: Eight counters in a number, 8 bits each.
LANES = 0x0101010101010101


def node(text: Column) -> Column:
    """The key of a text: 128 bits of its SHA-256."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once; a column named inside a lambda is computed anew for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(hashes: str, width: int = WORDS) -> Column:
    """Hashes of the runs of `width` words of an array of word hashes; empty if there are fewer."""
    def of(h: Column) -> Column:
        run = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])
        return F.when(F.size(h) >= width, F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - width, F.lit(0))), run)).otherwise(F.array().cast("array<bigint>"))

    return once(F.col(hashes), of)


def item_shingles(hashes: str) -> Column:
    """Those of an item: five words wide, or as wide as a shorter item is."""
    out = shingles(hashes)
    for width in range(1, WORDS):
        out = F.when(F.size(hashes) == width, shingles(hashes, width)).otherwise(out)
    return out


def shifted(x: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, by)


def simhash(hashes: Column) -> Column:
    """64 bits, each set if more of the hashes have it than lack it. Eight sums do for up to 255 hashes:
    each adds eight bits at a time. It is never null, so that no filter computes it a second time."""
    zero, each = F.lit(0).cast("long"), lambda n: F.sequence(F.lit(0), F.lit(n - 1))

    def of(h: Column) -> Column:
        sum_of = lambda k, mask: F.aggregate(h, zero, lambda n, x: n + shifted(x, k).bitwiseAND(F.lit(mask)))
        bit = lambda n, b: F.when(n * 2 > F.size(h), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(zero)
        count = lambda lanes, b: shifted(F.get(lanes, b.bitwiseAND(F.lit(7))), b.bitwiseAND(F.lit(56))).bitwiseAND(F.lit(255))
        few = once(F.transform(each(8), lambda k: sum_of(k, LANES)), lambda lanes: F.aggregate(each(64), zero, lambda a, b: a.bitwiseOR(bit(count(lanes, b), b))))
        return F.when(F.size(h) < 256, few).otherwise(F.aggregate(each(64), zero, lambda a, b: a.bitwiseOR(bit(sum_of(b, 1), b))))

    return F.coalesce(once(hashes, of), zero)


def blocks(print_: str) -> Column:
    """Each block's value with the block's number before it."""
    part = lambda b, lo, hi: F.shiftrightunsigned(print_, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).bitwiseOR(F.lit(b << 16))
    return F.array(*[part(b, lo, hi) for b, (lo, hi) in enumerate(zip(BLOCKS, BLOCKS[1:]))])


def first_block(difference: Column) -> Column:
    """The number of the first block in which two fingerprints agree, given the bits they differ in."""
    same = lambda lo, hi: F.shiftrightunsigned(difference, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) == 0
    return F.coalesce(*[F.when(same(lo, hi), F.lit(b)) for b, (lo, hi) in enumerate(zip(BLOCKS, BLOCKS[1:]))])


def weighted(run: Column) -> Column:
    """A set with a member for each occurrence, so that its Jaccard is the weighted one: in sorted order
    an occurrence's number is its distance from the first of its kind."""
    return once(F.sort_array(run), lambda r: F.transform(r, lambda x, i: F.xxhash64(x, i + 1 - F.array_position(r, x))))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, item (key of its words), n (words), width (of shingles), item_shingles, item_members, fingerprint."""
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("hashes")).withColumn("n", F.size("hashes")).filter(F.col("n") > 0)
    items = items.withColumn("item_shingles", item_shingles("hashes")).withColumn("item", F.xxhash64("hashes")).dropDuplicates(["item_id", "hashes"])
    return items.select("item_id", "item", "n", F.least(F.col("n"), F.lit(WORDS)).alias("width"), "item_shingles", weighted(F.col("item_shingles")).alias("item_members"), simhash(F.col("item_shingles")).alias("fingerprint"))


def windows_of(documents: DataFrame, items: DataFrame, threshold: float, widths: list[int], small: bool) -> DataFrame:
    """doc_id, node, n, start, window (its shingles), for each window that can reach the threshold."""
    anchors = items.select("n", F.explode_outer("item_shingles").alias("shingle")).distinct()
    texts = documents.select("doc_id", node(F.col("text")).alias("node"), word_hashes(F.col("text")).alias("hashes"))
    # The outer form: for the inner one Spark tests the array's size first, in a filter that computes the hashes anew for each shingle.
    runs = [texts.withColumn("runs", shingles("hashes", w)).select("doc_id", "node", "hashes", F.lit(w).alias("width"), F.posexplode_outer("runs").alias("at", "shingle")) for w in widths]
    hits = None
    for r in runs:
        h = r.join(F.broadcast(anchors) if small else anchors, "shingle").groupBy("doc_id", "node", "n", "width").agg(F.first("hashes").alias("hashes"), F.sort_array(F.collect_set("at")).alias("ats"))
        hits = h if hits is None else hits.unionByName(h)
    # Of a window's m shingles and an item's, this many at least are in common; from the k-th hit on, so many lie in windows that start here.
    most = F.col("n") - F.col("width") + 1
    hits = hits.withColumn("m", F.least(F.col("n"), F.size("hashes")) - F.col("width") + 1)
    hits = hits.withColumn("need", F.ceil((F.col("m") + most) * threshold / (1 + threshold) - 1e-9).cast("int")).filter(F.size("ats") >= F.col("need"))

    def starts(at: Column, k: Column) -> Column:
        low = F.greatest(F.get("ats", k + F.col("need") - 1) - F.col("m") + 1, F.lit(0))
        high = F.least(at, F.greatest(F.size("hashes") - F.col("n"), F.lit(0)))
        return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))

    hits = hits.withColumn("starts", F.array_distinct(F.flatten(F.transform("ats", starts))))
    runs_again = shingles("hashes")
    for w in widths:
        if w != WORDS:
            runs_again = F.when(F.col("width") == w, shingles("hashes", w)).otherwise(runs_again)
    hits = hits.withColumn("runs", runs_again).select("doc_id", "node", "n", "m", "runs", F.explode_outer("starts").alias("start")).filter(F.col("start").isNotNull())
    return hits.select("doc_id", "node", "n", "start", F.slice("runs", F.col("start") + 1, F.col("m")).alias("window"))


def leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, node (key of the text), item_id, start (word), similarity: for each text and item
    the most similar window that reaches the threshold, the first of equals."""
    items = items_of(benchmark)
    # At most five widths.
    widths = sorted({r["width"] for r in items.select("width").distinct().collect()} | {WORDS})
    size = items.agg(F.sum(F.size("item_shingles")).alias("shingles"), F.count("*").alias("n")).first()
    small = max(size["shingles"] or 0, size["n"] * len(BLOCKS)) <= BROADCAST
    held = F.broadcast if small else lambda df: df

    windows = windows_of(documents, items, threshold, widths, small).withColumn("print", simhash(F.col("window")))
    keyed = items.select("item_id", "item", "n", "fingerprint", F.explode(blocks("fingerprint")).alias("block"))
    near = windows.select("*", F.explode(blocks("print")).alias("block")).join(held(keyed), ["n", "block"])
    difference = F.col("print").bitwiseXOR(F.col("fingerprint"))
    near = near.filter(F.bit_count(difference) <= RADIUS)
    # A pair is found by each block that agrees; the first keeps it.
    near = near.filter(F.shiftrightunsigned("block", 16) == first_block(difference))
    near = near.select("doc_id", "node", "n", "start", "item_id", "item", weighted(F.col("window")).alias("members"))
    members = items.select(F.col("item_id").alias("i_id"), F.col("item").alias("i_item"), "item_members")
    near = near.join(held(members), F.col("item_id").eqNullSafe(F.col("i_id")) & (F.col("item") == F.col("i_item")))
    sizes = F.size("members") + F.size("item_members")
    similarity = once(F.size(F.array_intersect("members", "item_members")), lambda common: common / (sizes - common))
    scored = near.select("doc_id", "node", "item_id", "start", similarity.alias("similarity")).filter(F.col("similarity") >= threshold)
    best = scored.groupBy("doc_id", "node", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    return best.select("doc_id", "node", "item_id", (-F.col("best.back")).cast("long").alias("start"), "best.similarity")
