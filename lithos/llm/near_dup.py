"""Near duplicates by DartMinHash.

A text is a weighted set: its five-word shingles with their counts, as unit regions (shingle, k-th
occurrence). Darts fall on (region × rank) at rate one, their number, place and rank given by hashes
alone, so that texts that share a region share its darts. Each dart belongs to one coordinate, and
the earliest dart of each coordinate is the signature: two texts agree in a coordinate with a
probability of their weighted Jaccard similarity. Ranks are read in layers until every coordinate
has a dart, so the work follows the text's length and not length times coordinates.

Bands of coordinates are joined: within a bucket every text is paired with a hub and with its
neighbour in an order by a further band, which is linear in the bucket's size, and never all with
all. Each pair is verified by its exact weighted Jaccard similarity, and classes are the
connected components of the verified links. Then come the buckets that still hold several classes.
A text can only have a link to another class if enough of its regions occur in another class; those
that can't are left out, which takes a count and no pairs. Of the others in a bucket, every text
outside the largest class is compared exactly with every text of another class, in blocks, through
the block's postings of regions; no pair is written but a link found. So the classes are those of
all pairs within buckets. The work of that last step grows with the number of such texts in a bucket
times those outside the largest class, spread over tasks of two blocks each.

Exact copies of a text are one node throughout. Words are `\\w+` in lower case; a text of one to
four words is one shingle, one without words matches only its exact copies. A null text is empty,
very long ones are read whole. The class id is the least doc_id of the class (null ids don't count;
null if there's no other), so ties don't matter. Repeated rows are exact copies. Empty input gives an
empty result. Only doc_id and text are read, whatever other columns are named.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.llm.common import checkpointed, remove, shared_path

WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 25, 5
K = BANDS * ROWS
#: Texts of a bucket, and characters of theirs, that are compared with as many others in one unit of work.
BLOCK, BLOCK_CHARS = 4096, 8_000_000
TOKEN = re.compile(r"\w+")
#: Ends of the layers of ranks; each has four times the darts of all before.
LAYERS = [4.0**e for e in range(-3, 9)]
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Shingler:
    """Hashes of shingles; word hashes are kept."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def shingles(self, text: str) -> np.ndarray:
        import xxhash

        words = TOKEN.findall(text.lower())
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > 80_000:
            known.clear()
        try:
            codes = [known[w] for w in words]
        except KeyError:
            codes = [known.get(w) or known.setdefault(w, xxhash.xxh64_intdigest(w) or 1) for w in words]
        codes = np.array(codes, np.uint64)
        n = max(1, len(codes) - WORDS + 1)
        out = np.zeros(n, np.uint64)
        for k in range(min(WORDS, len(codes))):
            out = mix(out * _A + codes[k : k + n])
        return out


def regions(shingles: np.ndarray) -> np.ndarray:
    """A hash for each (shingle, occurrence)."""
    order = np.sort(shingles)
    first = np.concatenate(([True], order[1:] != order[:-1]))
    starts = np.flatnonzero(first)
    nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return mix(order + nth.astype(np.uint64) * _A)


#: Per layer, the distribution function of the number of darts on a unit region.
def _cumulative(mean: float) -> np.ndarray:
    n = np.arange(int(mean + 12 * np.sqrt(mean) + 14))
    logs = n * np.log(mean) - mean - np.concatenate(([0.0], np.cumsum(np.log(n[1:]))))
    return np.cumsum(np.exp(logs))


_SPANS = [(a, b, _cumulative(b - a)) for a, b in zip([0.0, *LAYERS], LAYERS)]


def signature(cells: np.ndarray) -> np.ndarray:
    """The earliest dart of each of K coordinates, for the regions of a text (one at least)."""
    out, empty = np.zeros(K, np.uint64), np.ones(K, bool)
    for layer, (low, high, cumulative) in enumerate(_SPANS):
        seeds = mix(cells + np.array([layer + 1], np.uint64) * _C)
        number = np.searchsorted(cumulative, unit(seeds), side="right")
        total = int(number.sum())
        if not total:
            continue
        ends = np.cumsum(number)
        nth = np.arange(total) - np.repeat(ends - number, number)
        darts = mix(np.repeat(seeds, number) + (nth + 1).astype(np.uint64) * _A)
        place = (darts % np.uint64(K)).astype(np.int64)
        late_first = np.argsort(mix(darts ^ _B))[::-1]  # ranks within a layer, latest first: the earliest is written last
        found, fill = np.zeros(K, np.uint64), np.zeros(K, bool)
        found[place[late_first]] = darts[late_first]
        fill[place] = True
        new = empty & fill
        out[new] = found[new]
        empty &= ~fill
        if not empty.any():
            break
    return out


def bands(cells: np.ndarray) -> np.ndarray:
    rows = signature(cells).reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for k in range(ROWS):
        out = mix(out * _A + rows[:, k])
    return out.view(np.int64)


def node(text: Column) -> Column:
    """The key of a text and its exact copies: 128 bits of its SHA-256."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two sorted arrays of regions: min over max of the counts is intersection over union here."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, node, bands (array of a key per band; null without words)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            found = []
            for text in batch["text"].to_pylist():
                shingles = shingler.shingles(text or "")
                found.append(bands(regions(shingles)) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["node"], pa.array(found, pa.list_(pa.int64()))], ["doc_id", "node", "bands"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), node(F.col("text")).alias("node"), "text")
    return rows.mapInArrow(sign, "doc_id long, node binary, bands array<long>")


def pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def buckets(nodes: DataFrame) -> DataFrame:
    """key, key2, node, hub for each band of nodes (node, id, bands) whose key others share; key2 is
    that of the next band, the hub the bucket's first node by id."""
    keys = nodes.filter(F.col("bands").isNotNull()).select("node", "id", "bands", F.posexplode_outer("bands").alias("at", "key"))
    keys = keys.select("node", "id", "key", F.element_at("bands", ((F.col("at") + 1) % BANDS + 1).cast("int")).alias("key2"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("id", "node"))["node"].alias("hub"))
    return keys.join(sizes.filter("n > 1"), "key").select("key", "key2", "node", "hub")


def candidates(shared: DataFrame) -> DataFrame:
    """Pairs (u < v) of a bucket's members with its hub and with their neighbour."""
    n = max(2, int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = shared.select("key", "key2", "node").repartitionByRange(n, "key", "key2", "node").sortWithinPartitions("key", "key2", "node")

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last = None, None
        for batch in batches:
            us, vs = [], []
            for key, name in zip(batch["key"].to_pylist(), batch["node"].to_pylist(), strict=True):
                if key == last_key:
                    us.append(name)
                    vs.append(last)
                last_key, last = key, name
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], ["node", "other"])

    pairs = shared.select("node", F.col("hub").alias("other")).unionByName(order.select("key", "node").mapInArrow(neighbours, "node binary, other binary"))
    pairs = pairs.filter(F.col("node") != F.col("other"))
    return pairs.select(pair(F.col("node"), F.col("other"))).distinct()


def several(named: DataFrame) -> DataFrame:
    """key, top (the label of its largest class), n (members), outside: buckets (key, node, label) of several classes."""
    of_class = named.groupBy("key", "label").agg(F.count("*").alias("n"))
    sizes = of_class.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"))
    return sizes.filter(F.col("n") > F.col("top.n")).select("key", F.col("top.label").alias("top"), "n", (F.col("n") - F.col("top.n")).alias("outside"))


def linkable(suspects: DataFrame, texts: DataFrame, threshold: float, path: str) -> DataFrame:
    """node of those suspects (node, label) that can have a link to another label among them. Two texts
    at the threshold t have t times the larger one's regions in common, and a common region of two
    labels is known from its least and greatest label."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                found = [regions(shingler.shingles(text or "")) for text in part["text"].to_pylist()]
                sizes = np.array([len(f) for f in found])
                rows = pa.array(np.repeat(np.arange(len(found)), sizes))
                yield pa.RecordBatch.from_arrays(
                    [part["node"].take(rows), part["label"].take(rows), pa.array(np.repeat(sizes, sizes), pa.int64()), pa.array(np.concatenate(found).view(np.int64))], ["node", "label", "size", "region"]
                )

    suspects.join(texts, "node").select("node", "label", "text").mapInArrow(cells, "node binary, label binary, size long, region long").write.parquet(path)
    rows = suspects.sparkSession.read.parquet(path)
    mixed = rows.groupBy("region").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("region")
    common = rows.join(mixed, "region", "left_semi").groupBy("node").agg(F.count("*").alias("common"), F.first("size").alias("size"))
    return common.filter(F.col("common") >= F.col("size") * threshold - 1e-9).select("node")


def units(named: DataFrame) -> DataFrame:
    """key, b, o, query, node, label: buckets of several classes (key, node, label, chars) cut into
    units (key, b, o) of a block of all members and a block of those outside the largest class, the
    latter marked as queries."""
    chars = named.groupBy("key").agg(F.sum("chars").alias("chars"))
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.ceil(F.col("chars") * n / F.col("n") / BLOCK_CHARS)).cast("int")
    sizes = several(named).join(chars, "key").select("key", "top", blocks(F.col("n")).alias("n_b"), blocks(F.col("outside")).alias("n_o"))
    rows = named.drop("chars").join(sizes, "key")
    of_node = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    members = rows.select("key", of_node(F.col("n_b")).alias("b"), all_of(F.col("n_o")).alias("o"), F.lit(False).alias("query"), "node", "label")
    outside = rows.filter(F.col("label") != F.col("top"))
    queries = outside.select("key", all_of(F.col("n_b")).alias("b"), of_node(F.col("n_o")).alias("o"), F.lit(True).alias("query"), "node", "label")
    return members.unionByName(queries)


def links_across(members: list[tuple[bytes, bytes, np.ndarray]], queries: list[tuple[bytes, bytes, np.ndarray]], threshold: float) -> Iterator[tuple[bytes, bytes]]:
    """For each query (node, label, regions) a link to each other class of the members that has one."""
    sizes = np.array([len(r) for _, _, r in members])
    number = {label: i for i, label in enumerate({label for _, label, _ in members})}
    labels = np.array([number[label] for _, label, _ in members])
    regions_ = np.concatenate([r for _, _, r in members])
    order = np.argsort(regions_, kind="stable")
    postings, owners = regions_[order], np.repeat(np.arange(len(members)), sizes)[order]
    for name, label, cells in queries:
        first, end = np.searchsorted(postings, cells, "left"), np.searchsorted(postings, cells, "right")
        counts = end - first
        at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        common = np.bincount(owners[at], minlength=len(members))
        near = np.flatnonzero((common / np.maximum(1, len(cells) + sizes - common) >= threshold) & (labels != number.get(label, -1)))
        for i in near[np.unique(labels[near], return_index=True)[1]]:
            yield name, members[i][0]


def further_links(shared: DataFrame, labels: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """u, v: links between classes (labels: node, label) of a bucket, one at least for each text outside
    its largest class and other class that it has a link to."""
    spark = shared.sparkSession
    named = shared.select("key", "node").join(labels, "node")
    # The hub was tried against all: a bucket of two has no untried pair.
    untried = several(named).filter("n > 2").select("key")
    suspects = checkpointed(named.join(untried, "key", "left_semi"))
    path = shared_path(spark, "near-dup-regions")
    left = checkpointed(linkable(suspects.select("node", "label").distinct(), texts, threshold, path))
    remove(spark, path)
    lengths = texts.select("node", F.length("text").alias("chars")).join(left, "node", "left_semi")
    rows = units(checkpointed(suspects.join(lengths, "node"))).join(texts, "node")
    rows = rows.repartition("key", "b", "o").sortWithinPartitions("key", "b", "o")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, unit_, sides = Shingler(), None, ([], [])

        def found() -> pa.RecordBatch:
            links = list(links_across(*sides, threshold)) if sides[0] and sides[1] else []
            return pa.RecordBatch.from_arrays([pa.array([min(x) for x in links], pa.binary()), pa.array([max(x) for x in links], pa.binary())], ["u", "v"])

        for batch in batches:
            for key, b, o, query, name, label, text in zip(*(batch[c].to_pylist() for c in ("key", "b", "o", "query", "node", "label", "text")), strict=True):
                if (key, b, o) != unit_:
                    yield found()
                    unit_, sides = (key, b, o), ([], [])
                sides[query].append((name, label, regions(shingler.shingles(text or ""))))
        yield found()

    return rows.select("key", "b", "o", "query", "node", "label", "text").mapInArrow(search, "u binary, v binary").distinct()


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs of `threshold` similarity and more; texts: node, text."""
    left = texts.select(F.col("node").alias("u"), F.col("text").alias("text_u"))
    right = texts.select(F.col("node").alias("v"), F.col("text").alias("text_v"))
    both = pairs.join(right, "v").join(left, "u").select("u", "v", "text_u", "text_v")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last, cells = Shingler(), None, None
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                u = batch["u"][i].as_py()
                if u != last:
                    last, cells = u, np.sort(regions(shingler.shingles(batch["text_u"][i].as_py() or "")))
                other = np.sort(regions(shingler.shingles(batch["text_v"][i].as_py() or "")))
                if similarity(cells, other) >= threshold:
                    keep.append(i)
            yield batch.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    return both.mapInArrow(verify, "u binary, v binary")


def vertex(id: Column, key: Column) -> Column:
    """A text's key with its first id before it, so that keys are in order of ids."""
    return F.concat(F.unhex(F.lpad(F.coalesce(F.hex(id), F.lit("f" * 16)), 16, "0")), key)


def texts_of(documents: DataFrame, nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """node (a vertex), text of those that share a bucket, read from the row of the text's first id."""
    wanted = shared.select("node").distinct().join(nodes.select(F.col("vertex").alias("node"), F.col("node").alias("w_key"), F.col("id").alias("w_id")), "node")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), node(F.col("text")).alias("key"), "text")
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key"))).select("node", "text")
    return texts.groupBy("node").agg(F.first("text").alias("text"))


def components(links: DataFrame) -> DataFrame:
    """node, label: a node of its connected component, the same for all, by contraction: each node
    hooks to the least of itself and its neighbours, hooks are followed to their ends (each step
    doubles the length), and the links between the ends are the next round's. As every end is met by
    a neighbour's hook or its own, a round leaves at most half the nodes; where hubs are less than their
    buckets' members, as `vertex` makes them, one round does nearly all. Lineage is cut in each."""
    labels = None
    while True:
        both = links.select("u", "v").union(links.select("v", "u")).toDF("node", "other")
        roots = checkpointed(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")))
        while True:
            further = roots.select(F.col("node").alias("root"), F.col("root").alias("further"))
            roots = checkpointed(roots.join(further, "root").select("node", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")))
            if not roots.agg(F.max("moved")).first()[0]:
                break
        roots = roots.select("node", "root")
        if labels is None:
            labels = roots.withColumnRenamed("root", "label")
        else:
            labels = checkpointed(labels.join(roots.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("root", "label").alias("label")))
        ends = [roots.select(F.col("node").alias(e), F.col("root").alias(f"root_{e}")) for e in ("u", "v")]
        links = checkpointed(links.join(ends[0], "u").join(ends[1], "v").select(pair(F.col("root_u"), F.col("root_v"))).filter("u != v").distinct())
        if links.agg(F.count("*")).first()[0] == 0:
            return labels


def classes(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, node, class_id, class_node (the node of the class's least doc_id), for each row of
    documents (doc_id, text)."""
    spark = documents.sparkSession
    signed = checkpointed(signatures(documents))
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    nodes = checkpointed(nodes.withColumn("vertex", vertex(F.col("id"), F.col("node"))))
    path = shared_path(spark, "near-dup")
    buckets(nodes.select(F.col("vertex").alias("node"), "id", "bands")).write.parquet(f"{path}/buckets")
    shared = spark.read.parquet(f"{path}/buckets")
    texts_of(documents, nodes, shared).write.parquet(f"{path}/texts")
    texts = spark.read.parquet(f"{path}/texts")
    links = checkpointed(verified(candidates(shared), texts, threshold))
    labels = components(links)
    labels = checkpointed(texts.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label")))
    further = checkpointed(further_links(shared, labels, texts, threshold))
    # The further links join classes: components of the labels, and labels of labels.
    ends = [labels.select(F.col("node").alias(e), F.col("label").alias(f"label_{e}")) for e in ("u", "v")]
    joined = further.join(ends[0], "u").join(ends[1], "v").select(pair(F.col("label_u"), F.col("label_v"))).distinct()
    merged = components(joined).select(F.col("node").alias("label"), F.col("label").alias("further"))
    labels = checkpointed(labels.join(merged, "label", "left").select("node", F.coalesce("further", "label").alias("label")))
    remove(spark, path)
    member = nodes.select("node", "id", "vertex").join(labels.withColumnRenamed("node", "vertex"), "vertex", "left").withColumn("label", F.coalesce("label", "vertex"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node"))
    chosen = member.groupBy("label").agg(least.alias("least")).select("label", F.col("least.id").alias("class_id"), F.col("least.node").alias("class_node"))
    of_node = member.join(chosen, "label").select("node", "class_id", "class_node")
    return signed.select("doc_id", "node").join(of_node, "node").select("doc_id", "node", "class_id", "class_node")
