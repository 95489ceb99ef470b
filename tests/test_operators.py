"""Operators whose effect the tables can't show: forks, commits, replication, trees, functions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lithos.functions import scalars
from lithos.operators import content, events, forks, pieces, refs, tree, versions
from lithos.plans import edits
from lithos.plans.commit import Dataset
from lithos.sources import tables
from lithos.streaming import replicate


def fork(spark, nodes, block=4):
    rows = [(n, "data", i // block, data[i : i + block]) for n, data in nodes.items() for i in range(0, len(data), block)]
    return spark.createDataFrame(rows, "node long, fork string, block_index long, content binary")


def whole(blocks):
    out = {}
    for r in blocks.orderBy("node", "block_index").collect():
        out[r["node"]] = out.get(r["node"], b"") + bytes(r["content"])
    return out


@pytest.mark.parametrize("offset, data", [(0, b"XY"), (3, b"abcdef"), (9, b"zz"), (14, b"end"), (10, b"")])
def test_fork_write(spark, offset, data):
    before = b"0123456789"
    blocks = fork(spark, {1: before, 2: b"other"})
    patch = spark.createDataFrame([(1, "data", offset, data)], "node long, fork string, offset long, data binary")
    got = whole(forks.write(blocks, patch, 4))
    want = bytearray(before.ljust(offset if data else 0, b"\0"))
    if data:
        want[offset : offset + len(data)] = data
    assert got[2] == b"other"
    assert got[1] == bytes(want)


def test_fork_read_append_extend_truncate(spark):
    blocks = fork(spark, {1: b"0123456789"})
    read = lambda o, n: b"".join(bytes(r["data"]) for r in forks.read(blocks, 1, "data", o, n, 4).collect())
    assert (read(2, 5), read(8, 50), read(10, 5)) == (b"23456", b"89", b"")
    more = spark.createDataFrame([(1, "data", b"abc"), (3, "data", b"new")], "node long, fork string, data binary")
    assert whole(forks.append(blocks, more, 4)) == {1: b"0123456789abc", 3: b"new"}
    longer = spark.createDataFrame([(1, "data", 14), (4, "data", 5)], "node long, fork string, length long")
    assert whole(forks.extend(blocks, longer, 4)) == {1: b"0123456789\0\0\0\0", 4: b"\0" * 5}
    assert whole(forks.truncate(blocks, 1, "data", 5, 4)) == {1: b"01234"}
    assert whole(forks.truncate(blocks, 1, "data", 0, 4)) == {}


def test_chunks_give_the_content_back(spark):
    text = "äbc" * 700
    df = spark.createDataFrame([(1, text), (2, ""), (3, "x")], "segment long, content string")
    blocks = content.chunk(df, 64).withColumnsRenamed({"segment": "node", "chunk": "content"})
    back = {r["node"]: r["content"] for r in content.reassemble(blocks).collect()}
    assert back == {1: text, 3: "x"}


def test_final_version_cant_change(spark):
    schema = "segment long, versionid long, sha1 string, len long, final boolean"
    cas = spark.createDataFrame([(1, 1, "a", 1, True), (2, 1, "b", 1, False)], schema)
    same = spark.createDataFrame([(1, 1, "a", 1, False), (2, 1, "c", 2, False)], schema)
    assert {(r["segment"], r["sha1"]) for r in content.store_versioned(cas, same).collect()} == {(1, "a"), (2, "c")}
    with pytest.raises(Exception, match="final version"):
        content.store_versioned(cas, spark.createDataFrame([(1, 1, "z", 1, False)], schema)).collect()


def test_release(spark):
    cas = spark.createDataFrame([(1, 1, 1, 10), (1, 1, 2, 11), (1, 2, 1, 10)], "collectionid long, segment long, versionid long, dataid long")
    data = spark.createDataFrame([(10,), (11,)], "dataid long")
    left, kept = refs.release(cas, data, spark.createDataFrame([(1, 1)], "collectionid long, segment long"))
    assert left.count() == 1 and [r["dataid"] for r in kept.collect()] == [10]
    left, kept = refs.release_versions(cas, data, spark.createDataFrame([(1, 1, 2)], "collectionid long, segment long, versionid long"))
    assert left.count() == 2 and [r["dataid"] for r in kept.collect()] == [10]


def test_commits(spark, tmp_path):
    data = Dataset(spark, str(tmp_path / "d"))
    rows = spark.createDataFrame([(1, "a")], "id long, v string")
    first = data.begin(1000)
    first.append("t", rows)
    first.commit()
    second = data.begin(1000)
    assert (second.time, second.uniquifier) == (1000, 1)
    second.append("t", rows)
    second.rollback()
    # A batch that wrote its rows and crashed before its record isn't seen.
    rows.withColumns({"_batch": F.lit("lost"), "_version": F.lit(99).cast("long")}).write.mode("append").parquet(str(tmp_path / "d" / "t"))
    assert data.table("t").count() == 1
    third = data.begin(2000)
    third.append("t", rows)
    third.commit(snapshot="s")
    assert data.table("t").count() == 2
    assert [(r["versionid"], r["snapshot"]) for r in data.commits().orderBy("versionid").collect()] == [(1, None), (2, "s")]


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    schema = "eventid long, collectionid long, eventtype string"
    source, target = str(tmp_path / "source"), str(tmp_path / "target")
    log = spark.range(100).select(F.col("id").alias("eventid"), (F.col("id") % 3).alias("collectionid"), F.lit("T").alias("eventtype"))
    log.filter("eventid < 60").repartition(3).write.parquet(source)
    replicate.replicate_stream(spark, source, schema, target, str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(target).count() == 60
    log.filter("eventid >= 50").coalesce(1).write.mode("append").parquet(source)  # ten are delivered again
    replicate.replicate_stream(spark, source, schema, target, str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(target).count() == 100
    replicate.replicate_stream(spark, source, schema, target, str(tmp_path / "c2")).awaitTermination()  # a lost checkpoint
    got = spark.read.parquet(target)
    assert got.count() == 100 and got.select("eventid").distinct().count() == 100
    assert replicate.replicate_batch(log, target) == 0


def test_tree_edits(spark):
    edges = spark.createDataFrame([("/", "a", "1"), ("1", "b", "2"), ("/", "c", "3")], "parent string, name string, child string")
    with pytest.raises(Exception, match="exists"):
        tree.created(edges, spark.createDataFrame([("/", "a", "9")], edges.schema)).collect()
    assert tree.created(edges, spark.createDataFrame([("/", "a", "9")], edges.schema), exclusive=False).count() == 3
    with pytest.raises(ValueError):
        tree.deleted(edges, spark.createDataFrame([("/", "a")], "parent string, name string"))
    assert tree.deleted(edges, spark.createDataFrame([("1", "b")], "parent string, name string")).count() == 2
    moved = {tuple(r) for r in tree.moved(edges, "1", "b", "/", "d").collect()}
    assert ("/", "d", "2") in moved and len(moved) == 3
    got = {r["path"]: r["child"] for r in tree.resolve(spark.createDataFrame([("/a/b",), ("/a//b/",), ("/x",), ("/",)], "path string"), edges).collect()}
    assert got == {"/a/b": "2", "/a//b/": "2", "/x": None, "/": "/"}


def test_scalars(spark):
    df = spark.createDataFrame([("/a/b/c", "x, y,,z ", "ff00")], "path string, ids string, hex string")
    got = df.select(scalars.parent_path(F.col("path")), scalars.leaf_name(F.col("path")), scalars.without_leading(F.col("path"), 1), scalars.id_list(F.col("ids")), scalars.hash_bucket(F.col("hex"), 4), scalars.serial_path(F.lit(12345678))).first()
    assert tuple(got) == ("/a/b", "c", "b/c", ["x", "y", "z"], 15, "012/345/678.casseg")
    maps = spark.createDataFrame([({"a": "1", "b": "2"},)], "m map<string,string>")
    got = maps.select(scalars.map_put(F.col("m"), "a", F.lit("9")), scalars.map_without(F.col("m"), "a"), scalars.map_only(F.col("m"), F.array(F.lit("b"), F.lit("z")))).first()
    assert tuple(got) == ({"a": "9", "b": "2"}, {"b": "2"}, {"b": "2"})
    ends = spark.range(1).select(scalars.readable(F.lit(5), F.lit(10), F.lit(8)), scalars.readable(F.lit(8), F.lit(1), F.lit(8)), scalars.block_index(F.lit(1 << 20)), scalars.space_used(F.lit(65536))).first()
    assert tuple(ends) == (3, -1, 1, 131072)


def test_segment_files(spark, tmp_path):
    for i, data in ((1, b"one"), (1002, b"two")):
        digits = str(i).zfill(9)
        folder = tmp_path / digits[:3] / digits[3:6]
        folder.mkdir(parents=True)
        (folder / f"{digits[6:]}.casseg").write_bytes(data)
    files = tables.segment_files(spark, str(tmp_path))
    assert {(r["dataid"], r["casid"]["sha1"], r["casid"]["len"]) for r in files.collect() if r["dataid"] is not None}.issuperset({(i, hashlib.sha1(d).hexdigest(), 3) for i, d in ((1, b"one"), (1002, b"two"))})
    assert refs.rebuilt_index(files).count() == 2


def test_snapshots(spark):
    schema = "volume long, name string, versiontime long, uniquifier int"
    have = spark.createDataFrame([(1, "b", 20, 0), (1, "a", 10, 1)], schema)
    more = versions.with_snapshot(have, spark.createDataFrame([(1, "a", 30, 0)], schema))
    assert [r["name"] for r in versions.list_snapshots(more, 1).collect()] == ["b", "a"]
    assert versions.release_snapshot(more, 1, "a").count() == 1


# Forks by name, bytes, ids


def test_forks_of_a_node_stay_apart(spark):
    blocks = fork(spark, {1: b"0123456789"}).unionByName(fork(spark, {1: b"abcdef"}).withColumn("fork", F.lit("resource")))
    patch = spark.createDataFrame([(1, "resource", 2, b"XY")], "node long, fork string, offset long, data binary")
    after = forks.write(blocks, patch, 4)
    assert whole(after.filter("fork = 'data'")) == {1: b"0123456789"} and whole(after.filter("fork = 'resource'")) == {1: b"abXYef"}
    assert {(r["fork"], r["length"]) for r in forks.length(after).collect()} == {("data", 10), ("resource", 6)}
    have = blocks.select("node", "fork").distinct()
    assert [r["fork"] for r in forks.names(have, 1).collect()] == ["data", "resource"]
    assert forks.got(have, spark.createDataFrame([(1, "data"), (2, "x")], "node long, fork string")).count() == 3
    with pytest.raises(Exception, match="no fork"):
        forks.got(have, spark.createDataFrame([(2, "x")], "node long, fork string"), create=False).collect()
    left, kept = forks.dropped(have, blocks, spark.createDataFrame([(1, "data")], "node long, fork string"))
    assert [r["fork"] for r in left.collect()] == ["resource"] and whole(kept) == {1: b"abcdef"}


def test_bytes_come_back(spark):
    odd = bytes(range(256)) * 3 + b"\xff\xfe\x00\x80"
    df = spark.createDataFrame([(1, odd), (2, b"\xff")], "segment long, content binary")
    blocks = content.chunk(df, 7).withColumnsRenamed({"segment": "node", "chunk": "content"})
    assert {r["node"]: bytes(r["content"]) for r in content.reassemble(blocks.repartition(5)).collect()} == {1: odd, 2: b"\xff"}
    stream = content.in_order(blocks, ["node"]).collect()
    assert b"".join(bytes(r["content"]) for r in stream if r["node"] == 1) == odd


def test_serial_paths_beyond_nine_digits(spark):
    ids = [7, 999_999_999, 1_234_567_890, 1_234_567_899, 10**15 + 3]
    rows = spark.createDataFrame([(i,) for i in ids], "id long").withColumn("path", scalars.serial_path(F.col("id"))).withColumn("back", scalars.serial_number(F.col("path"))).collect()
    assert [r["path"] for r in rows] == ["000/000/007.casseg", "999/999/999.casseg", "001/234/567/890.casseg", "001/234/567/899.casseg", "001/000/000/000/000/003.casseg"]
    assert [r["back"] for r in rows] == ids


def test_wide_serial_paths_keep_every_digit(spark, tmp_path):
    """Documents 812 and 8120, whose numbers differ by one digit more, have two files."""
    from lithos import queries

    spark.createDataFrame([(812,), (8120,), (1_000_000,)], "doc_id long").write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.serial_paths_wide(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r["path"] for r in rows] == ["100/246/912/677/744.casseg", "001/002/469/126/777/440.casseg", "123/456/789/012/000/000.casseg"]
    assert [r["serial"] for r in rows] == [i * 123456789012 for i in (812, 8120, 1_000_000)]


def test_segment_files_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, b"one"), (1_234_567_890, b"two")], "dataid long, content binary")
    write = lambda df, **more: {r["dataid"]: r["status"] for r in tables.write_segment_files(df, str(tmp_path), **more).collect()}
    assert write(rows) == {1: "written", 1_234_567_890: "written"} and write(rows) == {1: "unchanged", 1_234_567_890: "unchanged"}
    assert {r["dataid"]: bytes(r["content"]) for r in tables.segment_files(spark, str(tmp_path)).collect()} == {1: b"one", 1_234_567_890: b"two"}
    other = spark.createDataFrame([(1, b"other")], "dataid long, content binary")
    with pytest.raises(Exception, match="holds another segment"):
        write(other)
    assert write(other, replace=True) == {1: "replaced"} and (tmp_path / "000/000/001.casseg").read_bytes() == b"other"


# Keys with many rows, deep trees


def test_large_keys_are_numbered_in_pieces(spark):
    log = spark.range(500).select(F.col("id").alias("eventid"), F.when(F.col("id") % 5 == 0, F.col("id") % 3).otherwise(None).alias("collectionid"), (F.col("id") * 7 % 90).alias("timestamp"))
    one, split = (pieces.numbered(log, "collectionid", ["timestamp", "eventid"], "n", large).orderBy("eventid").collect() for large in (10_000, 20))
    assert one == split and split[0]["n"] is not None
    assert events.numbered(log, ["timestamp", "eventid"]).agg(F.min("collection_eventid")).first()[0] == 0


def test_nearest_of_many_targets(spark):
    rows = spark.range(300).select((F.col("id") % 3).alias("segment"), (F.col("id") * 11 % 100).alias("versiontime"), (F.col("id") % 2).cast("int").alias("uniquifier"), F.col("id").alias("versionid")).dropDuplicates(["segment", "versiontime", "uniquifier"])
    targets = spark.range(60).select((F.col("id") % 4).alias("segment"), (F.col("id") * 5 - 20).alias("at_time"), F.lit(0).alias("at_uniquifier")).distinct()
    want = {tuple(r) for r in versions.nearest(rows, targets).collect()}
    for large in (10_000, 10):
        assert {tuple(r) for r in versions.nearest_each(rows, targets, large).collect()} == want
    assert want


def test_exact_makes_no_more_rows_than_it_reads(spark):
    """Stamps that many segments share."""
    rows = spark.range(200).select(F.col("id").alias("segment"), F.col("id").alias("versionid"), F.col("id").alias("dataid"))
    named = spark.range(200).select(F.col("id").alias("versionid"), F.lit(5).alias("versiontime"), F.lit(0).alias("uniquifier"))
    targets = spark.range(0, 200, 2).select(F.col("id").alias("segment"), F.lit(5).alias("versiontime"), F.lit(0).alias("uniquifier"))
    got = versions.exact(rows, named, spark.range(200).withColumnRenamed("id", "dataid"), targets)
    assert sorted(r["segment"] for r in got.collect()) == list(range(0, 200, 2))


def test_deep_trees_and_cycles(spark):
    n = 45
    edges = spark.createDataFrame([("/" if i == 0 else f"d{i - 1}", "x", f"d{i}") for i in range(n)], "parent string, name string, child string")
    path = "/x" * n
    assert tree.resolve(spark.createDataFrame([(path,)], "path string"), edges).first()["child"] == f"d{n - 1}"
    below = tree.subtree(edges, spark.createDataFrame([("/",)], "node string"))
    assert below.count() == n + 1 and below.agg(F.max("depth")).first()[0] == n
    sizes = spark.createDataFrame([(f"d{n - 1}", 5), ("d3", 2)], "node string, length long")
    totals = {r["node"]: r["total"] for r in tree.lengths_below(edges, sizes).collect()}
    assert totals["/"] == 7 and totals["d3"] == 5 and totals[f"d{n - 2}"] == 5
    loop = spark.createDataFrame([("a", "x", "b"), ("b", "y", "a")], edges.schema)
    assert tree.subtree(loop, spark.createDataFrame([("a",)], "node string")).count() == 2
    with pytest.raises(ValueError, match="within itself"):
        tree.lengths_below(loop, spark.createDataFrame([("b", 1)], "node string, length long"))
    assert tree.lengths_below(edges.limit(0), sizes).count() == 0


def test_changes_with_nulls(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y"), (4, None)], "k long, v string")
    b = spark.createDataFrame([(1, "z"), (2, None), (4, None), (5, None)], "k long, v string")
    assert {(r["k"], r["change"]) for r in versions.changes(a, b, ["k"], "v").collect()} == {(1, "modified"), (2, "modified"), (3, "deleted"), (5, "added")}


# Edits of a dataset


def stored(spark, path):
    data = Dataset(spark, path, edits.KEYS)
    rows = spark.createDataFrame([("a", 1, 1, "s1", 2, b"v1"), ("a", 2, 1, "s2", 2, b"v2"), ("b", 1, 1, "s1", 2, b"v1"), ("b", 3, 1, "s3", 2, b"v3")], "collectionid string, segment long, segmentversion int, sha1 string, len long, content binary")
    tx = data.begin(1000)
    tx.append("collections", spark.createDataFrame([("a", {"volume": "A"}), ("b", {})], "collectionid string, metadata map<string,string>"))
    edits.store(tx, rows)
    tx.commit()
    return data, rows


def test_edits_are_seen_after_their_commit(spark, tmp_path):
    data, rows = stored(spark, str(tmp_path / "d"))
    contents = lambda: {r["sha1"] for r in data.table("data").collect()}
    tx = data.begin(2000)
    edits.store(tx, rows)
    assert tx.view("cas").count() == 4  # idempotent
    tx.commit()
    assert data.table("cas").count() == 4 and data.table("data").count() == 3
    tx = data.begin(3000)
    edits.release(tx, spark.createDataFrame([("a", 1), ("a", 2)], "collectionid string, segment long"))
    assert tx.view("cas").count() == 2 and data.table("cas").count() == 4
    tx.rollback()
    assert tx.view("cas").count() == 4
    tx = data.begin(3000)
    edits.release(tx, spark.createDataFrame([("a", 1), ("a", 2)], "collectionid string, segment long"))
    tx.commit()
    assert data.table("cas").count() == 2 and contents() == {"s1", "s3"}  # s1 is shared
    assert data.table("cas", upto=1).count() == 4  # what a reader of an older version sees
    tx = data.begin(4000)
    edits.store(tx, rows.filter("sha1 = 's2'"))  # stored anew after its release
    edits.set_metadata(tx, "b", "k", "v")
    tx.commit()
    assert contents() == {"s1", "s2", "s3"}
    tx = data.begin(5000)
    edits.set_metadata(tx, "b", "k", None)
    edits.delete_collection(tx, spark.createDataFrame([("a",)], "collectionid string"))
    tx.commit()
    assert [(r["collectionid"], r["metadata"]) for r in data.table("collections").collect()] == [("b", {})] and contents() == {"s1", "s3"}


def test_the_first_of_two_commits_wins(spark, tmp_path):
    data = Dataset(spark, str(tmp_path / "d"))
    rows = spark.createDataFrame([(1,)], "id long")
    a, b = data.begin(1000), data.begin(1000)
    a.append("t", rows)
    b.append("t", rows)
    a.commit()
    with pytest.raises(RuntimeError, match="another transaction"):
        b.commit()
    assert data.table("t").count() == 1


def test_moves_and_deletions_by_path(spark, tmp_path):
    data = Dataset(spark, str(tmp_path / "d"), edits.KEYS)
    tx = data.begin(1)
    tx.append("edges", spark.createDataFrame([("/", "a", "1"), ("1", "b", "2"), ("1", "c", "3"), ("/", "d", "4")], "parent string, name string, child string"))
    tx.commit()
    tx = data.begin(2)
    edits.move(tx, "1", "b", "4", "e")
    tx.commit()
    tx = data.begin(3)
    edits.delete_paths(tx, spark.createDataFrame([("/a/c",), ("/no/where",)], "path string"))
    tx.commit()
    assert {tuple(r) for r in data.table("edges").select("parent", "name", "child").collect()} == {("/", "a", "1"), ("/", "d", "4"), ("4", "e", "2")}
    for path in ("/", "a/b"):
        with pytest.raises(Exception, match="can't delete"):
            edits.delete_paths(data.begin(4), spark.createDataFrame([(path,)], "path string"))
    with pytest.raises(ValueError, match="isn't empty"):
        edits.delete_paths(data.begin(4), spark.createDataFrame([("/d",)], "path string"))


def test_transactions_are_applied_once(spark, tmp_path):
    source, _ = stored(spark, str(tmp_path / "s"))
    target = Dataset(spark, str(tmp_path / "t"), edits.KEYS)
    schema = "collectionid string, eventid long, transactionid long, eventtype string, segment long, segmentversion int"
    tx = source.begin(2000)
    tx.append("events", spark.createDataFrame([("a", 0, 0, "C", 1, 1), ("a", 1, 0, "T", None, None), ("a", 2, 1, "C", 2, 1), ("b", 0, 0, "C", 1, 1), ("b", 1, 0, "T", None, None)], schema))
    tx.commit()
    assert replicate.apply_transactions(source, target, 7, 10) == 1 and replicate.apply_transactions(source, target, 7, 10) is None
    # Transaction 1 of `a` isn't committed yet.
    assert {(r["collectionid"], r["segment"]) for r in target.table("cas").collect()} == {("a", 1), ("b", 1)}
    assert [bytes(r["content"]) for r in target.table("data").collect()] == [b"v1"]
    assert {(r["collectionid"], r["metadata"].get("volume")) for r in target.table("collections").collect()} == {("a", "A"), ("b", None)}
    tx = source.begin(3000)
    tx.append("events", spark.createDataFrame([("a", 3, 1, "T", None, None), ("a", 4, 2, "R", 1, 1), ("a", 5, 2, "M", None, None), ("a", 6, 2, "T", None, None)], schema))
    edits.set_metadata(tx, "a", "volume", "B")
    tx.commit()
    assert replicate.apply_transactions(source, target, 7, 20, apply_releases=True) == 2
    assert {(r["collectionid"], r["segment"]) for r in target.table("cas").collect()} == {("a", 2), ("b", 1)}
    assert target.table("collections").filter("collectionid = 'a'").first()["metadata"] == {"volume": "B"}
    assert sorted((r["collectionid"], r["eventid"]) for r in target.table("replicated_events").collect()) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("a", 4), ("a", 5), ("a", 6), ("b", 0), ("b", 1)]


def shuffled(spark):
    """Bytes that the session's stages have shuffled so far."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


def test_contents_are_shuffled_once(spark, tmp_path):
    """40 contents of 100,000 random digits in 80 segments: one way through a shuffle for the store, one
    for the replication, none where only metadata changes, also where nothing is small enough to broadcast."""
    import random

    digits = random.Random(7)
    texts = ["".join(digits.choices("0123456789abcdef", k=100_000)) for _ in range(40)]
    rows = spark.createDataFrame([("ab"[i % 2], i, 1, texts[i // 2]) for i in range(80)], "collectionid string, segment long, segmentversion int, content string").repartition(2, "segment")
    rows = rows.withColumns({"sha1": F.sha1("content"), "len": F.octet_length("content").cast("long")}).localCheckpoint()
    source, target = (Dataset(spark, str(tmp_path / name), edits.KEYS) for name in "st")
    schema = "collectionid string, eventid long, transactionid long, eventtype string, segment long, segmentversion int"
    unit = 40 * 100_000
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        step = lambda: sum(n for k, n in shuffled(spark).items() if k not in before)
        tx = source.begin(1)
        tx.append("collections", spark.createDataFrame([("a", {"volume": "A"}), ("b", {"volume": "B"})], "collectionid string, metadata map<string,string>"))
        edits.store(tx, rows)
        tx.append("events", rows.select("collectionid", F.col("segment").alias("eventid"), F.lit(0).cast("long").alias("transactionid"), F.lit("C").alias("eventtype"), "segment", "segmentversion").unionByName(spark.createDataFrame([(c, 100, 0, "T", None, None) for c in "ab"], schema)))
        tx.commit()
        assert step() < 2.2 * unit  # a copy of a content can be in either of two partitions
        before = shuffled(spark)
        assert replicate.apply_transactions(source, target, 7, 10) == 1
        assert step() < 1.3 * unit
        tx = source.begin(2)
        edits.set_metadata(tx, "a", "volume", "C")
        tx.append("events", spark.createDataFrame([("a", 101, 1, "M", None, None), ("a", 102, 1, "T", None, None)], schema))
        tx.commit()
        before = shuffled(spark)
        assert replicate.apply_transactions(source, target, 7, 20) == 2
        assert step() < 0.3 * unit
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert target.table("cas").count() == 80 and target.table("collections").filter("metadata['volume'] = 'C'").count() == 1
    assert sorted(r["content"] for r in target.table("data").collect()) == sorted(texts)


def test_a_reference_and_its_content_are_of_one_row(spark, tmp_path):
    data = Dataset(spark, str(tmp_path / "d"), edits.KEYS)
    rows = spark.createDataFrame([("a", 1, 1, f"s{i}", 2, f"v{i}") for i in range(9)], "collectionid string, segment long, segmentversion int, sha1 string, len long, content string").repartition(5)
    tx = data.begin(1)
    edits.store(tx, rows)
    edits.store(tx, rows.filter("sha1 != 's0'").withColumn("segment", F.lit(2).cast("long")).drop("content"), rows)
    tx.commit()
    assert [(r["segment"], r["sha1"]) for r in data.table("cas").orderBy("segment").collect()] == [(1, "s0"), (2, "s1")]
    assert {(r["sha1"], r["content"]) for r in data.table("data").collect()} == {("s0", "v0"), ("s1", "v1")} and data.table("data").count() == 2


def test_files_and_volumes(spark, tmp_path):
    data = Dataset(spark, str(tmp_path / "d"), edits.KEYS)
    edge = lambda name, child: spark.createDataFrame([("/", name, child)], "parent string, name string, child string")
    two = fork(spark, {1: b"0123456789"}).unionByName(fork(spark, {1: b"abc"}).withColumn("fork", F.lit("resource")))
    tx = data.begin(1)
    edits.create_volume(tx, "v", {"name": "first"})
    edits.create_file(tx, edge("a", "1"), two)
    tx.commit()
    tx = data.begin(2)
    with pytest.raises(ValueError, match="taken"):
        edits.create_file(tx, edge("a", "2"), two)
    with pytest.raises(ValueError, match="exists"):
        edits.create_volume(tx, "v", {})
    edits.copy_file(tx, 1, 2, edge("b", "2"))
    edits.replace_fork(tx, 1, "resource", fork(spark, {1: b"xy"}).withColumn("fork", F.lit("resource")))
    edits.set_metadata(tx, "v", "name", "second")
    tx.commit(snapshot="s")
    blocks = data.table("blocks")
    of = lambda name: whole(blocks.filter(F.col("fork") == name))
    assert of("data") == {1: b"0123456789", 2: b"0123456789"} and of("resource") == {1: b"xy", 2: b"abc"}
    assert {tuple(r) for r in data.table("forks").collect()} == {(n, f) for n in (1, 2) for f in ("data", "resource")}
    assert [r["metadata"] for r in tables.volumes(data.table("collections")).collect()] == [{"volume": "", "name": "second"}]
    assert [r["metadata"]["name"] for r in data.table("collections", upto=1).collect()] == ["first"]


def test_replicated_versions_keep_their_stamps(spark, tmp_path):
    data = Dataset(spark, str(tmp_path / "d"))
    tx = data.begin(9, version=(70, 5, 2))
    tx.append("t", spark.createDataFrame([(1,)], "id long"))
    tx.commit()
    assert tuple(data.commits().first())[1:] == (70, 5, 2, None)
    after = data.begin(5)
    assert (after.versionid, after.time, after.uniquifier) == (71, 5, 3)


def test_listeners_hear_each_batch(spark, tmp_path):
    schema = "eventid long, collectionid long, eventtype string"
    log = spark.range(10).select(F.col("id").alias("eventid"), F.lit(1).cast("long").alias("collectionid"), F.lit("T").alias("eventtype"))
    log.coalesce(1).write.parquet(str(tmp_path / "s"))
    heard = []
    replicate.replicate_stream(spark, str(tmp_path / "s"), schema, str(tmp_path / "t"), str(tmp_path / "c"), on_batch=lambda batch, i: heard.append((i, batch.count()))).awaitTermination()
    assert heard == [(0, 10)]


def test_catalogs_over_jdbc(spark, tmp_path):
    """The embedded database that comes with Spark."""
    url = f"jdbc:derby:{tmp_path}/catalog;create=true"
    spark.range(100).select(F.col("id").alias("versionid"), (F.col("id") * 2).alias("versiontime")).write.format("jdbc").options(url=url, dbtable="versions", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    read = tables.jdbc_table(spark, url, "versions", key="versionid", bounds=(0, 100), parts=4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert read.rdd.getNumPartitions() == 4 and read.filter("versionid >= 90").agg(F.sum("versiontime")).first()[0] == 2 * sum(range(90, 100))


def test_schemas_and_the_clock(spark):
    from lithos import schemas

    for name, ddl in vars(schemas).items():
        if name.isupper():
            assert spark.createDataFrame([], ddl).count() == 0
    assert abs(spark.range(1).select(scalars.now_millis()).first()[0] / 1000 - __import__("time").time()) < 60
    guarded = spark.createDataFrame([("volume",)], "k string").select(scalars.unreserved(F.col("k"), ["volume"]))
    with pytest.raises(Exception, match="reserved metadata key"):
        guarded.collect()
