"""Registered queries of the operators that read catalogs and that derive changed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos import catalog
from lithos.functions import scalars
from lithos.operators import content, forks, refs, tree, versions
from lithos.plans import edits
from lithos.plans.commit import Dataset
from lithos.registry import query
from lithos.sources import tables
from lithos.sources.tables import table
from lithos.streaming import replicate

EDGES = "(SELECT '/' AS parent, trim(r_name) AS name, 'r' || r_regionkey AS child FROM region UNION ALL SELECT 'r' || n_regionkey, trim(n_name), 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || c_nationkey, trim(c_name), 'c' || c_custkey FROM customer)"
#: Lines as references: a supplier is a collection, a part a segment, an order a version, a date a content.
CAS = "(SELECT DISTINCT l_suppkey AS collectionid, l_partkey AS segment, l_orderkey AS versionid, epoch_us(l_shipdate) // 86400000000 AS dataid FROM lineitem)"
BYTES = "(SELECT doc_id AS node, hex(encode(coalesce(text, ''))) AS h FROM documents)"


def cas(spark: SparkSession, d: str) -> DataFrame:
    day = F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 86_400_000_000).cast("long")
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("collectionid"), F.col("l_partkey").alias("segment"), F.col("l_orderkey").alias("versionid"), day.alias("dataid")).distinct()


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as forks of blocks of 1,000 bytes."""
    rows = catalog.contents(spark, d).withColumn("content", F.encode("content", "UTF-8"))
    cut = content.chunk(rows, 1000)
    return cut.select(F.col("segment").alias("node"), F.lit("data").alias("fork"), "block_index", F.col("chunk").alias("content"))


def hashes(of: DataFrame) -> DataFrame:
    return content.reassemble(of, ["node", "fork"]).select("node", F.sha1("content").alias("sha1"), "n_blocks")


# Catalog


@query("SELECT trim(n_name) AS id FROM nation")
def collection_ids(spark: SparkSession, d: str) -> DataFrame:
    return tables.collection_ids(catalog.collections(spark, d))


@query("SELECT n_nationkey AS internalid, n_regionkey AS metadataid FROM nation WHERE trim(n_name) = 'KENYA'")
def collection_by_id(spark: SparkSession, d: str) -> DataFrame:
    return catalog.collections(spark, d).filter(F.col("id") == "KENYA").select("internalid", "metadataid")


@query("SELECT n_nationkey AS internalid, n_regionkey AS metadataid, trim(r_name) AS content FROM nation JOIN region ON r_regionkey = n_regionkey")
def collection_metadata(spark: SparkSession, d: str) -> DataFrame:
    data = table(spark, d, "region").select(F.col("r_regionkey").alias("dataid"), F.trim("r_name").alias("content"))
    return refs.metadata(catalog.collections(spark, d).select("internalid", "metadataid"), data)


@query("SELECT n_nationkey AS internalid FROM nation WHERE n_regionkey <> 1")
def volumes(spark: SparkSession, d: str) -> DataFrame:
    return tables.volumes(catalog.collections(spark, d)).select("internalid")


@query("SELECT n_nationkey AS internalid, CASE WHEN n_regionkey = 1 THEN 'region' ELSE 'region,volume' END AS keys, 'region ' || n_regionkey || CASE WHEN n_regionkey = 1 THEN '' ELSE ' named' END AS said FROM nation")
def volume_properties(spark: SparkSession, d: str) -> DataFrame:
    """Keys of a collection's metadata, and the map with a key set and another taken away."""
    rows = catalog.collections(spark, d)
    named = scalars.map_put(F.col("metadata"), "volume", F.lit("named"))
    after = F.when(F.map_contains_key("metadata", "volume"), named).otherwise(scalars.map_without(F.col("metadata"), "volume"))
    said = F.concat(F.lit("region "), F.try_element_at(after, F.lit("region")), F.coalesce(F.concat(F.lit(" "), F.try_element_at(after, F.lit("volume"))), F.lit("")))
    return rows.select("internalid", F.array_join(scalars.metadata_keys(F.col("metadata")), ",").alias("keys"), said.alias("said"))


@query("SELECT n_nationkey AS servernum, trim(n_name) AS serverid, n_nationkey = 1 AS is_self FROM nation")
def peers(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "nation").select(F.col("n_nationkey").alias("servernum"), F.trim("n_name").alias("serverid"))
    return tables.peers(known)


@query("SELECT ((SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY serverid))::INT AS servernum, serverid FROM (SELECT trim(r_name) AS serverid FROM region EXCEPT SELECT trim(n_name) FROM nation)")
def new_peers(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "nation").select(F.col("n_nationkey").alias("servernum"), F.trim("n_name").alias("serverid"))
    return tables.new_peers(known, table(spark, d, "region").select(F.trim("r_name").alias("serverid")).union(known.select("serverid")))


@query(f"SELECT segment FROM {CAS} WHERE collectionid = 7")
def segment_ids(spark: SparkSession, d: str) -> DataFrame:
    return tables.segment_ids(cas(spark, d), 7)


@query("SELECT * FROM (VALUES (1, 'a1', 'file', '/stores/a'), (2, 'b2', 'object', 's3://stores/b:2')) t(storenum, storeid, kind, location)")
def configured_stores(spark: SparkSession, d: str) -> DataFrame:
    return tables.stores_from_config(spark, ["a1:file:/stores/a", "b2:object:s3://stores/b:2"])


@query("SELECT s_suppkey AS storenum, s_name AS storeid FROM supplier WHERE s_suppkey % 2 = 1")
def new_stores(spark: SparkSession, d: str) -> DataFrame:
    stores = table(spark, d, "supplier").select(F.col("s_suppkey").alias("storenum"), F.col("s_name").alias("storeid"))
    return tables.new_stores(stores, stores.filter("storenum % 2 = 0"))


@query("""SELECT s_suppkey AS storenum, CASE WHEN s_suppkey % 11 = 0 THEN 'Closed' WHEN s_suppkey % 7 = 0 THEN 'Rebuilding' WHEN s_suppkey % 5 = 0 THEN 'Starting'
WHEN s_suppkey % 3 = 0 THEN 'NeedsRebuild' WHEN s_suppkey % 4 = 0 THEN 'NeedsReloadOfNewObjects' WHEN s_suppkey % 2 = 0 THEN 'ReadOnly' ELSE 'Ready' END AS status,
s_suppkey % 11 <> 0 AND s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 4 <> 0 AS available FROM supplier""")
def store_states(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    stores = table(spark, d, "supplier").select(k.alias("storenum"), (k % 5 != 0).alias("opened"), (k % 11 == 0).alias("closed"), (k % 7 == 0).alias("rebuilding"), (k % 2 == 0).alias("read_only"), (k + 1).alias("last_on_disk"), F.when(k % 3 == 0, None).when(k % 4 == 0, k).otherwise(k + 1).alias("last_indexed"))
    rows = refs.with_status(stores)
    usable = refs.available(rows).select(F.col("storenum").alias("usable"))
    return rows.join(usable, F.col("storenum") == F.col("usable"), "left").select("storenum", "status", F.col("usable").isNotNull().alias("available"))


# Scalar functions


@query("SELECT l_orderkey, l_linenumber, l_orderkey * 1000003 // 1048576 AS block_index, l_orderkey * 1000003 % 1048576 AS block_offset, CASE WHEN l_linenumber * 1000 >= l_partkey THEN -1 ELSE least(4096, l_partkey - l_linenumber * 1000) END::BIGINT AS readable FROM lineitem")
def block_positions(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("l_orderkey").cast("long") * 1_000_003
    read = scalars.readable(F.col("l_linenumber").cast("long") * 1000, F.lit(4096).cast("long"), F.col("l_partkey").cast("long"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.block_index(at).alias("block_index"), scalars.block_offset(at).alias("block_offset"), read.alias("readable"))


@query("SELECT page_id, '/' || array_to_string(p[1:len(p) - 1], '/') AS parent, p[len(p)] AS name, array_to_string(p[2:], '/') AS rest FROM (SELECT page_id, list_filter(string_split(url, '/'), lambda x: x <> '') AS p FROM pages)")
def path_functions(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", scalars.parent_path(url).alias("parent"), scalars.leaf_name(url).alias("name"), scalars.without_leading(url, 1).alias("rest"))


@query("SELECT n_nationkey, trim(n_name) || '|' || n_regionkey || '|z' AS ids FROM nation")
def id_lists(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit(" "), F.trim("n_name"), F.lit(" ,,"), F.col("n_regionkey"), F.lit(" , z"))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(scalars.id_list(text), "|").alias("ids"))


@query("SELECT c_custkey, CASE WHEN strlen(c_mktsegment) = 9 THEN c_mktsegment END AS id FROM customer")
def valid_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", scalars.valid_id(F.col("c_mktsegment"), 9).alias("id"))


@query("SELECT doc_id, CASE WHEN strlen(text) <= 1000 THEN sha1(text) END AS sha1 FROM documents")
def limited_utf8(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha1(scalars.limited_utf8(F.col("text"), 1000)).alias("sha1"))


@query("SELECT a.doc_id, coalesce(a.text, '') = coalesce(b.text, '') AS same FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def same_contents(spark: SparkSession, d: str) -> DataFrame:
    """Whether each document's content equals that of the next, by content ids."""
    rows = table(spark, d, "documents").select("doc_id", scalars.content_id(F.coalesce("text", F.lit(""))).alias("id"))
    after = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("id").alias("next"))
    return rows.join(after, "doc_id").select("doc_id", scalars.same_content(F.col("id"), F.col("next")).alias("same"))


@query("SELECT n_nationkey, trim(n_name) AS key FROM nation")
def unreserved_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", scalars.unreserved(F.trim("n_name"), ["volume", "replication"]).alias("key"))


# Storing and releasing


@query(f"SELECT collectionid, segment, versionid, CASE WHEN versionid % 3 = 1 THEN dataid + 1 ELSE dataid END AS dataid, versionid % 3 = 0 AS final FROM (SELECT collectionid, segment, versionid, min(dataid) AS dataid FROM {CAS} GROUP BY ALL)")
def store_versioned(spark: SparkSession, d: str) -> DataFrame:
    """Versions stored again: final ones with the same content, one third of the others with another."""
    rows = cas(spark, d).groupBy("collectionid", "segment", "versionid").agg(F.min("dataid").alias("dataid"))
    key = F.concat_ws(":", "collectionid", "segment").alias("segment")
    as_stored = lambda data: rows.select(key, "versionid", data.cast("string").alias("sha1"), F.lit(1).cast("long").alias("len"), (F.col("versionid") % 3 == 0).alias("final"))
    done = content.store_versioned(as_stored(F.col("dataid")), as_stored(F.when(F.col("versionid") % 3 == 1, F.col("dataid") + 1).otherwise(F.col("dataid"))))
    part = lambda i: F.split("segment", ":")[i].cast("long")
    return done.select(part(0).alias("collectionid"), part(1).alias("segment"), "versionid", F.col("sha1").cast("long").alias("dataid"), "final")


@query(f"SELECT 'cas' AS kind, count(*) AS n, sum(dataid)::BIGINT AS total FROM {CAS} WHERE segment % 3 <> 0 UNION ALL SELECT 'data', count(DISTINCT dataid), sum(DISTINCT dataid)::BIGINT FROM {CAS} WHERE segment % 3 <> 0")
def release_segments(spark: SparkSession, d: str) -> DataFrame:
    """What is left when every third segment is released."""
    rows = cas(spark, d)
    left, data = refs.release(rows, rows.select("dataid").distinct(), rows.filter("segment % 3 = 0").select("collectionid", "segment").distinct())
    return sums(left, "cas").unionByName(sums(data, "data"))


@query(f"SELECT 'cas' AS kind, count(*) AS n, sum(dataid)::BIGINT AS total FROM {CAS} WHERE versionid % 5 <> 0 UNION ALL SELECT 'data', count(DISTINCT dataid), sum(DISTINCT dataid)::BIGINT FROM {CAS} WHERE versionid % 5 <> 0")
def release_versions(spark: SparkSession, d: str) -> DataFrame:
    rows = cas(spark, d)
    left, data = refs.release_versions(rows, rows.select("dataid").distinct(), rows.filter("versionid % 5 = 0").select("collectionid", "segment", "versionid").distinct())
    return sums(left, "cas").unionByName(sums(data, "data"))


def sums(rows: DataFrame, kind: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.sum("dataid").alias("total")).select(F.lit(kind).alias("kind"), "n", "total")


@query("""WITH c AS (SELECT n_nationkey AS internalid, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 100 END AS metadataid FROM nation),
r AS (SELECT c_nationkey AS collectionid, c_custkey % 40 AS dataid FROM customer),
l AS (SELECT * FROM r WHERE collectionid <> 4), k AS (SELECT * FROM c WHERE internalid <> 4)
SELECT (SELECT count(*) FROM k) AS n_collections, (SELECT count(*) FROM l) AS n_references,
(SELECT count(*) FROM (SELECT dataid FROM r UNION SELECT metadataid FROM c WHERE metadataid IS NOT NULL) a WHERE dataid IN (SELECT dataid FROM l UNION SELECT metadataid FROM k WHERE metadataid IS NOT NULL)) AS n_data""")
def delete_collection(spark: SparkSession, d: str) -> DataFrame:
    """A collection goes with its references, its metadata and what only it referred to."""
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("internalid"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") + 100).cast("long").alias("metadataid"))
    links = table(spark, d, "customer").select(F.col("c_nationkey").alias("collectionid"), (F.col("c_custkey") % 40).cast("long").alias("dataid"))
    data = links.select("dataid").union(rows.select("metadataid").dropna()).distinct()
    left = refs.delete_collection(rows, links, data, 4)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(left[0], "n_collections").crossJoin(count(left[1], "n_references")).crossJoin(count(left[2], "n_data"))  # one row each


@query("SELECT p_partkey AS dataid, p_size + count(l_partkey) AS usage FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_size")
def used_again(spark: SparkSession, d: str) -> DataFrame:
    data = table(spark, d, "part").select(F.col("p_partkey").alias("dataid"), F.col("p_size").alias("usage"))
    return refs.used_again(data, table(spark, d, "lineitem").select(F.col("l_partkey").alias("dataid")))


@query(f"SELECT node, sha1, n FROM (SELECT doc_id AS node, sha1(coalesce(text, '')) AS sha1, (strlen(coalesce(text, '')) + 999) // 1000 AS n FROM documents) WHERE n > 0 UNION ALL SELECT -1, sha1(coalesce(text, '')), (strlen(coalesce(text, '')) + 999) // 1000 FROM documents WHERE doc_id = 3")
def copied_file(spark: SparkSession, d: str) -> DataFrame:
    rows = blocks(spark, d)
    return hashes(rows.unionByName(content.copy_file(rows, 3, -1))).withColumnRenamed("n_blocks", "n")


# Forks


@query(f"SELECT node, sha1(unhex(CASE WHEN length(h) < 3000 THEN rpad(h, 3000, '0') ELSE substr(h, 1, 3000) END || hex('PATCH'::BLOB) || substr(h, 3011))) AS sha1, greatest((length(h) // 2 + 999) // 1000, 2) AS n_blocks FROM {BYTES}")
def fork_write(spark: SparkSession, d: str) -> DataFrame:
    """Five bytes written at 1,500, beyond the end of short forks."""
    patch = table(spark, d, "documents").select(F.col("doc_id").alias("node"), F.lit("data").alias("fork"), F.lit(1500).cast("long").alias("offset"), F.encode(F.lit("PATCH"), "UTF-8").alias("data"))
    return hashes(forks.write(blocks(spark, d), patch, 1000))


@query(f"SELECT node, sha1(unhex(h || hex('more'::BLOB))) AS sha1, (length(h) // 2 + 4 + 999) // 1000 AS n_blocks FROM {BYTES}")
def fork_append(spark: SparkSession, d: str) -> DataFrame:
    more = table(spark, d, "documents").select(F.col("doc_id").alias("node"), F.lit("data").alias("fork"), F.encode(F.lit("more"), "UTF-8").alias("data"))
    return hashes(forks.append(blocks(spark, d), more, 1000))


@query(f"SELECT node, sha1(unhex(CASE WHEN length(h) < 5000 THEN rpad(h, 5000, '0') ELSE h END)) AS sha1, greatest((length(h) // 2 + 999) // 1000, 3) AS n_blocks FROM {BYTES}")
def fork_extend(spark: SparkSession, d: str) -> DataFrame:
    longer = table(spark, d, "documents").select(F.col("doc_id").alias("node"), F.lit("data").alias("fork"), F.lit(2500).alias("length"))
    return hashes(forks.extend(blocks(spark, d), longer, 1000))


@query(f"SELECT node, sha1(unhex(CASE WHEN node = 5 THEN substr(h, 1, 300) ELSE h END)) AS sha1, (length(CASE WHEN node = 5 THEN substr(h, 1, 300) ELSE h END) // 2 + 999) // 1000 AS n_blocks FROM {BYTES} WHERE length(h) > 0")
def fork_truncate(spark: SparkSession, d: str) -> DataFrame:
    return hashes(forks.truncate(blocks(spark, d), 5, "data", 150, 1000))


@query(f"SELECT sha1(unhex(substr(h, 201, 4000))) AS sha1 FROM {BYTES} WHERE node = (SELECT min(node) FROM {BYTES} WHERE length(h) > 3000)")
def fork_read(spark: SparkSession, d: str) -> DataFrame:
    """2,000 bytes from 100 on of the first fork that is long enough."""
    rows = blocks(spark, d)
    node = rows.filter("block_index = 1 AND octet_length(content) > 500").agg(F.min("node")).first()[0]
    longer = rows.filter("block_index = 2").agg(F.min("node")).first()[0]
    read = forks.read(rows, min(x for x in (node, longer) if x is not None), "data", 100, 2000, 1000)
    return read.agg(F.sha1(F.expr("listagg(data) WITHIN GROUP (ORDER BY block_index)")).alias("sha1"))


@query("SELECT node, string_agg(fork, ',' ORDER BY fork) AS forks, sum(n)::BIGINT AS n_blocks FROM (SELECT conv_id AS node, coalesce(role, '') AS fork, count(*) AS n FROM conversations WHERE coalesce(role, '') <> 'system' GROUP BY 1, 2 UNION ALL SELECT conv_id, 'resource', 0 FROM conversations GROUP BY 1) GROUP BY 1")
def fork_names(spark: SparkSession, d: str) -> DataFrame:
    """A role's turns are a fork: `system` is dropped, an empty `resource` is made."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("node"), F.coalesce("role", F.lit("")).alias("fork"), F.col("turn").cast("long").alias("block_index"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    have = turns.select("node", "fork").distinct()
    have, left = forks.dropped(have, turns, have.filter("fork = 'system'"))
    have = forks.got(have, have.select("node", F.lit("resource").alias("fork")).distinct().unionByName(turns.select("node", F.lit("resource").alias("fork")).distinct()))
    counts = left.groupBy("node", "fork").agg(F.count("*").alias("n"))
    return have.join(counts, ["node", "fork"], "left").groupBy("node").agg(F.array_join(F.array_sort(F.collect_list("fork")), ",").alias("forks"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_blocks"))


@query("SELECT conv_id AS node, sha1(string_agg(CASE WHEN coalesce(role, '') = 'user' THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END, '' ORDER BY turn)) AS sha1, count(*) AS n_blocks FROM conversations GROUP BY 1, coalesce(role, '')")
def fork_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Forks of users' turns replaced by ones with a mark at their end."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("node"), F.coalesce("role", F.lit("")).alias("fork"), F.col("turn").cast("long").alias("block_index"), F.coalesce("text", F.lit("")).alias("content"))
    new = turns.filter("fork = 'user'").withColumn("content", F.concat("content", F.lit("!")))
    return hashes(forks.replaced(turns.select("node", "fork").distinct(), turns, new.select("node", "fork").distinct(), new)[1])


# Tree


@query(f"SELECT parent, name, child FROM {EDGES} UNION ALL SELECT 'n' || n_nationkey, 'new', 'f' || n_nationkey FROM nation")
def created_files(spark: SparkSession, d: str) -> DataFrame:
    """A file in each nation, asked for twice: the second time those there stay."""
    edges = catalog.edges(spark, d)
    new = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("parent"), F.lit("new").alias("name"), F.concat(F.lit("f"), F.col("n_nationkey")).alias("child"))
    return tree.created(tree.created(edges, new), new.withColumn("child", F.lit("other")), exclusive=False)


@query(f"SELECT parent, name, CASE WHEN parent LIKE 'r%' THEN 'link' ELSE child END AS child FROM {EDGES}")
def replaced_links(spark: SparkSession, d: str) -> DataFrame:
    edges = catalog.edges(spark, d)
    return tree.replaced(edges, edges.filter("parent LIKE 'r%'").withColumn("child", F.lit("link")))


@query(f"SELECT parent, name, child FROM {EDGES} UNION ALL SELECT '/', 'to ' || c_custkey, 'c' || c_custkey FROM customer WHERE c_nationkey = 3")
def linked_files(spark: SparkSession, d: str) -> DataFrame:
    edges = catalog.edges(spark, d)
    links = table(spark, d, "customer").filter("c_nationkey = 3").select(F.lit("/").alias("parent"), F.concat(F.lit("to "), F.col("c_custkey")).alias("name"), F.concat(F.lit("c"), F.col("c_custkey")).alias("child"))
    return tree.linked(edges, links, edges.select(F.col("parent").alias("node")).distinct())


@query("SELECT c.c_custkey FROM customer c WHERE c_nationkey <> 5")
def deleted_paths(spark: SparkSession, d: str) -> DataFrame:
    """The files left when those of a nation are deleted by their paths."""
    region, nation, customer = (table(spark, d, n) for n in ("region", "nation", "customer"))
    there = customer.filter("c_nationkey = 5").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    paths = there.select(F.concat_ws("/", F.lit(""), F.trim("r_name"), F.trim("n_name"), F.trim("c_name")).alias("path"))
    left = tree.deleted_paths(catalog.edges(spark, d), paths.unionByName(spark.createDataFrame([("/no/such",)], "path string")))
    return left.filter("child LIKE 'c%'").select(F.expr("cast(substr(child, 2) AS bigint)").alias("c_custkey"))


# Snapshots, replication and commits


@query("SELECT trim(r_name) AS name, r_regionkey::BIGINT AS versiontime FROM region WHERE r_regionkey <> 2")
def snapshots_left(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots of a volume, in order, without a released one."""
    have = table(spark, d, "region").select(F.lit(1).alias("volume"), F.trim("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("versiontime"), F.lit(0).alias("uniquifier"))
    gone = have.filter("versiontime = 2").first()["name"]
    return versions.list_snapshots(versions.release_snapshot(have, 1, gone), 1).select("name", "versiontime")


@query("WITH e AS (SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('signup', 'error')), l AS (SELECT user_id, arg_max(event_type, event_id) AS last FROM e GROUP BY 1) SELECT user_id AS collectionid, 'peer' AS server FROM l WHERE last = 'signup' AND user_id % 4 <> 0")
def new_collections(spark: SparkSession, d: str) -> DataFrame:
    """Users whose last server event is their creation, but for those the target knows."""
    log = catalog.events(spark, d).filter("source_type IN ('signup', 'error')").select("eventid", "collectionid", F.when(F.col("source_type") == "signup", "C").otherwise("D").alias("eventtype"))
    rows = catalog.events(spark, d).select("collectionid").distinct().withColumn("metadata", F.create_map(F.lit("a"), F.lit("b")))
    new = replicate.new_collections(log, rows, rows.filter("collectionid % 4 = 0"), "peer")
    return new.select("collectionid", F.col("metadata")["replication-server"].alias("server"))


@query(f"SELECT collectionid, segment, versionid AS segmentversion, dataid::VARCHAR AS sha1 FROM {CAS} WHERE (collectionid, segment, versionid) IN (SELECT l_suppkey, l_partkey, l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def created_segments(spark: SparkSession, d: str) -> DataFrame:
    """Lines of flag R are events that made a segment; each is read at its version."""
    made = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("collectionid"), F.col("l_partkey").alias("segment"), F.col("l_orderkey").alias("segmentversion"), F.when(F.col("l_returnflag") == "R", "C").otherwise("M").alias("eventtype"))
    rows = cas(spark, d).select("collectionid", "segment", F.col("versionid").alias("segmentversion"), F.col("dataid").cast("string").alias("sha1"), F.lit(1).alias("len"))
    data = rows.select("sha1", "len").distinct().withColumn("content", F.lit("x"))
    return replicate.created_segments(made, rows, data).drop("len", "content")


def stored(spark: SparkSession, d: str) -> Dataset:
    """Documents committed in two batches: those of `en`, then the others."""
    data = Dataset(spark, catalog.shared_path(spark, "dataset"), edits.KEYS)
    rows = catalog.contents(spark, d).select(F.col("collection").alias("collectionid"), "segment", F.lit(1).alias("segmentversion"), "sha1", "len", "content").dropna(subset=["collectionid"])
    for time, part in enumerate((rows.filter("collectionid = 'en'"), rows.filter("collectionid != 'en'"))):
        tx = data.begin(1000 + time)
        tx.append("collections", part.select("collectionid").distinct().withColumn("metadata", F.create_map(F.lit("volume"), F.col("collectionid"))))
        edits.store(tx, part)
        tx.commit()
    return data


@query("WITH d AS (SELECT lang, doc_id, coalesce(text, '') AS t FROM documents WHERE lang IS NOT NULL) SELECT 'all' AS state, (SELECT count(*) FROM d) AS n_references, (SELECT count(DISTINCT t) FROM d) AS n_contents UNION ALL SELECT 'first', (SELECT count(*) FROM d WHERE lang = 'en'), (SELECT count(DISTINCT t) FROM d WHERE lang = 'en') UNION ALL SELECT 'released', (SELECT count(*) FROM d WHERE doc_id % 3 <> 0), (SELECT count(DISTINCT t) FROM d WHERE doc_id % 3 <> 0) UNION ALL SELECT 'deleted', (SELECT count(*) FROM d WHERE doc_id % 3 <> 0 AND lang <> 'en'), (SELECT count(DISTINCT t) FROM d WHERE doc_id % 3 <> 0 AND lang <> 'en')")
def dataset_states(spark: SparkSession, d: str) -> DataFrame:
    """References and contents of a dataset after its commits: at its first version, with all stored,
    after a third of the segments was released, after a collection was deleted."""
    data, seen = stored(spark, d), []

    def look(state: str, upto: int | None = None) -> None:
        counted = [data.table(t, upto).agg(F.count("*").alias(n)) for t, n in (("cas", "n_references"), ("data", "n_contents"))]
        seen.append(counted[0].crossJoin(counted[1]).select(F.lit(state).alias("state"), "n_references", "n_contents"))  # one row each

    look("first", 1)
    look("all", 2)
    tx = data.begin(2000)
    edits.release(tx, data.table("cas").filter("segment % 3 = 0").select("collectionid", "segment").distinct())
    tx.commit()
    look("released", 3)
    tx = data.begin(3000)
    edits.delete_collection(tx, spark.createDataFrame([("en",)], "collectionid string"))
    tx.commit()
    look("deleted")
    return seen[0].unionByName(seen[1]).unionByName(seen[2]).unionByName(seen[3])


@query(f"SELECT parent, name, child FROM {EDGES} WHERE NOT (parent = 'r1' AND name = 'CANADA') UNION ALL SELECT 'r2', 'MOVED', child FROM {EDGES} WHERE parent = 'r1' AND name = 'CANADA'")
def dataset_move(spark: SparkSession, d: str) -> DataFrame:
    """A directory moved by a transaction; another one that also moved it was rolled back."""
    data = Dataset(spark, catalog.shared_path(spark, "dataset"), edits.KEYS)
    tx = data.begin(1000)
    tx.append("edges", catalog.edges(spark, d))
    tx.commit()
    lost = data.begin(2000)
    edits.move(lost, "r1", "CANADA", "r3", "LOST")
    lost.rollback()
    tx = data.begin(2000)
    edits.move(tx, "r1", "CANADA", "r2", "MOVED")
    tx.commit(snapshot="moved")
    return data.table("edges")


@query("SELECT lang AS collectionid, 'copy of ' || lang AS volume, count(*) AS n_references, count(DISTINCT coalesce(text, '')) AS n_contents FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def dataset_replicated(spark: SparkSession, d: str) -> DataFrame:
    """A dataset's transactions applied to another one, twice; then its metadata changes."""
    source = stored(spark, d)
    target = Dataset(spark, catalog.shared_path(spark, "dataset"), edits.KEYS)
    made = source.table("cas").select("collectionid", F.col("segment").cast("long").alias("eventid"), F.lit(0).cast("long").alias("transactionid"), F.lit("C").alias("eventtype"), "segment", "segmentversion")
    ends = made.groupBy("collectionid").agg((F.max("eventid") + 1).alias("eventid")).select("collectionid", "eventid", F.lit(0).cast("long").alias("transactionid"), F.lit("T").alias("eventtype"), F.lit(None).cast(made.schema["segment"].dataType).alias("segment"), F.lit(None).cast("int").alias("segmentversion"))
    tx = source.begin(2000)
    tx.append("events", made.unionByName(ends))
    tx.commit()
    replicate.apply_transactions(source, target, 1, 3000)
    replicate.apply_transactions(source, target, 1, 3000)
    langs = ends.select("collectionid", "eventid")
    tx = source.begin(4000)
    tx.replace("collections", source.table("collections").withColumn("metadata", F.create_map(F.lit("volume"), F.concat(F.lit("copy of "), F.col("collectionid")))))
    none = [F.lit(None).cast(made.schema["segment"].dataType).alias("segment"), F.lit(None).cast("int").alias("segmentversion")]
    event = lambda letter, k: langs.select("collectionid", (F.col("eventid") + k).alias("eventid"), F.lit(1).cast("long").alias("transactionid"), F.lit(letter).alias("eventtype"), *none)
    tx.append("events", event("M", 1).unionByName(event("T", 2)))
    tx.commit()
    replicate.apply_transactions(source, target, 1, 5000)
    rows = target.table("cas").join(target.table("data").select("sha1", "len"), ["sha1", "len"])
    counts = rows.groupBy("collectionid").agg(F.count("*").alias("n_references"), F.countDistinct("sha1", "len").alias("n_contents"))
    return counts.join(target.table("collections"), "collectionid").select("collectionid", F.col("metadata")["volume"].alias("volume"), "n_references", "n_contents")
