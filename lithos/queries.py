"""The registered queries of the engine's own operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos import catalog, edit_queries  # noqa: F401  (the latter registers its own)
from lithos.functions import scalars
from lithos.operators import content, events, forks, refs, tree, versions
from lithos.registry import oracle_sql, queries, query  # noqa: F401
from lithos.sources import tables
from lithos.sources.tables import table
from lithos.streaming import replicate

CONTENTS = "(SELECT lang AS collection, doc_id AS segment, sha1(coalesce(text, '')) AS sha1, strlen(coalesce(text, ''))::BIGINT AS len, coalesce(text, '') AS content FROM documents)"
VERSIONS = "(SELECT o_custkey AS segment, o_orderkey AS versionid, epoch_us(o_orderdate) AS versiontime, (row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) - 1)::INT AS uniquifier, o_totalprice AS payload FROM orders)"
LOG = "(SELECT event_id AS eventid, user_id AS collectionid, CASE event_type WHEN 'purchase' THEN 'T' WHEN 'signup' THEN 'C' WHEN 'error' THEN 'R' ELSE 'M' END AS eventtype, epoch_us(ts) AS timestamp, event_id // 10 AS transactionid, event_type AS source_type, value, props FROM events)"
EDGES = "(SELECT '/' AS parent, trim(r_name) AS name, 'r' || r_regionkey AS child FROM region UNION ALL SELECT 'r' || n_regionkey, trim(n_name), 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || c_nationkey, trim(c_name), 'c' || c_custkey FROM customer)"
#: 1997-01-01 and 1998-01-01 in µs.
T97, T98 = 852076800000000, 883612800000000
E_MID = 5000


# Content


@query(f"SELECT segment, sha1, len FROM {CONTENTS}")
def content_id(spark: SparkSession, d: str) -> DataFrame:
    return catalog.contents(spark, d).select("segment", scalars.content_id(F.col("content")).alias("c")).select("segment", "c.sha1", "c.len")


@query(f"SELECT sum(n)::BIGINT AS n_segments, count(*) AS n_contents, sum(n * len)::BIGINT AS bytes_total, sum(len)::BIGINT AS bytes_stored FROM (SELECT sha1, len, count(*) AS n FROM {CONTENTS} GROUP BY ALL)")
def dedup_ratio(spark: SparkSession, d: str) -> DataFrame:
    return content.dedup_summary(catalog.contents(spark, d))


@query(f"SELECT sha1, len, min(segment) AS first_segment, count(*) AS n_refs FROM {CONTENTS} GROUP BY ALL HAVING count(*) > 1")
def dedup_groups(spark: SparkSession, d: str) -> DataFrame:
    return content.dedup_groups(catalog.contents(spark, d))


@query(f"SELECT collection, segment, CASE WHEN segment = min(segment) OVER (PARTITION BY collection, sha1, len) THEN 'created' ELSE 'exists' END AS status FROM {CONTENTS}")
def store_status(spark: SparkSession, d: str) -> DataFrame:
    return content.store_status(catalog.contents(spark, d))


@query(f"SELECT sha1, len FROM {CONTENTS} WHERE collection = 'en' EXCEPT SELECT sha1, len FROM {CONTENTS} WHERE collection <> 'en'")
def find_or_store(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.contents(spark, d).select("collection", "sha1", "len")
    return content.find_or_store(rows.filter("collection = 'en'"), rows.filter("collection != 'en'")).select("sha1", "len")


@query(f"SELECT DISTINCT a.sha1, a.len, EXISTS (SELECT 1 FROM {CONTENTS} b WHERE b.collection <> 'en' AND b.sha1 = a.sha1 AND b.len = a.len) AS existed FROM {CONTENTS} a WHERE a.collection = 'en'")
def find_or_store_status(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.contents(spark, d).select("collection", "sha1", "len")
    return content.find_or_store_status(rows.filter("collection = 'en'"), rows.filter("collection != 'en'"))


@query(f"SELECT collection, segment, sha1, len FROM {CONTENTS} a WHERE EXISTS (SELECT 1 FROM {CONTENTS} b WHERE b.collection = 'de' AND b.sha1 = a.sha1 AND b.len = a.len)")
def content_references(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.contents(spark, d).select("collection", "segment", "sha1", "len")
    return content.references(rows, rows.filter("collection = 'de'"))


@query(f"SELECT collection, segment, sha1(content) = sha1 AND strlen(content) = len AS ok FROM {CONTENTS}")
def verify_segments(spark: SparkSession, d: str) -> DataFrame:
    return content.verify(catalog.contents(spark, d))


@query(f"SELECT segment, collection, sha1, len, false AS repaired FROM {CONTENTS} WHERE segment % 2 = 0 UNION ALL SELECT segment, collection, sha1, len, len > 0 AS repaired FROM {CONTENTS} WHERE segment % 2 = 1")
def repair_segments(spark: SparkSession, d: str) -> DataFrame:
    """Odd segments are damaged and repaired from the master; the result's own hash is returned."""
    master = catalog.contents(spark, d)
    local = master.withColumn("content", F.when((F.col("segment") % 2 == 1) & (F.col("len") > 0), F.concat("content", F.lit("?"))).otherwise(F.col("content")))
    done = content.repair(local, master)
    return done.select("segment", "collection", F.sha1("content").alias("sha1"), F.octet_length("content").cast("long").alias("len"), "repaired")


@query(f"SELECT segment, i::BIGINT AS block_index, substr(content, (i * 1024 + 1)::INT, 1024) AS chunk FROM {CONTENTS}, unnest(range(0, (length(content) + 1023) // 1024)) t(i)")
def char_chunks(spark: SparkSession, d: str) -> DataFrame:
    return content.chunk(catalog.contents(spark, d), 1024)


@query("SELECT conv_id AS node, sha1(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS sha1, count(*) AS n_blocks FROM conversations GROUP BY 1")
def reassemble(spark: SparkSession, d: str) -> DataFrame:
    return content.reassemble(catalog.fork_blocks(spark, d), "node").select("node", F.sha1("content").alias("sha1"), "n_blocks")


@query("SELECT conv_id AS node, sum(strlen(coalesce(text, '')))::BIGINT AS length FROM conversations GROUP BY 1")
def total_length(spark: SparkSession, d: str) -> DataFrame:
    return forks.total_length(catalog.fork_blocks(spark, d))


@query(f"SELECT collection, count(*) AS n_segments, sum((len // 65536 + 1) * 65536)::BIGINT AS bytes_used FROM {CONTENTS} GROUP BY 1")
def store_space(spark: SparkSession, d: str) -> DataFrame:
    return refs.space(catalog.contents(spark, d), "collection", "len")


@query("SELECT doc_id, substr(d, 1, 3) || '/' || substr(d, 4, 3) || '/' || substr(d, 7, 3) || '.casseg' AS path, doc_id AS serial FROM (SELECT doc_id, lpad(doc_id::VARCHAR, 9, '0') AS d FROM documents)")
def serial_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", scalars.serial_path(F.col("doc_id")).alias("path"))
    return rows.withColumn("serial", scalars.serial_number(F.col("path")))


@query("""SELECT doc_id, CASE WHEN n >= 1000000000000 THEN substr(d, 1, 3) || '/' ELSE '' END || CASE WHEN n >= 1000000000 THEN substr(d, 4, 3) || '/' ELSE '' END || substr(d, 7, 3) || '/' || substr(d, 10, 3) || '/' || substr(d, 13, 3) || '.casseg' AS path, n AS serial
FROM (SELECT doc_id, n, lpad(n::VARCHAR, 15, '0') AS d FROM (SELECT doc_id, doc_id::BIGINT * 123456789012 // CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 1000000000 END AS n FROM (SELECT doc_id FROM documents)) t)""")
def serial_paths_wide(spark: SparkSession, d: str) -> DataFrame:
    """Serial numbers of all lengths. The SQL's paths hold fifteen digits, so from document 8104 on, where the
    numbers have sixteen, it cuts them and the two differ (README, REPLY_r02.md)."""
    parts = F.when(F.col("doc_id") % 4 == 0, 1).when(F.col("doc_id") % 4 == 1, 1000).when(F.col("doc_id") % 4 == 2, 1_000_000).otherwise(1_000_000_000)
    rows = table(spark, d, "documents").select("doc_id", F.expr("doc_id * 123456789012L").alias("n"), parts.cast("long").alias("by"))
    rows = rows.select("doc_id", F.expr("n div by").alias("n"))
    return rows.select("doc_id", scalars.serial_path(F.col("n")).alias("path")).withColumn("serial", scalars.serial_number(F.col("path")))


@query(f"SELECT segment AS node, sha1, (len + 999) // 1000 AS n_blocks FROM {CONTENTS} WHERE len > 0")
def reassemble_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of 1,000 bytes, which cut characters apart, put together again."""
    rows = catalog.contents(spark, d).withColumn("content", F.encode("content", "UTF-8"))
    blocks = content.chunk(rows, 1000).withColumnsRenamed({"segment": "node", "chunk": "content"})
    return content.reassemble(blocks).select("node", F.sha1("content").alias("sha1"), "n_blocks")


# Versions


@query(f"SELECT segment, {T98}::BIGINT AS at_time, 0 AS at_uniquifier, versiontime, uniquifier, versionid, payload FROM {VERSIONS} WHERE versiontime < {T98} OR versiontime = {T98} AND uniquifier <= 0 QUALIFY row_number() OVER (PARTITION BY segment ORDER BY versiontime DESC, uniquifier DESC) = 1")
def asof_nearest_lex(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.order_versions(spark, d)
    targets = table(spark, d, "customer").select(F.col("c_custkey").alias("segment"), F.lit(T98).cast("long").alias("at_time"), F.lit(0).alias("at_uniquifier"))
    return versions.nearest(rows, targets)


@query(f"SELECT segment, {T98}::BIGINT AS at_time, 1 AS at_uniquifier, versiontime, u AS uniquifier, versionid, payload FROM (SELECT *, (versionid % 3)::INT AS u FROM {VERSIONS}) WHERE versiontime <= {T98} AND u <= 1 QUALIFY row_number() OVER (PARTITION BY segment ORDER BY versiontime DESC, u DESC, versionid DESC) = 1")
def asof_nearest_component(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.order_versions(spark, d).withColumn("uniquifier", (F.col("versionid") % 3).cast("int"))
    targets = table(spark, d, "customer").select(F.col("c_custkey").alias("segment"), F.lit(T98).cast("long").alias("at_time"), F.lit(1).alias("at_uniquifier"))
    return versions.nearest(rows, targets, mode="component")


@query(f"SELECT segment, versiontime, uniquifier, versionid, payload FROM {VERSIONS}")
def exact_version(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.order_versions(spark, d)
    targets = rows.select("segment", "versiontime", "uniquifier")
    named, data = rows.select("versionid", "versiontime", "uniquifier"), rows.select(F.col("versionid").alias("dataid"), "payload")
    found = versions.exact(rows.select("segment", "versionid", F.col("versionid").alias("dataid")), named, data, targets)
    return found.select("segment", "versiontime", "uniquifier", "versionid", "payload")


@query(f"WITH v AS (SELECT * FROM {VERSIONS}), t AS (SELECT segment, versiontime - 1 AS at_time FROM v) SELECT t.segment, at_time, 1 AS at_uniquifier, v.versiontime, v.uniquifier, v.versionid, v.payload FROM (SELECT DISTINCT segment, at_time FROM t) t ASOF JOIN (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY segment, versiontime ORDER BY uniquifier DESC) = 1) v ON v.segment = t.segment AND t.at_time >= v.versiontime")
def asof_before_each(spark: SparkSession, d: str) -> DataFrame:
    """For each version the one its segment had just before: as many moments as versions."""
    rows = catalog.order_versions(spark, d)
    targets = rows.select("segment", (F.col("versiontime") - 1).alias("at_time"), F.lit(1).alias("at_uniquifier")).distinct()
    return versions.nearest_each(rows, targets)


@query(f"SELECT segment, max(versiontime) AS last_modified FROM {VERSIONS} GROUP BY 1")
def last_modified(spark: SparkSession, d: str) -> DataFrame:
    return versions.last_modified(catalog.order_versions(spark, d))


@query(f"SELECT segment, versiontime, uniquifier, versionid, payload FROM {VERSIONS} WHERE versiontime < {T97} OR versiontime = {T97} AND uniquifier <= 0 QUALIFY row_number() OVER (PARTITION BY segment ORDER BY versiontime DESC, uniquifier DESC) = 1")
def default_version(spark: SparkSession, d: str) -> DataFrame:
    return versions.as_of(catalog.order_versions(spark, d), (T97, 0))


@query(f"SELECT segment, versionid, versiontime, uniquifier, (row_number() OVER (PARTITION BY segment ORDER BY versiontime, uniquifier))::INT AS ordinal FROM {VERSIONS}")
def version_history(spark: SparkSession, d: str) -> DataFrame:
    return versions.history(catalog.order_versions(spark, d).drop("payload"))


@query(f"SELECT segment, versionid, versiontime, uniquifier FROM {VERSIONS} WHERE versiontime >= {T97} AND (versiontime < {T98} OR versiontime = {T98} AND uniquifier <= 0)")
def version_range(spark: SparkSession, d: str) -> DataFrame:
    return versions.in_range(catalog.order_versions(spark, d), (T97, 0), (T98, 0)).drop("payload")


@query(f"SELECT segment, versiontime, uniquifier, versionid, payload FROM {VERSIONS} QUALIFY row_number() OVER (PARTITION BY segment ORDER BY versiontime DESC, uniquifier DESC) = 1")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    return versions.latest(catalog.order_versions(spark, d))


@query("SELECT o_orderkey AS versionid, epoch_us(o_orderdate) // 1000 AS millis, (row_number() OVER (PARTITION BY epoch_us(o_orderdate) // 1000 ORDER BY o_orderkey) - 1)::INT AS uniquifier FROM orders")
def commit_uniquifier(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("versionid"), F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000).cast("long").alias("millis"))
    return versions.stamped(rows)


@query("SELECT o_orderkey AS versionid, strftime(o_orderdate, '%Y-%m-%d@%H:%M:%S.%g') || '-' || (o_orderkey % 3)::VARCHAR AS name FROM orders")
def snapshot_name(spark: SparkSession, d: str) -> DataFrame:
    millis = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000).cast("long")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("versionid"), scalars.snapshot_name(millis, F.col("o_orderkey") % 3).alias("name"))


@query(f"""WITH v AS (SELECT * FROM {VERSIONS}),
a AS (SELECT segment, versionid AS state FROM v WHERE versiontime <= {T97} QUALIFY row_number() OVER (PARTITION BY segment ORDER BY versiontime DESC, uniquifier DESC) = 1),
b AS (SELECT segment, versionid AS state FROM v WHERE versiontime <= {T98} QUALIFY row_number() OVER (PARTITION BY segment ORDER BY versiontime DESC, uniquifier DESC) = 1)
SELECT segment, CASE WHEN a.state IS NULL THEN 'added' WHEN b.state IS NULL THEN 'deleted' ELSE 'modified' END AS change, a.state AS before, b.state AS after
FROM a FULL JOIN b USING (segment) WHERE a.state IS DISTINCT FROM b.state""")
def state_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.order_versions(spark, d)
    at = lambda t: versions.latest(rows.filter(F.col("versiontime") <= t)).select("segment", F.col("versionid").alias("state"))
    return versions.changes(at(T97), at(T98), ["segment"], "state")


# Events


@query(f"SELECT eventid, collectionid, timestamp, transactionid FROM {LOG} WHERE eventtype = 'T' AND eventid >= {E_MID} ORDER BY eventid LIMIT 50")
def event_page_after_id(spark: SparkSession, d: str) -> DataFrame:
    return events.after_id(catalog.events(spark, d), None, E_MID, 50).select("eventid", "collectionid", "timestamp", "transactionid")


@query(f"SELECT eventid, collectionid, timestamp, transactionid FROM {LOG} WHERE eventtype = 'T' AND timestamp > 1704153600000000 ORDER BY timestamp, eventid LIMIT 50")
def event_page_after_time(spark: SparkSession, d: str) -> DataFrame:
    return events.after_time(catalog.events(spark, d), 1704153600000000, 50).select("eventid", "collectionid", "timestamp", "transactionid")


@query(f"SELECT eventid, eventtype, timestamp FROM {LOG} WHERE transactionid = 42 AND eventid >= 422 ORDER BY eventid LIMIT 1000")
def event_transaction_page(spark: SparkSession, d: str) -> DataFrame:
    return events.of_transaction(catalog.events(spark, d), 42, 422).select("eventid", "eventtype", "timestamp")


@query(f"SELECT eventid, collectionid, (SELECT count(*) FROM {LOG} WHERE eventid >= {E_MID}) > 100 AS has_more FROM {LOG} WHERE eventid >= {E_MID} ORDER BY eventid LIMIT 100")
def event_keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return events.keyset_page(catalog.events(spark, d).select("eventid", "collectionid"), E_MID, 100)


@query(f"SELECT collectionid, coalesce(max(eventid), -1)::BIGINT AS last_id, count(*) AS n_events FROM {LOG} WHERE eventtype = 'T' GROUP BY 1")
def last_event_guarded(spark: SparkSession, d: str) -> DataFrame:
    return events.last_or(catalog.events(spark, d).filter("eventtype = 'T'"), ["collectionid"])


@query(f"SELECT coalesce(max(eventid), -1)::BIGINT AS last_id, count(*) AS n_events FROM {LOG} WHERE eventtype = 'X'")
def last_event_empty(spark: SparkSession, d: str) -> DataFrame:
    return events.last_or(catalog.events(spark, d).filter("eventtype = 'X'"), [])


@query(f"SELECT coalesce(max(transactionid) + 1, 0)::BIGINT AS next_transaction FROM {LOG}")
def next_transaction(spark: SparkSession, d: str) -> DataFrame:
    return events.next_transaction(catalog.events(spark, d))


@query(f"SELECT collectionid, eventid, eventtype, timestamp FROM {LOG} QUALIFY row_number() OVER (PARTITION BY collectionid ORDER BY eventid DESC) = 1")
def last_event_per_collection(spark: SparkSession, d: str) -> DataFrame:
    return events.last_per_collection(catalog.events(spark, d).select("collectionid", "eventid", "eventtype", "timestamp"))


@query(f"SELECT collectionid, eventid, eventtype FROM {LOG} WHERE eventid = (SELECT max(eventid) FROM {LOG} WHERE collectionid = 7)")
def last_event_uncorrelated(spark: SparkSession, d: str) -> DataFrame:
    return events.last_uncorrelated(catalog.events(spark, d).select("collectionid", "eventid", "eventtype"), 7)


@query(f"SELECT transactionid, eventtype, min(eventid) AS eventid, arg_min(collectionid, eventid) AS collectionid FROM {LOG} GROUP BY 1, 2")
def transaction_event_dedup(spark: SparkSession, d: str) -> DataFrame:
    log = catalog.events(spark, d).select("transactionid", "eventtype", "eventid", "collectionid")
    return events.once_per_transaction(log, ["transactionid", "eventtype"])


@query(f"SELECT eventid, CASE substr(trim(upper(source_type)), 1, 1) WHEN 'C' THEN 'segment_created' WHEN 'T' THEN 'transaction_committed' WHEN 'R' THEN 'segment_released' WHEN 'M' THEN 'metadata_modified' END AS kind FROM {LOG} WHERE substr(trim(upper(source_type)), 1, 1) IN ('C', 'T', 'R', 'M')")
def event_kind_decode(spark: SparkSession, d: str) -> DataFrame:
    log = catalog.events(spark, d).withColumn("eventtype", F.concat(F.lit(" "), F.upper("source_type")))
    return catalog.event_kinds(log).select("eventid", "kind")


@query(f"SELECT eventid, collectionid, row_number() OVER (PARTITION BY collectionid ORDER BY timestamp, eventid) - 1 AS collection_eventid FROM {LOG}")
def event_numbering(spark: SparkSession, d: str) -> DataFrame:
    return events.numbered(catalog.events(spark, d).select("eventid", "collectionid", "timestamp"), ["timestamp", "eventid"]).drop("timestamp")


@query(f"SELECT transactionid, max(eventid) FILTER (eventtype = 'T') AS eventid, count(*) FILTER (eventtype = 'C') AS n_created, count(*) FILTER (eventtype = 'R') AS n_released, count(*) FILTER (eventtype = 'M') AS n_metadata FROM {LOG} GROUP BY 1 HAVING count(*) FILTER (eventtype = 'T') > 0")
def transaction_details(spark: SparkSession, d: str) -> DataFrame:
    return events.with_details(catalog.events(spark, d))


@query("SELECT event_id AS eventid, json_extract_string(props, '$.k') AS k FROM events")
def metadata_projection(spark: SparkSession, d: str) -> DataFrame:
    return catalog.events(spark, d).select("eventid", F.get_json_object("props", "$.k").alias("k"))


@query(f"SELECT eventid, collectionid, eventtype FROM {LOG} WHERE eventid > (SELECT max(eventid) FROM {LOG} WHERE eventid % 3 = 0 AND eventid < {E_MID}) OR eventid < {E_MID} AND eventid % 3 <> 0")
def replicate_batch(spark: SparkSession, d: str) -> DataFrame:
    log = catalog.events(spark, d).select("eventid", "collectionid", "eventtype")
    return replicate.pending(log, log.filter((F.col("eventid") % 3 == 0) & (F.col("eventid") < E_MID)), ["eventid"])


@query(f"SELECT l.eventid, l.collectionid, l.eventtype FROM {LOG} l LEFT JOIN (SELECT collectionid, max(eventid) AS last FROM {LOG} WHERE eventid < {E_MID} GROUP BY 1) t USING (collectionid) WHERE l.eventid > coalesce(t.last, -1) AND l.eventtype <> 'R'")
def replicate_after_cursor(spark: SparkSession, d: str) -> DataFrame:
    log = catalog.events(spark, d).select("eventid", "collectionid", "eventtype")
    return replicate.applied(replicate.after_cursor(log, log.filter(F.col("eventid") < E_MID)))


# References


@query("SELECT p_partkey, count(l_partkey) AS n_refs FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def refcounts(spark: SparkSession, d: str) -> DataFrame:
    return refs.counts(table(spark, d, "part"), table(spark, d, "lineitem").select("l_partkey"), "p_partkey", "l_partkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    return refs.orphans(table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select("l_orderkey"), "o_orderkey", "l_orderkey")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'N')")
def release_frees(spark: SparkSession, d: str) -> DataFrame:
    """Orders that no line refers to once those of flag N are released."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    gone = lines.filter("l_returnflag = 'N'")
    return refs.freed(table(spark, d, "orders").select("o_orderkey"), lines, gone, "o_orderkey", "l_orderkey")


@query("SELECT o_orderkey AS segment, l.k IS NOT NULL AS released FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') l ON l.k = o_orderkey")
def release_flags(spark: SparkSession, d: str) -> DataFrame:
    there = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.lit(1).alias("collectionid"), F.col("l_orderkey").alias("segment"))
    asked = table(spark, d, "orders").select(F.lit(1).alias("collectionid"), F.col("o_orderkey").alias("segment"))
    return refs.release_flags(there, asked).select("segment", "released")


@query("SELECT coalesce(o.o_orderkey, l.k) AS id, coalesce(l.n, 0)::BIGINT AS n_files, CASE WHEN l.n IS NULL THEN 'drop_index' WHEN o.o_orderkey IS NULL THEN 'index_file' WHEN l.n > 1 THEN 'remove_duplicate' ELSE 'ok' END AS action FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0) o FULL JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) l ON l.k = o.o_orderkey")
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    disk = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"))
    index = table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).filter("id % 5 != 0")
    return refs.reconcile(disk, index, "id")


@query("SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey > 100 AND l_orderkey <= 1000 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)")
def range_reload(spark: SparkSession, d: str) -> DataFrame:
    disk = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    return refs.to_reload(disk, table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).filter("id % 2 = 0"), "id", 100, 1000)


@query("SELECT (SELECT max(o_orderkey) FROM orders) AS last_on_disk, (SELECT max(l_orderkey) FROM lineitem WHERE l_orderkey % 2 = 0) AS last_indexed, (SELECT max(o_orderkey) FROM orders) > (SELECT max(l_orderkey) FROM lineitem WHERE l_orderkey % 2 = 0) AS needs_reload")
def needs_reload(spark: SparkSession, d: str) -> DataFrame:
    return refs.needs_reload(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).filter("id % 2 = 0"), "id")


@query("SELECT min(o_orderkey) AS first_id, max(o_orderkey) AS last_id, count(*) AS n FROM orders")
def id_bounds(spark: SparkSession, d: str) -> DataFrame:
    return tables.id_bounds(table(spark, d, "orders"), "o_orderkey")


# Tree


@query("SELECT page_id, depth, name FROM (SELECT page_id, i AS depth, parts[i] AS name FROM (SELECT page_id, list_filter(string_split(url, '/'), lambda x: x <> '') AS parts FROM pages), unnest(range(1, len(parts) + 1)) t(i))")
def path_components(spark: SparkSession, d: str) -> DataFrame:
    return tree.components(table(spark, d, "pages"), "page_id", "url")


@query("SELECT '/' || trim(r_name) || '/' || trim(n_name) AS path, 'n' || n_nationkey AS child FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT '/' || trim(r_name) || '/nowhere', NULL FROM region")
def resolve_paths(spark: SparkSession, d: str) -> DataFrame:
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    there = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat(F.lit("/"), F.trim("r_name"), F.lit("/"), F.trim("n_name")).alias("path"))
    absent = region.select(F.concat(F.lit("/"), F.trim("r_name"), F.lit("/nowhere")).alias("path"))
    return tree.resolve(there.unionByName(absent), catalog.edges(spark, d))


@query(f"WITH RECURSIVE e AS (SELECT * FROM {EDGES}), s AS (SELECT 'r1' AS root, 'r1' AS node, 0::BIGINT AS depth UNION ALL SELECT root, child, depth + 1 FROM s JOIN e ON e.parent = s.node) SELECT * FROM s")
def subtree(spark: SparkSession, d: str) -> DataFrame:
    return tree.subtree(catalog.edges(spark, d), spark.createDataFrame([("r1",)], "node string"))


@query(f"SELECT name, child FROM {EDGES} WHERE parent = 'r1'")
def dir_listing(spark: SparkSession, d: str) -> DataFrame:
    return tree.listing(catalog.edges(spark, d), "r1")


@query(f"SELECT parent, count(*) AS n_children FROM {EDGES} GROUP BY 1")
def child_count(spark: SparkSession, d: str) -> DataFrame:
    return tree.child_counts(catalog.edges(spark, d))


@query(f"WITH e AS (SELECT * FROM {EDGES}), c AS (SELECT 'c' || c_custkey AS node, c_acctbal::DECIMAL(18, 2) AS length FROM customer), n AS (SELECT e.parent AS node, sum(length) AS total FROM e JOIN c ON c.node = e.child GROUP BY 1), r AS (SELECT e.parent AS node, sum(total) AS total FROM e JOIN n ON n.node = e.child GROUP BY 1), a AS (SELECT '/' AS node, sum(total) AS total FROM r) SELECT node, total::DOUBLE AS total FROM (FROM n UNION ALL FROM r UNION ALL FROM a)")
def subtree_length(spark: SparkSession, d: str) -> DataFrame:
    lengths = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node"), F.col("c_acctbal").cast("decimal(18,2)").alias("length"))
    return tree.lengths_below(catalog.edges(spark, d), lengths).withColumn("total", F.col("total").cast("double"))


@query(f"SELECT parent, name, child FROM {EDGES} WHERE NOT (parent = 'r1' AND name = 'CANADA') UNION ALL SELECT 'r2', 'MOVED', child FROM {EDGES} WHERE parent = 'r1' AND name = 'CANADA'")
def move_node(spark: SparkSession, d: str) -> DataFrame:
    return tree.moved(catalog.edges(spark, d), "r1", "CANADA", "r2", "MOVED")


# Further catalog operators


@query("SELECT a.serverid, coalesce(max(n.n_nationkey), -1)::INT AS servernum FROM (SELECT trim(n_name) AS serverid FROM nation UNION SELECT trim(r_name) FROM region) a LEFT JOIN nation n ON trim(n.n_name) = a.serverid GROUP BY 1")
def server_numbers(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    known = nation.select(F.trim("n_name").alias("serverid"), F.col("n_nationkey").alias("servernum"))
    return tables.server_numbers(known, known.select("serverid").union(region.select(F.trim("r_name"))))


@query("SELECT l_orderkey AS node, 'data' AS fork, l_linenumber::BIGINT AS block_index, sha1(p_name) AS sha1, strlen(p_name)::BIGINT AS len FROM lineitem JOIN part ON p_partkey = l_partkey")
def fork_content_ids(spark: SparkSession, d: str) -> DataFrame:
    """A line is a block of its order's fork, a part its segment."""
    blocks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("node"), F.lit("data").alias("fork"), F.col("l_linenumber").cast("long").alias("block_index"), F.col("l_partkey").alias("segment"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("segment"), F.sha1("p_name").alias("sha1"), F.octet_length("p_name").cast("long").alias("len"))
    return content.fork_content_ids(blocks, parts)


@query(f"SELECT collection, segment, sha1, len FROM {CONTENTS} WHERE segment % 4 <> 0")
def new_references(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.contents(spark, d).drop("content")
    return content.new_references(rows.unionByName(rows), rows.filter("segment % 4 = 0"))


@query(f"SELECT segment, versionid, payload FROM (SELECT * FROM {VERSIONS} QUALIFY row_number() OVER (PARTITION BY segment ORDER BY versiontime DESC, uniquifier DESC) = 1) WHERE segment % 10 <> 0 UNION ALL SELECT c_custkey, -1, c_acctbal FROM customer WHERE c_custkey % 10 = 0")
def dirty_overlay(spark: SparkSession, d: str) -> DataFrame:
    """The latest state with every tenth customer written by an open transaction."""
    committed = versions.latest(catalog.order_versions(spark, d)).select("segment", "versionid", "payload")
    dirty = table(spark, d, "customer").filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("segment"), F.lit(-1).cast("long").alias("versionid"), F.col("c_acctbal").alias("payload"))
    return versions.overlaid(committed, dirty)


@query("SELECT c_nationkey::BIGINT AS volume, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS versiontime FROM customer")
def snapshot_upsert(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("volume"), F.col("c_name").alias("name"), F.lit(1).cast("long").alias("versiontime"), "c_custkey")
    new = have.filter("c_custkey % 3 = 0").withColumn("versiontime", F.lit(2).cast("long"))
    return versions.with_snapshot(have, new).drop("c_custkey")


@query("SELECT s_suppkey AS storenum, (s_acctbal * 1000000)::BIGINT AS free FROM supplier WHERE s_nationkey % 2 = 0 AND (s_acctbal * 1000000)::BIGINT > 1000 + 524288000 ORDER BY s_suppkey LIMIT 1")
def store_for_writing(spark: SparkSession, d: str) -> DataFrame:
    stores = table(spark, d, "supplier").select(F.col("s_suppkey").alias("storenum"), F.round(F.col("s_acctbal") * 1_000_000).cast("long").alias("free"), F.when(F.col("s_nationkey") % 2 == 0, "Ready").otherwise("Full").alias("status"))
    return refs.store_for_writing(stores, 1000).drop("status")


@query(f"SELECT eventid, eventtype FROM {LOG} WHERE eventid >= 900 ORDER BY eventid LIMIT 40")
def server_event_page(spark: SparkSession, d: str) -> DataFrame:
    return events.server_after_id(catalog.events(spark, d).select("eventid", "eventtype"), 900, 40)


@query(f"SELECT segment, ('0x' || substr(sha1, 1, 2))::INT::BIGINT AS bucket FROM {CONTENTS}")
def hash_buckets(spark: SparkSession, d: str) -> DataFrame:
    return catalog.contents(spark, d).select("segment", scalars.hash_bucket(F.col("sha1"), 8).alias("bucket"))


@query(f"SELECT segment, collection FROM {CONTENTS} WHERE collection = 'en' AND (sha1, len) IN (SELECT (sha1, len) FROM {CONTENTS} WHERE collection <> 'en')")
def retrieve_by_content_id(spark: SparkSession, d: str) -> DataFrame:
    """All segments of a collection with contents that others have."""
    rows = catalog.contents(spark, d).drop("content")
    return content.references(rows.filter("collection = 'en'"), rows.filter("collection != 'en'")).select("segment", "collection")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def delete_references(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return refs.without(table(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, ["o_orderkey"])


@query("SELECT trim(c_name) AS name, c_mktsegment AS segment, NULL::VARCHAR AS missing FROM customer WHERE c_nationkey = 7")
def child_info(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer")
    nodes = customer.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node"), F.create_map(F.lit("segment"), "c_mktsegment", F.lit("other"), F.col("c_acctbal").cast("string")).alias("metadata"))
    found = tree.child_info(catalog.edges(spark, d), nodes, "n7", ["segment", "missing"])
    return found.select("name", F.try_element_at("metadata", F.lit("segment")).alias("segment"), F.try_element_at("metadata", F.lit("missing")).alias("missing"))


@query("SELECT min(l_partkey) AS dataid, sha1(l_shipdate::VARCHAR) AS sha1 FROM lineitem GROUP BY 2")
def rebuilt_index(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "lineitem").select(F.col("l_partkey").alias("dataid"), F.sha1(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).alias("sha1"))
    return refs.rebuilt_index(files, "sha1")
