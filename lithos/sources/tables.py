"""Reading tables, segment files and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.functions import scalars


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, name: str, *, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A catalog table over JDBC; with a numeric key and its bounds the read is split."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def segment_files(spark: SparkSession, directory: str) -> DataFrame:
    """dataid, casid, content of the segment files below a directory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.casseg").load(directory)
    return files.select(scalars.serial_number(F.col("path")).alias("dataid"), scalars.content_id(F.col("content")).alias("casid"), "content")


def collection_ids(collections: DataFrame) -> DataFrame:
    return collections.select("id")


def peers(connected: DataFrame) -> DataFrame:
    """Peers with a mark for this server, which is number 1."""
    return connected.withColumn("is_self", F.col("servernum") == 1)


def server_numbers(connected: DataFrame, asked: DataFrame, key: str = "serverid") -> DataFrame:
    """The number of each server asked for, -1 for unknown ones; of several the largest."""
    known = connected.groupBy(key).agg(F.max("servernum").alias("servernum"))
    return asked.select(key).distinct().join(known, key, "left").withColumn("servernum", F.coalesce("servernum", F.lit(-1)).cast("int"))


def segment_ids(cas: DataFrame, collection: int) -> DataFrame:
    """Segment ids of a collection in order, one row for each version."""
    return cas.filter(F.col("collectionid") == collection).select("segment").orderBy("segment")


def id_bounds(data: DataFrame, key: str = "id") -> DataFrame:
    return data.agg(F.min(key).alias("first_id"), F.max(key).alias("last_id"), F.count("*").alias("n"))


def stores_from_config(spark: SparkSession, lines: list[str]) -> DataFrame:
    """storenum, storeid, kind, location from `id:type:location` lines, numbered in their order."""
    rows = [(i + 1, *line.split(":", 2)) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "storenum int, storeid string, kind string, location string")


def new_stores(configured: DataFrame, known: DataFrame) -> DataFrame:
    """Configured stores that the table lacks; to be appended."""
    return configured.join(known.select("storeid"), "storeid", "left_anti")


def volumes(collections: DataFrame, key: str = "volume") -> DataFrame:
    """Collections whose metadata map holds a volume, others are none."""
    return collections.filter(F.map_contains_key("metadata", key))


def write_segment_files(contents: DataFrame, directory: str, replace: bool = False) -> DataFrame:
    """Writes contents (dataid, content) as segment files below a directory, each by its task, and
    returns dataid, path, status: written, replaced or unchanged. Other bytes under a taken id are an
    error unless `replace`; the same bytes never are, so that a task may be tried again."""
    from collections.abc import Iterator

    import pyarrow as pa

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(directory) if "://" in directory else (fs.LocalFileSystem(), directory)
        for batch in batches:
            said = []
            for path, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                full, status = f"{top}/{path}", "written"
                if store.get_file_info(full).type != fs.FileType.NotFound:
                    with store.open_input_stream(full) as f:
                        status = "unchanged" if f.readall() == data else "replaced"
                    if status == "replaced" and not replace:
                        raise FileExistsError(f"{path} holds another segment")
                if status != "unchanged":
                    store.create_dir(full.rpartition("/")[0], recursive=True)
                    with store.open_output_stream(f"{full}.new") as f:
                        f.write(data)
                    store.move(f"{full}.new", full)
                said.append(status)
            yield pa.RecordBatch.from_arrays([batch["dataid"], batch["path"], pa.array(said, pa.string())], ["dataid", "path", "status"])

    rows = contents.select(F.col("dataid").cast("long").alias("dataid"), scalars.serial_path(F.col("dataid")).alias("path"), F.coalesce("content", F.unhex(F.lit(""))).alias("content"))
    return rows.mapInArrow(write, "dataid long, path string, status string")


def new_peers(connected: DataFrame, asked: DataFrame) -> DataFrame:
    """Peers (serverid) that the table lacks, numbered after its last; to be appended, and none the
    second time. Peers are few: servers, not data."""
    from pyspark.sql import Window

    new = asked.select("serverid").distinct().join(connected.select("serverid"), "serverid", "left_anti")
    last = connected.agg(F.coalesce(F.max("servernum"), F.lit(0)).alias("_last"))  # one row
    place = F.row_number().over(Window.orderBy("serverid"))
    return new.crossJoin(F.broadcast(last)).select((F.col("_last") + place).cast("int").alias("servernum"), "serverid")
