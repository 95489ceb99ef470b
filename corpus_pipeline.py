"""A corpus pipeline of five stages over `documents`; part of the subpackage lithos.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. Stages keep further columns of docs as they are, whatever their
names (their own are chosen so that they clash with none); rows with nulls are treated as the
operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.llm import decontamination, near_dup, pieces, secret_scan, toxicity
from lithos.llm.common import shared_path, ship_package, table
from lithos.llm.queries import piece_model

#: A document of this toxicity or more goes.
TOXIC = 0.3


def spare(docs: DataFrame, name: str) -> str:
    """The name, or one like it that is no column of docs."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the grammar rejects. The score is a column, so no join is needed."""
    ship_package(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score_column(F.col("text"), model) < TOXIC)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near duplicates the document with the least doc_id, once."""
    ship_package(spark)
    found = near_dup.classes(docs.select("doc_id", "text"))
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("class_node")))
    own_id, own_node, key = (spare(docs, n) for n in ("kept_id", "kept_node", "text_key"))
    kept = kept.select(F.col("doc_id").alias(own_id), F.col("node").alias(own_node)).distinct()
    keyed = docs.withColumn(key, near_dup.node(F.col("text")))
    chosen = keyed.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_node)), "left_semi")
    # Rows that repeat a doc_id and a text are copies; one stays.
    return chosen.dropDuplicates(["doc_id", key]).drop(key)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark."""
    found = decontamination.leaks(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    leaked = spare(docs, "leaked")
    return docs.join(found.select(F.col("node").alias(leaked)).distinct(), decontamination.node(docs["text"]) == F.col(leaked), "left_anti")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by [SECRET]; n_chars follows the text where it changes. No document goes."""
    ship_package(spark)
    scanner = secret_scan.fitted(docs.select("doc_id", "text"))
    name = spare(docs, "masked")
    masked = docs.withColumn(name, secret_scan.redact_column(F.col("text"), scanner))
    changed = ~F.col(name).eqNullSafe(F.col("text"))
    masked = masked.withColumn("n_chars", F.when(changed, F.length(name).cast("long")).otherwise(F.col("n_chars")))
    return masked.withColumn("text", F.col(name)).drop(name)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document that is left."""
    ship_package(spark)
    done = pieces.encode_documents(docs, piece_model(), digests=True)
    return done.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("pieces", piece_stage),
]

#: No stage but the secrets' base patterns can be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
