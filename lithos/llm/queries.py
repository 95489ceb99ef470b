"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.llm import chat, decontamination, licenses, near_dup, pieces, quality, secret_scan, sharding, toxicity, warc
from lithos.llm.common import shared_path, table

Query = Callable[[SparkSession, str], DataFrame]
CONVERSATION_7 = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.notices(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(CONVERSATION_7, "conv_id long, turn long, role string, text string"))
    said = chat.read_back(chat.examples(turns))
    loss = F.array_join("losses", "")
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return said.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(all_turns, "UTF-8"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")


def op4_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(documents, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_secret_grammars(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan_documents(documents, secret_scan.fitted(documents))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "format")
    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), number("format"), F.sha2(F.encode(said(base), "UTF-8"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), scores.alias("scores"))


def op6_best_fit_decreasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def piece_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op7_piece_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pieces.encode_documents(table(spark, sf_dir, "documents"), piece_model(), digests=True)
    return done.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


def op8_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate_documents(table(spark, sf_dir, "documents")).drop("worst")


def op9_warc_content_addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op10_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.leaks(documents, table(spark, sf_dir, "benchmark")).drop("node")


def queries() -> dict[str, Query]:
    return {
        "op1_license_dice": op1_license_dice,
        "op2_chat_prefix_targets": op2_chat_prefix_targets,
        "op3_dart_minhash": op3_dart_minhash,
        "op4_toxicity_grammar": op4_toxicity_grammar,
        "op5_secret_grammars": op5_secret_grammars,
        "op6_best_fit_decreasing": op6_best_fit_decreasing,
        "op7_piece_encode_decode": op7_piece_encode_decode,
        "op8_repetition_coverage": op8_repetition_coverage,
        "op9_warc_content_addressed": op9_warc_content_addressed,
        "op10_simhash_decontamination": op10_simhash_decontamination,
    }


#: Turns as the template writes them; a reply ends at `upto`, and a conversation's last turns after
#: its last reply make one more row.
OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    + len(regexp_extract_all(text, '</?s>')) + len(regexp_extract_all(text, '<<SYS>>')) + len(regexp_extract_all(text, '<</SYS>>')) + len(regexp_extract_all(text, '\[/?INST\]'))
    + 3 + length(role) + 1 + 5 AS n
  FROM t
), s AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS is_last
  FROM e
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR is_last THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""

OP9_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, (5 * (i // 4))::INT + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to,
  true AS verified
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_dice": licenses.oracle(), "op2_chat_prefix_targets": OP2_SQL, "op9_warc_content_addressed": OP9_SQL}
