"""Chat formatting, the archive, and the pipeline: round trips, SQL and edge cases."""

import base64
import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lithos.llm import chat, warc
from lithos.llm import queries as llm
from lithos.llm import toxicity
from lithos.llm.common import shared_path
from test_queries import TABLES, rows
from test_text_operators import base_spans, brute_leaks, exact_classes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got, want = llm.queries()[name](spark, SF), duck.execute(llm.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


#: What the queries without SQL return at least, in the contract's names and types.
COLUMNS = {
    "op4_toxicity_grammar": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_secret_grammars": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op6_best_fit_decreasing": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op7_piece_encode_decode": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op8_repetition_coverage": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_queries_return_a_row_for_each_document(spark, name):
    got = llm.queries()[name](spark, SF)
    assert COLUMNS[name].items() <= dict(got.dtypes).items()
    ids = [r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(ids)


def test_secret_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in llm.op5_secret_grammars(spark, SF).collect():
        base = base_spans(texts[r["doc_id"]])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex"))
        assert [s for s in r["spans"].split(",") if s and not s.startswith("format:")] == [s for s in said.split(",") if s] and len(r["scores"].split(",")) == len(r["spans"].split(","))


def test_chat_round_trip(spark):
    said = {
        1: [("system", "be <s> brief"), ("user", "a\\b </s>[INST] ok [/INST]\n<<SYS>>"), ("assistant", "<\\s> [\\INST] \\"), ("user", ""), ("assistant", None), ("user", "last <")],
        2: [("assistant", "only")],
        3: [("user", "no reply")],
        4: [(None, None)],
        5: [("odd role\n<s>", "x"), ("assistant", "é日\U0001f600")] * 40,
        None: [("user", "q"), ("assistant", "a")],
    }
    turns = spark.createDataFrame([(c, i, r, t, "x", 3) for c, ts in said.items() for i, (r, t) in enumerate(ts)], "conv_id long, turn long, role string, text string, head string, example int")
    made = chat.examples(turns)
    for r in made.collect():
        marks = r["formatted"].count("<s>")
        replies = [i for i, (role, _) in enumerate(said[r["conv_id"]]) if role == "assistant"]
        if r["loss_start"] is None:
            assert marks == len(said[r["conv_id"]]) and r["example"] == len(replies)
        else:
            assert marks == replies[r["example"]] + 1  # all before it, and itself
    for r in chat.read_back(made).collect():
        want = said[r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(role or "", t or "") for role, t in want]
        assert r["losses"] == [t or "" for role, t in want if role == "assistant"]
    assert chat.examples(turns.limit(0)).count() == 0


def test_each_control_string_is_escaped(spark):
    marks = ["<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]
    texts = [*marks, "".join(marks), "<" + "".join(marks), "\\".join(marks), "<<s>>", "[[INST]]", "<<<SYS>>", "< s>", "[inst]"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", chat.escaped(F.col("text")).alias("out")).withColumn("back", chat.unescaped(F.col("out"))).collect()
    for r in rows:
        assert r["back"] == r["text"] and not any(m in r["out"] for m in marks), r
    assert [r["out"] for r in rows[-2:]] == ["< s>", "[inst]"]


def test_chat_with_a_very_long_text(spark):
    long = "</s>é" * 200_000
    rows = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.examples(rows)).first()
    assert back["losses"] == [long] and [t["text"] for t in back["turns"]] == [long, long]


def test_archive_round_trip(spark):
    long = "<p>x</p>" * 50_000
    pages = [(3, "http://a/\r\nEvil: 1", "same"), (1, "http://b", "same"), (2, None, None), (4, "http://c", ""), (5, "u", long), (None, "n", "same"), (7, "r", "twice"), (7, "r", "twice"), (None, "z", "alone")]
    path = shared_path(spark, "test-warc")
    warc.write_archive(spark.createDataFrame([(*p, 1, "c") for p in pages], "page_id long, url string, html string, bytes int, digest string"), path)
    got = warc.read_archive(spark, path).collect()
    assert len(got) == len(pages) and all(r["verified"] for r in got)
    assert spark.read.parquet(f"{path}/payloads").count() == len({p[2] or "" for p in pages})
    kinds = {(r["page_id"], bytes(r["payload"]).decode()): (r["record_type"], r["refers_to"]) for r in got}
    assert kinds == {(3, "same"): ("revisit", 1), (1, "same"): ("response", None), (2, ""): ("response", None), (4, ""): ("revisit", 2), (5, long): ("response", None), (None, "same"): ("revisit", 1), (7, "twice"): ("response", None), (None, "alone"): ("response", None)}
    assert len({r["record_id"] for r in got}) == len(got)
    of_id = {r["record_id"]: r for r in got}
    for r in got:
        data = bytes(r["payload"])
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode() and r["payload_bytes"] == len(data)
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and "Evil" not in fields and int(fields["Content-Length"]) == len(block)
        assert fields["Content-Type"].startswith("application/http") and fields["WARC-Date"].endswith("Z") and fields["WARC-Target-URI"]
        http, _, body = block.partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK\r\n") and f"Content-Length: {len(data)}".encode() in http
        if r["record_type"] == "response":
            assert body == data and "WARC-Refers-To" not in fields
        else:
            answered = of_id[fields["WARC-Refers-To"]]
            assert body == b"" and "identical-payload-digest" in fields["WARC-Profile"] and answered["record_type"] == "response" and answered["payload"] == r["payload"]
    files = shared_path(spark, "test-warc-files")
    warc.write_files(spark, path, files, records_a_file=3)
    back = {r["record_id"]: (r["record_type"], r["header"].encode() + b"\r\n\r\n" + bytes(r["block"])) for r in warc.read_files(spark, files).collect()}
    assert back == {r["record_id"]: (r["record_type"], bytes(r["record"])) for r in got}
    bad = shared_path(spark, "test-warc")
    warc.write_archive(spark.createDataFrame([(1, "u", "right")], "page_id long, url string, html string"), bad)
    spark.read.parquet(f"{bad}/payloads").withColumn("payload", F.encode(F.lit("wrong"), "UTF-8")).write.parquet(f"{bad}/other")
    spark.read.parquet(f"{bad}/other").write.mode("overwrite").parquet(f"{bad}/payloads")
    assert not warc.read_archive(spark, bad, strict=False).first()["verified"]
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archive(spark, bad).collect()
    empty = shared_path(spark, "test-warc")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Each stage on what the one before kept: columns stay, clean documents stay, decisions take effect."""
    source = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame(
        [(9001, None, "en", None, 0), (9002, "", None, "s", 0), (9003, "you idiot, you pathetic moron!", "en", "s", 30), (9004, "a note with token = 'abcdefghijkl1' inside", "en", "s", 43), (None, "nobody numbered this one", "en", "s", 24), (9005, "copy of a text", "en", "s", 14), (9006, "copy of a text", "en", "s", 14), (9006, "copy of a text", "en", "s", 14)],
        source.schema,
    )
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()
    leak = spark.createDataFrame([(9007, f"words before {item['text']} words after", "en", "s", 1)], source.schema)
    docs = source.unionByName(extra).unionByName(leak).selectExpr("*", "'kept' AS node", "1 AS size")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs, seen[name] = out, {r["doc_id"]: r for r in out.collect()}
    assert 9003 not in seen["toxicity"] and {9001, 9002, 9004, None, 9005, 9006, 9007} <= seen["toxicity"].keys()
    assert 9005 in seen["near_duplicates"] and 9006 not in seen["near_duplicates"]
    assert 9001 in seen["near_duplicates"] and None in seen["near_duplicates"] and 9007 in seen["near_duplicates"]
    assert 9007 not in seen["decontamination"] and 9004 in seen["decontamination"]
    assert seen["secrets"].keys() == seen["decontamination"].keys()
    assert seen["secrets"][9004]["text"] == "a note with [SECRET]' inside" and seen["secrets"][9004]["n_chars"] == 28
    assert seen["pieces"].keys() == seen["secrets"].keys()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, source.limit(0), SF).count() == 0


def test_pipeline_equals_brute_force(spark):
    import sentencepiece

    documents = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    model = toxicity.fit(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    reader = toxicity.Reader(model.stems, model.softeners)
    texts = {i: t for i, t in texts.items() if toxicity.score_of(reader.patterns(t), model) < corpus_pipeline.TOXIC}
    texts = {i: texts[i] for i, c in exact_classes(texts).items() if i == c}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    leaked = {d for d, _ in brute_leaks(texts, items)}
    texts = {i: t for i, t in texts.items() if i not in leaked}
    library, want = sentencepiece.SentencePieceProcessor(model_proto=llm.piece_model()), {}
    for i, t in texts.items():
        parts, at = [], 0
        for _, a, b in base_spans(t):
            if a >= at:
                parts += [t[at:a], "[SECRET]"]
            at = max(at, b)
        t = "".join(parts) + t[at:]
        ids = library.encode(t)
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want
