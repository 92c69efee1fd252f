"""Files of runs, checked appends, versions, batch files and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import checks as c
from scoreloom.plans.fixtures import Tables
from scoreloom.sources import batches as ba
from scoreloom.sources import tables as tb
from scoreloom.sources.schema import TABLES
from scoreloom.streaming import live

SF = "/root/testdata/sf0.001"


def test_registry():
    assert len(TABLES) == 17
    for t in TABLES.values():
        assert set(t.key) <= set(t.schema.fieldNames()) and set(t.key) <= set(t.required)
        for column, parent in t.references:
            assert column in t.schema.fieldNames() and parent in TABLES


def test_read_table(spark, tmp_path):
    for run, lines in (("run_a", [{"response_id": "q-a1", "request_id": "q", "run_id": "run_a", "attempt": 1, "received_at": "2024-01-01T00:00:00.250Z"}]), ("run_b", [])):
        os.makedirs(tmp_path / run)
        (tmp_path / run / "responses.jsonl").write_text("\n\n".join(json.dumps(x) for x in lines) + "\n\n")
    r = tb.read_table(spark, str(tmp_path), "responses").collect()
    assert len(r) == 1 and r[0].attempt == 1 and r[0].error is None and r[0].received_at.microsecond == 250000
    assert tb.read_table(spark, str(tmp_path), "rubrics").count() == 0


def test_append_checks_rows(spark, tmp_path):
    good = spark.createDataFrame([("r", "run", True)], "response_id string, run_id string, passed boolean")
    tb.append(good, str(tmp_path / "v"), "validations")
    tb.append(good, str(tmp_path / "v"), "validations")
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2
    with pytest.raises(ValueError):
        tb.append(good.withColumn("extra", F.lit(1)), str(tmp_path / "v"), "validations")
    with pytest.raises(ValueError):
        tb.conform(good.drop("run_id"), "validations")
    with pytest.raises(ValueError):
        tb.append(good, str(tmp_path / "v"), "runs")
    with pytest.raises(Exception, match="required"):
        tb.conform(good.withColumn("run_id", F.lit(None).cast("string")), "validations").collect()


def test_upsert_versions(spark, tmp_path):
    def batch(status):
        return spark.createDataFrame([("b1", "run", "p", 0, status, 1, False, "2024-01-01 00:00:00", "2024-01-01 00:00:00")],
                                     "batch_id string, run_id string, provider string, round int, status string, n_requests int, collected boolean, created_at string, updated_at string")
    root = str(tmp_path / "batches")
    assert tb.read_version(spark, root, "batches").count() == 0
    assert tb.upsert_table(spark, batch("pending"), root, "batches") == 1
    assert tb.upsert_table(spark, batch("completed"), root, "batches") == 2
    assert [r.status for r in tb.read_version(spark, root, "batches").collect()] == ["completed"]
    with pytest.raises(ValueError):
        tb.upsert_table(spark, batch("x"), root, "responses")


def test_batch_files(spark, tmp_path):
    requests = spark.range(25).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("request_id"), F.when(F.col("id") % 5 == 0, "m1").otherwise("m0").alias("model"), F.col("id").alias("n"))
    from scoreloom.operators.sampling import messages
    ba.write_batches(ba.batch_lines(requests, "n", messages(F.lit("hi")), max_lines=8), str(tmp_path / "b"))
    files = spark.read.text(str(tmp_path / "b"))
    sizes = {(r.model, r.file_no): r["count"] for r in files.groupBy("model", "file_no").count().collect()}
    assert sizes == {("m0", 0): 8, ("m0", 1): 8, ("m0", 2): 4, ("m1", 0): 5}
    assert ba.repeated_ids(requests).count() == 0 and ba.repeated_ids(requests.union(requests)).count() == 25


def test_batch_files_hold_so_many_bytes_and_no_repeated_ids(spark, tmp_path):
    from scoreloom.operators.sampling import messages
    requests = spark.range(60).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("request_id"), F.lit("m").alias("model"), F.col("id").alias("n"))
    words = messages(F.repeat(F.lit("é"), (F.col("n") % 7 * 40).cast("int")))
    lines = ba.batch_lines(requests, "n", words, max_lines=20, max_bytes=1500)
    files = lines.groupBy("file_no").agg(F.sum(F.octet_length("value") + 1).alias("size"), F.count("*").alias("n")).orderBy("file_no").collect()
    assert [f.file_no for f in files] == list(range(len(files))) and len(files) > 6
    assert all(f["size"] <= 1500 and f.n <= 20 for f in files) and sum(f.n for f in files) == 60
    with pytest.raises(Exception, match="over 100 bytes"):
        ba.batch_lines(requests, "n", words, max_bytes=100).collect()
    with pytest.raises(ValueError, match="r7"):
        ba.write_batches(lines.union(lines.where("value like '%\"r7\"%'")), str(tmp_path / "again"))
    ba.write_batches(ba.embedding_lines(requests, "n", "request_id", "request_id", max_lines=25), str(tmp_path / "e"))
    assert spark.read.text(str(tmp_path / "e")).count() == 60


def test_questions_prefer_validation(spark, tmp_path):
    for split in ("train", "validation"):
        (tmp_path / f"{split}.jsonl").write_text(json.dumps({"id": "1", "question": split, "correct_answers": ["a"], "incorrect_answers": []}) + "\n\n")
    assert [r.question for r in tb.read_qa(spark, str(tmp_path)).collect()] == ["validation"]
    rows = tb.explode_answers(tb.read_qa(spark, str(tmp_path)).withColumn("correct_answers", F.array().cast("array<string>")), "id").collect()
    assert len(rows) == 1 and rows[0].answer is None


def responses(spark, tmp_path):
    """Responses in three files, the attempts of a request spread over them."""
    r = Tables(spark, SF).responses.select("response_id", "request_id", "attempt", "prompt_tokens", "completion_tokens",
                                           F.col("received_at").cast("timestamp").alias("received_at"), "finish_reason")
    for part in range(3):
        r.where(F.col("attempt") == (3, 1, 2)[part]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return r, live.stream_table(spark, str(tmp_path / "in"), r.schema, "parquet", files_per_batch=1)


def test_stream_latest_in_any_order(spark, tmp_path):
    batch, stream = responses(spark, tmp_path)
    live.start_latest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r.request_id: r.attempt for r in live.read_latest(spark, str(tmp_path / "out")).collect()}
    assert got == {r.request_id: r.attempt for r in live.highest_attempts(batch).collect()}
    assert len(list((tmp_path / "out" / "batches").glob("batch=*"))) == 3


def test_stream_latest_compacts(spark, tmp_path):
    """Late attempts, repeated batches, and reading that does not grow with the batches."""
    rows = [(f"q{i % 40}", i % 7 + 1, f"r{i}") for i in range(400)]
    root, seen = str(tmp_path / "out"), []
    for batch in range(10):
        some = rows[40 * batch:40 * batch + 40]
        live.highest_attempts(spark.createDataFrame(some, "request_id string, attempt int, response_id string")).write.mode("overwrite").parquet(f"{root}/batches/batch={batch}")
        seen += some
        if batch % 3 == 2:
            live.compact(spark, root, batch)
            live.compact(spark, root, batch)  # as after a failure
        got = {r.request_id: r.attempt for r in live.read_latest(spark, root).collect()}
        want = {}
        for q, a, _ in seen:
            want[q] = max(a, want.get(q, 0))
        assert got == want
    assert sorted(p.name for p in (tmp_path / "out" / "tables").glob("upto=*")) == ["upto=5", "upto=8"]
    assert len(list((tmp_path / "out" / "batches").glob("batch=*"))) == 4


def test_stream_sessions_are_emitted(spark, tmp_path):
    table = Tables(spark, SF).responses.select("request_id", F.col("received_at").cast("timestamp").alias("received_at"))
    edges = table.agg(F.expr("percentile_approx(received_at, array(0.0, 0.4, 0.8, 1.0))")).first()[0]
    table = table.where(F.col("received_at") > edges[0])
    for lo, hi in zip(edges, edges[1:]):
        table.where((F.col("received_at") > lo) & (F.col("received_at") <= hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.stream_table(spark, str(tmp_path / "in"), table.schema, "parquet", files_per_batch=1)
    q = live.activity_sessions(stream, "request_id", "1 hour", late="1 minute").writeStream.format("memory").queryName("emitted").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("emitted").collect()}
    want = {tuple(r) for r in live.activity_sessions(table, "request_id", "1 hour").collect()}
    assert got <= want and len(got) > 0.3 * len(want)


def test_stream_validate(spark, tmp_path):
    batch, stream = responses(spark, tmp_path)
    checks = {"not_truncated": c.not_truncated(F.col("finish_reason"))}
    live.start_append(live.validate(stream, checks), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r.response_id: r.passed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.response_id: r.passed for r in live.validate(batch, checks).collect()}


def test_stream_windows_and_sessions(spark, tmp_path):
    batch, stream = responses(spark, tmp_path)
    for k, build in enumerate((lambda d: live.tokens_per_window(d, "6 hours", late="10000 days"), lambda d: live.activity_sessions(d, "request_id", "1 hour", late="10000 days"))):
        name = f"stream_{k}"
        q = build(stream).writeStream.format("memory").queryName(name).outputMode("complete" if k == 0 else "append").option(
            "checkpointLocation", str(tmp_path / f"cp{k}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = {tuple(r) for r in spark.table(name).collect()}
        want = {tuple(r) for r in build(batch).collect()}
        assert got == (want if k == 0 else set())  # the watermark of 10,000 days closes no session
