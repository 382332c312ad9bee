import json

import duckdb
import pytest
import __spark_entry__ as entry
from foliospark.operators import retrieval, runlog
from foliospark.sources import tables
from foliospark.streaming.collect import stream_collect, stream_resume
from pyspark.sql import functions as F


def test_reader_checks_and_fills_columns(spark, tmp_path):
    spark.createDataFrame([("a", "t")], "cnr string, full_text string").write.parquet(str(tmp_path / "in"))
    got = tables.read_judgments(spark, str(tmp_path / "in")).first()
    assert got["cnr"] == "a" and got["bench"] is None and got["row_index"] == 0
    with pytest.raises(ValueError, match="full_text"):
        spark.createDataFrame([("a",)], "cnr string").write.parquet(str(tmp_path / "bad"))
        tables.read_judgments(spark, str(tmp_path / "bad"))
    found = tables.check_schema(spark, str(tmp_path / "in"))
    assert found["required_missing"] == [] and "bench" in found["absent"] and sum(found["rows"].values()) == 1


@pytest.mark.parametrize("form", ["list", "object", "lines"])
def test_benchmark_forms(spark, tmp_path, form):
    items = [{"question_id": "q1", "question": "x", "source_cnr": "c1"}, {"question_id": "q2", "question": "y", "gold_cnrs": ["g"], "source_cnr": " "}]
    path = tmp_path / ("b.jsonl" if form == "lines" else "b.json")
    path.write_text("\n".join(map(json.dumps, items)) if form == "lines" else json.dumps(items if form == "list" else {"questions": items}))
    got = {r["question_id"]: r for r in tables.load_benchmark(spark, str(path)).collect()}
    assert got["q1"]["gold_cnrs"] == ["c1"] and got["q2"]["group"] == "g"


def test_benchmark_problems_raise(spark, tmp_path):
    path = tmp_path / "b.json"
    path.write_text(json.dumps([{"question_id": "q", "source_cnr": "c"}, {"question_id": "q", "source_cnr": "c"}]))
    with pytest.raises(ValueError, match="repeated_id"):
        tables.load_benchmark(spark, str(path))


def test_log_keeps_the_last_line(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"id": "a", "status": "error"}\n{broken\n{"id": "a", "status": "ok"}\n{"id": "b", "status": "ok"}\n')
    log, counts = tables.read_result_log(spark, str(path), "id string, status string", "id")
    assert {r["id"]: r["status"] for r in log.collect()} == {"a": "ok", "b": "ok"}
    assert counts.first()["broken"] == 1
    todo = runlog.todo_items(spark.createDataFrame([("a",), ("c",)], "id string"), log, "id")
    assert [r[0] for r in todo.collect()] == ["c"]


def test_collect_stream_and_restart(spark, tmp_path):
    folder = str(tmp_path)
    schema = "cnr string, full_text string, n int"

    def write(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def run(state):
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        place = F.lpad(F.col("n").cast("string"), 9, "0")
        stream_collect(stream, f"{folder}/out", f"{folder}/{state}", "cnr", "full_text", place, shard_rows=2).awaitTermination()
        return sorted((r["n"], r["cnr"], r["shard"], r["run"], r["batch"]) for r in spark.read.parquet(f"{folder}/out").collect())

    write([("a", "one", 1), ("a", "two", 2), ("b", " one ", 3), ("c", " ", 4), ("d", None, 5), (" ", "x", 6), ("g", "seven", 7), ("h", "eight", 8), (None, "y", 9)])
    assert run("state") == [(1, "a", 0, 0, 0), (7, "g", 0, 0, 0), (8, "h", 1, 0, 0)]
    write([(" a ", "three", 10), ("e", "one", 11), ("f", "new", 12), ("b", "b again", 13)])
    kept = run("state")
    assert kept[:3] == [(1, "a", 0, 0, 0), (7, "g", 0, 0, 0), (8, "h", 1, 0, 0)] and kept[3] == (12, "f", 2, 0, 1) and len(kept) == 4
    assert run("other") == kept  # a new checkpoint: the shards alone are the state
    write([("i", "nine", 14), ("f", "ten", 15)])
    assert run("other") == kept + [(14, "i", 3, 1, 1)]


def test_resume_refuses_other_settings(spark, tmp_path):
    folder = str(tmp_path)
    spark.range(6).selectExpr("id AS item").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("item long").parquet(f"{folder}/in")
    work = lambda todo: todo.withColumn("status", F.lit("ok"))
    stream_resume(spark, stream, "item", work, f"{folder}/out", f"{folder}/s1", {"m": "1"}).awaitTermination()
    stream_resume(spark, stream, "item", work, f"{folder}/out", f"{folder}/s2", {"m": "1"}).awaitTermination()
    assert spark.read.parquet(f"{folder}/out").groupBy("item").count().where("count > 1").count() == 0
    with pytest.raises(ValueError, match="other settings"):
        stream_resume(spark, stream, "item", work, f"{folder}/out", f"{folder}/s3", {"m": "2"})


def test_rerank_of_unknown_ids_is_an_error(spark):
    pool = spark.createDataFrame([(1, "zz")], "question_id int, chunk_id string")
    asked = spark.createDataFrame([(1, "a b")], "question_id int, query string")
    chunks = spark.createDataFrame([("a", "a b c")], "chunk_id string, text string")
    with pytest.raises(ValueError):
        retrieval.rerank(pool, asked, chunks)
    known = spark.createDataFrame([(1, "a"), (1, "zz")], "question_id int, chunk_id string")
    assert retrieval.rerank(known, asked, chunks).first()["score"] == 1.0


def test_encoder_is_loaded_once_in_each_worker(spark, tmp_path):
    folder, sizes = tmp_path / "loads", tmp_path / "sizes"
    folder.mkdir(), sizes.mkdir()

    def make():
        import os
        import uuid

        import numpy as np

        (folder / f"{os.getpid()}-{uuid.uuid4().hex}").touch()

        def encode(texts):
            (sizes / f"{len(texts)}-{uuid.uuid4().hex}").touch()
            return np.array([[len(t), 1.0] for t in texts])

        return encode

    frame = spark.createDataFrame([("a" * (k % 7),) for k in range(1000)] + [(None,)], "text string").repartition(16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = retrieval.embed(frame, make, batch_size=10).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 1001 and all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-6 for r in got)
    loads = [x.name.split("-")[0] for x in folder.iterdir()]
    assert len(loads) == len(set(loads))
    parts = [int(x.name.split("-")[0]) for x in sizes.iterdir()]
    assert sum(parts) == 1001 and sum(n < 10 for n in parts) <= 16
    assert retrieval.embed(frame.limit(0), make).count() == 0


def test_embedded_shares_on_a_tie_round_up_as_in_sql(spark, tmp_path):
    """Counts 7, 18, 5, 1, 1 have length 20, so shares of 0.35, 0.9, 0.25, 0.05; as floats 0.35 and 0.05 are not what they were."""
    text = "a" * 7 + "b" * 18 + "c" * 5 + "d" + "e"
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, entry.queries()["udf3_embed"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(entry.oracle_sql()["udf3_embed"]).fetchall())
    assert got[0][1:6] == (0.4, 0.9, 0.3, 0.1, 0.1)


def test_collector_keeps_no_state_by_key_in_python(spark, tmp_path):
    """A stream of 30,000 numbers, each twice and in any order: right rows, and no keyed state in the stream."""
    rows = spark.range(60_000, numPartitions=6).selectExpr("id AS n", "concat('c', id % 30000) AS cnr", "concat('t', (id % 30000) div 2) AS full_text")
    rows.orderBy(F.xxhash64("n")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("n long, cnr string, full_text string").parquet(f"{tmp_path}/in")
    place = F.lpad(F.col("n").cast("string"), 9, "0")
    query = stream_collect(stream, f"{tmp_path}/out", f"{tmp_path}/state", "cnr", "full_text", place)
    query.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.agg(F.count("n"), F.max("n"), F.sum(F.col("n") % 2), F.countDistinct("shard")).first() == (15_000, 29_998, 0, 3)
    assert query.lastProgress["stateOperators"] == []
