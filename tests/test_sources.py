"""Logs read as they were written; streams give what tables give."""

import pytest
from pyspark.sql.types import StructType

from veriscope import schemas
from veriscope.operators import align
from veriscope.sources import logs as L
from veriscope.streaming import logs as W

HEADER = "task_id,prompt,model_output,expected_output,failure_type,geometric\n"


def test_csv_log(spark, tmp_path):
    (tmp_path / "a_zero_shot_no_mutation.csv").write_text(HEADER + 'T0,"line one\nline ""two""",1,1,,0.5\n' + HEADER + "T1,p,None,1,AssertionError > ,\nT2,p,NA,nan,LLMExecutionError > x,0.1\n")
    (tmp_path / "b_zero_shot_random.csv").write_text(HEADER + "T0,p,2,1,,0.9\n")
    log = L.read_log(spark, str(tmp_path))
    own, rest = L.baseline(log)
    rows = {r["task_id"]: r for r in own.collect()}
    assert set(rows) == {"T0", "T1", "T2"} and rows["T0"]["prompt"] == 'line one\nline "two"'
    assert rows["T1"]["model_output"] is None and rows["T2"]["expected_output"] is None and rows["T0"]["failure_type"] is None
    assert [r["task_id"] for r in rest.collect()] == ["T0"]
    assert L.named(log, ["zero_shot"], ["no_mutation"]).count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1 2  3\n\n4 5\n6\n")
    assert [(r["ord"], r["params"]) for r in L.read_parameters(spark, str(tmp_path / "p.txt"), 2).collect()] == [(0, [1, 2, 3]), (1, [4, 5])]
    (tmp_path / "m.json").write_text('[{"run": "r", "tasks_requested": 3, "outcomes": {"a": 1, "b": 2}}, {"run": "q", "tasks_requested": 9, "outcomes": {"a": 1}}]')
    m = L.read_manifest(spark, str(tmp_path / "m.json"))
    assert {r["run"]: r["ok"] for r in m.select("run", L.outcomes_add_up(m).alias("ok")).collect()} == {"r": True, "q": False}
    (tmp_path / "x.jsonl").write_text('{"full_sol": "s", "test_input": "1", "profile": {"loop1": [3], "if1": [1, 0]}, "raw_reply": ""}\n')
    assert L.read_profiles(spark, str(tmp_path / "x.jsonl")).first()["profile"] == {"loop1": [3], "if1": [1, 0]}
    assert L.range_spec("1-3, 7") == [1, 2, 3, 7]


def test_documents(spark, tmp_path):
    schema = StructType.fromDDL("_id string, a int, b int")
    s = L.Documents(spark, str(tmp_path / "d"), schema)
    s.replace(spark.createDataFrame([("x", 1, 2), ("y", 3, 4)], schema))
    s.upsert(spark.createDataFrame([("x", 9), ("z", 5)], "_id string, a int"))
    assert {tuple(r) for r in s.read().collect()} == {("x", 9, 2), ("y", 3, 4), ("z", 5, None)}
    s.replace(spark.createDataFrame([("x", 7)], "_id string, a int"))
    s.delete(spark.createDataFrame([("y",)], "_id string"))
    assert {tuple(r) for r in s.read().collect()} == {("x", 7, None), ("z", 5, None)}
    assert s.find("z").count() == 1


def test_cumulative_alignment(spark):
    target = spark.createDataFrame([(k,) for k in "abcd"], "k string")
    logs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "c"), (2, "d"), (5, "a"), (5, "b"), (5, "c")], "n int, k string")
    got = {tuple(r) for r in align.cumulative(target, logs, ["k"], "n").select("n", "k").collect()}
    assert got == {(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "c"), (5, "a"), (5, "c")}


def test_guarded(spark):
    left = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 3, 2)], "k string, v int, o int")
    right = spark.createDataFrame([("a", 10), ("b", 20), ("b", 30)], "k string, w int")
    assert [(r["k"], r["v_1"], r["w_2"]) for r in align.guarded(left, right, ["k"], ["o"]).collect()] == [("a", 1, 10)]


def test_stream_like_table(spark, tmp_path):
    rows = [(f"T{i % 7}", "p", "o", "e", [None, "AssertionError > ", "LLMExecutionError > x"][i % 3], 0.5) for i in range(30)]
    table = spark.createDataFrame(rows, schemas.PREDICTION_LOG)
    table.repartition(3).write.option("header", True).csv(str(tmp_path / "in"))
    stream = L.nulls(W.follow(spark, str(tmp_path / "in"), schemas.PREDICTION_LOG))
    q = W.append_to(stream, str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination()
    back = spark.read.parquet(str(tmp_path / "out"))
    got, want = (sorted(map(tuple, W.counters(x, ["task_id"]).collect())) for x in (back, table))
    assert got == want and W.first_answers(back).count() == 7


@pytest.mark.parametrize("window", [W.tumbling, W.sliding])
def test_windows_on_a_stream(spark, tmp_path, window):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = window(stream).writeStream.format("memory").queryName(f"w_{window.__name__}").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: str([x if not isinstance(x, float) else round(x, 4) for x in r])
    assert sorted(map(key, spark.table(f"w_{window.__name__}").collect())) == sorted(map(key, window(events).collect()))


def test_documents_opened_again(spark, tmp_path):
    schema = StructType.fromDDL("_id int, x string")
    path = str(tmp_path / "again")
    L.Documents(spark, path, schema).replace(spark.createDataFrame([(1, "a")], schema))
    again = L.Documents(spark, path, schema)
    assert again.version == 1
    again.upsert(spark.createDataFrame([(2, "b")], schema))
    (tmp_path / "again" / "v9").mkdir()  # a version that was not written to its end
    assert sorted(map(tuple, L.Documents(spark, path, schema).read().collect())) == [(1, "a"), (2, "b")]


def test_retried():
    calls = []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "ok"

    assert L.retried(call, wait=0) == "ok" and len(calls) == 3
    with pytest.raises(ConnectionError):
        L.retried(lambda: (_ for _ in ()).throw(ConnectionError()), times=2, wait=0)


def test_numbered(spark):
    from veriscope.operators.align import numbered

    rows = [(i * 7 % 101, str(i)) for i in range(101)]
    got = sorted((r["n"], r["k"]) for r in numbered(spark.createDataFrame(rows, "k int, v string"), "k", "n").collect())
    assert got == [(i, i) for i in range(101)]


def test_a_log_is_no_single_task(spark, tmp_path):
    """One mutation's rows are written by every task that has some, and no task sorts its rows before."""
    from pathlib import Path

    from pyspark.sql import functions as F
    from veriscope import scratch
    from veriscope.plans import catalog

    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").repartition(12).write.parquet(f"{tmp_path}/lineitem.parquet")
    top = Path(scratch.folder(spark).removeprefix("file://").removeprefix("file:"))
    before = set(top.glob("veriscope-*"))
    got = {r["log"]: r["n"] for r in catalog.QUERIES["s8_logs_by_name"](spark, str(tmp_path)).collect()}
    want = spark.read.parquet(f"{tmp_path}/lineitem.parquet").groupBy("l_linenumber").agg(F.count("*").alias("n")).collect()
    assert got == {r["l_linenumber"]: r["n"] for r in want if r["l_linenumber"] in (3, 5)}
    (made,) = set(top.glob("veriscope-*")) - before
    assert len(list(made.glob("log=3/*.parquet"))) > 1

    write = lambda: spark.range(9).selectExpr("id", "id % 3 log").write.partitionBy("log").mode("overwrite").parquet(f"{tmp_path}/out")
    with scratch.unsorted(spark, 16):
        write()
        assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "16"
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0" and spark.read.parquet(f"{tmp_path}/out").count() == 9
