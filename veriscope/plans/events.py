"""Event-time windows (an extension) over the table of events, and sources read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriscope import schemas, scratch
from veriscope.plans.base import log, table
from veriscope.sources import logs as L
from veriscope.streaming import logs as W

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("st1_tumbling", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def st1(s, d):
    return W.tumbling(table(s, d, "events")).withColumn("total", F.round("total", 2))


@query("st2_sliding", "SELECT start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start FROM events) GROUP BY 1")
def st2(s, d):
    return W.sliding(table(s, d, "events"))


@query("st3_sessions", "WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events), y AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x) SELECT min(ts) AS start, user_id, count(*) AS n FROM y GROUP BY user_id, g")
def st3(s, d):
    return W.sessions(table(s, d, "events"))


def _folder(s):
    import uuid

    return f"{scratch.folder(s)}/veriscope-{uuid.uuid4().hex}"


@query("s1_log_round_trip", "SELECT count(*) AS rows, count(failure) AS failed, count(DISTINCT output) AS outputs FROM (SELECT CASE l_returnflag WHEN 'A' THEN NULL ELSE l_returnflag END AS failure, l_comment AS output FROM (SELECT *, concat('a \"b\"', chr(10), l_partkey % 10) AS l_comment FROM lineitem))")
def s1(s, d):
    """A log with cells of several lines and quotes, written as CSV and read back."""
    own = table(s, d, "lineitem")
    rows = own.select(F.concat_ws("_", "l_orderkey", "l_partkey").alias("task_id"), F.lit("p").alias("prompt"), F.concat(F.lit('a "b"\n'), F.col("l_partkey") % 10).alias("model_output"), F.lit("e").alias("expected_output"), F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("failure_type"), F.lit(0.5).alias("geometric"))
    L.write_csv(rows, path := _folder(s))
    back = L.read_log(s, path)
    return back.agg(F.count("*").alias("rows"), F.count("failure_type").alias("failed"), F.count_distinct("model_output").alias("outputs"))


@query("s5_jsonl_to_csv", "SELECT count(*) AS n, sum((props::JSON ->> 'k')::BIGINT)::BIGINT AS k FROM events")
def s5(s, d):
    source, target = _folder(s), _folder(s)
    table(s, d, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k")).write.json(source)
    L.jsonl_to_csv(s, source, target, "k bigint")
    return s.read.schema("k bigint").csv(target, header=True).agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query("s6_nested_results", "SELECT l_linenumber::VARCHAR AS name, count(*) FILTER (l_returnflag = 'N') AS total_inconsistencies, count(*) AS total_tasks FROM lineitem GROUP BY 1")
def s6(s, d):
    n = table(s, d, "lineitem").groupBy("l_linenumber").agg(F.sum((F.col("l_returnflag") == "N").cast("bigint")).alias("total_inconsistencies"), F.count("*").alias("total_tasks"))
    one = n.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("l_linenumber").cast("string"), F.struct("total_inconsistencies", "total_tasks"))))).alias("value"))
    one.write.text(path := _folder(s))
    return L.read_results(s, path).select("name", "total_inconsistencies", "total_tasks")


@query("s13_upsert", "SELECT d.doc_id, d.source, CASE WHEN l.doc_id IS NULL THEN d.lang ELSE 'new' END AS lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def s13(s, d):
    own = table(s, d, "documents").select("doc_id", "source", "lang")
    store = L.Documents(s, _folder(s), own.schema, "doc_id")
    store.replace(own)
    store.upsert(table(s, d, "labels").select("doc_id", F.lit("new").alias("lang")))
    return store.read()


@query("s15_delete", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def s15(s, d):
    own = table(s, d, "documents").select("doc_id")
    store = L.Documents(s, _folder(s), own.schema, "doc_id")
    store.replace(own)
    store.delete(table(s, d, "labels").select("doc_id"))
    return store.read()


@query("s19_manifest", "SELECT l_suppkey::VARCHAR AS run, count(*) AS tasks, true AS adds_up FROM lineitem GROUP BY 1")
def s19(s, d):
    n = table(s, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    runs = n.groupBy(F.col("l_suppkey").cast("string").alias("run")).agg(F.sum("n").cast("int").alias("tasks_requested"), F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("outcomes"))
    L.write_json(runs, path := _folder(s))
    back = s.read.schema(schemas.MANIFEST).json(path)
    return back.select("run", F.col("tasks_requested").cast("bigint").alias("tasks"), L.outcomes_add_up(back).alias("adds_up"))


@query("s24_report", "SELECT '<table><tr><th>r_regionkey</th><th>r_name</th><th>nations</th></tr>' || string_agg('<tr><td>' || r_regionkey || '</td><td>' || r_name || '</td><td>' || n || '</td></tr>', '' ORDER BY r_regionkey) || '</table>' AS html FROM (SELECT r_regionkey, concat('&amp; ', r_name) AS r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1, 2)")
def s24(s, d):
    n = table(s, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("nations"))
    return L.html_table(table(s, d, "region").join(n, "r_regionkey").select("r_regionkey", F.concat(F.lit("& "), "r_name").alias("r_name"), "nations"), "r_regionkey")


@query("s21_replay", "SELECT conv_id, turn, concat('> ', text) AS answer FROM conversations")
def s21(s, d):
    own = table(s, d, "conversations")
    recorded = own.select(F.col("text").alias("prompt"), F.concat(F.lit("> "), "text").alias("model_output"), F.lit(0.1).alias("latency")).dropDuplicates(["prompt"])
    return L.Replay(recorded).answer(own.withColumnRenamed("text", "prompt")).select("conv_id", "turn", F.col("model_output").alias("answer"))


@query("s23_partitioned_instances", "SELECT l_suppkey % 10 AS model, l_linenumber AS round, count(*) AS n FROM lineitem GROUP BY 1, 2")
def s23(s, d):
    own = log(s, d).select((F.col("model") % 10).alias("model"), F.col("mutation").alias("round"), "output")
    with scratch.unsorted(s, 128):
        L.write_instances(own.repartition("model", "round"), path := _folder(s), ["model", "round"])
    return s.read.parquet(path).groupBy(F.col("model").cast("bigint").alias("model"), F.col("round").cast("int").alias("round")).agg(F.count("*").alias("n"))
