"""Queries over outcome logs that combine what :mod:`veriscope.plans.outcomes` has apart."""

from __future__ import annotations

import ast
import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from veriscope import scratch
from veriscope.functions import outcome as O
from veriscope.functions.programs import same_answer, value_of
from veriscope.functions.text import literal_answer, prompt_for
from veriscope.operators import metrics as M
from veriscope.plans.base import ALIGNED, LOG, log, table, values
from veriscope.plans.checked import CHECKED
from veriscope.plans.outcomes import _CATEGORY, _LOG_NAME, THRESHOLDS, _by_category, _log_name, aligned
from veriscope.sources import logs as L

QUERIES: dict = {}
ORACLE: dict = {}

#: The benchmarks of each task, and which mutations a task takes.
BENCHMARKS = {
    "code_generation": ("HumanEval", "BigCodeBench", "Turbulence"),
    "input_prediction": ("HumanEval", "CruxEval", "Turbulence"),
    "output_prediction": ("HumanEval", "CruxEval", "Turbulence"),
    "mcq_inconsistency": ("CodeMMLU",),
}


def check_options(task: str, benchmark: str, mutations: list[str]) -> None:
    """Raises before anything is planned."""
    if benchmark not in BENCHMARKS.get(task, ()):
        raise ValueError(f"{task} has no benchmark {benchmark}")
    known = {n for g in O.CATEGORY.values() for n in g} if task != "code_generation" else set(O.CATEGORY["Lexical"])
    if unknown := {*mutations} - known:
        raise ValueError(f"{task} takes no {sorted(unknown)}")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("p8_select_rename_reorder", "SELECT l_suppkey AS model_key, l_orderkey AS run_order, l_quantity AS run_quantity FROM lineitem WHERE l_linenumber = 7")
def p8(s, d):
    own = table(s, d, "lineitem").filter("l_linenumber = 7").select("l_quantity", "l_orderkey", "l_suppkey")
    named = own.withColumnsRenamed({"l_quantity": "run_quantity", "l_orderkey": "run_order", "l_suppkey": "model_key"})
    return named.select(sorted(named.columns, key=lambda c: (c != "model_key", c.lower())))


@query("g2_success_of_unmatched", f"WITH {LOG} SELECT variant, count(*) FILTER (failure IS NULL) AS success, count(*) AS answers FROM log GROUP BY 1")
def g2(s, d):
    return log(s, d).groupBy("variant").agg(M.count(O.correct(F.col("failure"))).alias("success"), F.count("*").alias("answers"))


@query("g6_distance_sum", ALIGNED + "SELECT sum(CASE WHEN inc THEN 1 ELSE 0 END)::DOUBLE AS distance FROM v")
def g6(s, d):
    different = O.differs(F.col("output_1"), F.col("output_2"))
    return aligned(s, d).agg(F.sum(O.verdict(F.col("failure_1"), F.col("failure_2"), different, different.cast("double"))["distance"]).alias("distance"))


@query("g11_without_ensembles", f"SELECT n AS log, count(*) AS k FROM (SELECT {_LOG_NAME} AS n FROM lineitem) WHERE NOT contains(n, 'constant_unfold') GROUP BY 1")
def g11(s, d):
    own = table(s, d, "lineitem").select(_log_name().alias("log"))
    return own.filter(~F.col("log").contains("constant_unfold")).groupBy("log").agg(F.count("*").alias("k"))


@query("g12_second_order", f"SELECT CASE WHEN n LIKE '%for2while_demorgan' THEN 'Second Order' ELSE 'Atomic' END AS order_class, count(*) FILTER (l_returnflag <> 'A') AS bad, count(*) AS k FROM (SELECT {_LOG_NAME} AS n, l_returnflag FROM lineitem) GROUP BY 1")
def g12(s, d):
    return table(s, d, "lineitem").groupBy(O.order_class(_log_name()).alias("order_class")).agg(M.count(F.col("l_returnflag") != "A").alias("bad"), F.count("*").alias("k"))


@query("g14_benchmark_rollup", "WITH x AS (SELECT p_brand AS benchmark, l_returnflag <> 'A' AS bad, CASE WHEN l_linenumber <= 3 THEN 'Lexical' WHEN l_linenumber <= 5 THEN 'Syntactic' ELSE 'Logical' END AS category FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT benchmark, category, count(*) FILTER (bad) AS n, count(*) AS d FROM x GROUP BY ROLLUP (benchmark, category)")
def g14(s, d):
    own = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    category = F.when(F.col("l_linenumber") <= 3, "Lexical").when(F.col("l_linenumber") <= 5, "Syntactic").otherwise("Logical")
    return own.select(F.col("p_brand").alias("benchmark"), category.alias("category"), (F.col("l_returnflag") != "A").alias("bad")).rollup("benchmark", "category").agg(M.count(F.col("bad")).alias("n"), F.count("*").alias("d"))


@query("g16_grand_total", _CATEGORY + "SELECT model, category, count(*) FILTER (bad) AS n, count(*) AS d FROM c GROUP BY GROUPING SETS ((model, category), (model), (category), ())")
def g16(s, d):
    own = _by_category(s, d)
    return own.groupingSets([("model", "category"), ("model",), ("category",), ()], "model", "category").agg(M.count(F.col("bad")).alias("n"), F.count("*").alias("d"))


@query("g27_merge_by_threshold", "SELECT t AS threshold, count(*) AS answers, count(*) FILTER (l_discount >= t) AS above FROM lineitem, (SELECT unnest([0.0, 0.02, 0.04, 0.06, 0.08, 0.09, 0.1]::DOUBLE[]) AS t) GROUP BY 1")
def g27(s, d):
    own = table(s, d, "lineitem").withColumn("threshold", F.explode(F.array(*map(F.lit, THRESHOLDS))))
    by_model = own.groupBy("l_suppkey", "threshold").agg(F.count("*").alias("a"), M.count(F.col("l_discount") >= F.col("threshold")).alias("b"))
    return by_model.groupBy("threshold").agg(F.sum("a").alias("answers"), F.sum("b").alias("above"))


@query("g34_failures_last", "SELECT l_orderkey AS id, array_to_string(list(l_linenumber ORDER BY l_returnflag = 'R', l_linenumber), ',') AS tests FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem) GROUP BY 1")
def g34(s, d):
    own = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").distinct()
    tests = own.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct((F.col("l_returnflag") == "R").alias("failed"), "l_linenumber"))).alias("x"))
    return tests.select("id", F.array_join(F.transform("x", lambda e: e["l_linenumber"].cast("string")), ",").alias("tests"))


@query("g38_pass_counter", "SELECT quality = 1 AS passed, toxic = 1 AS toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def g38(s, d):
    return table(s, d, "labels").groupBy((F.col("quality") == 1).alias("passed"), (F.col("toxic") == 1).alias("toxic")).agg(F.count("*").alias("n"))


@query("w8_ordinal_ids", "SELECT p_partkey, concat(p_brand, '_', row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)) AS task_id FROM part")
def w8(s, d):
    return table(s, d, "part").select("p_partkey", F.concat_ws("_", "p_brand", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))).alias("task_id"))


@query("w9_ranks", "SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS q, lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS before, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS after FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)")
def w9(s, d):
    a, b = Window.partitionBy("c_nationkey").orderBy("c_mktsegment"), Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    return table(s, d, "customer").select("c_custkey", F.rank().over(a).alias("r"), F.dense_rank().over(a).alias("dr"), F.ntile(4).over(b).alias("q"), F.lag("c_custkey").over(b).alias("before"), F.lead("c_custkey").over(b).alias("after"))


@query("o1_sorted_by_key", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey")
def o1(s, d):
    return table(s, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey")


@query("o4_lists_as_multisets", "WITH x AS (SELECT l_orderkey AS id, list_sort(list(l_suppkey % 2)) AS a, list_sort(list(l_partkey % 2)) AS b FROM lineitem GROUP BY 1) SELECT id, a = b AS same FROM x")
def o4(s, d):
    x = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.col("l_suppkey") % 2).alias("a"), F.collect_list(F.col("l_partkey") % 2).alias("b"))
    return x.select("id", (F.array_sort("a") == F.array_sort("b")).alias("same"))


@query("s8_logs_by_name", f"WITH {LOG} SELECT mutation AS log, count(*) AS n FROM log WHERE mutation IN (3, 5) GROUP BY 1")
def s8(s, d):
    """Logs in one folder a mutation, of which those are read whose folder the predicate names."""
    path = f"{scratch.folder(s)}/veriscope-{uuid.uuid4().hex}"
    with scratch.unsorted(s, 16):  # each task its part of each log: one may be larger than a task's memory
        log(s, d).select("task", "failure", F.col("mutation").alias("log")).write.partitionBy("log").parquet(path)
    return s.read.parquet(path).filter(F.col("log").isin(3, 5)).groupBy(F.col("log").cast("int").alias("log")).agg(F.count("*").alias("n"))


@query("s9_baseline_and_rest", "SELECT 2 AS baseline_rows, 1 AS other_rows")
def s9(s, d):
    rows = s.createDataFrame([("a_no_mutation", 1), ("b_no_mutation", 2), ("b_no_mutation", 3)], "file_name string, x int")
    own, rest = L.baseline(rows)
    return own.agg(F.count("*").cast("int").alias("baseline_rows")).join(rest.agg(F.count("*").cast("int").alias("other_rows")))  # one row each


@query("s12_clamped_count", "SELECT least(count(*) - 10, 500) AS n FROM documents")
def s12(s, d):
    return table(s, d, "documents").agg(F.least(F.count("*") - 10, F.lit(500)).alias("n"))


@query("s18_parameters", "SELECT 0 AS ord, '1,2,3' AS p UNION ALL SELECT 1, '4,5'")
def s18(s, d):
    path = f"{scratch.folder(s)}/veriscope-{uuid.uuid4().hex}"
    s.createDataFrame([("1 2  3\n\n4 5",)], "value string").coalesce(1).write.text(path)
    return L.read_parameters(s, path).select("ord", F.array_join(F.transform("params", lambda x: x.cast("string")), ",").alias("p"))


@query("x18_literal_values", values(*CHECKED["x18_literal_values"]))
def x18(s, d):
    @F.pandas_udf("data string, metadata string")
    def value(x: pd.Series) -> pd.DataFrame:
        out = []
        for t in x:
            try:
                v = value_of(ast.parse(t, mode="eval").body)
                out.append((str(v), type(v).__name__))
            except (ValueError, SyntaxError, TypeError, KeyError, ZeroDivisionError):
                out.append((None, None))
        return pd.DataFrame(out, columns=["data", "metadata"])

    own = s.createDataFrame([("1 + 2 * 3",), ("[1, (2, -3)]",), ("set([1])",), ("open('x')",), ("2 ** 10",)], "text string")
    return own.withColumn("v", value("text")).select("text", "v.data", "v.metadata")


@query("x35_generated_inputs", "SELECT p_partkey AS id, i, ('0x' || substr(md5('1234:' || p_partkey || ':' || i), 1, 7))::BIGINT % 100 AS value FROM part, (SELECT unnest([0, 1, 2, 3, 4]) AS i)")
def x35(s, d):
    """Five inputs a task, which seed, task and number decide: the same on every machine and retry."""
    own = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    h = F.md5(F.concat_ws(":", F.lit("1234"), F.col("id").cast("string"), F.col("i").cast("string")).cast("binary"))
    return own.select("id", "i", (F.conv(F.substring(h, 1, 7), 16, 10).cast("bigint") % 100).alias("value"))


@query("x36_equalities", values(*CHECKED["x36_equalities"]))
def x36(s, d):
    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([same_answer(ast.literal_eval(x), ast.literal_eval(y)) for x, y in zip(a, b)])

    own = s.createDataFrame([("[1, 2]", "[2, 1]"), ("(1, 2)", "(2, 1)"), ("[[1, 2], [3, 4]]", "[[3, 4], [1, 2]]"), ("1", "True"), ("{1: 2}", "{1: 2}")], "a string, b string")
    return own.withColumn("same", same("a", "b"))


@query("t28_tagged_values", "SELECT p_partkey AS id, p_size::VARCHAR AS data, 'int' AS metadata FROM part")
def t28(s, d):
    return table(s, d, "part").withColumn("v", literal_answer(F.col("p_size").cast("string"), unwrap=False)).select(F.col("p_partkey").alias("id"), "v.data", "v.metadata")


@query("t24_prompt_dispatch", "SELECT task, shot, contains(text, '{examples}') AS with_examples FROM (VALUES ('output_prediction', 'few_shot', '{examples}'), ('input_prediction', 'zero_shot', ''), ('mcq_inconsistency', 'zero_shot', '{examples}')) t(task, shot, text)")
def t24(s, d):
    own = s.createDataFrame([("output_prediction", "few_shot"), ("input_prediction", "zero_shot"), ("mcq_inconsistency", "zero_shot")], "task string, shot string")
    return own.withColumn("with_examples", prompt_for(F.col("task"), F.col("shot")).contains("{examples}"))
