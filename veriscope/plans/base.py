"""Tables under test bound to the engine's concepts, for DataFrames and for SQL alike.

An outcome log is read off ``lineitem``: the part is the task, the supplier the model, the line status
says original or mutated, the line number stands for a mutation, and the return flag and tax for the
way an answer ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The order in which rows of a log count as first.
ORDER = ["l_orderkey", "mutation", "model", "price", "day"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, tax = F.col("l_returnflag"), F.col("l_tax")
    failure = (
        F.when(flag == "A", F.lit(None).cast("string"))
        .when((flag == "N") & (tax < 0.01), "MutationCheckFailedError > AssertionError")
        .when((flag == "N") & (tax < 0.02), "could_not_parse_LLM_answer")
        .when(flag == "N", "AssertionError > ")
        .when(tax >= 0.07, "LLMExecutionError > no answer")
        .otherwise("LLMExecutionRuntimeError > timeout")
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("task"),
        F.col("l_suppkey").alias("model"),
        F.col("l_linestatus").alias("variant"),
        F.col("l_linenumber").alias("mutation"),
        "l_orderkey",
        F.when(F.col("l_quantity") <= 45, F.col("l_quantity")).alias("output"),
        F.col("l_discount").alias("conf"),
        failure.alias("failure"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_shipdate").alias("day"),
    )


LOG = """log AS (SELECT l_partkey AS task, l_suppkey AS model, l_linestatus AS variant, l_linenumber AS mutation, l_orderkey,
  CASE WHEN l_quantity <= 45 THEN l_quantity END AS output, l_discount AS conf,
  CASE WHEN l_returnflag = 'A' THEN NULL WHEN l_returnflag = 'N' AND l_tax < 0.01 THEN 'MutationCheckFailedError > AssertionError'
    WHEN l_returnflag = 'N' AND l_tax < 0.02 THEN 'could_not_parse_LLM_answer' WHEN l_returnflag = 'N' THEN 'AssertionError > '
    WHEN l_tax >= 0.07 THEN 'LLMExecutionError > no answer' ELSE 'LLMExecutionRuntimeError > timeout' END AS failure,
  l_extendedprice AS price, l_shipdate AS day FROM lineitem)"""


def correct(f: str) -> str:
    return f"({f} IS NULL)"


def wrong(f: str) -> str:
    return f"coalesce((contains({f}, 'AssertionError') AND NOT contains({f}, 'Mutation')) OR contains({f}, 'could_not_parse_LLM_answer'), false)"


def invalid(f: str) -> str:
    return f"coalesce(contains({f}, 'LLMExecutionRuntimeError') OR contains({f}, 'LLMExecutionError'), false)"


def first(source: str, keys: str, where: str = "true") -> str:
    return f"(SELECT * FROM {source} WHERE {where} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY l_orderkey, mutation, model, price, day) = 1)"


#: The two variants aligned by task: a the original, b the mutated.
ALIGNED = f"""WITH {LOG}, al AS (SELECT a.task, a.failure AS f1, b.failure AS f2, a.output AS o1, b.output AS o2, a.conf AS c1, b.conf AS c2, a.l_orderkey AS k1
  FROM {first("log", "task", "variant = 'O'")} a JOIN {first("log", "task", "variant = 'F'")} b ON a.task = b.task),
fl AS (SELECT *, {correct("f1")} AS R1, {wrong("f1")} AS W1, {invalid("f1")} AS I1, {correct("f2")} AS R2, {wrong("f2")} AS W2, {invalid("f2")} AS I2, coalesce(o1 <> o2, true) AS df FROM al),
v AS (SELECT *, (R1 OR W1 OR I1) AND (R2 OR W2 OR I2) AS compared, (R1 AND (W2 OR I2)) OR ((W1 OR I1) AND R2) OR (W1 AND W2 AND df) OR (W1 AND I2) OR (I1 AND W2) AS inc FROM fl)
"""
COUNTS = """count(*) AS total_tasks, count(*) FILTER (compared) AS compared, count(*) FILTER (inc) AS inconsistent,
 count(*) FILTER (inc AND W1) AS incorrect_original, count(*) FILTER (inc AND W2) AS incorrect_mutated, count(*) FILTER (inc AND I1) AS invalid_original, count(*) FILTER (inc AND I2) AS invalid_mutated,
 count(*) FILTER (inc AND NOT (I1 OR I2) AND NOT (W1 AND W2)) AS correctness, count(*) FILTER (inc AND W1 AND W2) AS incorrectness, count(*) FILTER (inc AND (I1 OR I2)) AS invalid,
 count(*) FILTER (inc)::DOUBLE AS distance, count(*) FILTER (R1 OR W1) AS answered_1, count(*) FILTER (R2 OR W2) AS answered_2, count(*) FILTER (R1) AS success_1, count(*) FILTER (R2) AS success_2"""


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v).lower() if isinstance(v, bool) else repr(v)


def values(columns: str, rows: list[tuple]) -> str:
    """The rows as SQL, with the types that ``columns`` gives."""
    named = [c.split() for c in columns.split(", ")]
    cast = ", ".join(f'"{n}"::{t} AS "{n}"' for n, t in named)
    return f"SELECT {cast} FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({', '.join(f'"{n}"' for n, _ in named)})"
