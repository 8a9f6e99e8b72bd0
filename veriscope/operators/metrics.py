"""Counts and rates over compared logs; ratios stay numbers, formatting is for the edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriscope.functions import outcome as O


def count(flag: Column) -> Column:
    return F.coalesce(F.sum(flag.cast("bigint")), F.lit(0).cast("bigint"))


def comparison(aligned: DataFrame, by: list[str], f1: str, f2: str, out1: str, out2: str) -> DataFrame:
    """Per group, what comparing two aligned logs counts: one aggregate over one verdict a row."""
    different = O.differs(F.col(out1), F.col(out2))
    v = aligned.withColumn("v", O.verdict(F.col(f1), F.col(f2), different, different.cast("double")))
    return v.groupBy(*by).agg(
        F.count("*").alias("total_tasks"),
        count(F.col("v.compared")).alias("compared"),
        count(F.col("v.inconsistent")).alias("inconsistent"),
        *[count(F.array_contains("v.incorrect", d)).alias(f"incorrect_{d.lower()}") for d in (O.ORIGINAL, O.MUTATED)],
        *[count(F.array_contains("v.invalid", d)).alias(f"invalid_{d.lower()}") for d in (O.ORIGINAL, O.MUTATED)],
        *[count(F.coalesce(F.col("v.kind") == k, F.lit(False))).alias(k.split()[0].lower()) for k in (O.CORRECTNESS, O.INCORRECTNESS, O.INVALID)],
        F.sum("v.distance").alias("distance"),
        count(O.answered(F.col(f1))).alias("answered_1"),
        count(O.answered(F.col(f2))).alias("answered_2"),
        count(O.correct(F.col(f1))).alias("success_1"),
        count(O.correct(F.col(f2))).alias("success_2"),
    )


def neighbourhood(log: DataFrame, group: list[str], failure: str, output: str) -> DataFrame:
    """Compared and inconsistent pairs of each group without making a pair.

    With c correct, w wrong and i invalid rows: all pairs of classified rows are compared, and those
    are inconsistent that hold a correct and another, a wrong and an invalid, or two wrong rows
    of different outputs, where a missing output differs from every other.
    """
    f = F.col(failure)
    sizes = log.groupBy(*group, F.when(O.wrong(f), F.col(output)).alias("o_"), (O.wrong(f) & F.col(output).isNotNull()).alias("w_")).agg(count(O.correct(f)).alias("c"), count(O.wrong(f)).alias("w"), count(O.invalid(f)).alias("i"))
    half = lambda n: F.floor(n * (n - 1) / 2)
    t = sizes.groupBy(*group).agg(F.sum("c").alias("c"), F.sum("w").alias("w"), F.sum("i").alias("i"), F.sum(F.when(F.col("w_"), half(F.col("w"))).otherwise(0)).alias("same"))
    n = F.col("c") + F.col("w") + F.col("i")
    return t.select(*group, "c", "w", "i", half(n).alias("compared"), (F.col("c") * (F.col("w") + F.col("i")) + F.col("w") * F.col("i") + half(F.col("w")) - F.col("same")).alias("inconsistent"))


def inconsistent_templates(log: DataFrame, template: str, failure: str) -> DataFrame:
    """Per template: whether a row is scored, and whether its rows end in more than one way."""
    f = F.col(failure)
    scored = f.isNull() | (O.has(f, "AssertionError") & ~F.coalesce(F.lower(f).contains("mutation"), F.lit(False)))
    return log.groupBy(template).agg(F.max(scored).alias("valid"), (F.count_distinct(F.coalesce(F.trim(f), F.lit("nan"))) > 1).alias("inconsistent"))


def correctness_score(x: DataFrame, by: list[str], passed: str, n: str) -> DataFrame:
    """p, its standard deviation and standard error, for ``n`` trials a group."""
    t = x.groupBy(*by).agg(count(F.col(passed)).alias("s"), F.max(n).alias("n"))
    p = F.try_divide(F.col("s").cast("double"), F.col("n"))
    return t.select(*by, "s", "n", p.alias("p"), F.sqrt(F.col("n") * p * (1 - p)).alias("sd"), F.sqrt(F.try_divide(p * (1 - p), F.col("n"))).alias("se"))


def geometric_mean(logs: Column) -> Column:
    """exp of the mean of an array of log-probabilities; 0 for none."""
    return F.when(F.size(logs) > 0, F.exp(F.aggregate(logs, F.lit(0.0), lambda s, x: s + x) / F.size(logs))).otherwise(0.0)


def confidence_sweep(aligned: DataFrame, thresholds: list[float], f1: str, f2: str, c1: str, c2: str, out1: str, out2: str, by: list[str]) -> DataFrame:
    """Per group and threshold: compared and inconsistent pairs, answered and correct ones.

    Every row gets the array of thresholds, which is a parameter, and is exploded by it.
    """
    rows = aligned.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    a, b = (O.at_threshold(F.col(f), F.col(c), F.col("threshold")) for f, c in ((f1, c1), (f2, c2)))
    low = "Confidence_lower_than_threshold"
    rows = rows.withColumn("a_", a).withColumn("b_", b)
    x, y = F.col("a_"), F.col("b_")
    bad = lambda f: O.wrong(f) | O.invalid(f) | F.coalesce(f == low, F.lit(False))
    gone = lambda f: O.invalid(f) | F.coalesce(f == low, F.lit(False))
    inconsistent = (O.correct(x) & bad(y)) | (bad(x) & O.correct(y)) | (O.wrong(x) & gone(y)) | (gone(x) & O.wrong(y)) | (O.wrong(x) & O.wrong(y) & O.differs(F.col(out1), F.col(out2)))
    compared = (O.correct(x) | bad(x)) & (O.correct(y) | bad(y))
    return rows.groupBy(*by, "threshold").agg(count(compared).alias("compared"), count(inconsistent).alias("inconsistent"), count(O.answered(y)).alias("answered"), count(O.correct(x) & O.correct(y)).alias("correct"))
