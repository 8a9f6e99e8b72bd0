"""Bringing two logs, or a log and a lookup, row by row to the same tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriscope import scratch


def keep_first(log: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in an explicit order, since rows of a table have none.

    An aggregate with partial results instead of a window: a key that a third of the rows share
    leaves each task as one row.
    """
    by = F.struct(*[F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)])
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("r_"))
    return best.select(*keys, *[F.col("r_")[c].alias(c) for c in rest])


def align(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], suffixes: tuple[str, str] = ("_1", "_2")) -> DataFrame:
    """Rows of both logs with the same key, the first of each; columns get a suffix."""

    def side(df: DataFrame, suffix: str) -> DataFrame:
        return keep_first(df, keys, order).withColumnsRenamed({c: c + suffix for c in df.columns if c not in keys})

    return side(left, suffixes[0]).join(side(right, suffixes[1]), keys)


def guarded(left: DataFrame, right: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of the left log, the first of each key, with the right log's row where it is the only one."""
    one = right.groupBy(*keys).agg(F.count("*").alias("n_"), *[F.first(c).alias(c + "_2") for c in right.columns if c not in keys]).filter("n_ = 1").drop("n_")
    return keep_first(left, keys, order).withColumnsRenamed({c: c + "_1" for c in left.columns if c not in keys}).join(one, keys)


def cumulative(target: DataFrame, logs: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Rows of ``logs`` that meet a target that shrinks to what every log so far has.

    A key stands until the first log, in the order of ``ordinal``, that lacks it: logs are numbered
    densely, so that is where a key's own numbers leave a gap.
    """
    numbers = logs.select(ordinal).distinct().withColumn("n_", F.dense_rank().over(Window.orderBy(ordinal)))  # a row a log
    own = logs.join(F.broadcast(numbers), ordinal).join(target.select(*keys).distinct(), keys, "left_semi")
    held = own.groupBy(*keys).agg(F.array_sort(F.collect_set("n_")).alias("s_"))
    until = F.size(F.filter("s_", lambda x, i: x == i + 1)).alias("until_")
    return own.join(held.select(*keys, until), keys).filter("n_ <= until_").drop("n_", "until_")


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """The rows in the order of ``key`` (unique) with their number from zero, without one task that sees them all.

    Ranges of the key are written with the number of their range and numbered apart; the counts of the ranges before
    one, a row a range, are added.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.table(df.repartitionByRange(parts, key).withColumn("p_", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("p_").count().withColumn("before_", F.sum("count").over(Window.orderBy("p_")) - F.col("count"))
    own = F.row_number().over(Window.partitionBy("p_").orderBy(key)) - 1
    return dealt.withColumn("n_", own).join(F.broadcast(sizes), "p_").withColumn(name, F.col("n_") + F.col("before_")).drop("p_", "n_", "count", "before_")


def pairs(log: DataFrame, group: list[str], ordinal: str) -> DataFrame:
    """All unordered pairs of rows in a group; columns of the later row end in _2."""
    later = log.withColumnsRenamed({c: c + "_2" for c in log.columns if c not in group})
    return log.join(later, group).filter(F.col(ordinal) < F.col(ordinal + "_2"))


def lookup(left: DataFrame, right: DataFrame, keys: list[str], default: dict) -> DataFrame:
    """Every row of the left with the right's columns, or defaults."""
    out = left.join(right, keys, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in default.items()})


def merge_counts(a: Column, b: Column) -> Column:
    """Sum of two maps of counts over all their keys; null counts as empty."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return F.map_zip_with(F.coalesce(a, none), F.coalesce(b, none), lambda k, x, y: F.coalesce(x, F.lit(0).cast("bigint")) + F.coalesce(y, F.lit(0).cast("bigint")))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows, and the old ones whose key is not new."""
    return old.join(new, key, "left_anti").unionByName(new)
