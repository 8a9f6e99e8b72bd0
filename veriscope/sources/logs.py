"""Reading and writing logs, result files, task documents and templates.

Every reader takes an explicit schema.  CSV cells may span lines, and the usual marks of a missing
cell become null.  A read keeps the file and an ordinal of the row in it (``file_name``, ``ordinal``)
where an order of rows matters, since a table has none.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from veriscope import schemas
from veriscope.operators.align import upsert


def nulls(df: DataFrame, missing=schemas.MISSING) -> DataFrame:
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name != "file_name"]
    return df.withColumns({c: F.when(~F.col(c).isin(*missing), F.col(c)) for c in text})


def read_log(spark: SparkSession, path: str | list[str], schema: str | StructType = schemas.PREDICTION_LOG) -> DataFrame:
    """A CSV log or a folder of them; header rows repeated inside a file are dropped."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    own = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    raw = spark.read.schema(own).option("columnNameOfCorruptRecord", "_corrupt_record").csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", enforceSchema=True)
    named = raw.select(*schema.fieldNames(), F.col("_metadata.file_name").alias("file_name"), F.monotonically_increasing_id().alias("ordinal"))
    key = schema.fieldNames()[0]
    return nulls(named.filter(F.coalesce(F.col(key) != key, F.lit(True))))


def named(df: DataFrame, contains: list[str] = (), without: list[str] = ()) -> DataFrame:
    """Rows of files whose name holds all of some texts and none of others."""
    name = F.col("file_name")
    for x in contains:
        df = df.filter(name.contains(x))
    for x in without:
        df = df.filter(~name.contains(x))
    return df


def baseline(df: DataFrame, mark: str = "no_mutation") -> tuple[DataFrame, DataFrame]:
    """The last log, by name, that holds the mark; and the rows of all other files."""
    last = df.filter(F.col("file_name").contains(mark)).agg(F.max("file_name").alias("file_name"))
    return df.join(F.broadcast(last), "file_name", "left_semi"), df.join(F.broadcast(last), "file_name", "left_anti")  # one row


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """Overwrite; ``single`` makes one file for people to read, and is for small tables."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def jsonl_to_csv(spark: SparkSession, source: str, target: str, schema: str | StructType) -> None:
    write_csv(spark.read.schema(schema).json(source), target)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Nested result files as rows: file, mutation or category, and its metrics."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file_name"))
    return raw.select("file_name", F.explode(F.from_json("value", schemas.RESULT)).alias("name", "m")).select("file_name", "name", "m.*")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path)


def outcomes_add_up(manifest: DataFrame) -> Column:
    return F.aggregate(F.map_values("outcomes"), F.lit(0).cast("bigint"), lambda s, x: s + x) == F.col("tasks_requested")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PROFILE).json(path)


def read_template(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("file_name"))


def read_parameters(spark: SparkSession, path: str, most: int = 20) -> DataFrame:
    """The first rows of a parameter file: an array of integers each, with its ordinal."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.slice(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != ""), 1, most)).alias("ord", "line"))
    return raw.select("ord", F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.cast("int")).alias("params"))


def write_instances(df: DataFrame, path: str, by: list[str]) -> None:
    """One partitioned table in place of a file for each instance."""
    df.write.mode("append").partitionBy(*by).parquet(path)


class Documents:
    """A table of documents in a folder, replaced as a whole by every change: a new version is written
    beside the old one, and readers name the version.  The last version that was written whole is the table's."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "_id"):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v*/_SUCCESS")
        found = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(done)
        self.version = max((int(f.getPath().getParent().getName()[1:]) for f in found), default=0)

    def read(self) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{self.version}")

    def _write(self, df: DataFrame) -> None:
        df.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/v{self.version + 1}")
        self.version += 1

    def upsert(self, new: DataFrame) -> None:
        """Insert, or overwrite the fields that the new rows have."""
        have = [c for c in self.schema.fieldNames() if c in new.columns]
        rest = [c for c in self.schema.fieldNames() if c not in new.columns]
        full = new.select(*have).join(self.read().select(self.key, *rest), self.key, "left")
        self._write(upsert(self.read(), full.select(*self.schema.fieldNames()), self.key))

    def replace(self, new: DataFrame) -> None:
        """Insert, or replace whole documents."""
        rest = {c: F.lit(None).cast(self.schema[c].dataType) for c in self.schema.fieldNames() if c not in new.columns}
        self._write(upsert(self.read(), new.withColumns(rest).select(*self.schema.fieldNames()), self.key))

    def delete(self, keys: DataFrame) -> None:
        self._write(self.read().join(keys, self.key, "left_anti"))

    def find(self, key) -> DataFrame:
        return self.read().filter(F.col(self.key) == key)


def html_table(df: DataFrame, order: str) -> DataFrame:
    """A report of a small table as one cell of HTML, its rows by ``order``, what it holds escaped."""

    def cell(c: str) -> Column:
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(a), F.lit(b))
        return F.concat(F.lit("<td>"), text, F.lit("</td>"))

    head = "<tr>" + "".join(f"<th>{c}</th>" for c in df.columns) + "</tr>"
    rows = df.select(F.col(f"`{order}`").alias("o_"), F.concat(F.lit("<tr>"), *map(cell, df.columns), F.lit("</tr>")).alias("r_"))
    every = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_", "r_"))), lambda x: x["r_"]), "")
    return rows.agg(F.concat(F.lit(f"<table>{head}"), every, F.lit("</table>")).alias("html"))


def retried(call: Callable, times: int = 3, wait: float = 1.0):
    """What ``call()`` returns, tried again after a doubling pause where the connection fails."""
    for i in range(times):
        try:
            return call()
        except (ConnectionError, TimeoutError):
            if i + 1 == times:
                raise
            time.sleep(wait * 2**i)


class ResponseSource(Protocol):
    def answer(self, prompts: DataFrame) -> DataFrame: ...


class Replay:
    """Recorded answers by prompt, in place of a live model."""

    def __init__(self, recorded: DataFrame):
        self.recorded = recorded

    def answer(self, prompts: DataFrame) -> DataFrame:
        return prompts.join(self.recorded.select("prompt", "model_output", "latency"), "prompt", "left")


def range_spec(text: str) -> list[int]:
    """'1-3,7' as integers."""
    out: list[int] = []
    for part in filter(None, re.split(r"\s*,\s*", text.strip())):
        lo, _, hi = part.partition("-")
        out += range(int(lo), int(hi or lo) + 1)
    return out
