"""What the operators share: words, chunks of Arrow batches, and input columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of code points other than these six white-space characters.
SPACES = " \t\n\v\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same for Java's patterns.
JAVA_SPACES = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(_UPPER, _UPPER.lower())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, _UPPER, _UPPER.lower())


def words(text: Column) -> Column:
    """The words of a text as an array (null: none), by JVM functions alone."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), JAVA_SPACES), "")


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of doc_id as text, modulo ``folds``; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def small(table: DataFrame, rows: int | None = None, most: int = 1 << 20) -> DataFrame:
    """A stored table with the wish to be broadcast where it has at most ``most`` rows (or ``rows`` says so), else as it is."""
    return F.broadcast(table) if (table.count() if rows is None else rows) <= most else table


def chunks(texts: list, size: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of a list of strings with about ``size`` characters each, at least one string."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > size:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def map_texts(docs: DataFrame, make: Callable, tail: str, *, keep: list[str], text_col: str = "text", size: int = 1_000_000) -> DataFrame:
    """A row of new columns ``tail`` for each row, beside the columns ``keep`` as they are.

    ``make()`` gives a task's function from a list of texts (null: empty) to a list of columns.
    Texts come in chunks of about ``size`` characters, which bounds memory; kept columns stay in
    Arrow, so nulls and large integers are exact.  Names of the result may clash with those of
    columns that are not kept.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(tail)
    if {*keep} & {*new.names}:
        raise ValueError(f"columns {sorted({*keep} & {*new.names})} would appear twice")
    own = [f"k{i}" for i in range(len(keep))]
    read = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(keep, own)], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    schema = StructType([*read.schema.fields[:-1], *new.fields])

    def run(batches):
        fn = make()
        types = [to_arrow_type(f.dataType) for f in new.fields]
        for b in batches:
            texts = b.column(len(own)).to_pylist()
            for i, j in chunks(texts, size):
                cols = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(fn(texts[i:j]), types)]
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(len(own))), *cols], names=schema.names)

    return read.mapInArrow(run, schema).withColumnsRenamed(dict(zip(own, keep)))
