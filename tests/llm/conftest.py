import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def hard(spark):
    """The hard texts, one row repeated, one without id, and columns whose names operators use inside."""
    from plain import HARD
    from pyspark.sql import functions as F

    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(HARD)] + [(3, HARD[3], "en", "s0", 3), (None, "a b c d e f", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("fp", "row", "k0", "w_", "base", "id", "slot_x")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
