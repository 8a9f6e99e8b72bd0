"""Registered queries against their SQL in DuckDB, and what every query returns."""

import duckdb
import pytest

from veriscope.llm import registry

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op2_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op4_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op5_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op6_simhash": ["doc_id", "fingerprint", "component_id"],
    "op7_brown": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op8_ann": ["query_id", "rank", "vec_id", "score"],
    "op9_crf": ["doc_id", "held_out", "lang_pred", "score"],
    "op10_suffix": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
}


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(name, spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    r = con.execute(registry.ORACLE[name])
    at = [[c[0] for c in r.description].index(c) for c in cols]
    want = sorted(tuple(norm(row[i]) for i in at) for row in r.fetchall())
    assert sorted(tuple(map(norm, x)) for x in df.select(cols).collect()) == want


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(name, spark):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    kinds = dict(df.dtypes)
    assert all(kinds[c] == "bigint" for c in COLUMNS[name] if c.startswith("n_") or c.endswith("_id") or c == "train_tokens")
    assert all(kinds[c] == "boolean" for c in ("held_out", "kept", "base_failed") if c in COLUMNS[name])
