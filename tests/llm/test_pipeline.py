"""The pipeline against a plain version of its stages."""

import corpus_pipeline
import plain
import pytest
from pyspark.sql import functions as F

from veriscope.llm import mixing, quality, secrets


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, "").cache()
        out.append((name, before, docs))
    return {name: (before, after) for name, before, after in out}


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_columns(stages):
    for name, (_, after) in list(stages.items())[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_quality_rules(stages, spark):
    before, after = map(by_id, stages["quality_rules"])
    for i, r in before.items():
        n, _, _, _, again = plain.quality(r["text"])
        if n < 10 or 100 * again > 20 * n:
            assert i not in after
    verdict = {r["doc_id"]: r["kept"] for r in quality.quality(stages["quality_rules"][0]).collect()}
    assert {i for i, k in verdict.items() if k} == set(after)
    assert all(before[i] == r for i, r in after.items())


def test_one_of_copies(stages):
    before, after = map(by_id, stages["simhash_near_dedup"])
    root = plain.components({i: plain.shingles(r["text"]) for i, r in before.items()}, lambda a, b: plain.jaccard(a, b) >= 0.8)
    assert set(after) == set(root.values())
    assert stages["simhash_near_dedup"][1].count() == len(after)


def test_without_secrets(stages):
    before, after = map(by_id, stages["secret_scans"])
    assert set(before) == set(after)
    for i, r in before.items():
        text = list(r["text"])
        for _, s, e in plain.secrets(r["text"]):
            text[s:e] = "*" * (e - s)
        hidden = after[i]["text"]
        assert len(hidden) == len(text) and all(b in (a, "*") for a, b in zip(text, hidden))
        assert not plain.secrets(hidden)


def test_interleaved(stages):
    before, after = stages["mixing_sources"]
    slot = {r["doc_id"]: (r["slot"], r["place"]) for r in mixing.mix(before).collect()}
    order = [r["doc_id"] for r in after.collect()]
    assert sorted(order) == sorted(slot) and [slot[i] for i in order] == sorted(slot.values())


def test_tokenized(stages):
    import public_tokenizers as P
    import tiktoken

    from veriscope.llm.bpe import Ranks

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=Ranks.load(P.path("byte_bpe_multi_50k.tiktoken")).rank, special_tokens={})
    before, after = stages["byte_level_bpe"]
    text = by_id(before)
    for r in after.collect():
        assert r["ids"] == own.encode_ordinary(text[r["doc_id"]]["text"]) and r["round_trip"]


def test_hard_rows(spark, hard, empty):
    for name, stage in corpus_pipeline.STAGES:
        n = stage(spark, hard, "").count()
        # the first two filter; the others return every row
        assert n == hard.count() if name not in ("quality_rules", "simhash_near_dedup") else n < hard.count(), name
        assert stage(spark, empty, "").count() == 0, name
    copies = hard.unionByName(hard).filter("doc_id is null or doc_id > 4")
    kept = corpus_pipeline.one_of_copies(spark, copies, "")
    assert kept.groupBy("doc_id").count().filter("doc_id is not null and count > 1").count() == 0
    assert kept.filter("doc_id is null").count() == 2
    # of two texts with one id the least stays, unless neither is the first of its group
    text = " ".join(f"w{i}" for i in range(60))
    own = [(1, text + " a", "en"), (5, text + " b", "en"), (5, "other words that no one else has at all", "de"), (9, "other words that no one else has at all", "fr"), (7, "some text", "en"), (7, "some text", None)]
    odd = spark.createDataFrame([(i, t, x, "s", len(t)) for i, t, x in own], hard.select(corpus_pipeline.COLUMNS).schema)
    kept = sorted((r["doc_id"], r["text"][:5], r["lang"]) for r in corpus_pipeline.one_of_copies(spark, odd, "").collect())
    assert kept == [(1, "w0 w1", "en"), (5, "other", "de"), (7, "some ", None)]
    blank = secrets.secrets(hard, keep=["doc_id"]).filter(F.col("doc_id").isNull())
    assert blank.first()["base"] == []
