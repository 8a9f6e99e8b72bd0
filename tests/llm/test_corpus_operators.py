"""Operators that compare rows with one another, against plain versions."""

import hashlib
import random

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from veriscope.llm import ann, simhash, suffix


def rows(df):
    return [r.asDict() for r in df.collect()]


def check_simhash(docs):
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    fp = {i: plain.fingerprint(t) for i, t in text.items()}
    want = plain.components({i: f for i, f in fp.items() if i is not None}, lambda a, b: (a ^ b).bit_count() <= 2)
    got = rows(simhash.simhash(docs))
    assert len(got) == docs.count()
    for r in got:
        assert r["fingerprint"] == f"{fp[r['doc_id']]:016x}"
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]], r


def test_simhash(hard, small, empty):
    check_simhash(hard)
    check_simhash(small)
    assert simhash.simhash(empty).count() == 0


def test_vote_in_blocks(monkeypatch):
    texts = ["a b c d e f g h", "", "one two", "x y z " * 400, " ".join(map(str, range(3000))), "A b"]
    want = simhash.vote(texts, words=4)
    assert [f"{int(x) & (1 << 64) - 1:016x}" for x in want[:, 0]] == [f"{plain.fingerprint(t):016x}" for t in texts]
    monkeypatch.setattr(simhash, "BLOCK", 64 * 4 * 7)
    assert (simhash.vote(texts, words=4) == want).all()


def test_near_duplicates(spark, hard, empty):
    """Against all pairs of texts with a similarity of 0.8: each is in one component, and nothing else is in any."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r["doc_id"]: plain.shingles(r["text"]) for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    pairs = plain.similar(sets)
    assert len(got) == len(sets) and sum(s < 1 for s in pairs.values()) >= 10
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.98 * len(pairs)
    for i, c in got.items():
        own = [j for j, k in got.items() if k == c and j != i]
        assert not own or max(plain.jaccard(sets[i], sets[j]) for j in own) >= 0.77
    odd = rows(simhash.near_duplicates(hard))
    assert len(odd) == hard.count() and {r["component_id"] for r in odd if r["doc_id"] in (0, 1, 2)} == {0}
    assert simhash.near_duplicates(empty).count() == 0


def test_near_duplicates_around(spark):
    """Texts with a few words changed: similarities on both sides of 0.8."""
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(4000))
    texts = []
    for i in range(400):
        own = [word() for _ in range(rng.randrange(60, 300))]
        other = list(own)
        for k in rng.sample(range(len(own)), max(1, int(len(own) * (0.01 + 0.03 * i / 400)))):
            other[k] = word()
        texts += [" ".join(own), " ".join(other)]
    sets = [plain.shingles(t) for t in texts]
    near = [plain.jaccard(sets[i], sets[i + 1]) for i in range(0, 800, 2)]
    got = {r["doc_id"]: r["component_id"] for r in rows(simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")))}
    found = [got[2 * i] == got[2 * i + 1] for i in range(400)]
    close, far = [f for f, s in zip(found, near) if s >= 0.8], [f for f, s in zip(found, near) if s < 0.75]
    assert min(len(close), len(far)) > 80 and sum(close) >= 0.97 * len(close) and sum(far) <= 0.01 * len(far)
    assert all(c in (i, i - 1) for i, c in got.items())


def test_near_duplicates_of_one_text(spark):
    """Many texts that differ from one in a word each: values that more than a few share, and one component."""
    own = [f"w{i * i}" for i in range(150)]
    texts = [" ".join([*own[: i % 150], f"x{i}", *own[i % 150 + 1 :]]) for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r["component_id"] for r in rows(simhash.near_duplicates(docs))} == {0}


def test_near_duplicates_beyond_ends(spark, monkeypatch):
    """Values that many share, most of whose pairs meet through nothing else: no link is lost there."""
    rng = random.Random(11)
    texts = []
    for g in range(30):  # the ends of a value are of few of these groups
        own = [f"g{g}w{k}" for k in range(200)]
        for _ in range(2):
            at = rng.randrange(200)
            texts.append(" ".join([*own[:at], f"z{rng.random()}", *own[at + 1 :]]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(simhash, "plan", lambda rows, similarity: (1, 2))  # two values: all share them
    got = {r["doc_id"]: r["component_id"] for r in rows(simhash.near_duplicates(docs))}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_near_duplicates_of_a_family(spark, monkeypatch):
    """Texts that share a value with many but are like none of them make no pairs; those that are like another meet."""
    rng, made, table = random.Random(5), [], simhash.scratch.table
    base = [f"b{k}" for k in range(150)]

    def changed(own, n):
        own = list(own)
        for k in rng.sample(range(len(own)), n):
            own[k] = f"z{rng.random()}"
        return own

    texts = []
    for g in range(70):
        own = changed(base, 12)
        texts += [" ".join(own)] + [" ".join(changed(own, 1))] * (g < 10)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(simhash, "plan", lambda rows, similarity: (1, 2))  # two values: all share them

    def counted(df, name="t"):
        made.append((name, (out := table(df, name)).count()))
        return out

    monkeypatch.setattr(simhash.scratch, "table", counted)
    got = {r["doc_id"]: r["component_id"] for r in rows(simhash.near_duplicates(docs))}
    assert got == {i: i - i % 2 if i < 20 else i for i in range(80)}
    met = [n for name, n in made if name == "entries"]
    assert met[0] >= 60 and met[-1] <= 40


def test_vote_memory():
    """Counts of many short texts are not held at once."""
    import tracemalloc

    texts = [f"word {i}" for i in range(10_000)]
    simhash.vote(texts[:10], words=16)
    tracemalloc.start()
    try:
        got = simhash.vote(texts, words=16)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.shape == (10_000, 16) and most < 40e6
    assert (got[5000:5003] == simhash.vote(texts[5000:5003], words=16)).all()


@pytest.mark.parametrize("segments", [1, 2, 4])
def test_links(spark, segments):
    rng = random.Random(5)
    # balls around few centres, and one centre whose ball shares a segment: more than a bucket holds
    near = {rng.getrandbits(64) for _ in range(30)}
    near |= {c ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for c in near for _ in range(10)}
    hot = rng.getrandbits(64)
    near |= {hot ^ 1 << a ^ 1 << b for a in range(32) for b in range(a)} | {hot ^ rng.getrandbits(32) for _ in range(300)}
    if segments == 1:
        near = set(list(near)[:400])
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in near)
    fps = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    got = {(r["a"], r["b"]) for r in simhash.links(fps, 2, segments).collect()}
    x = np.array(signed, np.int64)
    want = set()
    for i, a in enumerate(signed):
        d = np.bitwise_count((x[i + 1 :] ^ a).view(np.uint64))
        want |= {(a, signed[i + 1 + j]) for j in np.flatnonzero(d <= 2).tolist()}
    assert got == want


def test_components_of_a_chain(spark):
    ids = list(range(60))
    random.Random(2).shuffle(ids)
    pairs = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(ids, ids[1:])] + [(100, 101)], "a bigint, b bigint")
    label = spark.createDataFrame([(i, 1000 - i) for i in [*ids, 100, 101]], "fp bigint, doc_id bigint")
    got = {r["fp"]: r["component_id"] for r in simhash.components(pairs, label).collect()}
    assert got == {**dict.fromkeys(ids, 941), 100: 899, 101: 899}


def join_rows(spark, run):
    """What ``run()`` returns, and the rows that all joins made meanwhile, by Spark's own metrics."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    start, made = store.executionsList().size(), 0
    out = run()
    bus.waitUntilEmpty()
    ran = store.executionsList()
    for e in (ran.apply(i).executionId() for i in range(start, ran.size())):
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = (node.metrics().apply(i) for i in range(node.metrics().size() if "Join" in node.name() else 0))
            own = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
            made += sum(int(v.get().replace(",", "")) for v in own if v.isDefined())
    return out, made


@pytest.mark.parametrize("links", ["all", "ends"])
def test_components_of_a_large_group(spark, links):
    """A link is joined until its ends are in one tree, not in each round up to the last."""
    rng = random.Random(9)
    if links == "all":
        n, pairs = 150, [(i, j) for j in range(150) for i in range(j)]
    else:  # most links are with a few ends, which few others share
        n, pairs = 1510, [(i, h) for i in range(1500) for h in rng.sample(range(1500, 1510), 6)]
    rows = spark.createDataFrame([*pairs, (5000, 5001), (5001, 5001)], "a bigint, b bigint")
    label = spark.createDataFrame([(i, 9000 - i if i % 3 else None) for i in [*range(n), 5000, 5001, 6000]], "fp bigint, doc_id bigint")
    got, made = join_rows(spark, lambda: {r["fp"]: r["component_id"] for r in simhash.components(rows, label).collect()})
    least = min(9000 - i for i in range(n) if i % 3)
    assert got == {**dict.fromkeys(range(n), least), 5000: 4000, 5001: 4000}
    assert made <= 2.5 * len(pairs)


def check_repeats(docs, **how):
    """Rows in the order of ids, those without one first, and of equal ids in the order of the table."""
    text = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]
    order = sorted(range(len(text)), key=lambda i: (text[i][0] is not None, text[i][0] or 0, i))
    want = plain.repeats({k: text[i][1] for k, i in enumerate(order)})
    want = sorted((str(text[i][0]), len(text[i][1]), want[k][1], want[k][2], hashlib.sha256(want[k][0]).hexdigest()) for k, i in enumerate(order))
    got = [(str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(suffix.repeated(docs, **how))]
    assert sorted(got) == want


def made(spark, part):
    rng = random.Random(part)
    word = lambda: "".join(rng.choice("abcdéß") for _ in range(rng.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(40), prose(60)
    texts = ["", None, "x" * 99, "x" * 100, "x" * 101, "ab" * 700, passage, passage[5:], "\n" * 500]
    texts += [prose(rng.randrange(5)) + passage[rng.randrange(30) :] + prose(5) for _ in range(60)]
    texts += [prose(20) + other[: rng.randrange(80, 200)] + prose(9) + passage for _ in range(30)]
    texts += [prose(300) for _ in range(5)]
    texts += [texts[-1], texts[-2][:500] + "?" + texts[-2][500:], passage + passage]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3).sortWithinPartitions("doc_id")


def test_repeats(spark, small, hard, empty):
    check_repeats(made(spark, 1))
    check_repeats(small)
    check_repeats(hard)
    assert suffix.repeated(empty).count() == 0


def test_repeats_of_odd_ids(spark):
    """Null and repeated ids whose texts differ, in several partitions."""
    own = made(spark, 3)
    odd = own.withColumn("doc_id", F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 5)).withColumn("rid", F.lit(1))
    check_repeats(odd)


@pytest.mark.parametrize("part", [1, 4])
def test_repeats_in_parts(spark, part):
    """Collections cut at a few contexts: the same result."""
    check_repeats(made(spark, 2), part=part, collection=10)


@pytest.mark.parametrize("bits", [1, 6])
def test_repeats_with_a_weak_hash(spark, bits):
    """Contexts that differ under one hash: the bytes tell, and another hash is taken."""
    check_repeats(made(spark, 2), bits=bits)


def test_long_text_in_pieces():
    """Strings of a text longer than a piece are named by the same anchors."""
    import pyarrow as pa
    import zstandard

    rng = np.random.default_rng(4)
    raw = rng.integers(97, 123, suffix.PIECE + 5000).astype(np.uint8).tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([1]), pa.array([zstandard.compress(raw)], pa.binary())], names=["doc", "rid", "z"])
    starts = []
    for out in suffix._occurrences([batch]):
        q = out.column(4).to_numpy()
        for x in q.tolist():
            first = (x >> 14) - (x >> 7 & 127)
            starts += range(first, first + (x & 127) + 1)
    assert sorted(set(starts)) == list(range(len(raw) - 99))


def exact(v, k=20, every=20):
    ids, x = np.array([i for i, _ in v]), np.array([e for _, e in v], np.float64)
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            score = (x * q).sum(1)
            order = np.lexsort((ids, -score))
            out[int(i)] = [(int(ids[j]), float(score[j])) for j in order if ids[j] != i][:k]
    return out


def test_neighbours_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = exact([(r["vec_id"], r["embedding"]) for r in table.collect()])
    got = {}
    for r in ann.neighbours(table).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want) and all(len(g) == 20 for g in got.values())
    recall = np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9, recall
    for q in want:
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))


def recalls(got, want):
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    return np.array([len(found[q] & {v for v, _ in own}) / len(own) for q, own in want.items()])


@pytest.mark.parametrize("spread", [0.6, 0.9])
def test_neighbours_of_clusters(spark, spread):
    """Twenty thousand vectors in two hundred clusters: queries read under a fifth of them."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(200, 64))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    x = centre[rng.integers(0, 200, 20_000)] + spread / 8 * rng.normal(size=(20_000, 64))
    v = [(i, e) for i, e in enumerate(x.tolist())]
    own = recalls(ann.neighbours(spark.createDataFrame(v, "vec_id bigint, embedding array<double>")).collect(), exact(v))
    print("recall", own.mean(), "least", own.min(), "share below 0.5", (own < 0.5).mean())
    assert own.mean() >= 0.9 and (own < 0.5).mean() <= 0.01
    # what a query reads: the rows of its lists
    top = float(np.linalg.norm(x, axis=1).max())
    graph = ann.Graph(ann.bisected(ann.lifted(x, top), len(x) // ann.LIST_ROWS))
    sizes = np.bincount(np.concatenate(ann.placed(ann.lifted(x, top), graph)), minlength=len(graph.c))
    asked = ann.asked(x[::20], graph, top, sizes, ann.fitted(x, graph, top, 20))
    read = np.array([sizes[o].sum() for o in asked]) / len(x)
    print("rows read", read.mean())
    assert read.mean() < 0.2


def test_neighbours_without_structure(spark):
    """Directions at random: there is little to prune, and the ratio says so."""
    x = np.random.default_rng(2).normal(size=(12_000, 48))
    v = [(i, e) for i, e in enumerate(x.tolist())]
    own = recalls(ann.neighbours(spark.createDataFrame(v, "vec_id bigint, embedding array<double>")).collect(), exact(v))
    print("recall", own.mean(), "least", own.min(), "share below 0.5", (own < 0.5).mean())
    assert own.mean() >= 0.9 and (own < 0.5).mean() <= 0.02


def test_neighbours_of_two_lengths(spark):
    rng = np.random.default_rng(3)
    v = [(i, rng.normal(size=8 if i % 2 else 12).tolist()) for i in range(0, 1500)] + [(5000, rng.normal(size=8).tolist())]
    got = ann.neighbours(spark.createDataFrame(v, "vec_id bigint, embedding array<double>")).collect()
    want = exact([x for x in v if len(x[1]) == 12]) | exact([x for x in v if len(x[1]) == 8])
    assert 5000 in want and recalls(got, want).min() == 1


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [1.0, inf]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 1.0])]
    good = [(i, [float(i % 3), 1.0]) for i in range(20, 60)] + [(20, [2.0, 1.0])]
    got = ann.neighbours(spark.createDataFrame(bad + good, "vec_id bigint, embedding array<float>").withColumn("v", F.lit(0))).collect()
    for q in (20, 40):
        own = [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert own == exact(good[:-1])[q] and [r["rank"] for r in got if r["query_id"] == q].__len__() == 20
    assert {r["query_id"] for r in got} == {20, 40}
    few = spark.createDataFrame([(0, [1.0, 2.0]), (7, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in ann.neighbours(few).collect()] == [(0, 1, 7, 3.0)]
    assert ann.neighbours(few.limit(0)).count() == 0


def test_neighbours_of_copies(spark):
    """A vector that a third of the rows share: ties go to the smaller ids, and lists are cut."""
    rng = np.random.default_rng(9)
    v = [(i, ([1.0] * 16 if i % 3 == 0 else rng.normal(size=16).tolist())) for i in range(3000)]
    got = {}
    for r in ann.neighbours(spark.createDataFrame(v, "vec_id bigint, embedding array<double>")).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = exact(v)
    for q in (0, 60, 2940):
        assert got[q] == [i for i, _ in want[q]]
    assert np.mean([len(set(got[q]) & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
