"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors get one more coordinate that makes all their norms the largest one, so the largest inner
product is the smallest distance.  A bounded sample is bisected into balanced cells, whose means,
after a few rounds of refinement, are the centroids of posting lists.  Every vector goes to its
nearest list, and at a boundary to the others that are nearly as near and not behind one that is
chosen.  A query walks an in-memory graph of the centroids and takes every list that is not farther than
a ratio of its nearest; the ratio is the one that finds ``AIM`` of the true neighbours among the sample, so
vectors in clusters are pruned hard and vectors without structure hardly.  What its nearest lists have sets
the score that others have to reach.  The number of lists follows that of the vectors, and lists are read in
chunks of one size, so neither a list nor a vector that a third of the rows share makes a large task; scores
are exact, in double precision on the original vectors.

Bounds: a sample of ``SAMPLE`` vectors, or eight a list if that is more, and ``LISTS`` centroids at the
driver and in each task; beyond so many lists (33 million vectors) a list has more chunks.  Every row is
indexed, once, in a written table.  Recall against brute force is measured in the tests.

Defined results: vectors that are null, zero, or hold a null or a non-finite component take no part,
nor do rows without an id; vectors of different lengths have no inner product, so each length is searched
apart; rows that repeat an id count once; ties go to the smaller id; a query has fewer rows than ``k`` only
if there are fewer candidates; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope import scratch

K, EVERY = 20, 20
SAMPLE, LISTS, LIST_ROWS = 40_000, 1 << 16, 500
#: A vector also goes to lists this much farther than its nearest, to so many at most.
BOUNDARY, REPLICAS = 1.10, 4
#: The share of the sample's true neighbours that a query's lists are to hold, sample queries that decide, and rows that a query's lists have at least.
AIM, ASKED, LEAST_ROWS = 0.97, 256, 1000
#: Lists that a query reads first.
FIRST = 2
NEIGHBOURS, ROUNDS = 16, 6
#: Centroids that a walk holds: vectors are placed as carefully as queries look for them.
WIDTH = 64
CHUNK, QUERY_CHUNK = 1024, 256


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows."""
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0)


def bisected(x: np.ndarray, lists: int, seed: int = 11) -> np.ndarray:
    """Centroids of balanced cells: each cell is halved at the median between two means."""
    rng, cells, made = np.random.default_rng(seed), [(-len(x), 0, np.arange(len(x)))], 0
    while len(cells) < lists and cells[0][0] < -1:
        own = heappop(cells)[2]  # the largest
        y = x[own]
        pair = y[rng.choice(len(own), 2, replace=False)]
        for _ in range(4):
            side = distances(y, pair).argmin(1)
            if not 0 < side.sum() < len(side):
                break
            pair = np.stack([y[side == s].mean(0) for s in (0, 1)])
        order = np.argsort(y @ (pair[1] - pair[0]), kind="stable")
        for half in (own[order[: len(own) // 2]], own[order[len(own) // 2 :]]):
            made += 1
            heappush(cells, (-len(half), made, half))
    c = np.stack([x[o].mean(0) for _, _, o in sorted(cells, key=lambda c: c[1])])
    for _ in range(ROUNDS):
        near = np.concatenate([distances(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Graph:
    """Centroids linked to their nearest ones, and across the order of cells so that it is connected."""

    def __init__(self, c: np.ndarray):
        self.c, n = c, len(c)
        m = min(NEIGHBOURS, n - 1)
        near = np.concatenate([np.argpartition(distances(c[i : i + 512], c), m, axis=1)[:, : m + 1] for i in range(0, n, 512)])
        far = np.stack([(np.arange(n) + (1 << b)) % n for b in range(max(1, n.bit_length() - 1))], axis=1)
        self.links = np.concatenate((near, far), axis=1)

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row the ``width`` nearest centroids that a best-first walk finds, nearest first,
        and their squared distances; all rows walk together."""
        n, rows = len(self.c), np.arange(len(x))
        width = min(width, n)
        start = np.unique(np.linspace(0, n - 1, min(n, max(8, width // 2))).astype(int))
        square = (self.c * self.c).sum(1)
        own = (x * x).sum(1)

        def far(ids):
            return np.maximum(own[:, None] + square[ids] - 2 * np.einsum("qd,qmd->qm", x, self.c[ids]), 0)

        ids = np.broadcast_to(start, (len(x), len(start))).copy()
        d = far(ids)
        seen = np.zeros((len(x), n), bool)
        seen[rows[:, None], ids] = True
        open_ = np.ones_like(ids, bool)
        while True:
            order = np.argsort(d, axis=1, kind="stable")[:, :width]
            ids, d, open_ = (np.take_along_axis(a, order, 1) for a in (ids, d, open_))
            if not open_.any():
                return ids, d
            at = open_.argmax(1)  # the nearest one whose links have not been followed
            has = open_[rows, at]
            open_[rows, at] = False
            more = self.links[ids[rows, at]]
            fresh = ~seen[rows[:, None], more] & has[:, None]
            seen[rows[:, None], more] |= has[:, None]
            # the same centroid twice in one row of links
            first = np.argsort(more, axis=1, kind="stable")
            again = np.zeros_like(fresh)
            ordered = np.take_along_axis(more, first, 1)
            np.put_along_axis(again, first[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
            fresh &= ~again
            ids = np.concatenate((ids, more), 1)
            d = np.concatenate((d, np.where(fresh, far(more), np.inf)), 1)
            open_ = np.concatenate((open_, fresh), 1)


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """One more coordinate, so that every norm is ``top``."""
    return np.concatenate((x, np.sqrt(np.maximum(top * top - (x * x).sum(1), 0))[:, None]), 1)


def placed(x: np.ndarray, graph: Graph) -> list[np.ndarray]:
    """The lists of each lifted vector: the nearest, and at boundaries others that no chosen one hides."""
    ids, d = graph.search(x, WIDTH)
    out = []
    for i, r in zip(ids, d):
        own = [i[0]]
        for c, dist in zip(i[1:], r[1:]):
            if len(own) == REPLICAS or dist > BOUNDARY**2 * max(r[0], 1e-12) or not np.isfinite(dist):
                break
            if (((graph.c[own] - graph.c[c]) ** 2).sum(1) >= dist).all():
                own.append(c)
        out.append(np.array(own))
    return out


def raised(q: np.ndarray, top: float) -> np.ndarray:
    """Queries among lifted vectors."""
    return np.concatenate((q * (top / np.sqrt((q * q).sum(1)))[:, None], np.zeros((len(q), 1))), 1)


def fitted(x: np.ndarray, graph: Graph, top: float, k: int, seed: int = 5) -> float:
    """The least ratio at which the lists of a sample's queries hold ``AIM`` of their true neighbours in the
    sample, and of all queries but one in a hundred at least six of ten."""
    own = np.random.default_rng(seed).permutation(len(x))[:ASKED]
    m = min(k, len(x) - 1)
    if m < 1 or len(graph.c) < 2:
        return 1.0
    score = x[own] @ x.T
    score[np.arange(len(own)), own] = -np.inf
    best = np.argpartition(score, len(x) - m, axis=1)[:, len(x) - m :]
    d = distances(raised(x[own], top), graph.c)
    lists = placed(lifted(x[best.ravel()], top), graph)
    need = np.array([d[i // m, o].min() for i, o in enumerate(lists)]).reshape(-1, m) / np.maximum(d.min(1, keepdims=True), 1e-12)
    return float(np.sqrt(max(np.quantile(need, AIM), np.quantile(np.quantile(need, 0.6, axis=1), 0.99)))) + 1e-9


def asked(q: np.ndarray, graph: Graph, top: float, sizes: np.ndarray, ratio: float) -> list[np.ndarray]:
    """The lists of each query: those within the ratio, and enough for a full answer."""
    x = raised(q, top)
    out, width = [None] * len(q), WIDTH
    todo = np.arange(len(q))
    while len(todo):
        ids, d = graph.search(x[todo], width)
        left = []
        for t, i, r in zip(todo.tolist(), ids, d):
            i, r = i[np.isfinite(r)], r[np.isfinite(r)]
            n = max(int((r <= ratio**2 * r[0]).sum()), int(np.searchsorted(np.cumsum(sizes[i]), LEAST_ROWS)) + 1)
            if n >= len(i) and width < len(graph.c):
                left.append(t)  # the walk was too narrow for the ratio
            else:
                out[t] = i[:n]
        todo, width = np.array(left, int), 4 * width
    return out


def _matrix(s: pd.Series) -> np.ndarray:
    return np.stack(s.to_numpy()).astype(np.float64) if len(s) else np.zeros((0, 1))


def best(qid: np.ndarray, q: np.ndarray, floor: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int) -> pd.DataFrame:
    """Each query's ``k`` best rows of a chunk, if they reach its floor; near ties are scored one way
    whatever the block."""
    rough = q @ v.T
    rough[qid[:, None] == vid] = -np.inf
    rough[rough < (floor - 1e-9 * (1 + np.abs(np.where(np.isfinite(floor), floor, 0))))[:, None]] = -np.inf
    m = min(k + len(vid) - len(np.unique(vid)), len(vid))  # an id may be repeated
    edge = np.partition(rough, len(vid) - m, axis=1)[:, len(vid) - m]
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(edge), edge, 0)))
    a, b = np.nonzero((rough >= (np.where(np.isfinite(edge), edge, -np.finfo(float).max) - slack)[:, None]) & np.isfinite(rough))
    score = np.concatenate([(q[a[i : i + 65536]] * v[b[i : i + 65536]]).sum(1) for i in range(0, len(a), 65536)]) if len(a) else np.zeros(0)
    once = np.lexsort((-score, vid[b], a))
    a, b, score = a[once], b[once], score[once]
    once = np.concatenate(([True], (a[1:] != a[:-1]) | (vid[b[1:]] != vid[b[:-1]]))) if len(a) else np.zeros(0, bool)
    a, b, score = a[once], b[once], score[once]
    order = np.lexsort((vid[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    first = np.searchsorted(a, a)
    keep = np.arange(len(a)) - first < k
    return pd.DataFrame({"query_id": qid[a[keep]], "vec_id": vid[b[keep]], "score": score[keep]})


def neighbours(vectors: DataFrame, *, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding", list_rows: int = LIST_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` nearest found of each row whose id ``every`` divides."""
    x = F.col("v")
    kind = vectors.schema[vector_col].dataType.simpleString()
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(x, lambda e: e != 0)
    own = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), own.alias("v")).filter(F.col("id").isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False)))
    x = x.cast("array<double>")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, e: s + e * e))
    widths = rows.groupBy(F.size(x).alias("n")).agg(F.count("*").alias("rows"), F.max(norm).alias("top")).orderBy("n").collect()  # a row a length
    found = [_of_one_length(rows.filter(F.size(x) == w["n"]), w["rows"], w["n"], w["top"], k, every, list_rows) for w in widths]
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")


def _of_one_length(rows: DataFrame, n: int, width: int, top: float, k: int, every: int, list_rows: int) -> DataFrame:
    spark = rows.sparkSession
    lists = int(min(LISTS, max(1, n // list_rows)))
    size = max(SAMPLE, 8 * lists)
    share = min((1 << 64) - 1, (1 << 64) * size // n)
    sample = rows.filter(F.xxhash64("id") <= -(1 << 63) + share).select("v").distinct().limit(2 * size).toPandas()
    points = _matrix(sample["v"]) if len(sample) else np.zeros((1, width))
    made = Graph(bisected(lifted(points, top), lists))
    ratio = fitted(points, made, top, k)
    graph = spark.sparkContext.broadcast(made)
    index = f"list int, id bigint, v {rows.schema['v'].dataType.simpleString()}, first boolean"

    def spread(make):
        def run(batches):
            for b in batches:
                for i in range(0, len(b), 512):
                    part = b.iloc[i : i + 512]
                    own = make(_matrix(part["v"]))
                    count = np.array([len(o) for o in own])
                    at = np.repeat(np.arange(len(part)), count)
                    rank = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
                    yield pd.DataFrame({"list": np.concatenate(own).astype(np.int32), "id": part["id"].to_numpy()[at], "v": part["v"].to_numpy()[at], "first": rank < FIRST})

        return run

    stored = scratch.table(rows.mapInPandas(spread(lambda m: placed(lifted(m, top), graph.value)), index).drop("first"), "lists")
    sizes = np.zeros(len(made.c), np.int64)
    for r in stored.groupBy("list").count().collect():  # a row for each list
        sizes[r["list"]] = r["count"]
    queries = scratch.table(rows.filter(F.col("id") % every == 0).mapInPandas(spread(lambda m: asked(m, graph.value, top, sizes, ratio)), index), "queries")
    wanted = np.zeros((2, len(sizes)), np.int64)
    for r in queries.groupBy("list", "first").count().collect():  # two rows for each list
        wanted[int(r["first"]), r["list"]] = r["count"]
    salt = F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("int")

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        return best(a["id"].to_numpy(), _matrix(a["v"]), a["floor"].to_numpy(np.float64), b["id"].to_numpy(), _matrix(b["v"]), k)

    def scored(asking: DataFrame, first: bool) -> DataFrame:
        chunks = [(i, int(-(-s // CHUNK)) or 1, int(-(-w // QUERY_CHUNK)) or 1) for i, (s, w) in enumerate(zip(sizes.tolist(), wanted[int(first)].tolist())) if w]
        cut = F.broadcast(spark.createDataFrame(chunks, "list int, vs int, qs int"))  # a row for each list
        v = stored.join(cut, "list").select("list", (salt % F.col("vs")).alias("vc"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qc"), "id", "v")
        q = asking.join(cut, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("vs") - 1)).alias("vc"), (salt % F.col("qs")).alias("qc"), "id", "v", "floor")
        group = ["list", "vc", "qc"]
        return q.groupBy(*group).cogroup(v.groupBy(*group)).applyInPandas(compare, "query_id bigint, vec_id bigint, score double")

    least = F.lit(float("-inf"))
    first = scratch.table(scored(queries.filter("first").withColumn("floor", least), True), "nearest")
    # a query has k candidates of each chunk of a few lists, so the array is bounded
    floor = first.groupBy(F.col("query_id").alias("id")).agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).alias("floor"))
    others = scored(queries.filter("not first").join(floor, "id", "left").withColumn("floor", F.coalesce("floor", least)), False)
    found = first.unionByName(others).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = "row_number() over (partition by query_id order by score desc, vec_id)"
    return found.withColumn("rank", F.expr(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
