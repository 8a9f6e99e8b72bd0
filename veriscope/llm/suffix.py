"""Removal of repeated byte strings by column-wise construction over collections of contexts.

A string of ``LENGTH`` bytes holds the anchor that its content names: the piece of ``ANCHOR`` bytes
with the least hash in it.  Equal strings hold equal anchors at equal places, so all strings that
could be equal stand in the contexts of one anchor's occurrences.  Occurrences are sorted by anchor
and by a hash of their context; of contexts with one hash all but the first repeat it whole.  What is left
are the different contexts of an anchor that occurs more than once, where a repeated passage starts
or ends.  Those, aligned at the anchor, are the documents of a collection, and a suffix array of the
collection with its common prefixes is built column by column from the right: each round puts one
symbol in front of every context, which is a stable partition of the order so far (the step from one
column of the Burrows-Wheeler transform to the next), and new common prefixes are one more than the
least of the old ones between.  Strings with a common prefix of ``LENGTH`` are equal, and all but
the first are repeats.

No hash decides: neighbouring contexts that repeat one text whole are one stretch, whose bytes are sent
along and compared where it is removed.  If ever one differs, all is done again with another hash.

A collection over whole documents would take as many rounds as the longest has bytes, each over all
of the corpus; contexts need ``2 * LENGTH - ANCHOR`` at most, and collections are independent.
Collections are cut at ``PART`` contexts; the first string of each kind in the parts of one anchor
then meets the others, byte by byte, in a partial aggregate.  Anchors are dealt by ranges of their
sorted occurrences, so a passage that a third of the documents share does not make one large task.

Defined results: a null or empty text has no bytes; repeats in one text count; bytes are judged on the
input; rows that repeat a doc_id, and those without one, which come first, stand in the order of the
table; an empty table gives an empty result; other columns are not read.  Texts and their numbers are
written once, so every later step sees the same ones.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriscope import scratch
from veriscope.llm.texts import documents

LENGTH, ANCHOR = 100, 24
#: Contexts of an anchor that are sorted together, and of one collection.
PART, COLLECTION = 4096, 20_000
#: Bytes that are hashed together; a longer text is cut with an overlap.
PIECE = 1 << 20
_SPAN = LENGTH - ANCHOR + 1  # anchors in a string
_B = np.uint64(0x9E3779B97F4A7C15)
_BINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SEED = 100
_UP = np.cumprod(np.concatenate(([np.uint64(1)], np.full(PIECE + 1, _B))), dtype=np.uint64)
_DOWN = np.cumprod(np.concatenate(([np.uint64(1)], np.full(PIECE + 1, _BINV))), dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


@lru_cache
def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, np.uint64)


def anchors(raw: np.ndarray, cuts: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """For texts laid end to end (``cuts``: where each starts, and the end): of each anchor its hash,
    the hash of its context, its place, and the first and last start of the strings that it names."""
    n = len(raw)
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if n < LENGTH:
        return none
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_table(seed)[raw] * _DOWN[:n], dtype=np.uint64)))
    h = _mix((sums[ANCHOR:] - sums[:-ANCHOR]) * _UP[: n - ANCHOR + 1])
    # the place in the low bits makes the leftmost of equal hashes the least
    low = np.uint64(PIECE - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    # least of every _SPAN neighbours: from the right within blocks, and from the left in the next
    pad = -len(key) % _SPAN
    blocks = np.concatenate((key, np.full(pad, ~np.uint64(0)))).reshape(-1, _SPAN)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - LENGTH + 1
    place = (np.minimum(right[:starts], left[_SPAN - 1 : _SPAN - 1 + starts]) & low).astype(np.int64)
    valid = np.ones(starts, bool)
    for c in cuts[1:-1].tolist():
        valid[max(0, c - LENGTH + 1) : min(c, starts)] = False
    s = np.flatnonzero(valid)
    if not len(s):
        return none
    p = place[s]
    new = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1))))
    first, last, p = s[new], s[np.concatenate((new[1:] - 1, [len(s) - 1]))], p[new]
    u = _mix((sums[last + LENGTH] - sums[first]) * _UP[first] + ((p - first) * 128 + (last - first)).astype(np.uint64) * _B)
    return h[p], u, p, first, last


def _occurrences(batches, seed: int = SEED, bits: int = 64):
    """Rows of anchor, context, doc, row and q: place, and the distances of the first and last start."""
    import pyarrow as pa
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        ids, rids = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        packed = b.column(2)
        todo, size = [], 0

        def out():
            cuts = np.cumsum([0, *(len(x[2]) for x in todo)])
            a, u, p, s, e = anchors(np.frombuffer(b"".join(x[2] for x in todo), np.uint8), cuts, seed)
            u >>= np.uint64(64 - bits)
            own = np.searchsorted(cuts, s, "right") - 1
            at = np.array([x[1] for x in todo])[own] + p - cuts[own]
            who = np.array([x[0] for x in todo])[own]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (a.view(np.int64), u.view(np.int64), ids[who], rids[who], at << 14 | (p - s) << 7 | (e - s))], names=["a", "u", "doc", "rid", "q"])

        for i in range(len(packed)):
            raw = unpack.decompress(packed[i].as_py())
            if len(raw) < LENGTH:
                continue
            # pieces share LENGTH - 1 bytes, so every start is in one
            for lo in range(0, max(1, len(raw) - LENGTH + 1), PIECE - LENGTH):
                piece = raw[lo : lo + PIECE - 1] if len(raw) >= PIECE else raw
                if size + len(piece) >= PIECE:
                    yield out()
                    todo, size = [], 0
                todo.append((i, lo, piece))
                size += len(piece)
                if len(raw) < PIECE:
                    break
        if todo:
            yield out()


_KIND = "whole boolean, a bigint, part bigint, split boolean, doc bigint, rid bigint, q bigint, rid0 bigint, s0 bigint"


def _start(q: int) -> int:
    return (q >> 14) - (q >> 7 & 127)


def _groups(batches, most: int = PART):
    """From occurrences in the order of anchor, context and place: those that repeat a context whole, with the
    row and start of its first, and the first of each of several contexts of an anchor.  Streams; at most
    ``most`` rows are held."""
    import pyarrow as pa
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 32
    held, out = [], []
    state = {"a": None, "u": None, "edge": True, "split": False, "part": base, "first": None}

    def flush(split):
        if len(held) > 1 or split:
            out.extend((False, state["a"], state["part"], split, *r, None, None) for r in held)
        held.clear()
        state["part"] += 1

    def table():
        cols = list(zip(*out)) if out else [[]] * 9
        kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 5]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _KIND.split(", ")])

    for b in batches:
        a, u, doc, rid, q = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        same = a[1:] == a[:-1]
        some = np.concatenate(([True], same)) | np.concatenate((same, [True]))
        some[:1] = True
        for i in np.flatnonzero(some).tolist():
            if a[i] != state["a"]:
                if state["a"] is not None:
                    flush(state["edge"] or state["split"])
                    state["edge"] = False
                state |= {"a": int(a[i]), "u": None, "split": False}
            row = (int(doc[i]), int(rid[i]), int(q[i]))
            if u[i] == state["u"]:
                out.append((True, state["a"], 0, False, *row, *state["first"]))
                continue
            if len(held) == most:
                state["split"] = True
                flush(True)
            state |= {"u": u[i], "first": (row[1], _start(row[2]))}
            held.append(row)
        yield table()
    if state["a"] is not None:
        flush(True)  # the last anchor may go on in the next partition
        yield table()


def _contexts(batches):
    """The bytes of each context, from texts with their contexts."""
    import pyarrow as pa
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        out = [[] for _ in range(8)]
        for rid, z, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            raw = unpack.decompress(z)
            for f in found:
                q = f["q"]
                s = _start(q)
                for o, x in zip(out, (f["a"], f["part"], f["split"], f["doc"], rid, s, q >> 7 & 127, raw[s : s + (q & 127) + LENGTH])):
                    o.append(x)
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names=["a", "part", "split", "doc", "rid", "s", "off", "text"])


def columnwise(texts: list[bytes], off: np.ndarray, rank: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts aligned at ``off``, which strings of ``length`` start a repeat of one with less
    ``rank``, and which are the first of their kind: booleans by context and column (the start's
    distance from the leftmost possible)."""
    n, size = len(texts), np.array([len(t) for t in texts])
    left = int(off.max())
    begin = left - off
    width = int((begin + size).max())
    text = np.full((n, width), 256, np.uint16)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    row = np.repeat(np.arange(n), size)
    text[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + begin[row]] = flat
    order, common = np.arange(n), np.zeros(n, np.int32)
    starts = width - length + 1
    again, first = np.zeros((n, max(starts, 0)), bool), np.zeros((n, max(starts, 0)), bool)
    for c in range(width - 1, -1, -1):
        symbol = text[order, c]
        step = np.argsort(symbol, kind="stable")
        ordered = symbol[step]
        # common prefixes: one more than the least of the old ones between two that now are neighbours
        lo, hi = step[:-1] + 1, step[1:]
        same = ordered[1:] == ordered[:-1]
        new = np.zeros(n, np.int32)
        if same.any():
            lo, hi = lo[same], hi[same]
            level = np.floor(np.log2(np.maximum(hi - lo + 1, 1))).astype(int)
            least = np.empty(len(lo), np.int32)
            row_min = common
            for k in range(level.max() + 1):
                if k:
                    row_min = np.minimum(row_min[: -(1 << (k - 1))], row_min[1 << (k - 1) :])
                at = np.flatnonzero(level == k)
                least[at] = np.minimum(row_min[lo[at]], row_min[hi[at] - (1 << k) + 1])
            new[1:][same] = least + 1
        order, common = order[step], new
        if c < starts:
            fits = (begin[order] <= c) & (c + length <= begin[order] + size[order])
            run = np.flatnonzero(common < length)
            held = np.where(fits, rank[order], np.iinfo(np.int64).max)
            least = np.repeat(np.minimum.reduceat(held, run), np.diff(np.append(run, n)))
            again[order, c] = fits & (held > least)
            first[order, c] = fits & (held == least)
    return again, first


_FOUND = "open boolean, rid bigint, s bigint, e bigint, doc bigint, a bigint, t binary"


def _repeats(batches, most: int = COLLECTION):
    """Repeated stretches of contexts, and (open) the firsts of anchors whose contexts were split."""
    import pyarrow as pa

    held: list[tuple] = []
    kinds = [pa.bool_(), *[pa.int64()] * 5, pa.binary()]

    def work(rows):
        a, _, split, doc, rid, s, off, texts = zip(*rows)
        s, off = np.array(s), np.array(off)
        rank = np.empty(len(rows), np.int64)
        # by place of the anchor: strings of one column start at equal distances from it
        rank[np.lexsort((s + off, rid, doc))] = np.arange(len(rows))
        again, first = columnwise(texts, off, rank)
        begin = int(off.max()) - off
        out = []
        for i in np.flatnonzero(again.any(1)).tolist():
            c = np.flatnonzero(again[i])
            cut = np.flatnonzero(np.diff(c) > 1)
            for lo, hi in zip(c[np.concatenate(([0], cut + 1))].tolist(), c[np.concatenate((cut, [len(c) - 1]))].tolist()):
                out.append((False, rid[i], int(s[i] + lo - begin[i]), int(s[i] + hi - begin[i]) + LENGTH, None, None, None))
        for i in np.flatnonzero(split).tolist():
            for c in np.flatnonzero(first[i]).tolist():
                at = c - int(begin[i])
                out.append((True, rid[i], int(s[i]) + at, int(s[i]) + at + LENGTH, doc[i], a[i], texts[i][at : at + LENGTH]))
        cols = list(zip(*out)) if out else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _FOUND.split(", ")])

    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if len(held) >= most and r[:2] != held[-1][:2]:
                yield work(held)
                held = []
            held.append(r)
    if held:
        yield work(held)


def _sent(batches):
    """The bytes of the first of each stretch, from the text that has it."""
    import pyarrow as pa
    import zstandard

    unpack, last, raw = zstandard.ZstdDecompressor(), None, b""
    for b in batches:
        own = []
        for rid0, z, s, e, s0 in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4, 5))):
            if rid0 != last:  # a text's stretches come together
                last, raw = rid0, unpack.decompress(z)
            own.append(raw[s0 : s0 + e - s])
        yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), b.column(4), pa.array(own, pa.binary())], names=["rid", "s", "e", "t"])


def _kept(batches):
    """n_bytes, n_removed, n_spans and the kept bytes' hash of texts with their repeated stretches, and whether
    those that came with bytes have them."""
    import pyarrow as pa
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        out = [[], [], [], [], []]
        for z, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            raw, spans = unpack.decompress(z), []
            same = all(f["t"] is None or raw[f["s"] : f["e"]] == f["t"] for f in found or ())
            for s, e in sorted((f["s"], f["e"]) for f in found or ()):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(e, spans[-1][1])
                else:
                    spans.append([s, e])
            kept, at = hashlib.sha256(), 0
            for s, e in spans:
                kept.update(raw[at:s])
                at = e
            kept.update(raw[at:])
            for o, x in zip(out, (len(raw), sum(e - s for s, e in spans), len(spans), kept.hexdigest(), same)):
                o.append(x)
        kinds = [pa.int64()] * 3 + [pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(o, k) for o, k in zip(out, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "same_"])


def _packed(batches):
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor(level=3)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pack.compress(x) for x in b.column(2).to_pylist()], pa.binary())], names=["doc_id", "rid", "z"])


def repeated(docs: DataFrame, *, text_col: str = "text", part: int = PART, collection: int = COLLECTION, bits: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    ``bits`` is what the first hash of a context has; a second one, should it be needed, has them all.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("raw"))
    packed, seed = scratch.table(rows.mapInArrow(_packed, f"doc_id {kind}, rid bigint, z binary"), "texts"), SEED
    while True:
        done = _removed(packed, kind, seed, part, collection, bits)
        if not done.filter("not same_").limit(1).count():
            return done.drop("same_")
        scratch.drop(done)
        seed, bits = seed + 1, 64


def _removed(packed: DataFrame, kind: str, seed: int, part: int, collection: int, bits: int) -> DataFrame:
    parts = max(2, int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = packed.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), "rid", "z")
    found = scratch.table(order.mapInArrow(lambda x: _occurrences(x, seed, bits), "a bigint, u bigint, doc bigint, rid bigint, q bigint"), "anchors")
    dealt = found.repartitionByRange(parts, "a", "u", "doc", "rid").sortWithinPartitions("a", "u", "doc", "rid", "q")
    groups = scratch.table(dealt.mapInArrow(lambda x: _groups(x, part), _KIND), "groups")
    scratch.drop(found)

    firsts = groups.filter("not whole").groupBy("rid").agg(F.collect_list(F.struct("a", "part", "split", "doc", "q")).alias("found"))
    texts = packed.join(firsts, "rid").select("rid", "z", "found").mapInArrow(_contexts, "a bigint, part bigint, split boolean, doc bigint, rid bigint, s bigint, off int, text binary")
    sets = texts.repartition(parts, "a", "part").sortWithinPartitions("a", "part")
    own = scratch.table(sets.mapInArrow(lambda x: _repeats(x, collection), _FOUND).hint("rebalance"), "repeats")
    open_ = own.filter("open").select("a", "t", "rid", "s", "e", F.struct("doc", "rid", "s").alias("at"))
    least = open_.groupBy("a", "t").agg(F.min("at").alias("least"))
    late = open_.join(least, ["a", "t"]).filter(F.col("at") > F.col("least")).select("rid", "s", "e")

    # contexts that repeat neighbouring ones of one text, at one distance, are one stretch
    start = F.shiftright("q", 14) - F.shiftright("q", 7).bitwiseAND(F.lit(127))
    whole = groups.filter("whole").select("rid", start.alias("s"), (start + F.col("q").bitwiseAND(F.lit(127)) + LENGTH).alias("e"), "rid0", (F.col("s0") - start).alias("by"))
    run = Window.partitionBy("rid").orderBy("rid0", "by", "s")
    new = ~((F.lag("rid0").over(run) == F.col("rid0")) & (F.lag("by").over(run) == F.col("by")) & (F.lag("e").over(run) >= F.col("s")))
    cut = whole.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("n", F.sum("new").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    runs = cut.groupBy("rid", "n").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min("rid0").alias("rid0"), F.min("by").alias("by"))
    asked = scratch.table(runs.select("rid0", "rid", "s", "e", (F.col("s") + F.col("by")).alias("s0")), "runs")
    scratch.drop(groups)
    sent = packed.select(F.col("rid").alias("rid0"), "z").join(asked, "rid0").select("rid0", "z", "rid", "s", "e", "s0").mapInArrow(_sent, "rid bigint, s bigint, e bigint, t binary")

    every = sent.unionByName(own.filter("not open").select("rid", "s", "e").unionByName(late).withColumn("t", F.lit(None).cast("binary")))
    every = scratch.table(every.hint("rebalance"), "stretches")  # texts are dealt by two keys, one after the other
    scratch.drop(asked)
    scratch.drop(own)
    stretches = every.groupBy("rid").agg(F.collect_list(F.struct("s", "e", "t")).alias("found"))
    full = packed.join(stretches, "rid", "left").select("doc_id", "z", "found")
    done = full.mapInArrow(_kept, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, same_ boolean")
    done = scratch.table(done.hint("rebalance"), "kept")  # a short row a text: few files
    scratch.drop(every)
    return done


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(documents(spark, sf_dir))


#: The same in DuckDB's SQL, for tables of single documents with ids.
OP10_SQL = """
WITH s AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT list(doc_id * 4294967296 + i) AS "at" FROM (SELECT doc_id, i, array_slice(b, i, i + 99) AS w FROM s, unnest(range(1, n - 98)) u(i)) GROUP BY w HAVING count(*) > 1),
g AS (SELECT p // 4294967296 AS doc_id, p % 4294967296 AS i FROM (SELECT unnest(list_slice(list_sort("at"), 2, len("at"))) AS p FROM w)),
x AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM g),
y AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM x),
z AS (SELECT doc_id, min(i) AS a, max(i) + 99 AS e FROM y GROUP BY doc_id, k),
t AS (SELECT doc_id, sum(e - a + 1)::BIGINT AS n_removed, count(*) AS n_spans, list([a, e] ORDER BY a) AS cut FROM z GROUP BY 1),
k AS (SELECT s.doc_id, b, n, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, list_concat([[0::BIGINT, 0::BIGINT]], coalesce(cut, [])) AS cut FROM s LEFT JOIN t USING (doc_id))
SELECT doc_id, n AS n_bytes, n_removed, n_spans,
  sha256(unhex(array_to_string(list_transform(range(1, len(cut) + 1), lambda j: hex(array_slice(b, cut[j][2] + 1, CASE WHEN j = len(cut) THEN n ELSE cut[j + 1][1] - 1 END))), ''))) AS kept_sha256 FROM k
"""
