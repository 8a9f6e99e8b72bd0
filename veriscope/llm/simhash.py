"""SimHash near-duplicates by multi-index hashing.

A fingerprint's 64 bits are the majority votes of the XXH64 hashes of a text's shingles.  Two
fingerprints at most ``distance`` bits apart agree to within ``distance // segments`` bits in at
least one of the segments, so each distinct fingerprint is stored under its segments and looks up
a small Hamming ball around each of its own; what is fetched is verified on all 64 bits.  Where a
segment value is shared by more fingerprints than a whole ball has members, the looked-up ball is
drawn over all bits instead, so no bucket is compared all against all and no link is lost.

Linked fingerprints get the label of their component by hooking to the least neighbour, pointer jumping and
contraction: each round goes on with the links between different roots alone, as written tables.  Rows with one fingerprint meet only in partial aggregates and in
one join that adaptive execution can split.

:func:`near_duplicates` does the same for a similarity of texts, by default 0.8 of five-word shingles,
which 64 bits are too few for: fingerprints have ``WIDE`` bits, a pair at that similarity differs in 15 of
a hundred, and no cut into segments keeps such a pair within a small ball of one for certain.  So there are
as many segments as make a miss unlikely (``MISS``), their width grows with the logarithm of the number of
documents, equal values propose a pair, and the complete distance decides.  (Looking up values a bit away as well
needs a quarter of the segments and three times the rows.)  A segment value that more than
``HOT`` fingerprints share is first linked through four of them, so a large group of near copies makes no square
of pairs.  The rest of its pairs are compared as well, as far as they lie in different groups by then: no other
pair can change a component.  Where more than ``GROUPS`` groups share a value, texts that cannot be similar to any
of them do not meet: those with too many shingles that no other text there has.  Of pairs that their sets decide, the closest between two groups go first, and
then all that still lie in different groups.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; a text
with fewer words than a shingle is one shingle; repeated rows are returned each; a null doc_id is
returned but never is a component's id unless no other is there; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations
from math import acos, ceil, log, log2, pi

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veriscope import scratch
from veriscope.llm.texts import documents, lower_ascii, map_texts, small, words

SHINGLE = 3
DISTANCE = 2
SEGMENTS = 2
SEED = 42
#: Bits of a wide fingerprint, its shingles' words, the similarity it is for, and the chance to miss a pair at that similarity.
WIDE, WIDE_SHINGLE, SIMILARITY, MISS = 1024, 5, 0.8, 0.02
#: Fingerprints that share a segment value and are compared each with each, whatever groups they are in.
HOT = 8
#: Groups that share such a value and all meet, whatever their texts have in common.
GROUPS = 8
#: Standard deviations around the bits that differ at the similarity within which sets decide, and the same for the first 128 bits.
SLACK, SLACK_128 = 2, 3.25
#: Shingles that are counted together, for a bit each.
BLOCK = 1 << 22
#: Words of fingerprints that are counted at a time: 4 MB of counts, however short the texts.
VOTES = 1 << 13


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def vote(texts: list[str], shingle: int = SHINGLE, seed: int = SEED, words: int = 1) -> np.ndarray:
    """The fingerprints of texts as ``words`` signed 64-bit integers each (a row a text).

    The first word has the bits of the shingles' XXH64, each further one those of a mix of it.
    """
    from xxhash import xxh64_intdigest

    step = max(1, VOTES // words)
    if len(texts) > step:
        return np.concatenate([vote(texts[i : i + step], shingle, seed, words) for i in range(0, len(texts), step)])
    ones, total = np.zeros((len(texts), 64 * words), np.int64), np.zeros(len(texts), np.int64)
    more = (np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[1:]
    most = BLOCK // (64 * words)
    flat: list[int] = []
    runs: list[tuple[int, int]] = []

    def count():
        h = np.array(flat, np.uint64)[:, None]
        bits = np.unpackbits(np.concatenate((h, _mix(h + more)), axis=1).view(np.uint8), axis=1, bitorder="little")
        at = 0
        for i, n in runs:
            ones[i] += bits[at : at + n].sum(0, dtype=np.int32)
            total[i] += n
            at += n
        flat.clear()
        runs.clear()

    for i, t in enumerate(texts):
        w = t.encode().lower().split()  # of bytes: A-Z alone, and the six white-space characters alone
        size = min(len(w), shingle)
        for lo in range(0, max(0, len(w) - size + 1) if w else 0, most):  # a long text in blocks
            own = w[lo : lo + most + size - 1]
            n = len(own) - size + 1
            if len(flat) + n > most and flat:
                count()
            flat += [xxh64_intdigest(b" ".join(x), seed) for x in zip(*(own[k:] for k in range(size)))]
            runs.append((i, n))
    if flat:
        count()
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.int64)


def fingerprints(docs: DataFrame, *, keep: list[str], text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` and fp (long)."""
    import pyarrow as pa

    return map_texts(docs, lambda: lambda texts: [pa.array(vote(texts, shingle)[:, 0])], "fp bigint", keep=keep, text_col=text_col)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ball(low: int, width: int, radius: int) -> list[int]:
    """Masks with at most ``radius`` bits among the ``width`` bits from ``low``, zero first."""
    return [_signed(sum(1 << b for b in c)) for r in range(radius + 1) for c in combinations(range(low, low + width), r)]


def _far(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Each pair a, b of distinct fingerprints (column fp, no repeats) within ``distance`` bits, once."""
    if 64 % segments:
        raise ValueError("segments must divide 64")
    width, radius = 64 // segments, distance // segments
    part = [_signed(((1 << width) - 1) << (s * width)) for s in range(segments)]
    whole = [[m for m in ball(0, 64, distance) if not m & part[s]] for s in range(segments)]
    hot = max(map(len, whole))

    def entries(name: str) -> DataFrame:
        segs = F.array(*[F.struct(F.lit(s).alias("s"), F.col("fp").bitwiseAND(F.lit(part[s])).alias("v")) for s in range(segments)])
        return fps.select(F.col("fp").alias(name), F.explode(segs).alias("e")).select(name, F.col("e.s").alias("s"), F.col("e.v").alias("v"))

    # of two different segment values, only the larger looks up the smaller
    masks = F.array(*[F.array(*[F.lit(m) for m in ball(s * width, width, radius)]) for s in range(segments)])
    probes = (
        entries("a")
        .select("a", "s", F.col("v").alias("own"), F.explode(masks[F.col("s")]).alias("m"))
        .select("a", "s", "m", "own", F.col("own").bitwiseXOR(F.col("m")).alias("v"))
        .filter("v <= own")
        .select("a", "s", "m", "v")
    )
    table = entries("b")
    crowded = table.groupBy("s", "v").count().filter(F.col("count") > hot).select("s", "v", F.lit(True).alias("hot"))
    probes = probes.join(crowded, ["s", "v"], "left")
    ordered = (F.col("m") != 0) | (F.col("a") < F.col("b"))
    near = _far(F.col("a"), F.col("b")).between(1, distance)
    cold = probes.filter("hot is null").alias("p").join(table.alias("t"), (F.col("p.s") == F.col("t.s")) & (F.col("p.v") == F.col("t.v")) & ordered & near).select("a", "b")
    rest = F.array(*[F.array(*[F.lit(m) for m in whole[s]]) for s in range(segments)])
    drawn = (
        probes.filter("hot")
        .select("a", "m", F.explode(rest[F.col("s")]).alias("o"))
        .filter(F.bit_count("m") + F.bit_count("o") <= distance)
        .select("a", "m", F.col("a").bitwiseXOR(F.col("m")).bitwiseXOR(F.col("o")).alias("b"))
        .filter((F.col("a") != F.col("b")) & ordered)
    )
    dense = drawn.join(fps.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b")
    return cold.unionByName(dense).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """For each node of ``pairs`` (a, b: long) the least label within reach.

    ``label`` has columns fp and doc_id for each node at least.  Returns fp and component_id.  Each
    round hooks every node to its least neighbour, jumps pointers until all name the root of their tree,
    and goes on with the links between different roots, each once: half the nodes at most.  So a link is joined
    in the rounds in which its ends are still apart, not in all of them.  Tables are written, so a lost executor costs one step.
    """
    edges, roots = scratch.table(pairs.select("a", "b").filter("a != b"), "edges"), None
    while roots is None or edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.table(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("r")), "least")
        # hooks to the least neighbour make no cycle but of two nodes, of which the lesser is the root
        now = scratch.table(_jumped(least).select("u", F.when(F.col("j") == F.col("u"), F.least("u", "r")).otherwise(F.col("j")).alias("r")), "hooked")
        scratch.drop(least)
        while True:
            after = scratch.table(_jumped(now).select("u", F.col("j").alias("r"), (F.col("r") != F.col("j")).alias("moved")), "hooked")
            scratch.drop(now)
            now = after.drop("moved")
            now.scratch_path = after.scratch_path
            if not after.filter("moved").limit(1).count():
                break
        of = lambda c: now.select(F.col("u").alias(c), F.col("r").alias(f"r{c}"))
        left = edges.join(of("a"), "a").join(of("b"), "b").filter("ra != rb")
        left = scratch.table(left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        scratch.drop(edges)
        edges = left
        if roots is None:
            roots = now
        else:
            named = roots.join(now.select(F.col("u").alias("r"), F.col("r").alias("s")), "r", "left")
            named = scratch.table(named.select("u", F.coalesce("s", "r").alias("r")), "roots")
            scratch.drop(roots)
            scratch.drop(now)
            roots = named
    scratch.drop(edges)
    first = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"))
    names = roots.join(label.select(F.col("fp").alias("u"), first.alias("l")), "u").groupBy("r").agg(F.min("l").alias("l"))
    return roots.join(names, "r").select(F.col("u").alias("fp"), F.col("l.d").alias("component_id"))


def _jumped(hooks: DataFrame) -> DataFrame:
    """The hooks u to r, and what r is hooked to (j)."""
    return hooks.join(hooks.select(F.col("u").alias("r"), F.col("r").alias("j")), "r").select("u", "r", "j")


def simhash(docs: DataFrame, *, text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of ``docs``."""
    own = scratch.table(fingerprints(docs, keep=["doc_id"], text_col=text_col, shingle=shingle), "fingerprints")
    fps = scratch.table(own.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct")
    pairs = scratch.table(links(fps.select("fp"), distance, segments), "links")
    named = fps.join(components(pairs, fps), "fp", "left").select("fp", F.coalesce("component_id", "doc_id").alias("component_id"))
    named = scratch.table(named, "components")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return own.join(named, "fp").select("doc_id", text.alias("fingerprint"), "component_id")


def differing(similarity: float) -> float:
    """The share of bits in which two texts of equal size and this similarity of their shingles differ."""
    return acos(2 * similarity / (1 + similarity)) / pi


def plan(rows: int, similarity: float = SIMILARITY, miss: float = MISS) -> tuple[int, int]:
    """The width of a segment and the number of segments: a value has about one of ``rows`` by chance."""
    width = max(16, ceil(log2(max(rows, 2))))
    return width, ceil(log(miss) / log(1 - (1 - differing(similarity)) ** width))


def keys(prints: np.ndarray, width: int, segments: int) -> np.ndarray:
    """The segments of wide fingerprints: number and value in one long.  The first two words' bits are in none."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")[:, 128:]
    n = bits.shape[1]
    at = np.arange(width * segments)
    at = at % n * (2 * (at // n * 101) + 1) % n  # beyond all bits once more, in another order
    power = np.int64(1) << np.arange(width, dtype=np.int64)
    return np.stack([bits[:, a].astype(np.int64) @ power | np.int64(s) << np.int64(width) for s, a in enumerate(at.reshape(segments, width))], axis=1)


def _keyed(prints: DataFrame, width: int, segments: int) -> DataFrame:
    """The same (fp first) with the first two words x and y, and the keys of the segments."""
    schema = StructType([*prints.schema.fields, *StructType.fromDDL("x bigint, y bigint, keys array<bigint>")])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            own = np.frombuffer(b"".join(b.column(0).to_pylist()), np.int64).reshape(b.num_rows, -1)
            offsets = np.arange(0, b.num_rows * segments + 1, segments, dtype=np.int32)
            own_keys = pa.ListArray.from_arrays(offsets, pa.array(keys(own, width, segments).ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own[:, 0]), pa.array(own[:, 1]), own_keys], names=schema.names)

    return prints.mapInArrow(run, schema)


def _candidates(fps: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Pairs a, b of ids whose fingerprints agree in a segment, and in the first two words but for ``most``.

    Where more than ``HOT`` share a value, only pairs with one of its ends: :func:`_across` has the others.  The keys
    of these values are returned beside the pairs.
    """
    own = ("id", "x", "y")
    table = fps.select(*own, F.explode("keys").alias("key"))
    crowded = small(scratch.table(table.groupBy("key").count().filter(F.col("count") > HOT).select("key"), "crowded"))
    near = (_far(F.col("p.x"), F.col("t.x")) + _far(F.col("p.y"), F.col("t.y"))) <= most
    alone = table.join(crowded, "key", "left_anti")
    cold = alone.alias("p").join(alone.alias("t"), (F.col("p.key") == F.col("t.key")) & (F.col("p.id") < F.col("t.id")) & near)
    shared, some = table.join(crowded, "key", "left_semi"), F.struct(*own)
    ends = shared.groupBy("key").agg(F.array_distinct(F.array(F.min(some), F.max(some), F.min_by(some, "x"), F.max_by(some, "x"))).alias("ends"))
    hot = shared.join(ends, "key").select(F.struct(*own).alias("p"), F.explode("ends").alias("t")).filter((F.col("p.id") != F.col("t.id")) & near)
    a, b = F.col("p.id"), F.col("t.id")
    return cold.select(a.alias("a"), b.alias("b")).unionByName(hot.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))).distinct(), crowded


def _across(fps: DataFrame, texts: DataFrame, crowded: DataFrame, group: DataFrame, most: int, most_128: int, shingle: int, similarity: float) -> DataFrame:
    """a, b and d (at most ``most``) of the pairs that the values of ``crowded`` propose, of those in different groups.

    ``fps`` has id, h, x, y, keys and w (all words), ``group`` fp (an id) and component_id.  Groups meet before their
    members do, so members of one group make no pairs.  Of the texts of values that more than ``GROUPS`` share, those
    that have too few shingles in common with all others of them do not meet these: they are similar to none.
    """
    entries = fps.select("id", F.explode("keys").alias("key")).join(crowded, "key", "left_semi")
    entries = scratch.table(entries.join(group.withColumnRenamed("fp", "id"), "id", "left").select("key", "id", F.coalesce("component_id", "id").alias("c")), "entries")
    several = entries.select("key", "c").distinct().groupBy("key").agg(F.count("*").alias("g")).filter("g > 1")
    entries = scratch.table(entries.join(small(scratch.table(several, "several")), "key"), "several")
    asked = scratch.table(entries.filter(F.col("g") > GROUPS).select("id").distinct(), "many")
    sets = _sets(asked, fps, texts, shingle).select("id", F.size("s").alias("n"), "s")
    alone = sets.select("id", F.explode("s").alias("e")).groupBy("e").agg(F.min("id").alias("id"), F.max("id").alias("hi")).filter("id = hi")
    # of how many shingles each text has, how many another has too; far: 1, or 2 if too few for a similarity to any of them
    known = sets.drop("s").join(alone.groupBy("id").agg(F.count("*").alias("k")), "id", "left").select("id", "n", (F.col("n") - F.coalesce("k", F.lit(0))).alias("o"))
    known = scratch.table(known.withColumn("far", F.when(F.col("o") < similarity * F.col("n") - 1e-9, 2).otherwise(1)), "known")
    entries = entries.join(small(known).select("id", "far"), "id", "left").withColumn("far", F.coalesce("far", F.lit(0)))
    entries = scratch.table(entries.filter((F.col("g") <= GROUPS) | (F.col("far") < 2)).select("key", "id", "c", "far"), "entries")
    ids = scratch.table(entries.select("id").distinct(), "ids")
    words = fps.join(small(ids), "id", "left_semi").select("id", "x", "y", "w")
    words = scratch.table(words.join(small(known).select("id", "n", "o"), "id", "left"), "words")
    classes = entries.select("key", "c", "far").distinct()
    meet = classes.withColumnsRenamed({"c": "pc", "far": "pfar"}).join(classes, "key").filter("pc < c and pfar * far < 2")
    left = meet.join(entries.withColumnsRenamed({"id": "pid", "c": "pc", "far": "pfar"}), ["key", "pc", "pfar"])
    left = left.join(words.withColumnsRenamed({c: f"p{c}" for c in words.columns}), "pid").select("key", "c", "far", "pid", "px", "py", "pw", "pn", "po")
    right = entries.join(words, "id")
    close = _far(F.col("px"), F.col("x")) + _far(F.col("py"), F.col("y")) <= most_128
    may = F.coalesce(F.least("po", "o") * (1 + similarity) >= similarity * (F.col("pn") + F.col("n")) - 1e-9, F.lit(True))
    met = left.join(right, ["key", "c", "far"]).filter(close & may & (_distance("pw", "w") <= most))
    return met.select(F.least("pid", "id").alias("a"), F.greatest("pid", "id").alias("b"), _distance("pw", "w").alias("d")).distinct()


def _distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: _far(u, v)), F.lit(0), lambda s, n: s + n)


def near_duplicates(docs: DataFrame, *, text_col: str = "text", shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id of every row: texts whose shingles have about this similarity or more are linked."""
    import pyarrow as pa

    longs = WIDE // 64
    width, segments = plan(docs.count(), similarity)
    p = differing(similarity)
    least, most, most_128 = (int(n * p + k * (n * p * (1 - p)) ** 0.5) for n, k in ((WIDE, -SLACK), (WIDE, SLACK), (128, SLACK_128)))

    def make():
        return lambda texts: [pa.array([r.tobytes() for r in vote(texts, shingle, words=longs)], pa.binary())]

    start = scratch.mark()
    texts = docs.select("doc_id", F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t")).select("doc_id", "t", F.md5(F.col("t").cast("binary")).alias("h"))
    every = map_texts(texts, make, "fp binary", keep=["doc_id", "h"], text_col="t")
    every = scratch.table(every.withColumn("id", F.monotonically_increasing_id()), "wide")
    fps = every.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min("id").alias("id"), F.min("h").alias("h"))
    fps = scratch.table(_keyed(fps, width, segments), "distinct")
    pairs, crowded = _candidates(fps, most_128)
    word = lambda c: F.transform(F.sequence(F.lit(0), F.lit(longs - 1)), lambda i: F.conv(F.hex(F.substring(c, i * 8 + 1, F.lit(8))), 16, -10).cast("bigint"))
    full = fps.select("id", word(F.col("fp")).alias("w"))
    met = pairs.join(full.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a").join(full.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b")
    near = scratch.table(met.select("a", "b", _distance("wa", "wb").alias("d")).filter(F.col("d") <= most), "near")
    label = fps.select(F.col("id").alias("fp"), F.col("id").alias("doc_id"))
    group = scratch.table(components(near.filter(F.col("d") <= least).select("a", "b"), label), "groups")
    sure = near.filter(F.col("d") <= least).select("a", "b")

    def apart(pairs: DataFrame, group: DataFrame) -> DataFrame:
        """The pairs whose ends are in different groups, with these."""
        of = lambda c: group.select(F.col("fp").alias(c), F.col("component_id").alias(f"c{c}"))
        return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumns({f"c{c}": F.coalesce(f"c{c}", c) for c in "ab"}).filter("ca != cb")

    closest = apart(near.filter(F.col("d") > least), group).groupBy(F.least("ca", "cb"), F.greatest("ca", "cb")).agg(F.min(F.struct("d", "a", "b")).alias("m")).select("m.a", "m.b")
    closest = scratch.table(closest, "closest")
    found = scratch.table(sure.unionByName(_similar(closest, fps, texts, shingle, similarity)), "links")
    group = scratch.table(components(found, label), "groups")
    # all that is still apart: what other pairs of the values that many share, and the less close ones, link
    wide = fps.select("id", "h", "x", "y", "keys", word(F.col("fp")).alias("w"))
    across = scratch.table(_across(wide, texts, crowded, group, most, most_128, shingle, similarity), "across")
    unsure = near.unionByName(across).filter(F.col("d") > least).select("a", "b").distinct().join(closest, ["a", "b"], "left_anti")
    rest = scratch.table(apart(unsure, group).select("a", "b"), "rest")
    more = across.filter(F.col("d") <= least).select("a", "b").unionByName(_similar(rest, fps, texts, shingle, similarity))
    more = scratch.table(apart(more, group).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "links")
    own = fps.join(group.withColumnRenamed("fp", "id"), "id", "left").select("fp", "doc_id", F.coalesce("component_id", "id").alias("c"))
    if more.limit(1).count():
        merged = components(more, label).select(F.col("fp").alias("c"), F.col("component_id").alias("m"))
        own = own.join(merged, "c", "left").select("fp", "doc_id", F.coalesce("m", "c").alias("c"))
    named = own.join(own.groupBy("c").agg(F.min("doc_id").alias("component_id")), "c").select("fp", "component_id")
    named = scratch.table(named, "components")
    done = scratch.table(every.select("doc_id", "fp").join(named, "fp").select("doc_id", "component_id"), "named")
    scratch.release(keep=done, since=start)
    return done


def _sets(ids: DataFrame, fps: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """id and s, the hashes of the text's shingles, of each of ``ids``.

    Texts are found by their MD5; those that are asked for are few where near copies are.
    """
    asked = scratch.table(fps.join(ids, "id", "left_semi").select("id", "h"), "asked")
    met = texts.join(small(asked.select("h").distinct(), asked.count()), "h", "left_semi").select("h", words(lower_ascii(F.col("t"))).alias("w"))
    own = asked.join(met.groupBy("h").agg(F.min("w").alias("w")), "h")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - shingle + 1, F.lit(1)))
    return own.select("id", F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice("w", i, F.lit(shingle))))).alias("s"))


def _similar(pairs: DataFrame, fps: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs a, b of ids whose texts' sets of shingles have a Jaccard similarity of at least ``similarity``."""
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), fps, texts, shingle)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(common >= similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(documents(spark, sf_dir))
