"""Language-model scoring by Brown's class-based bigrams.

Training texts give the count of every token over the whole corpus (a distributed aggregate).  The
most frequent words are put into classes by exchange clustering: each word in turn moves to the
class that raises the likelihood of the class bigrams most.  Every further word seen ``LEAST``
times starts in the class that its neighbours' classes make likeliest; then all words, frequent and
further, are exchanged together: each word's best class is found from the sums of the classes beside it,
where these sums are, and the moves of a round stay if they raise the likelihood (else those that gain
most, by halves).  Words seen fewer times stand for words never seen and belong to a class of their form
(length, punctuation).  A text's score is the sum of log10 class transition and word emission
probabilities, both smoothed; perplexity is 10 to the power of minus the mean.

Texts are cut into words twice: once to count them, and once to write them as numbers.  Counts of all words
never meet in one place: at most ``HEAD`` words of at most ``LONGEST`` bytes go to the tasks, chosen by a
count threshold; the rest of each text's words find their counts and numbers in a join over the written
table, so that every further pass reads the numbers of all words that have a class.  The driver and each task
hold a byte for each such word, its class.  The first clustering reads at most ``UNITS`` squared sums.

Defined results: a null or empty text is the end token alone; a null doc_id belongs to the training
texts; without training texts every count is zero; repeated rows count and are scored each; other
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope import scratch
from veriscope.llm.texts import documents, fold, map_texts

#: Words whose counts go to every task, and the most bytes of such a word: 32 MB at most.
HEAD, LONGEST = 500_000, 64
#: Words that are clustered first, their classes, and rounds of exchange.
CLUSTERED, CLASSES, EXCHANGES = 1500, 48, 5
#: Rounds of exchange of all words, and the times that moves are halved if all of them lower the likelihood.
ROUNDS, HALVES = 2, 4
#: The least count of a further word with a class of its own choice.
LEAST = 5
FORMS = 8
END_CLASS = CLASSES + FORMS
ALL_CLASSES = END_CLASS + 1
#: Clustered words, forms and the end.
UNITS = CLUSTERED + FORMS + 1
SMOOTH = 0.5
#: Words that a pass over the codes holds at a time.
PASS = 1 << 18
#: Sides of a word: the classes before it, the classes after it, and itself after it.
SIDES = 2 * ALL_CLASSES + 1
#: Words whose sums a task holds in one array, and sums of other words that it holds before it writes them.
DENSE, HELD = 1 << 12, 1 << 19
#: Distinct words that a task counts before it writes their counts.
COUNTED = 1 << 18
_MARK = re.compile(rb"[!-@\[-`{-~]")
_JAVA_MARK = r"[!-@\x5B-`{-~]"


def form(word: bytes) -> int:
    return min(3, (len(word) - 1) // 3) * 2 + (_MARK.search(word) is not None)


def _form_column(word: str):
    return (F.least(F.lit(3), F.floor((F.octet_length(word) - 1) / 3)) * 2 + F.col(word).rlike(_JAVA_MARK).cast("long")).cast("int")


def tokens(texts: list[str], index: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The flat head indices (-1: another word), the number of words of each text, the other words."""
    cut = [t.encode().lower().split() for t in texts]
    n = np.array([len(c) for c in cut], np.int64)
    get = index.get
    ids = np.array([get(w, -1) for c in cut for w in c], np.int64)
    other = np.flatnonzero(ids < 0)
    if not len(other):
        return ids, n, []
    flat = [w for c in cut for w in c]
    return ids, n, [flat[i] for i in other.tolist()]


def word_counts(train: DataFrame) -> DataFrame:
    """w and c: the words of the texts (column text) and how often they occur."""

    def run(batches):
        import pyarrow as pa

        seen = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update((t or "").encode().lower().split())
                if len(seen) > COUNTED:
                    yield _counted(pa, seen)
                    seen = Counter()
        yield _counted(pa, seen)

    return train.select("text").mapInArrow(run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("c"))


def _counted(pa, seen: Counter):
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])


def _units(codes: np.ndarray, n: np.ndarray, unit: np.ndarray, first: int, end_unit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units (or classes; forms from ``first``) of the texts, an end after each; each text's first place, each word's place."""
    own = first + (-1 - codes) % FORMS
    known = codes >= 0
    own[known] = unit[codes[known]]
    end = np.cumsum(n + 1)
    out = np.full(len(codes) + len(n), end_unit, np.int64)
    place = np.arange(len(codes)) + np.repeat(np.arange(len(n)), n)
    out[place] = own
    return out, end - n - 1, place


def _xlog(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(total: np.ndarray) -> float:
    """The log likelihood of class bigrams, but for what no change of classes changes."""
    return float(_xlog(total).sum() - 2 * _xlog(total.sum(0)).sum())


def gains(beside: np.ndarray, kind: np.ndarray, total: np.ndarray) -> np.ndarray:
    """How much the likelihood rises if one word moves, for each word (row) and class; 0 for the class that it has.

    ``beside`` has the counts of each word's sides, ``kind`` the words' classes, ``total`` the class bigrams with the words in.
    """
    of, rows, cols, n = total.sum(0), total[:CLASSES], total[:, :CLASSES].T, len(kind)
    mass, own = beside[:, ALL_CLASSES:-1].sum(1), beside[:, -1]
    at, each = np.arange(n), np.arange(CLASSES)
    before, after = beside[:, :ALL_CLASSES].copy(), beside[:, ALL_CLASSES:-1].copy()
    before[at, kind] -= own
    after[at, kind] -= own
    out = np.zeros((n, CLASSES))
    for here, other, now in ((after, before, rows), (before, after, cols)):
        w, a = np.nonzero(here)
        if not len(w):
            continue
        x, t = here[w, a], now.T[a]
        mine = a == kind[w]  # that class without the word
        t[mine] -= other[w[mine], :CLASSES]
        t[np.arange(len(w)), kind[w]] -= x + own[w] * mine
        first = np.flatnonzero(np.diff(w, prepend=-1))
        out[w[first]] += np.add.reduceat(_xlog(t + x[:, None]) - _xlog(t), first, axis=0)
    x, size = np.repeat(total[each, each][None], n, 0), np.repeat(of[None, :CLASSES], n, 0)
    x[at, kind] -= before[at, kind] + after[at, kind] + own
    size[at, kind] -= mass
    b, a = before[:, :CLASSES], after[:, :CLASSES]
    out += _xlog(x + a + b + own[:, None]) - _xlog(x + a) - _xlog(x + b) + _xlog(x)
    out -= 2 * (_xlog(size + mass[:, None]) - _xlog(size))
    return out - out[at, kind][:, None]


def exchange(left: np.ndarray, right: np.ndarray, count: np.ndarray, rounds: int = EXCHANGES) -> np.ndarray:
    """The class of each unit from its bigrams (left, right, count); forms and the end keep theirs."""
    cls = np.concatenate((np.arange(CLUSTERED) % CLASSES, np.arange(CLASSES, ALL_CLASSES)))
    total = np.zeros((ALL_CLASSES, ALL_CLASSES))
    np.add.at(total, (cls[left], cls[right]), count)
    mass = np.bincount(right, count, UNITS)  # of each unit
    of = np.bincount(cls, mass, ALL_CLASSES)
    by_right, by_left = np.argsort(right, kind="stable"), np.argsort(left, kind="stable")
    into, out_of = np.searchsorted(right[by_right], np.arange(UNITS + 1)), np.searchsorted(left[by_left], np.arange(UNITS + 1))

    for _ in range(rounds):
        moved = 0
        for w in range(CLUSTERED):
            if not mass[w]:
                continue
            a, b = by_right[into[w] : into[w + 1]], by_left[out_of[w] : out_of[w + 1]]
            own = count[a][left[a] == w].sum()
            a, b = a[left[a] != w], b[right[b] != w]
            before = np.bincount(cls[left[a]], count[a], ALL_CLASSES)
            after = np.bincount(cls[right[b]], count[b], ALL_CLASSES)
            k = cls[w]
            total[k] -= after
            total[:, k] -= before
            total[k, k] -= own
            of[k] -= mass[w]
            rows, cols, same = total[:CLASSES], total[:, :CLASSES].T, np.arange(CLASSES)
            gain = (_xlog(rows + after) - _xlog(rows)).sum(1) + (_xlog(cols + before) - _xlog(cols)).sum(1)
            x = total[same, same]
            gain += _xlog(x + after[same] + before[same] + own) - _xlog(x) - (_xlog(x + after[same]) - _xlog(x)) - (_xlog(x + before[same]) - _xlog(x))
            gain -= 2 * (_xlog(of[:CLASSES] + mass[w]) - _xlog(of[:CLASSES]))
            best = int(np.argmax(gain))
            if gain[best] <= gain[k] + 1e-9:
                best = k
            moved += best != k
            cls[w] = best
            total[best] += after
            total[:, best] += before
            total[best, best] += own
            of[best] += mass[w]
        if not moved:
            break
    return cls


@dataclass(frozen=True)
class Model:
    """What training texts teach.  ``kind`` has the class of each word of ``names``; a word without one has that of its form."""

    names: list[bytes]
    kind: np.ndarray
    count: np.ndarray  # of each word of names
    trans: np.ndarray  # log10 probabilities of classes after classes
    below: np.ndarray  # log10 denominators of each class's emissions
    ends: int
    tokens: int
    types: int


@dataclass(frozen=True)
class Head:
    """The most frequent words with their counts, and how many words and tokens of each form there are in all."""

    names: list[bytes]
    count: np.ndarray
    forms: dict[int, tuple[int, int]]
    #: Which rows (w, c) of the counts these words are.
    inside: Column


def head(counts: DataFrame) -> Head:
    """The head of the counts (w, c) of all training words."""
    # one row for each form, mark and count class: how many words and tokens there are
    short = F.octet_length("w") <= LONGEST
    frame = counts.select("c", short.alias("short"), _form_column("w").alias("form"))
    forms = {r["form"]: (r["v"], r["n"]) for r in frame.groupBy("form").agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect()}
    inside = short & (F.col("c") >= _threshold(frame.filter("short")))
    got = counts.filter(inside).toArrow()
    if got.num_rows < CLUSTERED:  # many words of one count: those that are clustered first are chosen by name
        got = counts.filter(short).orderBy(F.col("c").desc(), "w").limit(CLUSTERED).toArrow()
        inside = F.col("w").isin(got["w"].to_pylist())
    order = sorted(zip(got["c"].to_pylist(), got["w"].to_pylist()), key=lambda x: (-x[0], x[1]))
    return Head([w.encode() for _, w in order], np.array([x for x, _ in order], np.int64), forms, inside)


def _tail(counts: DataFrame, top: Head) -> tuple[DataFrame, np.ndarray]:
    """w, c and id of the words outside the head, and the forms of those with an id.  Words seen ``LEAST`` times have
    one, counted on from the head's places; it is null for the others."""
    rest = counts.filter(~top.inside)
    often = scratch.table(rest.filter(F.col("c") >= LEAST).select("w", "c", _form_column("w").alias("form"), F.monotonically_increasing_id().alias("place")), "often")
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    size = {r["part"]: r["n"] for r in often.groupBy(part.alias("part")).agg((F.max(at) + 1).alias("n")).collect()}
    first, total = [], len(top.names)
    for k in range(max(size, default=-1) + 1):
        first.append(total)
        total += size.get(k, 0)
    id_ = F.get(F.array(*map(F.lit, first)), part.cast("int")).cast("int") + at.cast("int") if first else F.lit(None).cast("int")
    often = often.select("w", "c", "form", id_.alias("id"))
    got = often.select("id", F.col("form").cast("tinyint")).toArrow()
    forms = np.zeros(got.num_rows, np.int8)
    forms[got["id"].to_numpy() - len(top.names)] = got["form"].to_numpy()
    return often.select("w", "c", "id").unionByName(rest.filter(F.col("c") < LEAST).select("w", "c", F.lit(None).cast("int").alias("id"))), forms


def coded(docs: DataFrame, counts: DataFrame, top: Head, keep: list[str]) -> tuple[DataFrame, np.ndarray]:
    """The columns ``keep``, codes (a word's place in the head or its number beyond, or less than zero its form), and
    known and more of the words outside the head: how many the training texts have, and the sum of their log10 counts.
    Beside it, the forms of the numbered words outside the head."""
    shared = docs.sparkSession.sparkContext.broadcast(b"\n".join(top.names))

    def make():
        import pyarrow as pa

        index = {w: i for i, w in enumerate(shared.value.split(b"\n"))} if shared.value else {}

        def run(texts):
            ids, n, other = tokens(texts, index)
            unknown = ids < 0
            size = np.zeros(len(n), np.int64)
            np.add.at(size, np.repeat(np.arange(len(n)), n)[unknown], 1)
            cuts = np.concatenate(([0], np.cumsum(size)))
            w, tf, offs, code = [], [], [0], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b > a:
                    times = Counter(other[a:b])
                    of = {x: -1 - form(x) - FORMS * i for i, x in enumerate(times)}  # which of the text's other words it is
                    code.extend([of[x] for x in other[a:b]])
                    w.extend(times)
                    tf.extend(times.values())
                offs.append(len(w))
            ids[unknown] = code
            offs = np.array(offs, np.int32)
            starts = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            return [pa.ListArray.from_arrays(starts, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(offs, pa.array(w, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(offs, pa.array(tf, pa.int32()))]

        return run

    seen = map_texts(docs, make, "codes array<int>, w array<string>, tf array<int>", keep=keep, size=250_000)
    seen = scratch.table(seen.withColumn("row", F.monotonically_increasing_id()), "seen")
    tail, forms = _tail(counts, top)
    rest = seen.select("row", F.posexplode(F.arrays_zip("w", "tf")).alias("i", "x")).select("row", "i", F.col("x.w").alias("w"), F.col("x.tf").alias("tf"))
    found = rest.join(tail, "w", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("known"),
        F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("more"),
        F.collect_list(F.when(F.col("id").isNotNull(), F.struct("i", "id"))).alias("ids"),
    )
    full = seen.select(*keep, "codes", "row").join(found, "row", "left").select(*keep, F.coalesce("known", F.lit(0)).cast("long").alias("known"), F.coalesce("more", F.lit(0.0)).alias("more"), "codes", "ids")
    out = scratch.table(_numbered(full), "codes")
    scratch.drop(seen)
    return out, forms


def _numbered(texts: DataFrame) -> DataFrame:
    """The same with the numbers ``ids`` of the texts' other words among the codes."""
    schema = texts.drop("ids").schema

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for lo, hi in _chunks(b.column(b.num_columns - 2)):
                part = b.slice(lo, hi - lo)
                codes, ids = part.column(part.num_columns - 2), part.column(part.num_columns - 1)
                n, many = (x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (codes.value_lengths(), ids.value_lengths()))
                new, pairs = codes.flatten().to_numpy().astype(np.int64), ids.flatten()
                i, number = (x.to_numpy().astype(np.int64) for x in pairs.flatten())
                if len(i):
                    key = (np.repeat(np.arange(len(many)), many) << 32) + i
                    order = np.argsort(key)
                    key, number = key[order], number[order]
                    own = np.flatnonzero(new < 0)
                    ask = (np.repeat(np.arange(len(n)), n)[own] << 32) + (-1 - new[own]) // FORMS
                    place = np.minimum(np.searchsorted(key, ask), len(key) - 1)
                    hit = key[place] == ask
                    new[own[hit]] = number[place[hit]]
                starts = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.ListArray.from_arrays(starts, pa.array(new.astype(np.int32)))], names=schema.names)

    return texts.mapInArrow(run, schema)


def learn(train: DataFrame, counts: DataFrame) -> Model:
    """The model of training texts (column text) and the counts (w, c) of their words."""
    top = head(counts)
    return fit(*coded(train, counts, top, []), top)


def fit(train: DataFrame, tail: np.ndarray, top: Head) -> Model:
    """The model of training texts as codes; ``tail`` has the forms of the numbered words outside the head."""
    broadcast = train.sparkSession.sparkContext.broadcast
    ends, c, forms, names = train.count(), top.count, top.forms, top.names
    n_all, v_all = sum(n for _, n in forms.values()) + ends, sum(v for v, _ in forms.values()) + (ends > 0)
    shapes = np.concatenate((np.array([form(w) for w in names], np.int16), tail))
    place = np.arange(len(shapes))
    early = place < min(CLUSTERED, len(names))
    unit = np.where(early, place, CLUSTERED + shapes).astype(np.int16)
    shared = broadcast(unit)
    left, right, n = _pairs(_sums(train, lambda: _bigrams(shared.value, CLUSTERED, UNITS)), UNITS)
    cls = exchange(left, right, n)
    kind = cls[unit].astype(np.int8)  # the class of each word with a code
    # words of a class of their own choice: those of the first clustering, and all that are seen often enough
    own = early | (place >= len(names))
    own[: len(names)] |= c >= LEAST
    further = own & ~early
    if further.any():
        mass = np.bincount(cls[: early.sum()], c[:CLUSTERED], CLASSES)
        words_, to = _likeliest(_beside(train, kind, further, broadcast), _transitions(cls[left], cls[right], n), mass)
        kind[words_] = to
    total = _class_bigrams(train, kind, broadcast)
    if further.any():
        kind, total = _exchange_all(train, kind, own, total, broadcast)
    # emission denominators: a class of chosen words is closed, a form has one share for all unseen words
    types = np.bincount(kind[own], minlength=ALL_CLASSES).astype(float)
    types[CLASSES:END_CLASS] = -np.bincount(shapes[own], minlength=FORMS)
    for k, (v, _) in forms.items():
        types[CLASSES + k] += v
    size = total.sum(0)
    below = np.log10(np.maximum(size + SMOOTH * (types + (np.arange(ALL_CLASSES) >= CLASSES)), SMOOTH))  # a class without words is not asked
    below[END_CLASS] = np.log10(ends + SMOOTH)  # one token: its emission is certain
    smooth = total + SMOOTH
    return Model(names, kind, c, np.log10(smooth / smooth.sum(1, keepdims=True)), below, ends, n_all, v_all)


def _exchange_all(train: DataFrame, kind: np.ndarray, own: np.ndarray, total: np.ndarray, broadcast) -> tuple[np.ndarray, np.ndarray]:
    """Classes and class bigrams after rounds in which each word that ``own`` names may move to any class."""
    best = likelihood(total)
    for _ in range(ROUNDS):
        words_, to, gain = _moves(_beside(train, kind, own, broadcast), kind, total, broadcast)
        for _ in range(HALVES + 1):
            if not len(words_):
                return kind, total
            new = kind.copy()
            new[words_] = to
            now = _class_bigrams(train, new, broadcast)
            if likelihood(now) > best:
                break
            more = gain > np.median(gain)
            words_, to, gain = words_[more], to[more], gain[more]
        else:
            return kind, total
        kind, total, best = new, now, likelihood(now)
    return kind, total


def lm_score(docs: DataFrame, *, held_out: int = 1, folds: int = 5, text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of each row."""
    broadcast = docs.sparkSession.sparkContext.broadcast
    out_col = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    source = docs.select("doc_id", F.col(text_col).alias("text"), out_col.alias("held_out"))
    train = source.filter(~F.col("held_out"))
    counts = scratch.table(word_counts(train), "counts")
    top = head(counts)
    every, tail = coded(source, counts, top, ["doc_id", "held_out"])
    m = fit(every.filter(~F.col("held_out")), tail, top)
    model = broadcast((m.kind, m.trans, m.below, np.log10(m.count + SMOOTH), np.log10(m.ends + SMOOTH), np.log10(m.tokens + SMOOTH * (m.types + 1)), m.ends))
    scored = _map_codes(every, lambda: _scorer(model.value), "n_tokens bigint, head_known bigint, head_base double, head_score double", ["doc_id", "held_out", "known", "more"])
    score = F.col("head_score") + F.col("more")
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.col("known")).alias("n_known"),
        F.lit(m.tokens).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.col("more")).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )


def _threshold(frame: DataFrame, most: int = HEAD) -> int:
    """A count that at most ``most`` words reach, from the number of words in bands of counts.

    A band holds the counts that agree in their first 12 bits, so there are some thousands of rows.
    """
    shift = F.greatest(F.lit(0), F.floor(F.log2("c")) - 11)
    low = (F.floor(F.col("c") / F.pow(F.lit(2.0), shift)) * F.pow(F.lit(2.0), shift)).cast("long")
    total, least = 0, 1 << 62
    for r in sorted(frame.groupBy(low.alias("low")).count().collect(), key=lambda r: -r["low"]):
        total += r["count"]
        if total > most:
            break
        least = r["low"]
    return least


def _map_codes(texts: DataFrame, make, tail: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and those that ``make()``'s function gives for the codes of many texts and their lengths;
    without ``keep`` as many rows as it likes."""
    from pyspark.sql.types import StructType

    read = texts.select("codes", *keep)
    schema = StructType([*read.schema.fields[1:], *StructType.fromDDL(tail).fields])

    def run(batches):
        import pyarrow as pa

        fn = make()
        for b in batches:
            size = b.column(0).value_lengths().to_numpy().astype(np.int64)
            for lo, hi in _chunks(b.column(0)):
                part = b.slice(lo, hi - lo)
                cols = fn(part.column(0).flatten().to_numpy().astype(np.int64), size[lo:hi])
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *map(pa.array, cols)], names=schema.names)
        if hasattr(fn, "rest"):
            yield pa.RecordBatch.from_arrays([*map(pa.array, fn.rest())], names=schema.names)

    return read.mapInArrow(run, schema)


def _chunks(codes) -> list[tuple[int, int]]:
    """Ranges of rows with about ``PASS`` words each, at least one row."""
    size = codes.value_lengths().to_numpy().astype(np.int64)
    cut = np.flatnonzero(np.diff(np.cumsum(size) // PASS, prepend=-1)).tolist()
    return list(zip(cut, [*cut[1:], len(size)]))


def _sums(train: DataFrame, make) -> DataFrame:
    """pair and n: the counts of pairs that ``make``'s function finds, summed over the training texts."""
    return _map_codes(train, make, "pair bigint, n bigint", []).groupBy("pair").agg(F.sum("n").alias("n"))


def _pairs(sums: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left, right and count, in the order of left and right; at most ``width`` squared rows."""
    got = sums.toArrow()
    pair, n = (got[k].to_numpy().astype(np.int64) for k in ("pair", "n"))
    at = np.argsort(pair)
    return pair[at] // width, pair[at] % width, n[at].astype(float)


def _transitions(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> np.ndarray:
    trans = np.full((ALL_CLASSES, ALL_CLASSES), SMOOTH)
    np.add.at(trans, (left, right), n)
    return np.log10(trans / trans.sum(1, keepdims=True))


def _class_bigrams(train: DataFrame, kind: np.ndarray, broadcast) -> np.ndarray:
    shared, total = broadcast(kind), np.zeros((ALL_CLASSES, ALL_CLASSES))
    left, right, n = _pairs(_sums(train, lambda: _bigrams(shared.value, CLASSES, ALL_CLASSES)), ALL_CLASSES)
    total[left, right] = n
    return total


class _Sums:
    """A task's counts of the sides of the words that ``asked`` names: a row for a word with its counts, packed, each time
    that ``HELD`` of them have gathered, and at the end."""

    def __init__(self, kind: np.ndarray, asked: np.ndarray):
        self.kind, self.asked, self.held = kind, asked, []
        self.dense = np.zeros(min(DENSE, len(kind)) * SIDES, np.int64)

    def __call__(self, codes: np.ndarray, n: np.ndarray):
        c, start, place = _units(codes, n, self.kind, CLASSES, END_CLASS)
        before = np.roll(c, 1)
        before[start] = END_CLASS
        own = np.flatnonzero(codes >= 0)
        own = own[self.asked[codes[own]]]
        key, at = codes[own] * SIDES, place[own]
        twice = np.flatnonzero(np.diff(own) == 1)
        twice = twice[(codes[own[twice]] == codes[own[twice] + 1]) & (np.diff(at)[twice] == 1)]  # itself after it, in one text
        key = np.concatenate((key + before[at], key + ALL_CLASSES + c[at + 1], key[twice] + 2 * ALL_CLASSES))
        low = key < len(self.dense)
        self.dense += np.bincount(key[low], minlength=len(self.dense))
        self.held.append(np.unique(key[~low], return_counts=True))
        return self.flush() if sum(len(k) for k, _ in self.held) > HELD else _packed(key[:0], key[:0])

    def flush(self):
        key, n = (np.concatenate(x) for x in zip(*self.held))
        self.held = []
        if not len(key):
            return _packed(key, n)
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        return _packed(key[first], np.add.reduceat(n, first))

    def rest(self):
        key = np.flatnonzero(self.dense)
        self.held.append((key, self.dense[key]))
        return self.flush()


def _packed(key: np.ndarray, n: np.ndarray):
    """Words and their sides with counts, eight bytes each, of sorted keys."""
    import pyarrow as pa

    w = key // SIDES
    first = np.flatnonzero(np.diff(w, prepend=-1))
    offs = pa.py_buffer((np.append(first, len(w)) * 8).astype(np.int32).tobytes())
    return pa.array(w[first]), pa.Array.from_buffers(pa.binary(), len(first), [None, offs, pa.py_buffer((n << 8 | key % SIDES).astype(np.int64).tobytes())])


def _beside(train: DataFrame, kind: np.ndarray, asked: np.ndarray, broadcast) -> DataFrame:
    """w and sides: the packed counts of the sides of each word that ``asked`` names."""
    shared = broadcast((kind.copy(), asked))
    return _map_codes(train, lambda: _Sums(*shared.value), "w bigint, sides binary", []).groupBy("w").agg(F.collect_list("sides").alias("sides"))


def _unpacked(batches, most: int):
    """Words and the counts of their sides, at most so many words at a time."""
    for b in batches:
        for i in range(0, b.num_rows, most):
            part = b.slice(i, most)
            ends = np.concatenate(([0], np.cumsum(part.column(1).value_lengths().to_numpy())))
            flat = part.column(1).flatten()
            raw = flat.buffers()
            offs = np.frombuffer(raw[1], np.int32)[flat.offset : flat.offset + len(flat) + 1] // 8
            x = np.frombuffer(raw[2], np.int64, offs[-1])[offs[0] :]
            row = np.repeat(np.arange(part.num_rows), np.diff(offs[ends]))
            sums = np.bincount(row * SIDES + (x & 255), x >> 8, part.num_rows * SIDES).reshape(-1, SIDES)
            yield part.column(0).to_numpy(), sums


def _likeliest(beside: DataFrame, trans: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and their classes, from the counts of classes beside each word."""
    weight = np.concatenate((trans[:, :CLASSES], trans[:CLASSES].T))  # classes before, then classes after

    def run(batches):
        import pyarrow as pa

        for w, sums in _unpacked(batches, 5_000):
            own = sums[:, :ALL_CLASSES].sum(1, keepdims=True)
            fit = sums[:, :-1] @ weight - own * np.log10(np.maximum(mass + own, SMOOTH))
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(np.argmax(fit, 1).astype(np.int8))], names=["w", "k"])

    got = beside.mapInArrow(run, "w bigint, k tinyint").toArrow()  # a row a word
    return got["w"].to_numpy(), got["k"].to_numpy()


def _moves(beside: DataFrame, kind: np.ndarray, total: np.ndarray, broadcast) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words that another class suits better, those classes, and what each move alone would gain."""
    shared = broadcast(kind.copy())

    def run(batches):
        import pyarrow as pa

        for w, sums in _unpacked(batches, 400):
            gain = gains(sums, shared.value[w].astype(np.int64), total)
            best, at = np.argmax(gain, 1), np.arange(len(w))
            up = gain[at, best] > 1e-6
            yield pa.RecordBatch.from_arrays([pa.array(w[up]), pa.array(best[up].astype(np.int8)), pa.array(gain[at, best][up])], names=["w", "k", "gain"])

    got = beside.mapInArrow(run, "w bigint, k tinyint, gain double").toArrow()
    return tuple(got[k].to_numpy() for k in ("w", "k", "gain"))


def _bigrams(unit: np.ndarray, forms: int, width: int):
    def run(codes, n):
        own, start, _ = _units(codes, n, unit, forms, width - 1)
        before = np.roll(own, 1)
        before[start] = width - 1
        return np.unique(before * width + own, return_counts=True)

    return run


def _scorer(model):
    kind, trans, below, head_log, end_log, all_log, ends = model

    def run(codes, n):
        c, start, _ = _units(codes, n, kind, CLASSES, END_CLASS)
        before = np.roll(c, 1)
        before[start] = END_CLASS
        step = trans[before, c] - below[c]
        log = np.zeros(len(codes))
        known = (codes >= 0) & (codes < len(head_log))
        log[known] = head_log[codes[known]]
        owner = np.repeat(np.arange(len(n)), n)
        logs = np.bincount(owner, log, len(n)) + end_log
        seen = np.bincount(owner, known, len(n)).astype(np.int64) + (ends > 0)
        return n + 1, seen, logs - (n + 1) * all_log, np.add.reduceat(step, start) + logs

    return run


def op7_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(documents(spark, sf_dir))
