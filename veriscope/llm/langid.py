"""Language identification by a linear-chain conditional random field over words.

A text is the sequence of its runs of letters.  A word's features are its affixes, its character
n-grams with borders and whether it is in the lexicon of a language; a state is a language, and
learned transitions say how often neighbours share one, so words in code-switched text get labels
of their own.  Forward-backward gives every word's posteriors; a text's language is the one with the
largest mean posterior, which is its score.

The field is fitted on at most ``SAMPLE`` labelled texts of each language (those of least hash, so a
third of all rows in one source or group of copies does not matter).  Those texts are learned from whole,
in sequences of ``SEQUENCE`` words, by gradients of the likelihood; every language of the table is one.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without labelled
training texts every text is ``und``; repeated rows are returned each; a null doc_id belongs to the
training texts; other columns are not read.
"""

from __future__ import annotations

import re
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.llm.texts import documents, fold, map_texts

#: Labelled texts of each language that the field is fitted on.
SAMPLE = 400
SEQUENCE = 40
#: States up to which a chain is cut into blocks, at a cost of their cube; beyond, texts advance word by word together.
FEW = 8
BUCKETS = 1 << 16
LEXICON = 200
EPOCHS = 3
_WORD = re.compile(r"[^\W\d_]+")


def split_words(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    return [w for w in _WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


_MIX, _P = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


def grams(names: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature its buckets and the word of each, in the order of words: character
    one- to three-grams with borders, a prefix and a suffix of three letters, the word itself."""
    raw = np.frombuffer("".join(f"\x02{w}\x03" for w in names).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(w) + 2 for w in names], np.int64)
    end = np.cumsum(size)
    start = end - size
    owner = np.repeat(np.arange(len(names)), size)

    def bucket(h, kind):
        return (((h + np.uint64(kind)) * _MIX) >> np.uint64(48)).astype(np.int64) % BUCKETS

    out, h = [], raw
    for k in range(1, 4):
        if k > 1:
            h = h[:-1] * _P + raw[k - 1 :]
        same = owner[: len(h)] == owner[k - 1 :]
        out.append((bucket(h[same], k), owner[: len(h)][same]))
    long = np.flatnonzero(size >= 5)
    for at, kind in ((start[long], 4), (end[long] - 4, 5)):
        h = raw[at]
        for i in range(1, 4):
            h = h * _P + raw[at + i]
        out.append((bucket(h, kind), long))
    power = np.cumprod(np.full(int(size.max()), _P), dtype=np.uint64)
    out.append((bucket(np.add.reduceat(raw * power[np.arange(len(raw)) - np.repeat(start, size)], start), 6), np.arange(len(names))))
    return out


class Field:
    """Emission weights by bucket, lexicon weights, transitions and the start."""

    def __init__(self, labels: list[str], lexicon: dict[str, set[int]]):
        self.labels = labels
        n = len(labels)
        self.emit, self.lex = np.zeros((BUCKETS, n)), np.zeros((n, n))
        self.trans, self.start = np.zeros((n, n)), np.zeros(n)
        self.row = {w: i for i, w in enumerate(lexicon, 1)}
        self.bits = np.zeros((len(lexicon) + 1, n), np.uint8)  # the first row is that of all other words
        for i, own in enumerate(lexicon.values(), 1):
            self.bits[i, sorted(own)] = 1

    def listed(self, names: list[str]) -> np.ndarray:
        return self.bits[[self.row.get(w, 0) for w in names]]

    def scores(self, names: list[str]) -> np.ndarray:
        """Log scores of distinct words by language."""
        out = self.listed(names) @ self.lex
        for bucket, owner in grams(names):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            if len(first):
                out[owner[first]] += np.add.reduceat(self.emit[bucket], first)
        return out


def forward_backward(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Posteriors of every word of several sequences laid end to end.

    ``emit``: words by states, log scores; ``first``: True where a sequence starts.
    """
    alpha, beta, _ = messages(emit, first, trans, start)
    post = alpha * beta
    return post / post.sum(1, keepdims=True)


def pair_sums(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of every word, and the expected number of each transition in all sequences."""
    alpha, beta, e = messages(emit, first, trans, start)
    post = alpha * beta
    inner = np.flatnonzero(~first)
    t, right = np.exp(trans - trans.max()), e[inner] * beta[inner]
    left = alpha[inner - 1]
    whole = ((left @ t) * right).sum(1, keepdims=True)  # of each pair of neighbours
    return post / post.sum(1, keepdims=True), (left / whole).T @ right * t


def messages(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward and backward messages of every word, and its scaled emissions."""
    return (_by_blocks if emit.shape[1] <= FEW else _by_words)(emit, first, trans, start)


def _by_words(emit, first, trans, start):
    """All sequences advance together, the longest to its end."""
    n, k = emit.shape
    e = np.exp(emit - emit.max(1, keepdims=True))
    t, s = np.exp(trans - trans.max()), np.exp(start - start.max())
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, n))
    order = np.argsort(-size, kind="stable")
    at, size = at[order], size[order]
    going = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")  # sequences longer than each step
    alpha, beta = np.empty((n, k)), np.ones((n, k))
    v = np.broadcast_to(s, (len(at), k))
    for i, m in enumerate(going.tolist()):
        here = at[:m] + i
        v = (v[:m] if i == 0 else v[:m] @ t) * e[here]
        v = v / v.sum(1, keepdims=True)
        alpha[here] = v
    for i in range(len(going) - 2, -1, -1):
        here = at[: going[i + 1]] + i
        v = (e[here + 1] * beta[here + 1]) @ t.T
        beta[here] = v / v.sum(1, keepdims=True)
    return alpha, beta, e


def _by_blocks(emit, first, trans, start):
    """The chain is cut into blocks; all blocks advance together, once as products of matrices to learn what
    enters each block, and once more from there.  Scaling at each step keeps it exact in floating point."""
    n, k = emit.shape
    e = np.exp(emit - emit.max(1, keepdims=True))
    t, s = np.exp(trans - trans.max()), np.exp(start - start.max())
    width = max(1, int(np.sqrt(n)))
    blocks = -(-n // width)
    pad = blocks * width - n
    e = np.concatenate((e, np.ones((pad, k)))).reshape(blocks, width, k)
    f = np.concatenate((first, np.ones(pad, bool))).reshape(blocks, width)

    def scaled(x, axes):
        return x / x.sum(axes, keepdims=True)

    # forward: a row vector passes word i by t (or, at a start, by s whatever came before), then e
    whole = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for i in range(width):
        step = np.where(f[:, i, None, None], whole.sum(2, keepdims=True) * s, whole @ t)
        whole = scaled(step * e[:, i, None, :], (1, 2))
    enter = np.empty((blocks, k))
    v = np.ones(k) / k
    for b in range(blocks):
        enter[b] = v
        v = scaled(v @ whole[b], 0)
    alpha = np.empty((blocks, width, k))
    v = enter
    for i in range(width):
        v = scaled(np.where(f[:, i, None], s, v @ t) * e[:, i], 1)
        alpha[:, i] = v
    # backward: beta of word i from word i + 1; at the end of a sequence it is one
    last = np.concatenate((f.reshape(-1)[1:], [True])).reshape(blocks, width)
    nxt = np.concatenate((e.reshape(-1, k)[1:], np.ones((1, k)))).reshape(blocks, width, k)
    whole = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for i in range(width - 1, -1, -1):
        step = np.where(last[:, i, None, None], whole.sum(1, keepdims=True) * np.ones((1, k, 1)) / k, t @ (nxt[:, i, :, None] * whole))
        whole = scaled(step, (1, 2))
    leave = np.empty((blocks, k))
    v = np.ones(k) / k
    for b in range(blocks - 1, -1, -1):
        leave[b] = v
        v = scaled(whole[b] @ v, 0)
    v, beta = leave, np.empty((blocks, width, k))
    for i in range(width - 1, -1, -1):
        v = scaled(np.where(last[:, i, None], 1.0, (nxt[:, i] * v) @ t.T), 1)
        beta[:, i] = v
    return tuple(x.reshape(-1, k)[:n] for x in (alpha, beta, e))


def train(texts: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = 7) -> Field:
    """The field that maximises the likelihood of the texts' languages, by stochastic gradients.

    To show the field what a change of language looks like, a sequence follows the one before it with
    the chance that transitions are learned from: one in eight joins sequences of two languages.
    """
    labels = sorted({y for y, _ in texts})
    index = {y: i for i, y in enumerate(labels)}
    cut = [(index[y], split_words(t)) for y, t in texts]
    count: dict[int, dict[str, int]] = {}
    for y, ws in cut:
        own = count.setdefault(y, {})
        for w in set(ws):
            own[w] = own.get(w, 0) + 1
    lexicon: dict[str, set[int]] = {}
    for y, own in count.items():
        for w in sorted(own, key=lambda w: (-own[w], w))[:LEXICON]:
            lexicon.setdefault(w, set()).add(y)
    field = Field(labels, lexicon)
    rng, n = np.random.default_rng(seed), len(labels)
    pieces = [(y, ws[at : at + SEQUENCE]) for y, ws in cut for at in range(0, len(ws), SEQUENCE)]
    square = np.full((BUCKETS, n), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(pieces))
        for lo in range(0, len(order), 16):
            part = [pieces[i] for i in order[lo : lo + 16]]
            ws = [w for _, x in part for w in x]
            gold = np.repeat([y for y, _ in part], [len(x) for _, x in part])
            first = np.zeros(len(ws), bool)
            ends = np.cumsum([0, *(len(x) for _, x in part)])[:-1]
            first[ends] = rng.random(len(ends)) > 0.125
            first[0] = True
            kinds = grams(ws)
            flat, owner = (np.concatenate([k[i] for k in kinds]) for i in (0, 1))
            bits = field.listed(ws)
            emit = bits @ field.lex
            np.add.at(emit, owner, field.emit[flat])
            post, pairs = pair_sums(emit, first, field.trans, field.start)
            error = -post
            error[np.arange(len(ws)), gold] += 1
            rows, inv = np.unique(flat, return_inverse=True)
            g = np.zeros((len(rows), n))
            np.add.at(g, inv, error[owner])
            square[rows] += g * g
            field.emit[rows] += 0.1 * g / np.sqrt(square[rows])
            field.lex += 0.01 * bits.T @ error / 16
            field.start += 0.05 * error[first].sum(0) / max(1, first.sum())
            inner = np.flatnonzero(~first)
            if len(inner):
                seen = np.zeros((n, n))
                np.add.at(seen, (gold[inner - 1], gold[inner]), 1)
                field.trans += 0.5 * (seen - pairs) / len(inner)
    field.emit = field.emit.astype(np.float32)
    return field


def label(texts: list[str], field: Field) -> tuple[list[list[str]], list[np.ndarray]]:
    """The words of each text and their posteriors (words by languages)."""
    cut = [split_words(t) for t in texts]
    n = np.array([len(c) for c in cut])
    names: dict[str, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for c in cut for w in c], np.int64)
    if not len(ids):
        return cut, [np.zeros((0, len(field.labels)))] * len(texts)
    first = np.zeros(len(ids), bool)
    first[(np.cumsum(n) - n)[n > 0]] = True
    post = forward_backward(field.scores(list(names))[ids], first, field.trans, field.start)
    return cut, np.split(post, np.cumsum(n)[:-1])


def language(docs: DataFrame, *, held_out: int = 0, folds: int = 5, text_col: str = "text", lang_col: str = "lang", per_word: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred and score; with ``per_word`` also arrays of words and their languages."""
    out = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    source = docs.select("doc_id", F.col(text_col).alias("text"), out.alias("held_out"))
    labelled = docs.filter(~out & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("y"), F.col(text_col).alias("t"))
    spark = docs.sparkSession
    size = labelled.groupBy("y").count().collect()  # a row a language
    texts = []
    if size:
        # a share of all hashes that about SAMPLE texts of the language have
        share = F.create_map(*[F.lit(x) for r in size for x in (r["y"], -(1 << 63) + min((1 << 64) - 1, (1 << 64) * SAMPLE // r["count"]))])
        texts = [(r["y"], r["t"]) for r in labelled.filter(F.xxhash64("t") <= share[F.col("y")]).distinct().limit(2 * SAMPLE * len(size)).collect()]
    field = train(sorted(texts)) if texts else None
    shared = spark.sparkContext.broadcast(field)
    tail = "lang_pred string, score double" + ", words array<string>, langs array<string>" * per_word

    def make():
        own = shared.value

        def run(xs):
            if own is None:
                return [["und"] * len(xs), [0.0] * len(xs), *([[[]] * len(xs)] * 2 if per_word else [])]
            cut, post = label(xs, own)
            mean = [p.mean(0) if len(p) else None for p in post]
            pred = ["und" if m is None else own.labels[int(m.argmax())] for m in mean]
            score = [0.0 if m is None else float(min(1.0, m.max())) for m in mean]
            return [pred, score, *([cut, [[own.labels[i] for i in p.argmax(1)] for p in post]] if per_word else [])]

        return run

    return map_texts(source, make, tail, keep=["doc_id", "held_out"])


def op9_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(documents(spark, sf_dir))
