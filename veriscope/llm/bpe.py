"""Byte-level BPE encoding and decoding by ranked merges over the distinct pieces of each batch.

A text is cut by the tokenizer's pattern into pieces; the distinct pieces of a batch, as rows of
bytes, are folded together: in each round every piece merges its lowest-ranked adjacent pair (the
leftmost of equals), until no piece holds a ranked pair.  A piece of over ``LONG`` bytes is folded alone,
with its ranked pairs in a heap and its symbols in a chain, in time that grows with n log n.  The rank map is a literal table of the
task: byte strings with their ranks, and for each token the pairs of tokens that make it.  Decoding
concatenates the byte strings of the ids.

Defined results: a null or empty text has no tokens; every valid text round-trips; repeated rows
are encoded each; a doc_id may be null or repeated; other columns of the input are not read.
Memory is bounded by a chunk of ``CHUNK`` characters (or one longer text) and ``CACHE`` pieces.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from veriscope.llm.texts import documents, map_texts

CHUNK = 1_000_000
#: Encoded pieces that a task keeps from batch to batch; beyond that it starts anew.
CACHE = 200_000
#: Bytes of a piece that is folded alone, and not kept.
LONG = 256
_NONE = np.int64(1) << 40


class Ranks:
    """A literal rank map: bytes to rank, rank to bytes, and ranked pairs of tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.rank, self.size = ranks, max(ranks.values(), default=0) + 1
        self.piece = [b""] * self.size
        for b, r in ranks.items():
            self.piece[r] = b
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        if (self.byte < 0).any():
            raise ValueError("every byte needs a rank")
        pairs = {ranks[b[:i]] * self.size + ranks[b[i:]]: r for b, r in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks}
        self.key = np.array(sorted(pairs), np.int64)
        self.value = np.array([pairs[k] for k in self.key.tolist()], np.int64)
        # open addressing: one or two looks for a pair, against seventeen of a binary search
        bits = max(4, int(2 * len(self.key)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.slot_key, self.slot_value = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int64)
        todo, at = np.arange(len(self.key)), self._hash(self.key)
        while len(todo):
            free = self.slot_key[at] < 0
            take, first = np.unique(at[free], return_index=True)
            own = np.flatnonzero(free)[first]
            self.slot_key[take], self.slot_value[take] = self.key[todo[own]], self.value[todo[own]]
            left = np.ones(len(todo), bool)
            left[own] = False
            todo, at = todo[left], (at[left] + 1) & self.mask

    @classmethod
    def load(cls, path: str) -> Ranks:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or a number above every rank."""
        key = left * self.size + right
        at = self._hash(key)
        got = self.slot_key[at]
        out = np.where(got == key, self.slot_value[at], _NONE)
        more = np.flatnonzero((got != key) & (got >= 0))
        while len(more):
            at[more] = (at[more] + 1) & self.mask
            got = self.slot_key[at[more]]
            hit = got == key[more]
            out[more[hit]] = self.slot_value[at[more[hit]]]
            more = more[~hit & (got >= 0)]
        return out

    @cached_property
    def pairs(self) -> dict[int, int]:
        return dict(zip(self.key.tolist(), self.value.tolist()))

    def fold_long(self, piece: bytes) -> np.ndarray:
        """The ids of one piece: the least ranked pair, and of equals the leftmost, is always on top of a heap."""
        sym = self.byte[np.frombuffer(piece, np.uint8)]
        n, size, get = len(sym), self.size, self.pairs.get
        own = np.full(n, -1, np.int64)  # the rank of the pair that starts at each place
        first = self.pair(sym[:-1], sym[1:])
        own[:-1] = np.where(first < _NONE, first, -1)
        at = np.flatnonzero(own >= 0)
        heap = (own[at] * n + at).tolist()
        heapify(heap)
        sym, own, after, before = sym.tolist(), own.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            rank, i = divmod(heappop(heap), n)
            if own[i] != rank:
                continue  # the pair is no longer there
            j = after[i]
            k = after[j]
            sym[i], own[i], own[j], sym[j], after[i] = rank, -1, -1, -1, k
            if k < n:
                before[k] = i
                new = get(rank * size + sym[k])
                if new is not None:
                    own[i] = new
                    heappush(heap, new * n + i)
            h = before[i]
            if h >= 0:
                new = get(sym[h] * size + rank)
                own[h] = -1 if new is None else new
                if new is not None:
                    heappush(heap, new * n + h)
        out = np.array(sym, np.int64)
        return out[out >= 0]

    def fold(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece (none of them empty), all pieces folded together."""
        out: list = [None] * len(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        todo = np.arange(len(pieces))
        sym = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        while len(todo):
            end = np.cumsum(size)
            start = end - size
            rank = np.full(len(sym), _NONE, np.int64)
            rank[:-1] = self.pair(sym[:-1], sym[1:])
            rank[end - 1] = _NONE  # no pair crosses pieces
            least = np.minimum.reduceat(rank, start)
            over = least >= _NONE
            if over.any():
                for i in np.flatnonzero(over).tolist():
                    out[todo[i]] = sym[start[i] : end[i]]
                keep = np.repeat(~over, size)
                todo, size, sym, rank, least = todo[~over], size[~over], sym[keep], rank[keep], least[~over]
                if not len(todo):
                    break
                end = np.cumsum(size)
                start = end - size
            hit = rank == np.repeat(least, size)
            # the leftmost only; an overlapping neighbour (as in aaa) has to wait for the next round
            where = np.flatnonzero(hit)
            owner = np.searchsorted(end, where, "right")
            first = where[np.concatenate(([True], owner[1:] != owner[:-1]))]
            sym = sym.copy()
            sym[first] = least
            keep = np.ones(len(sym), bool)
            keep[first + 1] = False
            sym, size = sym[keep], size - 1
        return out


def encode(texts: list[str], ranks: Ranks, pattern, cache: dict[str, np.ndarray]) -> list[np.ndarray]:
    """The ids of each text as unsigned 32-bit numbers."""
    found = [pattern.findall(t) for t in texts]
    size = [len(f) for f in found]
    flat = [p for f in found for p in f]
    code, distinct = pd.factorize(np.array(flat, object)) if flat else (np.zeros(0, np.int64), [])
    new = [p for p in distinct if p not in cache]
    fresh: dict[str, np.ndarray] = {}
    if new:
        raw = [p.encode() for p in new]
        whole = [ranks.rank.get(b) for b in raw]
        rest = [i for i, w in enumerate(whole) if w is None and len(raw[i]) <= LONG]
        fresh = {p: np.array([w], np.uint32) for p, w in zip(new, whole) if w is not None}
        fresh |= {new[i]: ids.astype(np.uint32) for i, ids in zip(rest, ranks.fold([raw[i] for i in rest]))}
        fresh |= {new[i]: ranks.fold_long(raw[i]).astype(np.uint32) for i, w in enumerate(whole) if w is None and len(raw[i]) > LONG}
    ids = [fresh[p] if p in fresh else cache[p] for p in distinct]
    if len(cache) + len(fresh) > CACHE:
        cache.clear()
    if len(fresh) <= CACHE:
        cache.update((p, x) for p, x in fresh.items() if len(p) <= LONG)
    if not flat:
        return [np.zeros(0, np.uint32)] * len(texts)
    each = np.array([len(i) for i in ids], np.int64)
    start = np.cumsum(each) - each
    n = each[code]
    end = np.cumsum(n)
    at = np.arange(end[-1]) - np.repeat(end - n, n) + np.repeat(start[code], n)
    every = np.concatenate(ids)[at]
    cut = np.concatenate(([0], end))[np.cumsum([0, *size])]
    return [every[a:b] for a, b in zip(cut[:-1], cut[1:])]


def decode(ids: Iterable[int], ranks: Ranks) -> bytes:
    """The concatenated byte strings of the ids."""
    return b"".join(map(ranks.piece.__getitem__, ids))


@lru_cache(1)
def _tokenizer(path: str, pattern: str):
    import regex

    return Ranks.load(path), regex.compile(pattern)


def bpe(docs: DataFrame, path: str, pattern: str, *, keep: list[str] | None = None, text_col: str = "text", digest: bool = False) -> DataFrame:
    """Each row's ids and the bytes they decode to, beside its columns ``keep``.

    ``path`` names a rank file that every machine has.  Adds n_tokens, and ids (array of long) and
    decoded (binary), or with ``digest`` the SHA-256 of both: ids as little-endian unsigned 32-bit
    integers.  No shuffle; a lost task is run again alone.
    """

    def make():
        ranks, cut = _tokenizer(path, pattern)
        cache: dict[str, np.ndarray] = {}

        def run(texts: list[str]) -> list[list]:
            every = encode(texts, ranks, cut, cache)
            back = [decode(ids.tolist(), ranks) for ids in every]
            n = [len(ids) for ids in every]
            if digest:
                return [n, [hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids in every], [hashlib.sha256(x).hexdigest() for x in back]]
            return [n, [ids.astype(np.int64) for ids in every], back]

        return run

    tail = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<bigint>, decoded binary"
    return map_texts(docs, make, f"n_tokens bigint, {tail}", keep=["doc_id"] if keep is None else keep, text_col=text_col, size=CHUNK)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)
