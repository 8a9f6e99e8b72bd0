"""Parametric functions on arrays, strings, integers and matrices, as Column expressions.

Positions are zero-based and ranges are inclusive unless a name says otherwise; a range may end past
the array.  What has no answer is null.  Sets are returned as sorted arrays without repeats.  Only the
functions under "in Python" leave the JVM: their results are not bounded by a fold over the input, or
are found once for all rows.
"""

from __future__ import annotations

from collections import Counter
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sl(l: Column, a: int, b: int) -> Column:
    return F.slice(l, F.lit(a + 1), F.lit(max(b - a + 1, 0)))


def _inner(l: Column, a: int, b: int) -> Column:
    return F.slice(l, F.lit(a + 2), F.lit(max(b - a - 1, 0)))


def _chars(s: Column) -> Column:
    return F.array_remove(F.split(s, ""), "")


def _total(l: Column) -> Column:
    return F.aggregate(l, F.lit(0).cast("bigint"), lambda s, x: s + x)


def _set(l: Column) -> Column:
    return F.array_sort(F.array_distinct(l))


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value found once a row: inside a lambda it would be found again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _divisor(n: Column, upto: Column) -> Column:
    """Whether some number from 2 to ``upto`` divides n."""
    return F.when(upto < 2, F.lit(False)).otherwise(F.exists(F.sequence(F.lit(2).cast("bigint"), upto.cast("bigint")), lambda d: n % d == 0))


def is_prime(n: Column) -> Column:
    return (n > 1) & ~_divisor(n, F.floor(F.sqrt(n.cast("double"))))


def is_composite(n: Column) -> Column:
    return (n > 3) & _divisor(n, F.floor(F.sqrt(n.cast("double"))))


def _ordered(l: Column, descending: bool) -> Column:
    return F.reverse(F.array_sort(l)) if descending else F.array_sort(l)


# ranges of integers


def ints_inclusive(l, a, b):
    return _sl(l, a, b)


def ints_exclusive(l, a, b):
    return _inner(l, a, b)


def positive(l, a, b, inclusive=True):
    return F.filter(_sl(l, a, b) if inclusive else _inner(l, a, b), lambda x: x > 0)


def negative(l, a, b, inclusive=True):
    return F.filter(_sl(l, a, b) if inclusive else _inner(l, a, b), lambda x: x < 0)


def even(l, a, b, inclusive=True):
    return F.filter(_sl(l, a, b) if inclusive else _inner(l, a, b), lambda x: x % 2 == 0)


def odd(l, a, b, inclusive=True):
    return F.filter(_sl(l, a, b) if inclusive else _inner(l, a, b), lambda x: x % 2 != 0)


def largest(l, a, b):
    return F.array_max(_sl(l, a, b))


def smallest(l, a, b):
    return F.array_min(_sl(l, a, b))


def second_largest(l, a, b):
    return F.try_element_at(F.array_sort(_sl(l, a, b)), F.lit(-2))


def second_smallest(l, a, b):
    return F.try_element_at(F.array_sort(_sl(l, a, b)), F.lit(2))


def sum_odd(l, a, b):
    return _total(odd(l, a, b))


def sum_even(l, a, b):
    return _total(even(l, a, b))


def divisible_by_both(l, k, m, a, b):
    return F.filter(_sl(l, a, b), lambda x: (x % k == 0) & (x % m == 0))


def sum_divisible_by_either(l, k, m, a, b):
    return _total(F.filter(_sl(l, a, b), lambda x: (x % k == 0) | (x % m == 0)))


def not_divisible_exclusive(l, k, a, b):
    return F.filter(_inner(l, a, b), lambda x: x % k != 0)


def nth_smallest(l, n, a, b):
    return F.try_element_at(F.array_sort(_sl(l, a, b)), F.lit(n)) if n > 0 else F.lit(None).cast("bigint")


def divisible(l, k, a, b):
    return F.filter(_sl(l, a, b), lambda x: x % k == 0)


def sum_of_values_between(l, lo, hi):
    return _total(F.filter(l, lambda x: x.between(lo, hi)))


# integers


def sum_of_multiples(n, k):
    """Sum of the first k multiples of n."""
    return F.expr("bigint(0)") + F.floor(n * k * (k + 1) / 2).cast("bigint")


def divisors_between(n, a, b):
    lo, hi = F.lit(max(a, 1)).cast("bigint"), F.least(n, F.lit(b)).cast("bigint")
    return F.when(hi < lo, F.array().cast("array<bigint>")).otherwise(F.filter(F.sequence(lo, F.greatest(lo, hi)), lambda i: n % i == 0))


def sum_of_divisors_between(n, a, b):
    return _total(divisors_between(n, a, b))


def gcd(x: Column, y: Column) -> Column:
    """Euclid's steps as a fold; 128 steps suffice for any two bigints."""
    start = F.struct(F.abs(x).cast("bigint").alias("x"), F.abs(y).cast("bigint").alias("y"))
    step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, F.lit(0).cast("bigint")).otherwise(s["x"] % F.nullif(s["y"], F.lit(0).cast("bigint"))).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(128)), start, step, lambda s: s["x"])


def gcd_at(l, a, b):
    """Greatest common factor of two elements; 0 unless both are positive, null for short arrays."""
    x, y = F.get(l, F.lit(a)), F.get(l, F.lit(b))
    return F.when(F.size(l) < 2, F.lit(None)).when((x > 0) & (y > 0), gcd(x, y)).otherwise(F.when(x.isNotNull() & y.isNotNull(), 0))


def gcd_of_three(l, a, b, c):
    return F.when(F.size(l) >= 3, gcd(gcd(F.get(l, F.lit(a)), F.get(l, F.lit(b))), F.get(l, F.lit(c))))


def is_perfect_at(l, a):
    n = F.get(l, F.lit(a))
    return F.when(n <= 1, F.lit(False)).otherwise(_total(F.filter(F.sequence(F.lit(1).cast("bigint"), F.greatest(n - 1, F.lit(1)).cast("bigint")), lambda i: n % i == 0)) == n)


def subsets_of_size(l, k):
    """Binomial coefficient of the number of distinct elements; exact up to 38 digits."""
    n = F.size(F.array_distinct(l))
    if k == 0:
        return F.lit(1).cast("decimal(38,0)")
    fold = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(1).cast("decimal(38,0)"), lambda p, i: F.floor(p * (n - i + 1) / i).cast("decimal(38,0)"))
    return F.when(n < k, F.lit(0).cast("decimal(38,0)")).otherwise(fold)


def prime_factors(n):
    return F.when(n < 2, F.array().cast("array<bigint>")).otherwise(F.filter(F.sequence(F.lit(2).cast("bigint"), F.greatest(n, F.lit(2)).cast("bigint")), lambda i: (n % i == 0) & is_prime(i)))


def primes_between(l, a, b, descending=False):
    return _ordered(F.filter(_sl(l, a, b), is_prime), descending)


def composites_between(l, a, b):
    return _set(F.filter(_sl(l, a, b), is_composite))


def missing_as_text(l, a, b):
    """Sum of the integers that the elements between two positions leave out of their span: binary
    if odd, hexadecimal if even, empty if none is missing."""
    lo, hi = F.get(l, F.lit(a)), F.get(l, F.lit(b))
    span = F.when(hi - lo < 2, F.array().cast("array<bigint>")).otherwise(F.sequence(lo + 1, F.greatest(hi - 1, lo + 1)))
    rest = F.array_except(span, _inner(l, a, b))
    n = _total(rest)
    return F.when(F.size(rest) == 0, "").when(n % 2 != 0, F.bin(n)).otherwise(F.hex(n))


def binary_divisible_by_fibonacci(s, k):
    """Whether a binary text is divisible by the k-th Fibonacci number (0, 1, 1, 2, ...); null below the third."""
    a, b = 0, 1
    for _ in range(max(k - 2, 0)):
        a, b = b, a + b
    if k <= 2:
        return F.lit(None).cast("boolean")
    return F.aggregate(_chars(s), F.lit(0).cast("bigint"), lambda r, c: (r * 2 + F.when(c == "1", 1).otherwise(0)) % b) == 0


# changes of arrays


def insert_at(l, value, i):
    return l if i < 0 else F.when(F.size(l) <= i, l).otherwise(F.array_insert(l, F.lit(i + 1), F.lit(value).cast("bigint")))


def insert_after(l, value, i):
    return l if i < 0 else F.when(F.size(l) <= i, F.array_append(l, F.lit(value).cast("bigint"))).otherwise(F.concat(F.slice(l, 1, i + 1), F.array(F.lit(value).cast("bigint")), F.slice(l, F.lit(i + 2), F.size(l))))


def union_of(*sets):
    out = sets[0]
    for s in sets[1:]:
        out = F.array_union(out, s)
    return _set(out)


def common_between(l, m, a, b):
    return F.array_sort(F.array_intersect(_sl(l, a, b), _sl(m, a, b)))


def circular_runs_with_product(l, k):
    """Contiguous runs of the array taken as a circle whose product is k, by start, then length.  Below 2^63, k is divided by
    one element of a run after the other, so no product is too large and runs whose first does not divide it are not tried."""
    wide = not -(2**63) < k < 2**63
    whole = "decimal(38,0)" if wide else "bigint"
    first, last = (F.lit(str(v)).cast(whole) for v in ((1, k) if wide or k == 0 else (k, 1)))

    def step(r: Column, x: Column) -> Column:
        if wide:
            return (r * x).cast(whole)
        if k == 0:
            return r * F.when(x == 0, 0).when(x != 0, 1)
        return F.when((x != 0) & (r % x == 0), F.call_function("div", r, x)).otherwise(F.lit(0).cast(whole))

    def lengths(run: Column) -> Column:
        start = F.struct(first.alias("r"), F.lit(1).alias("m"), F.array().cast("array<int>").alias("found"))

        def merge(s: Column, x: Column) -> Column:
            r = step(s["r"], x.cast(whole))
            return F.struct(r.alias("r"), (s["m"] + 1).alias("m"), F.when(r == last, F.array_append(s["found"], s["m"])).otherwise(s["found"]).alias("found"))

        return F.aggregate(run, start, merge, lambda s: s["found"])

    def runs(c: Column, n: Column) -> Column:
        starts = F.sequence(F.lit(1), n)
        if not wide and k:
            starts = F.filter(starts, lambda j: step(first, F.get(c, j - 1).cast(whole)) != 0)
        return F.flatten(F.transform(starts, lambda j: F.transform(lengths(F.slice(c, j, n)), lambda m: F.slice(c, j, m))))

    found = _let(l, lambda own: _let(F.concat(own, own), lambda c: runs(c, F.size(own))))
    return F.when(F.size(l) == 0, F.array().cast("array<array<bigint>>")).otherwise(found)


# strings


def nth_smallest_char(s, n, a, b):
    c = _sl(_chars(s), a, b)
    return F.coalesce(F.try_element_at(F.array_sort(c), F.lit(n)), F.lit(""))


def insert_before_char(s, c, text):
    return F.replace(s, F.lit(c), F.lit(text + c))


def insert_after_char(s, c, text):
    return F.replace(s, F.lit(c), F.lit(c + text))


def vowels_between(s, a, b, lo, hi):
    """Vowels in [a, b) that are above lo and at most hi."""
    return F.filter(F.slice(_chars(s), F.lit(a + 1), F.lit(max(b - a, 0))), lambda c: c.isin(*"aeiouAEIOU") & (c > lo) & (c <= hi))


def without_repeated(s, a, b):
    inside = _inner(_chars(s), a, b)
    return F.array_join(F.filter(_chars(s), lambda c: F.size(F.filter(inside, lambda d: d == c)) <= 1), "")


def without_chars_exclusive(s, lo, hi, a, b):
    inside = _inner(_chars(s), a, b)
    return F.array_join(F.filter(_chars(s), lambda c: ~(F.array_contains(inside, c) & (c > lo) & (c < hi))), "")


def without_chars_inclusive(s, lo, hi, a, b):
    inside = _sl(_chars(s), a, b)
    return F.array_join(F.filter(_chars(s), lambda c: ~(F.array_contains(inside, c) & (c >= lo) & (c <= hi))), "")


def greatest_chars(s, k, ascending=True):
    c = F.array_sort(_chars(s))
    top = F.slice(c, F.lit(-k), F.lit(k)) if k else F.slice(c, 1, 0)
    return F.when(F.size(c) < k, F.slice(c, 1, 0)).otherwise(top if ascending else F.reverse(top))


def smallest_chars(s, k, ascending=True):
    c = F.array_sort(_chars(s))
    low = F.slice(c, F.lit(1), F.lit(k))
    return F.when(F.size(c) < k, F.slice(c, 1, 0)).otherwise(low if ascending else F.reverse(low))


def _pieces(s: Column, k: int) -> Column:
    return F.when(F.length(s) < k, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substring(s, i, F.lit(k))))


def _palindrome(x: Column) -> Column:
    return (F.lower(x) == F.lower(F.reverse(x))) & x.rlike(r"^\p{L}+$")


def _folded(s: Column) -> Column:
    """The characters in a form that is equal wherever ``lower`` of a piece may make them equal; null where they are no letter."""
    return F.transform(_chars(s), lambda c: F.when(c.rlike(r"^\p{L}$"), F.when(c == "ς", "σ").otherwise(F.lower(c))))


def _grown(s: Column, c: Column, m: int, hi: int | None) -> Column:
    """What may be a palindrome of m, m + 2, ... characters, up to ``hi``: grown from those of m while both ends are alike."""
    n = F.size(c)
    same = lambda i, k: F.coalesce(F.get(c, i) == F.get(c, i + k - 1), F.lit(False))

    def reach(i: Column) -> Column:
        room = F.least(i, n - i - m, F.lit((hi - m) // 2)) if hi is not None else F.least(i, n - i - m)
        ends = F.filter(F.sequence(F.lit(1), F.greatest(room, F.lit(1))), lambda g: ~same(i - g, g * 2 + m))
        return F.when(room < 1, room).otherwise(F.coalesce(F.get(ends, F.lit(0)) - 1, room))

    starts = F.filter(F.sequence(F.lit(0), n - m), lambda i: F.forall(F.sequence(F.lit(0), F.lit((m - 1) // 2)), lambda j: same(i + j, F.lit(m) - j * 2)))
    return F.when(n < m, F.array().cast("array<string>")).otherwise(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(0), reach(i)), lambda g: F.substring(s, i - g + 1, g * 2 + m)))))


def _palindromes(s: Column, lo: int, hi: int | None = None) -> Column:
    """Distinct palindromes of ``lo`` to ``hi`` characters: each has one of ``lo`` or ``lo`` + 1 in its middle, so only what surrounds those is tried."""
    seeds = [m for m in (lo, lo + 1) if hi is None or m <= hi]
    found = _let(s, lambda t: _let(_folded(t), lambda c: F.concat(*(_grown(t, c, m, hi) for m in seeds))))
    return F.when(s.isNotNull(), _set(F.filter(found, _palindrome)))


def palindromes_of_length(s, k):
    return _set(F.filter(_pieces(s, k), _palindrome))


def palindromes_at_least(s, k):
    return _palindromes(s, max(k, 1))


def palindromes_of_lengths(s, a, b, lo, hi):
    part = F.array_join(_sl(_chars(s), a, b), "")
    none = lambda: F.array().cast("array<string>")
    found = lambda p: _palindromes(p, max(lo, 1), hi) if max(lo, 1) <= hi else none()
    return F.when(s.isNotNull(), _let(part, lambda p: F.when(F.size(F.array_distinct(_chars(p))) == F.length(p), none()).otherwise(found(p))))


def pieces_without_repeats(s, k):
    if k < 1:
        return F.array().cast("array<string>")
    return _set(F.filter(_pieces(s, k), lambda x: F.size(F.array_distinct(_chars(x))) == k))


def anagram_pairs(l, longer_than=0):
    keys = F.transform(F.filter(F.transform(l, lambda x: F.lower(F.replace(x, F.lit(" "), F.lit("")))), lambda x: F.length(x) > longer_than), lambda x: F.array_join(F.array_sort(_chars(x)), ""))
    return _total(F.transform(F.array_distinct(keys), lambda k: F.floor(F.size(F.filter(keys, lambda x: x == k)) * (F.size(F.filter(keys, lambda x: x == k)) - 1) / 2)))


def has_anagram_pairs(l, k):
    return F.when(F.size(l) < 2, F.lit(False)).otherwise(anagram_pairs(l, 2) >= k)


def has_at_most_anagram_pairs(l, k):
    return F.when(F.size(l) < 2, F.lit(False)).otherwise(anagram_pairs(l) <= k)


# matrices


def count_submatrices_of_size(m, k):
    """Contiguous submatrices with k cells, from the matrix's shape alone."""
    r, c = F.size(m), F.size(F.get(m, F.lit(0)))
    heights = F.filter(F.sequence(F.lit(1), F.lit(k)), lambda h: (F.lit(k) % h == 0) & (h <= r) & (F.lit(k) / h <= c))
    return F.when(r == 0, F.lit(None)).otherwise(_total(F.transform(heights, lambda h: (r - h + 1) * (c - F.floor(F.lit(k) / h) + 1))))


# in Python


def _witnessed(n: int) -> bool:
    """Whether n is prime: Miller and Rabin's test, which these bases decide below 3.3e24."""
    bases = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41)
    if n < 2 or any(n % p == 0 for p in bases):
        return n in bases
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    return all(pow(a, odd, n) == 1 or any(pow(a, odd << i, n) == n - 1 for i in range(twos)) for a in bases)


@cache
def _truncatable_of(ends: str, digits: int) -> np.ndarray:
    """Truncatable primes of so many digits, none of them 0, grown from those that are left when one digit of each of ``ends`` is cut."""
    left, right = "left" in ends, "right" in ends
    if digits <= left + right:
        return np.array([n for n in range(10 ** (digits - 1), 10**digits) if "0" not in str(n) and _witnessed(n)], "int64")
    inner = _truncatable_of(ends, digits - left - right).tolist()
    heads = [a * 10 ** (digits - 1) for a in range(1, 10)] if left else [0]
    tails = [1, 3, 7, 9] if right else [0]
    shift = 10 if right else 1
    return np.array(sorted(n for a in heads for x in inner for z in tails if (n := a + x * shift + z) < 2**63 and _witnessed(n)), "int64")


@cache
def _truncatable_below(ends: str, digits: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, "int64"), *(_truncatable_of(ends, k) for k in range(1, digits + 1))])


def _truncatable(n: Column, ends: str, inclusive: bool, descending: bool) -> Column:
    """The primes are found once a worker, up to the digits of the greatest n; a row takes those up to its own."""

    @F.arrow_udf("array<bigint>")
    def run(ns: pa.Array) -> pa.Array:
        top = pc.max(ns).as_py() or 0
        primes = _truncatable_below(ends, len(str(top)) if top > 1 else 0)
        upto = np.searchsorted(primes, ns.fill_null(0).to_numpy(zero_copy_only=False), "right" if inclusive else "left")
        starts = np.concatenate([[0], np.cumsum(upto)])
        at = np.arange(starts[-1]) - np.repeat(starts[:-1], upto)
        found = primes[np.repeat(upto, upto) - 1 - at if descending else at]
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(found), mask=ns.is_null())

    return run(n.cast("bigint"))


def right_truncatable_primes(n, descending=False):
    return _truncatable(n, "right", False, descending)


def left_truncatable_primes(n, descending=False):
    return _truncatable(n, "left", False, descending)


def both_truncatable_primes(n, descending=False):
    return _truncatable(n, "left right", True, descending)


def _arrangements(letters: str, least: int) -> list[str]:
    """Distinct palindromes (case aside) that some of the sorted letters make: every chain of outer pairs is one, and so is
    each with one of the letters left in its middle, so none is made twice."""
    left, out = Counter(letters), []
    alike = {a: [b for b in left if a.lower() == b.lower()] for a in left}

    def grow(head: str, tail: str) -> None:
        if 2 * len(head) >= least:
            out.append(head + tail)
        if 2 * len(head) + 1 >= least:
            out.extend(head + c + tail for c in left if left[c])
        for a in left:
            if left[a]:
                left[a] -= 1
                for b in alike[a]:
                    if left[b]:
                        left[b] -= 1
                        grow(head + a, b + tail)
                        left[b] += 1
                left[a] += 1

    grow("", "")
    return sorted(out)


def _arranged(texts: pd.Series, least: int, a: int, b: int) -> pd.Series:
    made = cache(_arrangements)  # of this batch, whose rows hold them anyway

    def one(t):
        if t is None:
            return None
        part = "".join(c for c in t[a : b + 1] if not (c.isascii() and not c.isalpha() and c.isprintable()))
        return made("".join(sorted(part)), least) if len(part) >= least and len(set(part)) < len(part) else []

    return texts.map(one)


def palindrome_arrangements(s, least, a, b):
    """Palindromic arrangements of at least ``least`` letters of a range; none unless a letter repeats."""

    @F.pandas_udf("array<string>")
    def run(x: pd.Series) -> pd.Series:
        return _arranged(x, least, a, b)

    return run(s)


def submatrices_with_sum(m, k):
    """Contiguous submatrices with sum k: rows, then columns, then blocks; by prefix sums."""

    @F.pandas_udf("array<array<array<bigint>>>")
    def run(ms: pd.Series) -> pd.Series:
        def one(rows):
            if rows is None:
                return None
            rows = [[int(v) for v in r] for r in rows]
            if not rows or not rows[0]:
                return []
            h, w = len(rows), len(rows[0])
            p = [[0] * (w + 1) for _ in range(h + 1)]
            for i in range(h):
                for j in range(w):
                    p[i + 1][j + 1] = rows[i][j] + p[i][j + 1] + p[i + 1][j] - p[i][j]
            boxes = [(i, i + 1, j, e) for i in range(h) for j in range(w) for e in range(j + 1, w + 1)]
            boxes += [(i, e, j, j + 1) for j in range(w) for i in range(h) for e in range(i + 2, h + 1)]
            boxes += [(i, f, j, e) for i in range(h - 1) for f in range(i + 2, h + 1) for j in range(w - 1) for e in range(j + 2, w + 1)]
            return [[r[j:e] for r in rows[i:f]] for i, f, j, e in boxes if p[f][e] - p[i][e] - p[f][j] + p[i][j] == k]

        return ms.map(one)

    return run(m)
