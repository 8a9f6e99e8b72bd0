"""Parametric functions and text functions on edge values, against plain Python."""

import math

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veriscope.functions import arrays as Q
from veriscope.functions import outcome as O
from veriscope.functions import text as T

ARRAYS = [[], [1], [2, -4, 0, 9, 9, -7], [6, 28, 496, 12], [3, 3, 3], [-1, -2], list(range(-20, 30))]


def values(spark, data, kind, column):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], f"i int, x {kind}")
    return [r["r"] for r in df.select("i", column(F.col("x")).alias("r")).orderBy("i").collect()]


PRIME = lambda n: n > 1 and all(n % d for d in range(2, math.isqrt(n) + 1))
CASES = {
    "ints_inclusive": (lambda x: Q.ints_inclusive(x, 1, 3), lambda l: l[1:4]),
    "ints_exclusive": (lambda x: Q.ints_exclusive(x, 1, 4), lambda l: l[2:4]),
    "odd": (lambda x: Q.odd(x, 0, 9), lambda l: [v for v in l[:10] if v % 2]),
    "even_exclusive": (lambda x: Q.even(x, 0, 9, False), lambda l: [v for v in l[1:9] if v % 2 == 0]),
    "second_largest": (lambda x: Q.second_largest(x, 0, 9), lambda l: sorted(l[:10])[-2] if len(l[:10]) > 1 else None),
    "nth_smallest": (lambda x: Q.nth_smallest(x, 3, 0, 9), lambda l: sorted(l[:10])[2] if len(l[:10]) > 2 else None),
    "nth_smallest_zero": (lambda x: Q.nth_smallest(x, 0, 0, 9), lambda l: None),
    "insert_at": (lambda x: Q.insert_at(x, 5, 2), lambda l: l if len(l) <= 2 else l[:2] + [5] + l[2:]),
    "insert_after": (lambda x: Q.insert_after(x, 5, 2), lambda l: l + [5] if len(l) <= 2 else l[:3] + [5] + l[3:]),
    "primes": (lambda x: Q.primes_between(x, 0, 60), lambda l: sorted(v for v in l if PRIME(v))),
    "composites": (lambda x: Q.composites_between(x, 0, 60), lambda l: sorted({v for v in l if v > 3 and not PRIME(v)})),
    "perfect": (lambda x: Q.is_perfect_at(x, 1), lambda l: None if len(l) < 2 else l[1] > 1 and sum(d for d in range(1, l[1]) if l[1] % d == 0) == l[1]),
    "subsets": (lambda x: Q.subsets_of_size(x, 4).cast("bigint"), lambda l: math.comb(len(set(l)), 4)),
    "sum_between": (lambda x: Q.sum_of_values_between(x, -3, 9), lambda l: sum(v for v in l if -3 <= v <= 9)),
}


@pytest.mark.parametrize("name", CASES)
def test_arrays(spark, name):
    column, plain = CASES[name]
    assert values(spark, ARRAYS, "array<bigint>", column) == [plain(list(l)) for l in ARRAYS]


def test_integers(spark):
    ns = [0, 1, 2, 7, 24, 97, 120, 400]
    assert values(spark, ns, "bigint", lambda n: Q.divisors_between(n, -3, 30)) == [[i for i in range(1, min(n, 30) + 1) if n % i == 0] for n in ns]
    assert values(spark, ns, "bigint", Q.prime_factors) == [[i for i in range(2, n + 1) if n % i == 0 and PRIME(i)] for n in ns]
    assert values(spark, ns, "bigint", lambda n: Q.sum_of_multiples(n, 5)) == [15 * n for n in ns]
    assert values(spark, ns, "bigint", lambda n: Q.gcd(n, F.lit(84))) == [math.gcd(n, 84) for n in ns]
    ok = lambda n, cut: "0" not in str(n) and all(PRIME(int(s)) for s in cut(str(n)) if s)
    right = [i for i in range(2, 400) if ok(i, lambda s: [s[: len(s) - k] for k in range(len(s))])]
    left = [i for i in range(2, 400) if ok(i, lambda s: [s[k:] for k in range(len(s))])]
    both = [i for i in range(2, 401) if ok(i, lambda s: [s[k : len(s) - k] for k in range(len(s))])]
    assert values(spark, [400], "bigint", Q.right_truncatable_primes) == [right]
    assert values(spark, [400], "bigint", lambda n: Q.left_truncatable_primes(n, True)) == [left[::-1]]
    assert values(spark, [400], "bigint", Q.both_truncatable_primes) == [both]


def test_truncatable_primes_by_growth(spark):
    # more numbers below them than can be tried one by one
    left = values(spark, [10**12, None, 9 * 10**18, 2, 3], "bigint", Q.left_truncatable_primes)
    assert left[1] is None and left[3:] == [[], [2]] and left[2][: len(left[0])] == left[0] and len(left[2]) == 4241
    assert all(PRIME(n) and "0" not in str(n) for n in left[0][::20]) and 357686312646216567629137 % 10**12 in left[0]


def test_both_truncatable_primes_by_growth(spark):
    both = values(spark, [10**7, None, 101, 1], "bigint", lambda n: Q.both_truncatable_primes(n, True))
    assert both[1] is None and both[3] == [] and both[2] == [n for n in range(97, 1, -1) if PRIME(n)]
    ok = lambda s: "0" not in s and all(PRIME(int(s[k : len(s) - k])) for k in range((len(s) + 1) // 2))
    assert len(both[0]) == 5158 and all(ok(str(n)) for n in both[0])
    assert [n for n in both[0] if n < 20000] == [n for n in range(19999, 1, -1) if ok(str(n))]


def test_right_truncatable_primes_by_growth(spark):
    right = values(spark, [9 * 10**18, None, 73939133, 73939134], "bigint", Q.right_truncatable_primes)
    assert right[1] is None and len(right[0]) == 83 and right[0][-1] == 73939133 and right[2:] == [right[0][:-1], right[0]]


def test_strings(spark):
    ss = ["", "a", "Abba", "racecar level", "hello World", "aab", "ABCabc123"]
    pal = lambda s, k: sorted({s[i : i + k] for i in range(len(s) - k + 1) if s[i : i + k].lower() == s[i : i + k].lower()[::-1] and s[i : i + k].isalpha()})
    assert values(spark, ss, "string", lambda s: Q.palindromes_of_length(s, 3)) == [pal(s, 3) for s in ss]
    assert values(spark, ss, "string", lambda s: Q.palindromes_at_least(s, 2)) == [sorted({x for k in range(2, len(s) + 1) for x in pal(s, k)}) for s in ss]
    assert values(spark, ss, "string", lambda s: Q.without_repeated(s, 0, 5)) == ["".join(c for c in s if s[1:5].count(c) <= 1) for s in ss]
    assert values(spark, ss, "string", lambda s: Q.pieces_without_repeats(s, 3)) == [sorted({s[i : i + 3] for i in range(len(s) - 2) if len({*s[i : i + 3]}) == 3}) for s in ss]
    assert values(spark, ss, "string", lambda s: Q.greatest_chars(s, 3, False)) == [sorted(s, reverse=True)[:3] if len(s) >= 3 else [] for s in ss]
    assert values(spark, ss, "string", lambda s: Q.nth_smallest_char(s, 2, 0, 3)) == [sorted(s[:4])[1] if len(s[:4]) > 1 else "" for s in ss]
    from itertools import permutations

    plain = lambda s: sorted({"".join(p) for k in range(2, len(s) + 1) for p in permutations(s, k) if "".join(p).lower() == "".join(p).lower()[::-1]}) if len(s) >= 2 and len({*s}) < len(s) else []
    assert values(spark, ss[:4], "string", lambda s: Q.palindrome_arrangements(s, 2, 0, 5)) == [plain("".join(c for c in s[:6] if c.isalpha())) for s in ss[:4]]
    words = [["listen", "Silent", "en list", "abc"], ["ab"], [], ["a b", "b a", "ab "]]
    pairs = [3, 0, 0, 3]
    assert values(spark, words, "array<string>", lambda w: Q.anagram_pairs(w)) == pairs


def test_palindromes_of_a_long_text(spark):
    # 200 million pieces, few of which have a palindrome in their middle
    text = "abc" * 6600 + "xRaceCAR" + "é1é" + "ΣaΣ"
    assert values(spark, [text, None, "aa", "ab😀bA"], "string", lambda s: Q.palindromes_at_least(s, 3)) == [sorted(["RaceCAR", "aceCA", "ceC", "ΣaΣ"]), None, [], []]


def test_palindromes_of_lengths_in_a_long_text(spark):
    import time

    text = "abc" * 20000 + "xRaceCAR"
    start = time.time()
    got = values(spark, [text, None, "abcba", "abc"], "string", lambda s: Q.palindromes_of_lengths(s, 1, 70000, 3, 6))
    assert got == [["aceCA", "ceC"], None, ["bcb"], []] and time.time() - start < 60  # the range is cut out once, not for each piece


def test_arrangements_are_made_once(monkeypatch):
    made, own = [], Q._arrangements
    monkeypatch.setattr(Q, "_arrangements", lambda letters, least: made.append(letters) or own(letters, least))
    got = Q._arranged(pd.Series(["BUILDING", "GNIBUILD", None, "HOUSEHOLD", "MACHINERY"] * 200), 3, 0, 6).tolist()
    assert sorted(made) == ["BDIILNU", "BGIILNU", "EHHOOSU"] and got[5:] == got[:-5]
    assert got[0] == ["IBI", "IDI", "ILI", "INI", "IUI"] and got[2] is None and got[4] == []
    odd = [x + c + y for x, y in ("Aa", "aA", "Bb", "bB") for c in "AaBb" if c not in (x, y)]
    even = [x + z + w + y for x, y in ("Aa", "aA", "Bb", "bB") for z, w in ("Aa", "aA", "Bb", "bB") if z not in (x, y)]
    assert own("AaBb", 3) == sorted(odd + even)


def test_matrices_and_circles(spark):
    m = [[1, 2, 3], [4, 5, 6], [7, 8, 9]]
    box = lambda k: sum(1 for i in range(3) for f in range(i + 1, 4) for j in range(3) for e in range(j + 1, 4) if (f - i) * (e - j) == k)
    for k in (1, 2, 4, 6, 5):
        assert values(spark, [m], "array<array<bigint>>", lambda x, k=k: Q.count_submatrices_of_size(x, k)) == [box(k)]
    found = values(spark, [m, []], "array<array<bigint>>", lambda x: Q.submatrices_with_sum(x, 12))
    assert found[0] and all(sum(map(sum, s)) == 12 for s in found[0]) and found[1] == []
    assert len(found[0]) == sum(1 for i in range(3) for f in range(i + 1, 4) for j in range(3) for e in range(j + 1, 4) if sum(map(sum, [r[j:e] for r in m[i:f]])) == 12)
    l = [2, 3, 1, 6]
    want = [c[:i] for j in range(4) for c in [l[j:] + l[:j]] for i in range(1, 5) if math.prod(c[:i]) == 6]
    assert values(spark, [l, []], "array<bigint>", lambda x: Q.circular_runs_with_product(x, 6)) == [want, []]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(-50, 50), max_size=8), min_size=1, max_size=30))
def test_ranges_like_slices(spark, data):
    assert values(spark, data, "array<bigint>", lambda x: Q.ints_inclusive(x, 2, 5)) == [l[2:6] for l in data]
    assert values(spark, data, "array<bigint>", lambda x: Q.sum_even(x, 0, 5)) == [sum(v for v in l[:6] if v % 2 == 0) for l in data]


FAILURES = {"C": None, "W": "AssertionError > ", "P": "could_not_parse_LLM_answer", "I": "LLMExecutionRuntimeError > t", "J": "LLMExecutionError > n", "N": "NoForLoopError > x", "M": "MutationCheckFailedError > AssertionError"}


def test_verdicts(spark):
    rows = [(a, b, FAILURES[a], FAILURES[b], x, y) for a in FAILURES for b in FAILURES for x, y in (("1", "1"), ("1", "2"), (None, None))]
    df = spark.createDataFrame(rows, "a string, b string, f1 string, f2 string, x string, y string")
    df = df.withColumn("v", O.verdict(F.col("f1"), F.col("f2"), O.differs(F.col("x"), F.col("y"))))
    kind = {"C": "c", "W": "w", "P": "w", "I": "i", "J": "i", "N": "-", "M": "-"}
    for r in df.collect():
        k = kind[r["a"]] + kind[r["b"]]
        v = r["v"]
        assert v["compared"] == ("-" not in k)
        differs = not (r["x"] is not None and r["x"] == r["y"])
        assert v["inconsistent"] == (k in ("cw", "ci", "wc", "ic", "wi", "iw") or k == "ww" and differs)
        if v["inconsistent"]:
            assert sorted(v["incorrect"]) == sorted([n for n, c in zip(("Original", "Mutated"), k) if c == "w"])
            assert sorted(v["invalid"]) == sorted([n for n, c in zip(("Original", "Mutated"), k) if c == "i"])


def test_vectors_and_scores(spark):
    rows = [({"a": True, "b": False}, {"a": True, "b": True}), ({"a": True}, {"a": True}), ({}, {"a": True}), ({"a": True, "b": True}, {"a": True})]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x map<string,boolean>, y map<string,boolean>").orderBy("i")
    got = df.select(O.vector_distance(F.col("x"), F.col("y")).alias("d"), O.vectors_differ(F.col("x"), F.col("y")).alias("e")).collect()
    assert [r["d"] for r in got] == [0.5, 0.0, 0.0, 0.5] and [r["e"] for r in got] == [True, False, False, True]


def test_legal_mutations(spark):
    df = spark.createDataFrame([(["random", "random"],), (["random", "demorgan"],), (["demorgan", "boolean_literal"],), (["demorgan", "constant_unfold"],), (["constant_unfold", "constant_unfold_add"],)], "n array<string>")
    assert [r[0] for r in df.select(O.legal(F.col("n"))).collect()] == [True, True, False, True, False]
    with pytest.raises(Exception, match="unknown mutation"):
        spark.createDataFrame([(["swap"],)], "n array<string>").select(O.legal(F.col("n"))).collect()


def test_text(spark):
    answers = ["x <|im_end|>\n```python\na = 1\n```\nok", ">>> no", "b = 2 # Test\n", "Correct so far\ndef f():\n  return 1\nWell done\nmore", "Good job! user x"]
    assert values(spark, answers, "string", T.code_answer) == ["a = 1", "", "b = 2", "Correct so far\ndef f():\n  return 1", "x"]
    got = values(spark, ["('a', 1)", "[1, 2]", "'q'", '"no', None], "string", T.literal_answer)
    assert [tuple(r) for r in got] == [("a", "str"), ("[1, 2]", "list"), ("q", "str"), ("no", "str"), (None, None)]
    assert values(spark, ["a b", "A ab"], "string", lambda x: T.renamed_words(x, {"a": "z$1"})) == ["z$1 b", "A ab"]
    assert values(spark, ["$1 $10"], "string", lambda x: T.filled(x, F.array(F.lit("p"), F.lit("q")))) == ["q q0"]
    # after A has gone the answer is C, which C does not stand before
    assert values(spark, ["D", "B", "A"], "string", lambda x: T.shifted_answer(x, F.array(F.lit("A"), F.lit("C")))) == ["C", "A", "A"]


def test_circular_products_of_great_numbers(spark):
    rows = [[10**18] * 3 + [2, 3], [2, None, 3], [0, 6, -1, -6], None, [2**62, 2]]
    got = values(spark, rows, "array<bigint>", lambda x: Q.circular_runs_with_product(x, 6))
    assert got == [[[2, 3]], [[3, 2]], [[6], [-1, -6]], None, []]
    assert values(spark, [[2**62, 2], [0, 5]], "array<bigint>", lambda x: Q.circular_runs_with_product(x, 2**63)) == [[[2**62, 2], [2, 2**62]], []]
    assert values(spark, [[4, 0], [5]], "array<bigint>", lambda x: Q.circular_runs_with_product(x, 0)) == [[[4, 0], [0], [0, 4]], []]
