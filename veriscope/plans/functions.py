"""The parametric functions over arrays of each order, integers of parts, and names as strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veriscope.functions import arrays as Q
from veriscope.plans.base import table

QUERIES: dict = {}
ORACLE: dict = {}

_SQL = {
    "array": "arr AS (SELECT l_orderkey AS id, list((l_partkey % 41 - 20)::BIGINT ORDER BY l_linenumber, l_partkey, l_suppkey) AS l, list((l_partkey % 97 + 1)::BIGINT ORDER BY l_linenumber, l_partkey, l_suppkey) AS p, list((l_suppkey % 13)::BIGINT ORDER BY l_linenumber, l_partkey, l_suppkey) AS m FROM lineitem GROUP BY 1)",
    "string": "arr AS (SELECT c_custkey AS id, concat(c_mktsegment, substr(c_name, 1, 4), c_mktsegment) AS s FROM customer)",
    "words": "arr AS (SELECT o_custkey AS id, list(right(o_orderkey::VARCHAR, 3) ORDER BY o_orderkey) AS w FROM orders GROUP BY 1)",
    "integer": "arr AS (SELECT p_partkey AS id, (p_partkey % 360 + 1)::BIGINT AS n FROM part)",
    "span": "arr AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT (l_partkey % 12)::BIGINT)) AS l FROM lineitem GROUP BY 1)",
    "bits": "arr AS (SELECT p_partkey AS id, bin(p_partkey) AS s FROM part)",
}


def _source(kind: str, s, d):
    if kind == "array":
        own = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
        return own.select("id", F.transform("x", lambda e: e["l_partkey"] % 41 - 20).alias("l"), F.transform("x", lambda e: e["l_partkey"] % 97 + 1).alias("p"), F.transform("x", lambda e: e["l_suppkey"] % 13).alias("m"))
    if kind == "string":
        return table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_mktsegment", F.substring("c_name", 1, 4), "c_mktsegment").alias("s"))
    if kind == "words":
        own = table(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("x"))
        return own.select("id", F.transform("x", lambda e: F.substring(e.cast("string"), -3, 3)).alias("w"))
    if kind == "integer":
        return table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 360 + 1).alias("n"))
    if kind == "span":
        return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set(F.col("l_partkey") % 12)).alias("l"))
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.bin("p_partkey").alias("s"))


def _text(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _add(name: str, kind: str, column: Callable[[], Column], sql: str | None) -> None:
    QUERIES[name] = lambda s, d: _source(kind, s, d).select("id", column().alias("r"))
    if sql:
        ORACLE[name] = f"WITH {_SQL[kind]} SELECT id, {sql} AS r FROM arr"


def _lists(name, kind, column, sql):
    _add(name, kind, lambda: _text(column()), f"array_to_string({sql}, ',')" if sql else None)


def _in(a, b, of="l"):
    return f"list_slice({of}, {a + 1}, {b + 1})"


def _ex(a, b, of="l"):
    return f"list_slice({of}, {a + 2}, {b})"


def _where(l, cond):
    return f"list_filter({l}, lambda x: {cond})"


def _sum(l):
    return f"coalesce(list_sum({l}), 0)::BIGINT"


def _prime(x):
    return f"({x} > 1 AND len(list_filter(range(2, floor(sqrt({x}))::BIGINT + 1), lambda q: {x} % q = 0)) = 0)"


_lists("q01_ints_inclusive", "array", lambda: Q.ints_inclusive(F.col("l"), 1, 3), _in(1, 3))
_lists("q02_ints_exclusive", "array", lambda: Q.ints_exclusive(F.col("l"), 0, 4), _ex(0, 4))
for _i, (_name, _cond) in enumerate((("positive", "x > 0"), ("negative", "x < 0"), ("even", "x % 2 = 0"), ("odd", "x % 2 <> 0"))):
    _fn = getattr(Q, _name)
    _lists(f"q{3 + 2 * _i:02}_{_name}_inclusive", "array", lambda f=_fn: f(F.col("l"), 0, 3), _where(_in(0, 3), _cond))
    _lists(f"q{4 + 2 * _i:02}_{_name}_exclusive", "array", lambda f=_fn: f(F.col("l"), 0, 5, inclusive=False), _where(_ex(0, 5), _cond))
_add("q11_largest", "array", lambda: Q.largest(F.col("l"), 1, 3), f"list_max({_in(1, 3)})")
_add("q12_smallest", "array", lambda: Q.smallest(F.col("l"), 1, 3), f"list_min({_in(1, 3)})")
_add("q13_second_largest", "array", lambda: Q.second_largest(F.col("l"), 0, 3), f"list_reverse_sort({_in(0, 3)})[2]")
_add("q14_second_smallest", "array", lambda: Q.second_smallest(F.col("l"), 0, 3), f"list_sort({_in(0, 3)})[2]")
_add("q15_sum_odd", "array", lambda: Q.sum_odd(F.col("l"), 0, 4), _sum(_where(_in(0, 4), "x % 2 <> 0")))
_add("q16_sum_even", "array", lambda: Q.sum_even(F.col("l"), 0, 4), _sum(_where(_in(0, 4), "x % 2 = 0")))
_lists("q17_divisible_by_both", "array", lambda: Q.divisible_by_both(F.col("l"), 2, 3, 0, 6), _where(_in(0, 6), "x % 2 = 0 AND x % 3 = 0"))
_add("q18_sum_divisible_by_either", "array", lambda: Q.sum_divisible_by_either(F.col("l"), 4, 5, 0, 6), _sum(_where(_in(0, 6), "x % 4 = 0 OR x % 5 = 0")))
_lists("q19_not_divisible", "array", lambda: Q.not_divisible_exclusive(F.col("l"), 3, 0, 5), _where(_ex(0, 5), "x % 3 <> 0"))
_add("q20_nth_smallest", "array", lambda: Q.nth_smallest(F.col("l"), 3, 0, 4), f"list_sort({_in(0, 4)})[3]")
_lists("q21_divisible", "array", lambda: Q.divisible(F.col("l"), 4, 0, 6), _where(_in(0, 6), "x % 4 = 0"))
_add("q22_sum_of_multiples", "integer", lambda: Q.sum_of_multiples(F.col("n"), 7), "(n * 7 * 8) // 2")
_lists("q23_divisors", "integer", lambda: Q.divisors_between(F.col("n"), -2, 40), "list_filter(range(1, least(n, 40) + 1), lambda x: n % x = 0)")
_add("q24_sum_of_divisors", "integer", lambda: Q.sum_of_divisors_between(F.col("n"), 3, 90), _sum("list_filter(range(3, least(n, 90) + 1), lambda x: n % x = 0)"))
_lists("q25_insert_at", "array", lambda: Q.insert_at(F.col("l"), 99, 2), "CASE WHEN len(l) <= 2 THEN l ELSE list_concat(list_concat(l[1:2], [99]), l[3:]) END")
_add("q26_sum_between", "array", lambda: Q.sum_of_values_between(F.col("l"), -5, 9), _sum(_where("l", "x BETWEEN -5 AND 9")))
_lists("q27_insert_after", "array", lambda: Q.insert_after(F.col("l"), 99, 2), "CASE WHEN len(l) <= 2 THEN list_append(l, 99) ELSE list_concat(list_concat(l[1:3], [99]), l[4:]) END")
_CH = "list_filter(string_split(s, ''), lambda x: x <> '')"
_CHARS = f"list_transform(range(1, length(s) + 1), lambda i: substr(s, i, 1))"
_add("q28_nth_smallest_char", "string", lambda: Q.nth_smallest_char(F.col("s"), 2, 1, 6), f"coalesce(list_sort(list_slice({_CHARS}, 2, 7))[2], '')")
_add("q29_gcd_at", "array", lambda: Q.gcd_at(F.col("p"), 0, 1), "CASE WHEN len(l) >= 2 THEN gcd(p[1], p[2]) END")
_add("q30_insert_before", "string", lambda: Q.insert_before_char(F.col("s"), "E", "<"), "replace(s, 'E', '<E')")
_add("q31_perfect", "array", lambda: Q.is_perfect_at(F.col("p"), 0), "CASE WHEN p[1] <= 1 THEN false ELSE list_sum(list_filter(range(1, p[1]), lambda x: p[1] % x = 0)) = p[1] END")
_add("q32_insert_after", "string", lambda: Q.insert_after_char(F.col("s"), "E", ">"), "replace(s, 'E', 'E>')")
_lists("q33_vowels", "string", lambda: Q.vowels_between(F.col("s"), 1, 14, "A", "o"), f"list_filter(list_slice({_CHARS}, 2, 14), lambda x: x IN ('a','e','i','o','u','A','E','I','O','U') AND x > 'A' AND x <= 'o')")
_lists("q34_union", "array", lambda: Q.union_of(F.col("l"), F.col("p"), F.col("m")), "list_sort(list_distinct(list_concat(list_concat(l, p), m)))")
_add("q35_without_repeated", "string", lambda: Q.without_repeated(F.col("s"), 1, 12), f"array_to_string(list_filter({_CHARS}, lambda x: len(list_filter(list_slice({_CHARS}, 3, 12), lambda y: y = x)) <= 1), '')")
_add("q36_without_chars_exclusive", "string", lambda: Q.without_chars_exclusive(F.col("s"), "B", "R", 0, 9), f"array_to_string(list_filter({_CHARS}, lambda x: NOT (list_contains(list_slice({_CHARS}, 2, 9), x) AND x > 'B' AND x < 'R')), '')")
_add("q37_without_chars_inclusive", "string", lambda: Q.without_chars_inclusive(F.col("s"), "B", "R", 0, 9), f"array_to_string(list_filter({_CHARS}, lambda x: NOT (list_contains(list_slice({_CHARS}, 1, 10), x) AND x >= 'B' AND x <= 'R')), '')")
_add("q38_subsets", "array", lambda: Q.subsets_of_size(F.col("l"), 3).cast("bigint"), "(len(list_distinct(l)) * (len(list_distinct(l)) - 1) * (len(list_distinct(l)) - 2) // 6)::BIGINT")
_lists("q39_greatest_chars", "string", lambda: Q.greatest_chars(F.col("s"), 4, False), f"list_slice(list_reverse_sort({_CHARS}), 1, 4)")
_lists("q40_smallest_chars", "string", lambda: Q.smallest_chars(F.col("s"), 4, True), f"list_slice(list_sort({_CHARS}), 1, 4)")
_lists("q41_common", "array", lambda: Q.common_between(F.col("l"), F.col("m"), 0, 4), f"list_sort(list_distinct(list_intersect({_in(0, 4)}, {_in(0, 4, 'm')})))")
_lists("q42_prime_factors", "integer", lambda: Q.prime_factors(F.col("n")), f"list_filter(range(2, n + 1), lambda x: n % x = 0 AND {_prime('x')})")
_lists("q43_primes", "array", lambda: Q.primes_between(F.col("p"), 0, 4, True), f"list_reverse_sort(list_filter({_in(0, 4, 'p')}, lambda x: {_prime('x')}))")
_lists("q44_composites", "array", lambda: Q.composites_between(F.col("p"), 0, 4), f"list_sort(list_distinct(list_filter({_in(0, 4, 'p')}, lambda x: x >= 4 AND NOT {_prime('x')})))")
_lists("q45_palindrome_arrangements", "string", lambda: Q.palindrome_arrangements(F.col("s"), 3, 0, 6), None)
#: Checked by hand: the first seven letters of each segment, of which the first has no letter twice.
_ARRANGED = {
    "MACHINERY": "",
    "FURNITURE": "UFU,UIU,UNU,URU,UTU",
    "BUILDING": "IBI,IDI,ILI,INI,IUI",
    "HOUSEHOLD": "HEH,HOEOH,HOH,HOOH,HOSOH,HOUOH,HSH,HUH,OEO,OHEHO,OHHO,OHO,OHSHO,OHUHO,OSO,OUO",
    "AUTOMOBILE": "OAO,OBO,OMO,OTO,OUO",
}
ORACLE["q45_palindrome_arrangements"] = f"SELECT c_custkey AS id, CASE c_mktsegment {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in _ARRANGED.items())} END AS r FROM customer"
_add("q46_gcd_of_three", "array", lambda: Q.gcd_of_three(F.col("p"), 0, 1, 2), "CASE WHEN len(l) >= 3 THEN gcd(gcd(p[1], p[2]), p[3]) END")
_PIECES = lambda s, k: f"list_transform(range(1, greatest(length({s}) - {k} + 2, 1)), lambda i: substr({s}, i, {k}))"
_PAL = "lower(x) = reverse(lower(x)) AND regexp_matches(x, '^[A-Za-z]+$')"
_lists("q47_palindromes_of_lengths", "string", lambda: Q.palindromes_of_lengths(F.col("s"), 2, 15, 3, 5), f"CASE WHEN len(list_distinct(list_slice({_CHARS}, 3, 16))) = length(s[3:16]) THEN [] ELSE list_sort(list_distinct(list_filter(list_concat(list_concat({_PIECES('s[3:16]', 3)}, {_PIECES('s[3:16]', 4)}), {_PIECES('s[3:16]', 5)}), lambda x: {_PAL}))) END")
_REST = "list_filter(range(l[1] + 1, l[len(l)]), lambda x: NOT list_contains(l, x))"
_NSUM = f"{_sum(_REST)}"
_add("q48_missing_as_text", "span", lambda: F.when(F.size("l") < 2, "").otherwise(Q.missing_as_text(F.concat(F.slice("l", 1, 1), F.slice("l", F.lit(2), F.size("l") - 1)), 0, 1)), f"CASE WHEN len(l) < 2 OR l[2] - l[1] < 2 THEN '' WHEN (list_sum(range(l[1] + 1, l[2]))) % 2 <> 0 THEN bin(list_sum(range(l[1] + 1, l[2]))::BIGINT) ELSE hex(list_sum(range(l[1] + 1, l[2]))::BIGINT) END")
_add("q49_binary_divisible", "bits", lambda: Q.binary_divisible_by_fibonacci(F.col("s"), 7), "id % 8 = 0")
_KEYS = lambda least: f"list_transform(list_filter(w, lambda x: length(x) > {least}), lambda x: array_to_string(list_sort(list_transform(range(1, length(x) + 1), lambda i: x[i])), ''))"
_PAIRS = lambda least: f"list_sum(list_transform(list_distinct({_KEYS(least)}), lambda k: len(list_filter({_KEYS(least)}, lambda y: y = k)) * (len(list_filter({_KEYS(least)}, lambda y: y = k)) - 1) // 2))"
_add("q50_has_anagrams", "words", lambda: Q.has_anagram_pairs(F.col("w"), 2), f"CASE WHEN len(w) < 2 THEN false ELSE coalesce({_PAIRS(2)}, 0) >= 2 END")
_add("q51_few_anagrams", "words", lambda: Q.has_at_most_anagram_pairs(F.col("w"), 1), f"CASE WHEN len(w) < 2 THEN false ELSE coalesce({_PAIRS(0)}, 0) <= 1 END")
_lists("q52_palindromes_of_length", "string", lambda: Q.palindromes_of_length(F.col("s"), 3), f"list_sort(list_distinct(list_filter({_PIECES('s', 3)}, lambda x: {_PAL})))")
_lists("q53_palindromes_at_least", "string", lambda: Q.palindromes_at_least(F.col("s"), 3), f"list_sort(list_distinct(list_filter(flatten(list_transform(range(3, length(s) + 1), lambda k: {_PIECES('s', 'k')})), lambda x: {_PAL})))")
_TR = lambda cut, top: f"list_filter(range(2, {top}), lambda x: NOT contains(x::VARCHAR, '0') AND len(list_filter(range(0, length(x::VARCHAR)), lambda k: {cut} <> '' AND NOT {_prime('coalesce(nullif(' + cut + ', ' + chr(39) * 2 + '), ' + chr(39) + '2' + chr(39) + ')::BIGINT')})) = 0)"
_lists("q54_right_truncatable", "integer", lambda: Q.right_truncatable_primes(F.col("n")), _TR("substr(x::VARCHAR, 1, length(x::VARCHAR) - k)", "n"))
_add("q55_circular_products", "array", lambda: F.size(Q.circular_runs_with_product(F.col("m"), 6)).cast("bigint"), "len(list_filter(flatten(list_transform(range(1, len(m) + 1), lambda j: list_transform(range(0, len(m)), lambda k: list_aggregate(list_slice(list_concat(m, m), j, j + k), 'product')))), lambda x: x = 6))::BIGINT")
_lists("q56_pieces_without_repeats", "string", lambda: Q.pieces_without_repeats(F.col("s"), 5), f"list_sort(list_distinct(list_filter({_PIECES('s', 5)}, lambda x: len(list_distinct(list_transform(range(1, 6), lambda i: x[i]))) = 5)))")
_add("q57_submatrices_with_sum", "array", lambda: F.size(Q.submatrices_with_sum(F.array("m", "p"), 12)).cast("bigint"), "len(list_filter(flatten(list_transform([m, p, list_transform(range(1, len(m) + 1), lambda i: m[i] + p[i])], lambda r: flatten(list_transform(range(1, len(r) + 1), lambda i: list_transform(range(i, len(r) + 1), lambda k: list_sum(list_slice(r, i, k))))))), lambda x: x = 12))::BIGINT")
_add("q58_count_submatrices", "array", lambda: Q.count_submatrices_of_size(F.array(F.col("l"), F.col("l"), F.col("l")), 4).cast("bigint"), "(CASE WHEN len(l) >= 4 THEN 3 * (len(l) - 3) ELSE 0 END + CASE WHEN len(l) >= 2 THEN 2 * (len(l) - 1) ELSE 0 END)::BIGINT")
_lists("q59_left_truncatable", "integer", lambda: Q.left_truncatable_primes(F.col("n")), _TR("substr(x::VARCHAR, k + 1)", "n"))
_lists("q60_both_truncatable", "integer", lambda: Q.both_truncatable_primes(F.col("n"), True), f"list_reverse({_TR('substr(x::VARCHAR, k + 1, greatest(length(x::VARCHAR) - 2 * k, 0))', 'n + 1')})")
