"""What one answer is, and what two answers to the same task say about each other.

An answer is correct if its failure is null, wrong if a check failed, invalid if there is none; the
three are independent, and all may be false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CORRECTNESS, INCORRECTNESS, INVALID = "Correctness Inconsistency", "Incorrectness Inconsistency", "Invalid Inconsistency"
ORIGINAL, MUTATED = "Original", "Mutated"
#: A task whose outcome vector cannot be used, and one scored by its first failure.
SKIPPED, SCORED = "BigCodeBencho471", "HumanEvalo32"
#: The groups of mutations that exclude one another.
CONFLICT_GROUPS = {
    "lexical": ["random", "sequential", "literal_format"],
    "syntactic": ["for2while", "for2enumerate"],
    "logical": ["demorgan", "boolean_literal", "commutative_reorder"],
    "constant_unfold": ["constant_unfold", "constant_unfold_add", "constant_unfold_mult"],
}
#: A mutation's category is the first one that its log's name holds.
CATEGORY = {
    "Lexical": CONFLICT_GROUPS["lexical"],
    "Syntactic": CONFLICT_GROUPS["syntactic"],
    "Logical": CONFLICT_GROUPS["logical"] + CONFLICT_GROUPS["constant_unfold"],
}


def has(text: Column, part: str) -> Column:
    """Null counts as without."""
    return F.coalesce(text.contains(part), F.lit(False))


def correct(failure: Column) -> Column:
    return failure.isNull()


def wrong(failure: Column) -> Column:
    return (has(failure, "AssertionError") & ~has(failure, "Mutation")) | has(failure, "could_not_parse_LLM_answer")


def invalid(failure: Column) -> Column:
    return has(failure, "LLMExecutionRuntimeError") | has(failure, "LLMExecutionError")


def answered(failure: Column) -> Column:
    return correct(failure) | wrong(failure)


def both_assertion(a: Column, b: Column) -> Column:
    return has(a, "AssertionError") & has(b, "AssertionError")


def differs(a: Column, b: Column) -> Column:
    """Two missing outputs are different outputs."""
    return F.coalesce(a != b, F.lit(True))


def vector_distance(a: Column, b: Column) -> Column:
    """Share of tests that pass in one of two outcome maps only, keys of the left; 0 if either is empty."""
    changed = F.size(F.filter(F.map_keys(a), lambda k: F.coalesce(F.try_element_at(a, k), F.lit(False)) != F.coalesce(F.try_element_at(b, k), F.lit(False))))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(changed / F.greatest(changed, F.size(a)))


def vectors_differ(a: Column, b: Column) -> Column:
    """Maps have no equality; their sorted entries do."""
    same = F.array_sort(F.map_entries(a)) == F.array_sort(F.map_entries(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(False)).otherwise(~same)


def scores_differ(task: Column, a: Column, b: Column, otherwise: Column, strict_reference: bool = True) -> Column:
    """For the scored task, equal scores count as a difference where the published numbers are to be met."""
    return F.when(task == SCORED, a == b if strict_reference else a != b).otherwise(otherwise)


def kind_of(f1: Column, f2: Column) -> Column:
    return F.when(invalid(f1) | invalid(f2), INVALID).when(wrong(f1) & wrong(f2), INCORRECTNESS).otherwise(CORRECTNESS)


def verdict(f1: Column, f2: Column, different: Column, distance: Column | None = None) -> Column:
    """A struct for an original and a mutated answer: compared, inconsistent, kind, incorrect and invalid
    (arrays of whose answer it is), and distance.

    ``different`` and ``distance`` are only asked for where both answers are wrong.
    """
    bad1, bad2 = wrong(f1) | invalid(f1), wrong(f2) | invalid(f2)
    distance = F.lit(0.0) if distance is None else distance

    def row(compared: bool, inconsistent, incorrect: list[str], unanswered: list[str], far=None) -> Column:
        inconsistent = F.lit(inconsistent) if isinstance(inconsistent, bool) else inconsistent
        names = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
        return F.struct(
            F.lit(compared).alias("compared"),
            inconsistent.alias("inconsistent"),
            F.when(inconsistent, kind_of(f1, f2)).alias("kind"),
            F.when(inconsistent, names(incorrect)).otherwise(names([])).alias("incorrect"),
            F.when(inconsistent, names(unanswered)).otherwise(names([])).alias("invalid"),
            (F.lit(0.0) if far is None else far).alias("distance"),
        )

    one = F.lit(1.0)
    return (
        F.when(correct(f1) & correct(f2), row(True, False, [], []))
        .when(correct(f1) & wrong(f2), row(True, True, [MUTATED], [], one))
        .when(correct(f1) & invalid(f2), row(True, True, [], [MUTATED], one))
        .when(wrong(f1) & correct(f2), row(True, True, [ORIGINAL], [], one))
        .when(invalid(f1) & correct(f2), row(True, True, [], [ORIGINAL], one))
        .when(wrong(f1) & wrong(f2), row(True, different, [ORIGINAL, MUTATED], [], distance))
        .when(wrong(f1) & invalid(f2), row(True, True, [ORIGINAL], [MUTATED], one))
        .when(invalid(f1) & wrong(f2), row(True, True, [MUTATED], [ORIGINAL], one))
        .when(bad1 & bad2, row(True, False, [], []))
        .otherwise(row(False, False, [], []))
    )


def neighbours(f1: Column, f2: Column, different: Column) -> Column:
    """The same for two instances of a template, in no order: compared and inconsistent."""
    row = lambda c, i: F.struct(F.lit(c).alias("compared"), (F.lit(i) if isinstance(i, bool) else i).alias("inconsistent"))
    bad = lambda f: wrong(f) | invalid(f)
    return (
        F.when((correct(f1) & correct(f2)) | (invalid(f1) & invalid(f2)), row(True, False))
        .when((correct(f1) & bad(f2)) | (bad(f1) & correct(f2)), row(True, True))
        .when(wrong(f1) & wrong(f2), row(True, different))
        .when((wrong(f1) & invalid(f2)) | (invalid(f1) & wrong(f2)), row(True, True))
        .otherwise(row(False, False))
    )


def usable(task: Column) -> Column:
    return task != SKIPPED


def category(name: Column) -> Column:
    out = F.when(F.lit(False), "")
    for kind, names in CATEGORY.items():
        out = out.when(name.rlike("|".join(names)), kind)
    return out


def order_class(name: Column) -> Column:
    """Second order if two mutations make the name."""
    lists = [n for names in CATEGORY.values() for n in names if not n.startswith("constant_unfold_")]
    hits = sum((name.contains(n).cast("int") for n in lists), start=F.lit(0))
    return F.when(hits >= 2, "Second Order").otherwise("Atomic")


def display_name(log: Column) -> Column:
    tail = F.substring_index(log, "shot_", -1)
    return F.when(tail.contains("_"), F.initcap(F.replace(tail, F.lit("_"), F.lit(" ")))).otherwise(F.concat(F.upper(F.substring(tail, 1, 1)), F.lower(F.substring(tail, F.lit(2), F.length(tail)))))


def rank_bucket(n: Column) -> Column:
    return F.when(n.between(1, 5), "A").when(n.between(6, 10), "B").when(n.between(11, 20), "C").when(n.between(21, 30), "D").when(n.between(31, 40), "E").otherwise("F")


def legal(names: Column, groups: dict[str, list[str]] | None = None) -> Column:
    """Whether no two different mutations of an array share a group; unknown names raise."""
    groups = groups or CONFLICT_GROUPS
    known = sorted({n for g in groups.values() for n in g})
    distinct = F.array_distinct(names)
    single = [F.size(F.array_intersect(distinct, F.array(*map(F.lit, g)))) <= 1 for g in groups.values()]
    out = single[0]
    for s in single[1:]:
        out = out & s
    unknown = F.array_except(distinct, F.array(*map(F.lit, known)))
    return F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown mutation "), F.array_join(unknown, ", "))).cast("boolean")).otherwise(out)


def percent(n: Column, d: Column) -> Column:
    """n of d in percent, rounded half to even as the published tables are; null without a denominator."""
    return F.bround(F.try_divide(n * F.lit(100.0), d), 2)


def at_threshold(failure: Column, confidence: Column, threshold: Column) -> Column:
    """The failure of a scored answer, or the mark of one below the threshold; no confidence is below all."""
    scored = failure.isNull() | (has(failure, "AssertionError") & ~has(failure, "Mutation"))
    return F.when(scored & ~(F.coalesce(F.nanvl(confidence, F.lit(-1.0)), F.lit(-1.0)) >= threshold), "Confidence_lower_than_threshold").otherwise(failure)
