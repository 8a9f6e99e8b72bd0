"""Program rewrites and facts as columns, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from veriscope.functions import programs as P
from veriscope.functions.outcome import CONFLICT_GROUPS
from veriscope.schemas import SEED


def _safe(f, default):
    def call(x):
        try:
            return f(x)
        except (SyntaxError, ValueError, TypeError, RecursionError, AttributeError):
            return default

    return call


def rewritten(source: Column, *mutations: str) -> Column:
    """A struct of status, error and code.  Mutations that exclude one another raise here, not in a row."""
    for g in CONFLICT_GROUPS.values():
        if len({*mutations} & {*g}) > 1:
            raise ValueError(f"mutations of one group: {sorted({*mutations} & {*g})}")
    if unknown := {*mutations} - {*P.REWRITES}:
        raise ValueError(f"unknown mutations: {sorted(unknown)}")

    @F.pandas_udf("status string, error string, code string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([P.rewrite(x, list(mutations)) for x in s], columns=["status", "error", "code"])

    return run(source)


def canonical(source: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(_safe(P.canonical, None))

    return run(source)


def applicable(source: Column) -> Column:
    fields = ("for_loop", "bool_op", "bool_literal", "commutative", "int_above_one")

    @F.pandas_udf(", ".join(f"{f} boolean" for f in fields))
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_safe(P.detect, dict.fromkeys(fields))(x) for x in s], columns=list(fields))

    return run(source)


def names(source: Column) -> Column:
    @F.pandas_udf("functions array<string>, params array<string>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_safe(P.names, (None, None))(x) for x in s], columns=["functions", "params"])

    return run(source)


def variable_types(source: Column) -> Column:
    @F.pandas_udf("map<string,string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(_safe(P.variable_types, None))

    return run(source)


def assert_cases(source: Column, function: Column) -> Column:
    """An array to explode: args, types, output, output_type."""

    @F.pandas_udf("cases array<struct<args: string, types: array<string>, output: string, output_type: string>>, rejected int")
    def run(s: pd.Series, f: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_safe(lambda x: P.assert_cases(*x), ([], 0))(x) for x in zip(s, f)], columns=["cases", "rejected"])

    return run(source, function)


_MEASURES = {**dict.fromkeys(("h1", "h2", "n1", "n2", "vocabulary", "length"), "int"), **dict.fromkeys(("calculated_length", "volume", "difficulty", "effort", "time", "bugs"), "double"), "cyclomatic": "int", "maintainability": "double", **dict.fromkeys(("lines", "code_lines", "blank"), "int")}


def complexity(source: Column) -> Column:
    @F.pandas_udf(", ".join(f"{k} {t}" for k, t in _MEASURES.items()))
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_safe(P.complexity, dict.fromkeys(_MEASURES))(x) for x in s], columns=list(_MEASURES))

    return run(source)


def tree(source: Column) -> Column:
    @F.pandas_udf("array<struct<depth: int, node: string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(_safe(P.tree_dump, None))

    return run(source)


def gate(source: Column, function: Column, arity: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series, f: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([_safe(lambda x: P.static_gate(*x), "no function")(x) for x in zip(s, f, n)])

    return run(source, function, arity)


def undefined(source: Column) -> Column:
    """The names that a program reads and binds nowhere; null where it cannot be parsed."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(_safe(P.undefined, None))

    return run(source)


def generated(kinds: Column, n: int, seed: int = SEED) -> Column:
    """The texts of ``n`` inputs of some kinds."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda k: [repr(P.generate(k, seed, i)) for i in range(n)])

    return run(kinds)
