"""Program rewrites, checks and measures over literal programs: the tables hold no program text.

What they return was checked by hand, and every rewritten program was run before and after: ``CHECKED`` has those rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veriscope.functions import text as T
from veriscope.functions.programs import REWRITES
from veriscope.operators import programs as P
from veriscope.operators import sandbox
from veriscope.plans.base import values
from veriscope.plans.checked import CHECKED, TREES

QUERIES: dict = {}

PROGRAMS = [
    ("loop", "f", "def f(xs):\n    total = 0\n    for x in xs:\n        if x % 2 == 0:\n            continue\n        total = total + x\n    return total", "([1, 2, 3, 10],)", "9"),
    ("range", "g", "def g(n):\n    out = []\n    for i in range(n):\n        out.append(i * 4)\n    return out", "(4,)", "[0, 4, 8, 12]"),
    ("logic", "h", "def h(a, b):\n    if a and not b or a > 10:\n        return True\n    return False", "(1, 0)", "True"),
    ("text", "t", "def t(s):\n    return s + 'it\\'s'", "('x',)", "\"xit's\""),
    ("nested", "n", "def n(m):\n    out = 0\n    for row in m:\n        for v in row:\n            out += v * 7\n    return out", "([[1, 2], [3]],)", "42"),
    ("zip", "z", "def z(a, b):\n    return [x for x, y in zip(a, b)]", "([1], [2])", "[1]"),
    ("broken", "b", "def b(:\n    pass", "()", "None"),
    ("raises", "r", "def r(x):\n    return 1 / x", "(0,)", "None"),
]
SCHEMA = "task_id string, function string, source string, args string, expected string"


UNITTEST = """
import unittest
class Case(unittest.TestCase):
    def test_odd(self):
        self.assertEqual(f([1, 3]), 4)
    def test_even(self):
        self.assertEqual(f([2]), 2)
"""

#: task, function, arity, program, test, reference and kinds of parameters.
ANSWERS = [
    ("right", "f", 1, "def f(n):\n    return n + n", "assert f(2) == 4", "def f(n):\n    return n * 2", "int"),
    ("other inputs", "f", 1, "def f(n):\n    return n + n if n < 45 else 0", "assert f(2) == 4", "def f(n):\n    return n * 2", "int"),
    ("test", "f", 1, "def f(n):\n    return n * n + 1", "assert f(2) == 4", "def f(n):\n    return n * 2", "int"),
    ("raises", "f", 2, "def f(a, b):\n    return a[b]", "assert f([5], 0) == 5", "def f(a, b):\n    return a[b]", "list,int"),
    ("name", "f", 1, "def g(n):\n    return n", "assert f(2) == 4", "def f(n):\n    return n * 2", "int"),
    ("undefined", "f", 1, "def f(n):\n    return n * two", "assert f(2) == 4", "def f(n):\n    return n * 2", "int"),
    ("stops", "f", 1, "def f(n):\n    return n * 2\nraise ValueError", "assert f(2) == 4", "def f(n):\n    return n * 2", "int"),
]


def answers(s):
    kinds = "task_id string, function string, arity int, source string, test string, reference string, kinds string"
    return s.createDataFrame(ANSWERS, kinds).withColumn("tests", F.create_map(F.lit("t"), "test")).drop("test").withColumn("args", F.lit(None).cast("string"))


def programs(s):
    return s.createDataFrame(PROGRAMS, SCHEMA)


def _rewrite(name):
    def run(s, d):
        return programs(s).withColumn("r", P.rewritten(F.col("source"), name)).select("task_id", "r.status", "r.error", "r.code")

    return run


for _i, _name in enumerate(REWRITES, 1):
    QUERIES[f"x{_i:02}_{_name}"] = _rewrite(_name)


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def x12_variable_types(s, d):
    return programs(s).select("task_id", F.explode(P.variable_types(F.col("source"))).alias("name", "type"))


@query
def x13_applicable(s, d):
    return programs(s).withColumn("a", P.applicable(F.col("source"))).select("task_id", "a.*")


@query
def x14_canonical(s, d):
    return programs(s).select("task_id", P.canonical(F.col("source")).alias("code"))


@query
def x15_names(s, d):
    return programs(s).withColumn("n", P.names(F.col("source"))).select("task_id", F.array_join("n.functions", ",").alias("functions"), F.array_join("n.params", ",").alias("params"))


@query
def x17_assert_cases(s, d):
    checks = s.createDataFrame([("a", "f", "assert f(1, [2]) == {'x': (1,)}\nassert f('y')\nassert not f(-3)\nassert f(1) > 2\nassert g(1) == 2")], "task_id string, function string, source string")
    return checks.withColumn("c", P.assert_cases(F.col("source"), F.col("function"))).select("task_id", "c.rejected", F.explode("c.cases").alias("k")).select("task_id", "rejected", "k.args", F.array_join("k.types", ",").alias("types"), "k.output", "k.output_type")


@query
def x20_rewritten_and_run(s, d):
    """Every program under De Morgan or a while loop, executed on its input: the value has to stay."""
    m = programs(s).withColumn("r", F.when(F.col("task_id") == "logic", P.rewritten(F.col("source"), "demorgan")).otherwise(P.rewritten(F.col("source"), "for2while")))
    ok = m.filter("r.status = 'ok'").select("task_id", "function", "args", "source", F.col("r.code").alias("mutated"))
    return sandbox.equivalent(ok, ["task_id"], seconds=8)


@query
def x24_execute(s, d):
    return sandbox.execute(programs(s), ["task_id", "expected"], seconds=8).select("task_id", "status", F.split_part("error", F.lit(" > "), F.lit(1)).alias("error"), "value.data", "value.metadata", (F.col("value.data") == F.col("expected")).alias("right"))


@query
def x27_test_vectors(s, d):
    tests = F.create_map(F.lit("t1"), F.lit("assert f([1, 3]) == 4"), F.lit("t2"), F.lit("assert f([]) == 1"), F.lit("t3"), F.lit("assert f(3)"), F.lit("u"), F.lit(UNITTEST))
    return sandbox.execute(programs(s).filter("task_id = 'loop'").drop("args").withColumn("tests", tests), ["task_id"], seconds=8).select("task_id", F.explode("tests").alias("test", "passed"))


@query
def x30_suite_gate(s, d):
    """The tasks whose reference passes its whole suite; the others have no say about answers."""
    ran = sandbox.execute(answers(s).withColumn("source", F.col("reference")).drop("args"), ["task_id"], seconds=8)
    return ran.select("task_id", (F.forall(F.map_values("tests"), lambda x: x) & (F.size("tests") > 0)).alias("usable"))


@query
def x34_fuzz(s, d):
    """A hundred seeded inputs of the kinds that a function takes, through it and its reference."""
    pairs = answers(s).filter("task_id not in ('name', 'stops')").withColumn("mutated", F.col("reference"))
    return sandbox.fuzz(pairs, ["task_id"], seconds=8)


@query
def x35_generated_kinds(s, d):
    """Inputs by the kinds of a function's parameters."""
    kinds = s.createDataFrame([(k,) for k in ("int", "bool", "str", "list", "matrix", "list,int,int")], "kinds string")
    return kinds.select("kinds", F.posexplode(P.generated(F.col("kinds"), 4)).alias("i", "input"))


@query
def x37_undefined_names(s, d):
    return answers(s).select("task_id", F.array_join(P.undefined(F.col("source")), ",").alias("names"))


@query
def x38_cascade(s, d):
    """Static gates, then tests, then a hundred inputs against the reference."""
    return sandbox.cascade(answers(s), ["task_id"], seconds=8)


@query
def x38_static_gates(s, d):
    return programs(s).select("task_id", P.gate(F.col("source"), F.lit("f"), F.lit(1)).alias("reason"))


@query
def x39_complexity(s, d):
    return programs(s).withColumn("c", P.complexity(F.col("source"))).select("task_id", "c.*")


@query
def x40_tree(s, d):
    return programs(s).select("task_id", F.posexplode(P.tree(F.col("source"))).alias("at", "n")).select("task_id", "at", "n.depth", "n.node")


@query
def t08_doctests(s, d):
    return s.createDataFrame([("a", "Adds.\n>>> f(1)\n2\n>>> f(2)\n3\n")], "task_id string, text string").select("task_id", F.explode(T.doctests(F.col("text"))).alias("call", "want"))


@query
def t09_split_docstring(s, d):
    own = s.createDataFrame([("a", 'def f(x):\n    """Adds one."""\n    return x + 1')], "task_id string, text string")
    return own.withColumn("p", T.split_docstring(F.col("text"))).select("task_id", "p.code", "p.docstring")


@query
def t10_without_metadata(s, d):
    return s.createDataFrame([("a", "METADATA = {\n  'a': 1\n}\ndef check(c):\n    assert c(1)")], "task_id string, text string").select("task_id", T.without_metadata(F.col("text")).alias("code"))


@query
def t11_functions_only(s, d):
    return programs(s).select("task_id", T.functions_only(F.concat(F.lit("from os import path\nprint(1)\n"), "source")).alias("code"))


ORACLE = {name: values(*CHECKED[name]) for name in CHECKED if name in QUERIES}
ORACLE["x40_tree"] = f"""WITH t AS ({values("task_id VARCHAR, n VARCHAR", list(TREES.items()))}), n AS (SELECT task_id, unnest(string_split(n, ', ')) AS n, unnest(range(0, len(string_split(n, ', ')))) AS "at" FROM t)
SELECT task_id, "at"::INTEGER AS "at", split_part(n, ' ', 1)::INTEGER AS depth, split_part(n, ' ', 2) AS node FROM n"""
