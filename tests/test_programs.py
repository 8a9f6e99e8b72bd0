"""Rewrites keep what programs compute; bad programs are rows, not exceptions."""

import ast

import pytest
from pyspark.sql import functions as F

from veriscope.functions import programs as P
from veriscope.operators import programs as ops
from veriscope.operators import sandbox
from veriscope.plans.programs import PROGRAMS

MORE = [
    ("f", "def f(xs):\n    out = []\n    for i, x in enumerate(xs):\n        for y in [x, x + 1]:\n            if y == 2:\n                continue\n            if y > 5:\n                break\n            out.append((i, y))\n    else:\n        out.append(0)\n    return out", ([1, 2, 7],)),
    ("f", "def f(d):\n    r = 0\n    for k in d.keys():\n        r += d[k]\n    return r or not (r and True)", ({"a": 1, "b": 97},)),
    ("f", "def f(a, b=2):\n    def g(a):\n        return a * 10 + b\n    return g(a=a) - 1", (4,)),
    ("f", "def f(s):\n    n = 0\n    for c in reversed(s):\n        n = n * 2 + (1 if c == 'x' and not n else 0)\n    return n", ("axbx",)),
    ("f", "def f():\n    return 0 + 1 + 2 + 4 + 7 + 10 + 97", ()),
]


def call(source, name, args):
    space = {}
    exec(source, space)
    return space[name](*args)


@pytest.mark.parametrize("mutation", list(P.REWRITES))
def test_meaning_stays(mutation):
    own = [(f, s, ast.literal_eval(a)) for _, f, s, a, e in PROGRAMS if e != "None"] + MORE
    done = 0
    # De Morgan keeps truth, not which operand is returned
    value = bool if mutation == "demorgan" else lambda x: x
    for name, source, args in own:
        if mutation == "literal_format" and "it" in source and "\\'" in source:
            continue  # quotes inside quotes break; running the program is what rejects it
        status, error, code = P.rewrite(source, [mutation])
        if status != "ok":
            assert error.split(" > ")[0] in ("NoForLoopError", "NoBooleanOperationError", "NoBooleanLiteralError", "NoCommutativeOperationError", "NoConstantUnfoldError", "IdenticalMutationError", "MutationFailedError")
            continue
        done += 1
        to = P.rename_map(source, mutation) if mutation in ("random", "sequential") else {}
        assert value(call(code, to.get(name, name), args)) == value(call(source, name, args)), code
    assert done or mutation == "literal_format"


def test_errors_are_values():
    assert P.rewrite("def b(:", ["demorgan"])[1].startswith("MutationFailedError")
    assert P.rewrite(None, ["demorgan"])[0] == "error"
    assert P.rewrite("x = 1", ["for2while"])[1].startswith("NoForLoopError")
    assert P.rewrite("x = 'a'", ["literal_format"])[0] in ("ok", "error")


def test_exclusive_mutations_raise(spark):
    with pytest.raises(ValueError):
        ops.rewritten(F.lit("x"), "random", "sequential")
    with pytest.raises(ValueError):
        ops.rewritten(F.lit("x"), "swap")


def test_facts():
    s = "def f(a, b):\n    n = len(a)\n    for i in range(n):\n        t = 'x'\n    return (n, t)"
    assert P.names(s) == (["f"], ["a", "b"])
    assert P.variable_types(s) == {"n": "int", "i": "int", "t": "str"}
    assert P.detect(s) == {"for_loop": True, "bool_op": False, "bool_literal": False, "commutative": False, "int_above_one": False}
    c = P.complexity("def f(x):\n    if x > 1 and x < 9:\n        return x + 1\n    return x")
    assert (c["h1"], c["n1"], c["cyclomatic"]) == (4, 4, 3) and c["time"] == pytest.approx(c["effort"] / 18)
    assert [P.static_gate(x, "f", 1) for x in ("x", "def (", "class A:\n  def f(s): pass", "def g(x): pass", "def f(): pass", "def f(x): pass")] == ["no function", "syntax error", "not a function", "wrong name", "wrong arity", None]


def test_assert_cases():
    cases, rejected = P.assert_cases("assert f(1, [2]) == {'x': (1,)}\nassert f('y')\nassert not f(-3)\nassert f(1) > 2\nassert g(1) == 2\nassert f(2 + 3) is None", "f")
    assert [(c["args"], c["output"], c["output_type"]) for c in cases] == [("(1, [2])", "{'x': (1,)}", "dict"), ("('y',)", "True", "bool"), ("(-3,)", "False", "bool"), ("(5,)", "None", "NoneType")]
    assert rejected == 2


def test_values():
    for v in (1, "a", [1, (2,)], {"k": None}, True, -2.5):
        t = P.tagged(v)
        assert P.untagged(**t) == v
    assert P.same_answer([1, "a"], ["a", 1]) and not P.same_answer((1, 2), (2, 1)) and not P.same_answer(1, True)


def test_sandbox(spark):
    rows = [
        ("ok", "def f(x):\n    return x + 1", "(1,)"),
        ("loop", "def f(x):\n    while True:\n        pass", "(1,)"),
        ("memory", "def f(x):\n    return len(bytearray(10 ** 11))", "(1,)"),
        ("raise", "def f(x):\n    raise KeyError(x)", "(1,)"),
        ("exit", "import os\nos._exit(3)", "(1,)"),
        ("noise", "print('x' * 100)\ndef f(x):\n    print(x)\n    return [x]", "('q',)"),
        ("none", None, "(1,)"),
    ]
    df = spark.createDataFrame(rows, "id string, source string, args string").withColumn("function", F.lit("f"))
    got = {r["id"]: r for r in sandbox.execute(df, ["id"], seconds=2).collect()}
    assert got["ok"]["value"]["data"] == "2" and got["noise"]["value"].asDict() == {"data": "['q']", "metadata": "list"}
    assert all(got[k]["status"] == "error" for k in ("loop", "memory", "raise", "exit", "none"))
    assert got["raise"]["error"].startswith("ExecutionError > KeyError")


def test_fuzz_tries_a_hundred_inputs(spark):
    from veriscope.plans import catalog

    got = {r["task_id"]: r for r in catalog.QUERIES["x34_fuzz"](spark, "").collect()}
    assert all(r["tried"] == 100 for r in got.values())
    assert got["right"]["counterexample"] is None and got["other inputs"]["counterexample"] is not None


LOOPS = [
    ("def f(xs):\n    t = 0\n    for x in xs:\n        if x % 2:\n            continue\n        t += x\n    else:\n        t += 100\n    return t", ["[1, 2, 3, 4]", "(2, 4)", "{2, 4}", "[]"]),
    ("def f(n):\n    o = []\n    for i in range(n):\n        n = n - 1\n        o.append(i)\n    return o", ["5", "0"]),
    ("def f(n):\n    o = []\n    for i in range(n, -3, -2):\n        i += 1\n        o.append(i)\n    return o", ["5", "-9"]),
    ("def f(n):\n    o = []\n    for i in range(1, 10, n):\n        o.append(i)\n    return o", ["5", "1", "-1"]),
    ("def f(a, b):\n    o = []\n    for x, (y, z) in zip(a, b):\n        o.append(x + y + z)\n    return o", ["[1, 2, 3], [(1, 2), (3, 4)]"]),
    ("def f(a):\n    o = []\n    for i, x in enumerate(a, 3):\n        o.append((i, x))\n    for i, x in enumerate(a):\n        o.append((i, x))\n    return o", ["'abc'", "[]"]),
    ("def f(a):\n    o = []\n    for x in reversed(a):\n        o.append(x)\n    s = [3, 4]\n    for v in s:\n        if v < 5:\n            s.append(v + 1)\n        o.append(v)\n    return o", ["[1, 2]", "'ab'"]),
    ("def f(d):\n    o = []\n    for k, v in d.items():\n        for w in v:\n            if w == 2:\n                break\n            o.append((k, w))\n    return o", ["{'a': [1, 2, 3], 'b': [5]}"]),
    ("def f(n):\n    o = []\n    s = [n, n + 1]\n    for v in s:\n        s = [7, 8, 9]\n        o.append(v)\n    return o", ["3"]),
]


@pytest.mark.parametrize("source, inputs", LOOPS)
def test_loops(source, inputs):
    code = P.for2while(source)
    assert "for " not in code
    for a in inputs:
        args = ast.literal_eval(f"({a},)")
        assert call(code, "f", args) == call(source, "f", args), code


def test_forms_of_loops():
    """Bounds follow from what is iterated: no list where a range or a sequence is."""
    assert "while index < stop" in P.for2while("def f(n):\n    for i in range(n):\n        print(i)")
    assert "while index > stop" in P.for2while("def f(n):\n    for i in range(9, n, -1):\n        print(i)")
    assert "min(len(items), len(items1))" in P.for2while("def f(a, b):\n    for x, y in zip(a, b):\n        print(x)")
    assert "[::-1]" in P.for2while("def f(a):\n    for x in reversed(a):\n        print(x)")
    assert "list(" not in P.for2while("def f():\n    s = 'ab'\n    for x in s:\n        print(x)")


def test_slices_keep_their_order():
    swap = P.REWRITES["commutative_reorder"]
    source = "def f(a, b):\n    return a[1:] + a[:1], b + 1"
    assert "a[1:] + a[:1], 1 + b" in swap(source) and call(swap(source), "f", ([1, 2], 3)) == ([2, 1], 4)


def test_tests_apart():
    """A test that hangs fails alone; cases of unittest have a verdict for each method."""
    case = "import unittest\nclass C(unittest.TestCase):\n    def test_a(self):\n        self.assertEqual(f(1), 2)\n    def test_b(self):\n        self.fail()"
    out = sandbox.run("def f(n):\n    return n + 1", tests={"good": "assert f(1) == 2", "hangs": "while True: pass", "bad": "assert f(1) == 1", "u": case}, seconds=2)
    assert out["tests"] == {"good": True, "hangs": False, "bad": False, "u.C.test_a": True, "u.C.test_b": False}


def test_fuzz_and_inputs(spark):
    pairs = [(1, "f", "def f(a, i):\n    return a[i]", "def f(a, i):\n    return a[i]", "list,int"), (2, "f", "def f(s):\n    return s", "def f(s):\n    return s.lower()", "str"), (3, "f", "def f(n):\n    return n", "def f(n):\n    raise ValueError", "int"), (4, "f", "def f(n:", "def f(n):\n    return n", "int")]
    got = {r["id"]: r for r in sandbox.fuzz(spark.createDataFrame(pairs, "id int, function string, source string, mutated string, kinds string"), ["id"], seconds=5).collect()}
    assert got[1]["counterexample"] is None and got[1]["tried"] == 100
    assert any(c.isupper() for c in got[2]["counterexample"]) and got[3]["counterexample"] == got[4]["counterexample"] == "(0,)"
    assert [P.generate("list,int", 1, i) for i in range(9)] == [P.generate("list,int", 1, i) for i in range(9)]
    with pytest.raises(ValueError):
        P.generate("tree", 1, 0)


def test_undefined_names():
    assert P.undefined("import os\ndef f(a, *b, c=1, **d):\n    try:\n        return [x for x in b if y], os, len(a), z\n    except KeyError as e:\n        raise e") == ["y", "z"]
    assert P.undefined("from math import *\nprint(pi)") == []
