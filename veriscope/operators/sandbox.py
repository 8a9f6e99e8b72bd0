"""Running programs of unknown origin, one child process a row.

A child gets a limit on CPU seconds, memory and file size, an empty folder of its own and no input;
whatever happens to it becomes the row's error.  Nothing is executed in the driver or in a Spark worker
itself.  This bounds accidents; it is no defence against an attacker, who needs a container.
"""

from __future__ import annotations

import json
import subprocess
import sys
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriscope.functions.programs import generate
from veriscope.operators.programs import gate
from veriscope.schemas import SEED

SECONDS, MEMORY = 20, 1 << 30

_CHILD = r"""
import ast, io, json, resource, sys, contextlib, unittest
task = json.loads(sys.stdin.read())
resource.setrlimit(resource.RLIMIT_CPU, (task["seconds"], task["seconds"] + 1))
resource.setrlimit(resource.RLIMIT_AS, (task["memory"],) * 2)
resource.setrlimit(resource.RLIMIT_FSIZE, (1 << 20,) * 2)
out = {"status": "ok", "error": None, "value": None, "values": [], "tests": {}}
def failed(kind, e):
    out.update(status="error", error=kind + " > " + type(e).__name__ + ": " + str(e)[:200])
with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
    space = {"__name__": "program"}
    try:
        exec(compile(task["source"], "program", "exec"), space)
        if task.get("args") is not None:
            r = space[task["function"]](*ast.literal_eval(task["args"]))
            r = r.tolist() if hasattr(r, "tolist") else r
            out["value"] = {"data": repr(r), "metadata": type(r).__name__}
        for args in task.get("inputs") or ():
            try:
                r = space[task["function"]](*ast.literal_eval(args))
                out["values"].append(type(r).__name__ + ":" + repr(r))
            except Exception as e:
                out["values"].append("raises:" + type(e).__name__)
        for name, text in (task.get("tests") or {}).items():
            own = dict(space)
            try:
                exec(compile(text, "test", "exec"), own)
                cases = [c for c in own.values() if isinstance(c, type) and issubclass(c, unittest.TestCase) and c.__module__ == "program"]
                for c in cases:
                    for method in unittest.defaultTestLoader.getTestCaseNames(c):
                        out["tests"][name + "." + c.__name__ + "." + method] = c(method).run().wasSuccessful()
                if not cases:
                    out["tests"][name] = True
            except BaseException as e:
                out["tests"][name] = False
    except MemoryError as e:
        failed("ResourceError", e)
    except BaseException as e:
        failed("ExecutionError", e)
sys.stdout.write(json.dumps(out))
"""


def run(source: str, function: str | None = None, args: str | None = None, tests: dict[str, str] | None = None, seconds: int = SECONDS, memory: int = MEMORY, inputs: list[str] | None = None) -> dict:
    """One child.  Of several tests each gets a child and a limit of its own, so one that hangs fails alone; a test
    that defines unittest cases has a verdict for each method."""
    if tests and (len(tests) > 1 or args is not None):
        out = run(source, function, args, None, seconds, memory)
        for name, text in tests.items():
            out["tests"] |= run(source, None, None, {name: text}, seconds, memory)["tests"] or {name: False}
        return out
    task = {"source": source, "function": function, "args": args, "tests": tests, "seconds": seconds, "memory": memory, "inputs": inputs}
    with tempfile.TemporaryDirectory() as folder:
        try:
            done = subprocess.run([sys.executable, "-I", "-c", _CHILD], input=json.dumps(task), capture_output=True, text=True, timeout=seconds + 2, cwd=folder, env={"PATH": "/usr/bin:/bin", "HOME": folder})
        except subprocess.TimeoutExpired:
            return {"status": "error", "error": f"TimeoutError > no answer in {seconds} seconds", "value": None, "values": [], "tests": {}}
    try:
        return json.loads(done.stdout)
    except ValueError:
        return {"status": "error", "error": f"ResourceError > the child ended with {done.returncode}", "value": None, "values": [], "tests": {}}


_RESULT = "status string, error string, value struct<data: string, metadata: string>, tests map<string,boolean>"


def execute(programs: DataFrame, keep: list[str], *, seconds: int = SECONDS, memory: int = MEMORY) -> DataFrame:
    """The columns ``keep``, and status, error, value and tests of each program.

    ``programs`` has source (null: an error), and function with args (a tuple's text) or tests (a map
    of snippets), or both.
    """
    have = set(programs.columns)
    absent = {"function": "string", "args": "string", "tests": "map<string,string>"}
    full = programs.select(*keep, *["source"] * ("source" not in keep), *[F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in absent.items() if c not in keep])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in full.select(*keep).schema.fields) + ", " + _RESULT

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                if r.source is None:
                    out = {"status": "error", "error": "NoProgramError > null", "value": None, "tests": {}}
                else:
                    out = run(r.source, r.function, r.args, dict(r.tests) if r.tests is not None else None, seconds, memory)
                rows.append((*(getattr(r, k) for k in keep), out["status"], out["error"], out["value"], out["tests"]))
            yield pd.DataFrame(rows, columns=[*keep, "status", "error", "value", "tests"])

    return full.mapInPandas(work, schema)


def equivalent(pairs: DataFrame, keep: list[str], *, seconds: int = SECONDS) -> DataFrame:
    """Whether ``source`` and ``mutated`` give one value for ``args``: a column equal, null if either fails."""
    own = execute(pairs, [*keep, "mutated", "function", "args"], seconds=seconds).select(*keep, "function", "args", F.col("value").alias("first"), F.col("mutated").alias("source"))
    both = execute(own, [*keep, "first"], seconds=seconds)
    return both.select(*keep, F.when(F.col("first").isNotNull() & F.col("value").isNotNull(), F.col("first") == F.col("value")).alias("equal"), "error")


def fuzz(pairs: DataFrame, keep: list[str], *, tries: int = 100, seed: int = SEED, seconds: int = SECONDS) -> DataFrame:
    """The columns ``keep``, tried, and the first of ``tries`` inputs (null: none) that tells ``source`` and ``mutated`` apart.

    ``pairs`` has function and kinds (the kinds of its parameters, joined by commas).  Raising the same exception is the same.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*keep).schema.fields) + ", tried int, counterexample string"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                made = [generate(r.kinds, seed, i) for i in range(tries)]
                inputs = [repr(x if "," in r.kinds else (x,)) for x in made]
                one, two = (run(x, r.function, seconds=seconds, inputs=inputs)["values"] for x in (r.source, r.mutated))
                differ = [i for i, x, y in zip(inputs, one, two) if x != y] + inputs[min(len(one), len(two)) :]  # no value: the child ended
                rows.append((*(getattr(r, k) for k in keep), len(inputs), differ[0] if differ else None))
            yield pd.DataFrame(rows, columns=[*keep, "tried", "counterexample"])

    return pairs.select(*dict.fromkeys([*keep, "source", "mutated", "function", "kinds"])).mapInPandas(work, schema)


def cascade(programs: DataFrame, keep: list[str], *, seconds: int = SECONDS, tries: int = 100) -> DataFrame:
    """The columns ``keep`` and the first reason why a program is no answer (null: none): a static gate, a test that
    fails, an input on which it differs from ``reference``.  What one step refuses the next does not run.

    ``programs`` has source, function, arity, tests, reference and kinds; ``keep`` tells its rows apart.
    """
    gated = programs.withColumn("reason", gate(F.col("source"), F.col("function"), F.col("arity")))
    fine = gated.filter("reason is null").drop("reason")
    ran = execute(fine.drop("args"), [*keep, "source", "function", "reference", "kinds"], seconds=seconds)
    passed = (F.col("status") == "ok") & (F.size("tests") > 0) & F.forall(F.map_values("tests"), lambda x: x)
    tested = ran.withColumn("reason", F.when(F.col("status") != "ok", "does not run").when(~passed, "test failed"))
    differ = fuzz(tested.filter("reason is null").withColumn("mutated", F.col("reference")), keep, tries=tries, seconds=seconds)
    last = differ.select(*keep, F.when(F.col("counterexample").isNotNull(), "differs from the reference").alias("reason"))
    return gated.filter("reason is not null").select(*keep, "reason").unionByName(tested.filter("reason is not null").select(*keep, "reason")).unionByName(last)


def outcome_of(passed: dict) -> bool:
    return bool(passed) and all(passed.values())
