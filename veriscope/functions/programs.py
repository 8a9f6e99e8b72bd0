"""Program text in, program text out: rewrites that keep meaning, and facts about programs.

Plain functions over Python's syntax trees; :mod:`veriscope.operators.programs` runs them over columns.
A rewrite that finds nothing to change raises :class:`NothingToDo`, whose name is the row's error.
"""

from __future__ import annotations

import ast
import builtins
import hashlib
import math
import random
from collections import Counter


class NothingToDo(Exception):
    """The program has nothing that the rewrite applies to."""


def canonical(source: str) -> str:
    return ast.unparse(ast.parse(source))


def names(source: str) -> tuple[list[str], list[str]]:
    """Functions and positional parameters, nested ones too, in source order without repeats."""
    found = sorted((n for n in ast.walk(ast.parse(source)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))), key=lambda n: (n.lineno, n.col_offset))
    args = [a.arg for f in found for a in (*f.args.posonlyargs, *f.args.args)]
    return list(dict.fromkeys(f.name for f in found)), list(dict.fromkeys(args))


def detect(source: str) -> dict[str, bool]:
    """What there is to rewrite, in one walk."""
    t = list(ast.walk(ast.parse(source)))
    ints = [n.value for n in t if isinstance(n, ast.Constant) and type(n.value) is int]
    return {
        "for_loop": any(isinstance(n, ast.For) for n in t),
        "bool_op": any(isinstance(n, ast.BoolOp) for n in t),
        "bool_literal": any(isinstance(n, ast.Constant) and isinstance(n.value, bool) for n in t),
        "commutative": any(isinstance(n, ast.BinOp) and isinstance(n.op, (ast.Add, ast.Mult)) and not _textual(n) for n in t),
        "int_above_one": any(i > 1 for i in ints),
    }


def random_name(seed: int, name: str) -> str:
    """Five to fourteen letters that the seed and the name decide."""
    d = hashlib.sha256(f"{seed}:{name}".encode()).digest()
    return "".join("abcdefghijklmnopqrstuvwxyz"[b % 26] for b in d[1 : 6 + d[0] % 10])


class _Rename(ast.NodeTransformer):
    def __init__(self, to: dict[str, str]):
        self.to = to

    def visit_FunctionDef(self, node):
        node.name = self.to.get(node.name, node.name)
        return self.generic_visit(node)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_arg(self, node):
        node.arg = self.to.get(node.arg, node.arg)
        return self.generic_visit(node)

    def visit_Name(self, node):
        node.id = self.to.get(node.id, node.id)
        return node

    def visit_Call(self, node):
        # keywords name parameters of the program's own functions only
        if isinstance(node.func, ast.Name) and node.func.id in self.to:
            for k in node.keywords:
                k.arg = self.to.get(k.arg, k.arg)
        return self.generic_visit(node)


def rename_map(source: str, style: str, seed: int = 1234) -> dict[str, str]:
    functions, params = names(source)
    if style == "sequential":
        return {f: f"generic_function{i}" for i, f in enumerate(functions, 1)} | {p: f"var{i}" for i, p in enumerate(params, 1)}
    out: dict[str, str] = {}
    for n in [*functions, *params]:
        salt = 0
        while (new := random_name(seed + salt, n)) in out.values():
            salt += 1
        out[n] = new
    return out


def rename(source: str, style: str, seed: int = 1234) -> str:
    return ast.unparse(_Rename(rename_map(source, style, seed)).visit(ast.parse(source)))


def literal_format(source: str) -> str:
    return canonical(source).translate({39: '"', 34: "'"})


def _fresh(used: set[str], stem: str) -> str:
    i = 0
    while (n := f"{stem}{i}" if i else stem) in used:
        i += 1
    used.add(n)
    return n


def _used(tree: ast.AST) -> set[str]:
    return {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} | {n.arg for n in ast.walk(tree) if isinstance(n, ast.arg)} | {n.name for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)}


def _call(name: str, *args: ast.expr) -> ast.Call:
    return ast.Call(ast.Name(name, ast.Load()), list(args), [])


class _Enumerate(ast.NodeTransformer):
    def __init__(self, used: set[str]):
        self.used, self.done = used, 0

    def visit_For(self, node):
        self.generic_visit(node)
        if isinstance(node.iter, ast.Call) and isinstance(node.iter.func, ast.Name) and node.iter.func.id == "enumerate":
            return node
        self.done += 1
        index, before = _fresh(self.used, "loop_var"), []
        it = node.iter
        if not isinstance(it, ast.Name) and not (isinstance(it, ast.Call) and isinstance(it.func, ast.Name)):
            new = _fresh(self.used, "new_var")
            before, it = [ast.Assign([ast.Name(new, ast.Store())], it)], ast.Name(new, ast.Load())
        pair = ast.Tuple([ast.Name(index, ast.Store()), node.target], ast.Store())
        return [*before, ast.For(pair, _call("enumerate", it), node.body, node.orelse)]


def for2enumerate(source: str) -> str:
    tree = ast.parse(source)
    t = _Enumerate(_used(tree))
    tree = t.visit(tree)
    if not t.done:
        raise NothingToDo("NoForLoopError")
    return ast.unparse(ast.fix_missing_locations(tree))


def _name(n: str, store: bool = False) -> ast.Name:
    return ast.Name(n, ast.Store() if store else ast.Load())


class _While(ast.NodeTransformer):
    """A loop with a counter and a bound that follows from what is iterated: the ends of a range, the length of a
    sequence, the least length of a zip.  What may be no sequence is made a list first, so the order and the
    number of rounds stay."""

    def __init__(self, used: set[str], types: dict[str, str]):
        self.used, self.types, self.bound_names, self.done = used, types, set(), 0

    def sequence(self, x: ast.expr, before: list) -> ast.expr:
        """An expression to index: a name that holds a sequence, as it is or by an assignment before the loop."""
        if isinstance(x, ast.Call) and isinstance(x.func, ast.Name) and x.func.id == "reversed" and len(x.args) == 1:
            backwards = ast.Slice(None, None, ast.UnaryOp(ast.USub(), ast.Constant(1)))
            x = ast.Subscript(self.sequence(x.args[0], before), backwards, ast.Load())
        elif type_of(x, self.types) not in ("list", "str", "tuple"):
            x = _call("list", x)
        elif isinstance(x, ast.Name) and x.id not in self.bound_names:
            return x
        name = _fresh(self.used, "items")
        before.append(ast.Assign([_name(name, True)], x))
        return _name(name)

    def bound(self, x: ast.expr, before: list) -> ast.expr:
        """A number that the loop's body cannot change."""
        if isinstance(x, ast.Constant):
            return x
        name = _fresh(self.used, "stop")
        before.append(ast.Assign([_name(name, True)], x))
        return _name(name)

    def visit_For(self, node):
        self.generic_visit(node)
        self.done += 1
        at, before = _fresh(self.used, "index"), []
        self.bound_names = {n.id for part in (node.target, *node.body) for n in ast.walk(part) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
        it, start, step = node.iter, ast.Constant(0), ast.Constant(1)
        kind = it.func.id if isinstance(it, ast.Call) and isinstance(it.func, ast.Name) and not it.keywords and not any(isinstance(a, ast.Starred) for a in it.args) else None
        test: ast.cmpop = ast.Lt()
        by = _integer(it.args[2]) if kind == "range" and len(it.args) == 3 else 1
        if kind == "range" and 1 <= len(it.args) <= 3 and by:
            start = self.bound(it.args[0], before) if len(it.args) > 1 else start
            limit = self.bound(it.args[1 if len(it.args) > 1 else 0], before)
            step, test = (ast.Constant(by), ast.Lt()) if by > 0 else (ast.UnaryOp(ast.USub(), ast.Constant(-by)), ast.Gt())
            value = _name(at)
        elif kind == "enumerate" and 1 <= len(it.args) <= 2:
            items = self.sequence(it.args[0], before)
            value = ast.Subscript(items, _name(at), ast.Load())
            count = ast.BinOp(_name(at), ast.Add(), self.bound(it.args[1], before)) if len(it.args) == 2 else _name(at)
            value, limit = ast.Tuple([count, value], ast.Load()), _call("len", items)
        elif kind == "zip" and len(it.args) > 1:
            all_items = [self.sequence(a, before) for a in it.args]
            value = ast.Tuple([ast.Subscript(i, _name(at), ast.Load()) for i in all_items], ast.Load())
            limit = _call("min", *[_call("len", i) for i in all_items])
        else:
            items = self.sequence(it, before)
            value, limit = ast.Subscript(items, _name(at), ast.Load()), _call("len", items)
        # the counter moves before the body, so continue needs no copy of the step
        body = [ast.Assign([node.target], value), ast.AugAssign(_name(at, True), ast.Add(), step), *node.body]
        loop = ast.While(ast.Compare(_name(at), [test], [limit]), body, node.orelse)
        return [*before, ast.Assign([_name(at, True)], start), loop]


def _integer(x: ast.expr) -> int | None:
    """The value of an integer literal with or without a sign."""
    try:
        n = ast.literal_eval(x)
    except ValueError:
        return None
    return n if type(n) is int else None


def for2while(source: str) -> str:
    tree = ast.parse(source)
    t = _While(_used(tree), variable_types(source))
    tree = t.visit(tree)
    if not t.done:
        raise NothingToDo("NoForLoopError")
    return ast.unparse(ast.fix_missing_locations(tree))


def _not(x: ast.expr) -> ast.expr:
    return x.operand if isinstance(x, ast.UnaryOp) and isinstance(x.op, ast.Not) else ast.UnaryOp(ast.Not(), x)


class _DeMorgan(ast.NodeTransformer):
    done = 0

    def visit_BoolOp(self, node):
        self.generic_visit(node)
        self.done += 1
        return _not(ast.BoolOp(ast.Or() if isinstance(node.op, ast.And) else ast.And(), [_not(v) for v in node.values]))


class _Literals(ast.NodeTransformer):
    done = 0

    def visit_Constant(self, node):
        if isinstance(node.value, bool):
            self.done += 1
            return ast.UnaryOp(ast.Not(), ast.Constant(not node.value))
        return node


def _textual(node: ast.expr) -> bool:
    """Whether an operation looks like one on texts or sequences, whose order matters."""
    return any(isinstance(n, (ast.JoinedStr, ast.List, ast.Tuple, ast.ListComp)) or isinstance(n, ast.Constant) and isinstance(n.value, (str, bytes)) or isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in ("str", "list", "tuple", "sorted", "chr", "input", "repr") or isinstance(n, ast.Subscript) and isinstance(n.slice, ast.Slice) or isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in ("join", "lower", "upper", "replace", "strip", "format", "split") for n in ast.walk(node))


class _Commute(ast.NodeTransformer):
    done = 0

    def visit_BinOp(self, node):
        self.generic_visit(node)
        if isinstance(node.op, (ast.Add, ast.Mult)) and not _textual(node):
            self.done += 1
            node.left, node.right = node.right, node.left
        return node


class _Unfold(ast.NodeTransformer):
    def __init__(self, how: str):
        self.how, self.done = how, 0

    def visit_JoinedStr(self, node):
        return node

    def visit_Constant(self, node):
        n = node.value
        if type(n) is not int or n < 0 or self.how != "add" and n < 2:
            return node
        self.done += 1
        if self.how == "add":
            return ast.BinOp(ast.Constant(n // 2), ast.Add(), ast.Constant(n - n // 2))
        f = next((k for k in range(2, min(n, 10)) if n % k == 0), None)
        return ast.BinOp(ast.Constant(f or n), ast.Mult(), ast.Constant(n // f if f else 1))


def _applied(source: str, t, error: str) -> str:
    tree = t.visit(ast.parse(source))
    if not t.done:
        raise NothingToDo(error)
    return ast.unparse(ast.fix_missing_locations(tree))


#: Every rewrite by name.  Unfolding without a choice multiplies.
REWRITES = {
    "random": lambda s: rename(s, "random"),
    "sequential": lambda s: rename(s, "sequential"),
    "literal_format": literal_format,
    "for2enumerate": for2enumerate,
    "for2while": for2while,
    "demorgan": lambda s: _applied(s, _DeMorgan(), "NoBooleanOperationError"),
    "boolean_literal": lambda s: _applied(s, _Literals(), "NoBooleanLiteralError"),
    "commutative_reorder": lambda s: _applied(s, _Commute(), "NoCommutativeOperationError"),
    "constant_unfold": lambda s: _applied(s, _Unfold("mult"), "NoConstantUnfoldError"),
    "constant_unfold_add": lambda s: _applied(s, _Unfold("add"), "NoConstantUnfoldError"),
    "constant_unfold_mult": lambda s: _applied(s, _Unfold("mult"), "NoConstantUnfoldError"),
}


def squeezed(source: str) -> str:
    """Without blank lines and spaces, to see whether a rewrite changed anything."""
    return "\n".join(x for x in source.replace(" ", "").split("\n") if x)


def rewrite(source: str | None, mutations: list[str]) -> tuple[str, str | None, str | None]:
    """Status, error and text: errors are values, so that a bad program is a row like any other."""
    try:
        out = source
        for m in mutations:
            out = REWRITES[m](out)
        if squeezed(canonical(source)) == squeezed(out):
            return "error", "IdenticalMutationError > the text did not change", None
        ast.parse(out)
        return "ok", None, out
    except NothingToDo as e:
        return "error", f"{e} > nothing to rewrite", None
    except KeyError as e:
        return "error", f"UnknownMutationError > {e}", None
    except (SyntaxError, ValueError, TypeError, RecursionError, AttributeError) as e:
        return "error", f"MutationFailedError > {type(e).__name__}", None


_CALLS = {"len": "int", "max": "int", "min": "int", "sum": "int", "int": "int", "abs": "int", "ord": "int", "str": "str", "chr": "str", "list": "list", "sorted": "list", "dict": "dict", "set": "set", "tuple": "tuple", "float": "float", "bool": "bool", "range": "range"}


def type_of(node: ast.expr, known: dict[str, str]) -> str | None:
    match node:
        case ast.Constant():
            return type(node.value).__name__
        case ast.List() | ast.ListComp():
            return "list"
        case ast.Dict() | ast.DictComp():
            return "dict"
        case ast.Set() | ast.SetComp():
            return "set"
        case ast.Tuple():
            return "tuple"
        case ast.JoinedStr():
            return "str"
        case ast.Compare():
            return "bool"
        case ast.Name():
            return known.get(node.id)
        case ast.Call(func=ast.Name()):
            return _CALLS.get(node.func.id)
        case ast.BinOp():
            return type_of(node.left, known) or type_of(node.right, known)
        case ast.UnaryOp():
            return "bool" if isinstance(node.op, ast.Not) else type_of(node.operand, known)
    return None


def variable_types(source: str) -> dict[str, str]:
    """Types that assignments let one see, in source order; a later one stands."""
    known: dict[str, str] = {}
    for n in ast.walk(ast.parse(source)):
        if isinstance(n, ast.Assign) and (t := type_of(n.value, known)):
            for target in n.targets:
                if isinstance(target, ast.Name):
                    known[target.id] = t
        elif isinstance(n, ast.For) and isinstance(n.target, ast.Name) and isinstance(n.iter, ast.Call) and isinstance(n.iter.func, ast.Name) and n.iter.func.id == "range":
            known[n.target.id] = "int"
    return known


def tagged(value) -> dict[str, str]:
    return {"data": str(value), "metadata": type(value).__name__}


def untagged(data: str, metadata: str):
    return data if metadata == "str" else ast.literal_eval(data)


def value_of(node: ast.expr):
    """Constants, signs, containers and sums of them."""
    match node:
        case ast.BinOp():
            a, b = value_of(node.left), value_of(node.right)
            return {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: a / b, ast.Pow: lambda: a**b if abs(b) < 100 else 1 / 0}[type(node.op)]()
        case ast.Call(func=ast.Name()) if node.func.id in ("set", "list", "tuple", "dict", "str", "int", "float") and not node.keywords:
            return {"set": set, "list": list, "tuple": tuple, "dict": dict, "str": str, "int": int, "float": float}[node.func.id](*map(value_of, node.args))
    return ast.literal_eval(node)


def assert_cases(source: str, function: str) -> tuple[list[dict], int]:
    """Inputs, their types and the output of each ``assert f(x) == y``, ``assert f(x)``, ``assert not f(x)``;
    and how many asserts were something else."""
    out, rejected = [], 0
    for n in ast.walk(ast.parse(source)):
        if not isinstance(n, ast.Assert):
            continue
        call, want = n.test, True
        if isinstance(call, ast.Compare) and len(call.ops) == 1 and isinstance(call.ops[0], (ast.Eq, ast.Is)):
            call, want = call.left, call.comparators[0]
        elif isinstance(call, ast.UnaryOp) and isinstance(call.op, ast.Not):
            call, want = call.operand, False
        try:
            if not (isinstance(call, ast.Call) and isinstance(call.func, ast.Name) and call.func.id == function):
                raise ValueError
            args = [value_of(a) for a in call.args]
            result = want if isinstance(want, bool) else value_of(want)
            out.append({"args": repr(tuple(args)), "types": [type(a).__name__ for a in args], "output": repr(result), "output_type": type(result).__name__})
        except (ValueError, TypeError, KeyError, SyntaxError, ZeroDivisionError):
            rejected += 1
    return out, rejected


def static_gate(source: str, function: str, arity: int) -> str | None:
    """The first reason why a program cannot be right; null if there is none."""
    if "def " not in source:
        return "no function"
    try:
        tree = ast.parse(source)
    except SyntaxError:
        return "syntax error"
    own = [n for n in tree.body if isinstance(n, ast.FunctionDef)]
    if not own:
        return "not a function"
    named = [f for f in own if f.name == function]
    if not named:
        return "wrong name"
    a = named[0].args
    if len(a.args) + len(a.posonlyargs) != arity:
        return "wrong arity"
    return "undefined name" if undefined(source) else None


def undefined(source: str) -> list[str]:
    """Names that a program reads and binds nowhere, in order of place: what a linter calls an error."""
    tree, bound, read = ast.parse(source), set(dir(builtins)) | {"__name__", "__file__"}, []
    for n in ast.walk(tree):
        match n:
            case ast.Name(ctx=ast.Load()):
                read.append((n.lineno, n.col_offset, n.id))
            case ast.Name() | ast.arg() | ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
                bound.add(getattr(n, "id", None) or getattr(n, "arg", None) or getattr(n, "name", None))
            case ast.alias():
                bound.add((n.asname or n.name).split(".")[0])
                if n.name == "*":
                    return []  # anything may be bound
            case ast.ExceptHandler(name=str()) | ast.MatchAs(name=str()) | ast.MatchStar(name=str()):
                bound.add(n.name)
            case ast.Global() | ast.Nonlocal():
                bound.update(n.names)
    return list(dict.fromkeys(name for _, _, name in sorted(read) if name not in bound))


def generate(kind: str, seed: int, i: int):
    """Input ``i`` of a kind, which seed, kind and number decide: int, bool, str, list, matrix, or several joined by
    commas as a tuple.  The first inputs are the edges: zero, empty, one."""
    if "," in kind:
        return tuple(generate(k.strip(), seed + j, i) for j, k in enumerate(kind.split(",")))
    rng = random.Random(f"{seed}:{kind}:{i}")
    size = i if i < 2 else rng.randrange(2, 9)
    match kind:
        case "int":
            return (0, 1, -1)[i] if i < 3 else rng.randrange(-100, 101)
        case "bool":
            return rng.random() < 0.5
        case "str":
            return "".join(rng.choice("abcdeABE 019") for _ in range(size))
        case "list":
            return [rng.randrange(-50, 51) for _ in range(size)]
        case "matrix":
            return [[rng.randrange(-9, 10) for _ in range(size)] for _ in range(max(1, size - 1))]
    raise ValueError(f"no kind {kind}")


def complexity(source: str) -> dict[str, float]:
    """Halstead's counts and measures, cyclomatic complexity, and lines."""
    tree = ast.parse(source)
    operators, operands = Counter(), Counter()
    branches = 0
    for n in ast.walk(tree):
        if isinstance(n, (ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.AugAssign)):
            k = len(n.values) - 1 if isinstance(n, ast.BoolOp) else 1
            operators[type(n.op).__name__] += k
            branches += k if isinstance(n, ast.BoolOp) else 0
            for x in [n.left, n.right] if isinstance(n, ast.BinOp) else [n.operand] if isinstance(n, ast.UnaryOp) else n.values if isinstance(n, ast.BoolOp) else [n.target, n.value]:
                operands[ast.unparse(x)] += 1
        elif isinstance(n, ast.Compare):
            for o, x in zip(n.ops, n.comparators):
                operators[type(o).__name__] += 1
                operands[ast.unparse(x)] += 1
            operands[ast.unparse(n.left)] += 1
        if isinstance(n, (ast.If, ast.For, ast.While, ast.IfExp, ast.ExceptHandler, ast.comprehension, ast.Assert)):
            branches += 1 + (len(n.ifs) if isinstance(n, ast.comprehension) else 0)
    h1, h2, n1, n2 = len(operators), len(operands), sum(operators.values()), sum(operands.values())
    vocabulary, length = h1 + h2, n1 + n2
    volume = length * math.log2(vocabulary) if vocabulary else 0.0
    difficulty = h1 / 2 * n2 / h2 if h2 else 0.0
    lines = source.splitlines()
    code = [x for x in lines if x.strip() and not x.strip().startswith("#")]
    functions = sum(isinstance(n, ast.FunctionDef) for n in ast.walk(tree))
    cyclomatic = branches + max(functions, 1)
    mi = max(0.0, (171 - 5.2 * math.log(volume or 1) - 0.23 * cyclomatic - 16.2 * math.log(len(code) or 1)) * 100 / 171)
    return {
        "h1": h1, "h2": h2, "n1": n1, "n2": n2, "vocabulary": vocabulary, "length": length,
        "calculated_length": sum(h * math.log2(h) for h in (h1, h2) if h), "volume": volume, "difficulty": difficulty,
        "effort": difficulty * volume, "time": difficulty * volume / 18, "bugs": volume / 3000,
        "cyclomatic": cyclomatic, "maintainability": mi, "lines": len(lines), "code_lines": len(code), "blank": sum(not x.strip() for x in lines),
    }


def tree_dump(source: str) -> list[dict]:
    out: list[dict] = []

    def walk(n, depth):
        out.append({"depth": depth, "node": type(n).__name__})
        for c in ast.iter_child_nodes(n):
            walk(c, depth + 1)

    walk(ast.parse(source), 0)
    return out


def same_answer(a, b, as_multiset: bool = True) -> bool:
    """Lists compare by what they hold, matrices cell by cell, everything else by equality."""
    if hasattr(a, "tolist"):
        a = a.tolist()
    if hasattr(b, "tolist"):
        b = b.tolist()
    if as_multiset and isinstance(a, list) and isinstance(b, list):
        key = lambda x: (type(x).__name__, repr(x))
        return sorted(a, key=key) == sorted(b, key=key)
    return type(a) is type(b) and a == b
