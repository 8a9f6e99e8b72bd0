"""Prompts, answers and programs as texts: Column functions, and Arrow functions where a parser is needed."""

from __future__ import annotations

import ast
import doctest

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of chat formats that a code answer is freed of, in this order.
CHAT_MARKS = (
    "<|im_start|>", "<|im_end|>", "<|begin_of_text|>", "<|start_header_id|>",
    "<|end_header_id|>", "<|eot_id|>", "<|end_of_text|>", "system", "user", "assistant",
    "<start_of_turn>", "<end_of_turn>", "</end_of_turn>",
)
#: Phrases around the code of an answer.
PHRASES = (
    "Here's the complete function code:",
    "Here is the complete function:",
    "The complete function is:",
    "Here's the function:",
    "Complete function:",
    "# Test the function",
    "# Testing the function:",
    ">>> task_func(",
    "Your code looks correct",
    "Your answer is correct",
    "Good job!",
    "Well done!",
    "This code",
    "The code above",
    "It calculates",
    "It uses the given requirements",
)
#: Where an answer's code ends.
CODE_ENDS = ("# Test", ">>>")
#: How a line of code starts, and what a line of feedback after it says.
CODE_STARTS = ("def ", "import ", "from ")
FEEDBACK = ("your code", "correct", "good job", "well done", "this code", "the code")
FENCE = "```"


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def unlines(parts: Column) -> Column:
    return F.array_join(parts, "\n")


def squeezed(program: Column) -> Column:
    """Without empty lines and spaces."""
    return unlines(F.filter(lines(F.replace(program, F.lit(" "), F.lit(""))), lambda x: x != ""))


def code_answer(answer: Column) -> Column:
    """The code in a model's answer: marks and phrases out, cut where tests or feedback begin, and of a
    fenced block its inside."""
    x = answer
    for m in (*CHAT_MARKS, *PHRASES):
        x = F.replace(x, F.lit(m), F.lit(""))
    for e in CODE_ENDS:
        x = F.substring_index(x, e, 1)

    def first(own: Column, test) -> Column:
        return F.array_min(F.filter(F.transform(own, lambda y, i: F.when(test(y, i), i)), lambda i: i.isNotNull()))

    starts, feedback = "^\\s*(" + "|".join(CODE_STARTS) + ")", "|".join(FEEDBACK)
    own = lines(x)
    begin = first(own, lambda y, i: y.rlike(starts))
    end = first(own, lambda y, i: (i >= begin) & F.lower(y).rlike(feedback))
    x = F.when(end.isNull(), x).otherwise(unlines(F.slice(own, F.lit(1), F.coalesce(end, F.lit(0)))))
    inside = F.regexp_extract(x, r"(?s)```(?:python)?\n(.*?)```", 1)
    return F.btrim(F.when(x.rlike(r"(?s)```(?:python)?\n(.*?)```"), inside).otherwise(x), F.lit(" \n\t\r"))


def literal_answer(answer: Column, unwrap: bool = True) -> Column:
    """The answer as a tagged value; a tuple gives its first element if ``unwrap``; other text without quotes."""

    def one(t):
        if t is None:
            return {"data": None, "metadata": None}
        try:
            v = ast.literal_eval(t.strip())
            if unwrap and isinstance(v, tuple) and v:
                v = v[0]
            return {"data": str(v), "metadata": type(v).__name__}
        except (ValueError, SyntaxError, TypeError, RecursionError, MemoryError):
            return {"data": t.strip().strip('"').strip("'"), "metadata": "str"}

    @F.pandas_udf("data string, metadata string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in s], columns=["data", "metadata"])

    return run(answer)


def json_answer(answer: Column) -> Column:
    """answer and reasoning of a JSON answer, fences aside; nulls if it is none."""
    return F.from_json(F.regexp_replace(answer, "```(?:json)?", ""), "answer string, reasoning string")


def fence_parts(text: Column) -> Column:
    """The two parts around a fence, or null."""
    p = F.filter(F.split(text, FENCE), lambda x: F.trim(x) != "")
    return F.when(F.size(p) == 2, p)


def example_parts(text: Column) -> Column:
    """What stands before the last heading of examples, and what follows it."""
    p = F.split(text, "Examples?:")
    head = F.array_join(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), "")
    return F.struct(head.alias("before"), F.when(F.size(p) > 1, F.try_element_at(p, F.lit(-1))).alias("examples"))


def doctests(text: Column) -> Column:
    """A map of doctest lines to what they should print."""

    def one(t):
        try:
            return {e.source.strip(): e.want.strip() for e in doctest.DocTestParser().get_examples(t or "")}
        except ValueError:
            return {}

    @F.pandas_udf("map<string,string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(text)


def split_docstring(prompt: Column) -> Column:
    """The program without its functions' docstrings, and the first docstring."""

    def one(t):
        try:
            tree = ast.parse(t)
        except (SyntaxError, TypeError, ValueError):
            return t, None
        first = None
        for n in ast.walk(tree):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and (doc := ast.get_docstring(n)) is not None:
                first = doc if first is None else first
                n.body = n.body[1:] or [ast.Pass()]
        return ast.unparse(tree), first

    @F.pandas_udf("code string, docstring string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in s], columns=["code", "docstring"])

    return run(prompt)


def without_metadata(check: Column) -> Column:
    """A check program without the assignment to METADATA."""

    def one(t):
        try:
            tree = ast.parse(t)
        except (SyntaxError, TypeError, ValueError):
            return t
        drop = [n for n in tree.body if isinstance(n, ast.Assign) and any(isinstance(x, ast.Name) and x.id == "METADATA" for x in n.targets)]
        gone = {i for n in drop for i in range(n.lineno, n.end_lineno + 1)}
        return "\n".join(x for i, x in enumerate(t.split("\n"), 1) if i not in gone)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(check)


def functions_only(program: Column) -> Column:
    """Functions and from-imports; everything else at the top level goes."""

    def one(t):
        try:
            return "\n".join(ast.unparse(n) for n in ast.parse(t).body if isinstance(n, (ast.FunctionDef, ast.ImportFrom)))
        except (SyntaxError, TypeError, ValueError):
            return t

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(program)


def renamed_words(text: Column, names: dict[str, str]) -> Column:
    """Whole words renamed one after the other."""
    for old, new in names.items():
        text = F.regexp_replace(text, rf"\b\Q{old}\E\b", new.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def filled(template: Column, params: Column) -> Column:
    """$0, $1, ... replaced in ascending order, so $1 also takes the start of $10."""
    pairs = F.transform(params, lambda p, i: F.struct(F.concat(F.lit("$"), i.cast("string")).alias("k"), p.alias("v")))
    return F.aggregate(pairs, template, lambda t, x: F.replace(t, x["k"], x["v"]))


def named(template: Column, name: Column) -> Column:
    return F.regexp_replace(template, F.lit(r"\$\d+"), name)


def without_import(program: Column, mark: str) -> Column:
    """Without the first line that names the module."""
    own = lines(program)
    at = F.array_min(F.filter(F.transform(own, lambda x, i: F.when(x.contains(mark), i)), lambda i: i.isNotNull()))
    return unlines(F.filter(own, lambda x, i: at.isNull() | (i != at)))


def quoted_name(prompt: Column) -> Column:
    return F.nullif(F.regexp_extract(prompt, "'([^']+)'", 1), F.lit(""))


def given(prompt: Column) -> Column:
    """The task told as a given program, with single spaces."""
    return F.regexp_replace(F.trim(F.replace(prompt, F.lit("Write"), F.lit("You are given"))), r"\s+", " ")


def choices_text(choices: Column) -> Column:
    """Choices of a map, in the order of letters, as a question's text."""
    entries = F.array_sort(F.map_entries(choices))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": \n"), e["value"], F.lit("\n\n"))), "")


def even_indent(program: Column) -> Column:
    """Indents doubled if the first indented line has two spaces."""
    own = lines(program)
    first = F.get(F.filter(own, lambda x: x.startswith("  ")), F.lit(0))
    doubled = F.transform(own, lambda x: F.concat(F.repeat(F.lit(" "), F.length(x) - F.length(F.ltrim(x))), x))
    return F.when(F.coalesce(first.rlike("^  [^ ]"), F.lit(False)), unlines(doubled)).otherwise(program)


def split_at_def(program: Column) -> Column:
    """Lines before the first def, and from it on."""
    own = lines(program)
    at = F.coalesce(F.array_min(F.filter(F.transform(own, lambda x, i: F.when(x.rlike(r"^\s*def "), i)), lambda i: i.isNotNull())), F.lit(0))
    return F.struct(unlines(F.slice(own, F.lit(1), at)).alias("header"), unlines(F.slice(own, at + 1, F.size(own))).alias("rest"))


def shifted_answer(answer: Column, removed: Column) -> Column:
    """The answer's letter after letters before it have gone; each compares with the moved letter."""
    return F.chr(F.aggregate(F.array_sort(removed), F.ascii(answer), lambda a, r: F.when(F.ascii(r) < a, a - 1).otherwise(a)).cast("bigint"))


def few_shot(examples: Column, shots: int | None = None) -> Column:
    """Examples of a map as doctest lines, in the order of keys."""
    e = F.array_sort(F.map_entries(examples))
    e = e if shots is None else F.slice(e, 1, shots)
    return F.array_join(F.transform(e, lambda x: F.concat(F.lit(">>> "), x["key"], F.lit("\n"), x["value"])), "\n")


def rendered(template: Column, **values: Column) -> Column:
    """{name} replaced by values, one after the other."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{" + k + "}"), v)
    return template


#: Prompts by task and shot; {program}, {input}, {output} and {examples} are filled.
PROMPTS = {
    ("output_prediction", "zero_shot"): "What does this program return for {input}?\n{program}",
    ("output_prediction", "few_shot"): "Examples:\n{examples}\nWhat does this program return for {input}?\n{program}",
    ("input_prediction", "zero_shot"): "For which input does this program return {output}?\n{program}",
    ("input_prediction", "few_shot"): "Examples:\n{examples}\nFor which input does this program return {output}?\n{program}",
    ("code_generation", "zero_shot"): "Complete the program.\n{program}",
    ("code_generation", "few_shot"): "Examples:\n{examples}\nComplete the program.\n{program}",
    ("mcq_inconsistency", "zero_shot"): "Which choice completes the program?\n{program}\n{examples}",
}


def prompt_for(task: Column, shot: Column) -> Column:
    out = F.when(F.lit(False), "")
    for (t, s), text in PROMPTS.items():
        out = out.when((task == t) & (shot == s), text)
    return out


def only_function(answer: Column) -> Column:
    """From the first def to the last indented return before the next def."""
    body = F.regexp_extract(F.replace(answer, F.lit("python"), F.lit("")), r"(?s)(def .*)", 1)
    one = F.concat(F.lit("def "), F.get(F.split(body, r"\ndef |^def "), F.lit(1)))
    own = lines(one)
    last = F.array_max(F.filter(F.transform(own, lambda x, i: F.when(x.rlike(r"^\s+return\b"), i)), lambda i: i.isNotNull()))
    return F.when(body == "", "").otherwise(unlines(F.slice(own, F.lit(1), F.coalesce(last + 1, F.size(own)))))


def defined(program: Column) -> Column:
    return F.regexp_extract_all(program, F.lit(r"def\s+(\w+)\("), F.lit(1))


def model_name(name: Column) -> Column:
    return F.translate(name, "-.:", "___")


def boolean_token(text: Column) -> Column:
    return F.when(text == "TRUE", True).when(text == "FALSE", False)


def hashed_name(name: Column, seed: int = 1234) -> Column:
    """Letters that the seed and the name decide, five to fourteen; the same on every machine and retry."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), name).cast("binary"), 256)
    n = F.lit(5) + F.conv(F.substring(h, 1, 4), 16, 10).cast("int") % 10
    return F.substring(F.translate(h, "0123456789", "ghijklmnop"), F.lit(5), n)


def rank_of_longest(length: Column) -> Column:
    return F.greatest(F.lit(2.0), F.pow(F.lit(2.0), F.ceil(F.log2(length))))
