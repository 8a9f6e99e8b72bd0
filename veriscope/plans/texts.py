"""Text functions over names, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriscope.functions import text as T
from veriscope.plans.base import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def talk(s, d):
    return table(s, d, "conversations")


@query("t01_squeezed", "SELECT conv_id, turn, array_to_string(list_filter(string_split(replace(text, ' ', ''), chr(10)), lambda x: x <> ''), chr(10)) AS r FROM conversations")
def t1(s, d):
    return talk(s, d).select("conv_id", "turn", T.squeezed(F.col("text")).alias("r"))


_FENCED = "concat('Sure. ', chr(10), '```python', chr(10), 'x = ', conv_id, chr(10), '```', chr(10), 'Done')"


@query("t02_code_answer", "SELECT conv_id, turn, concat('x = ', conv_id) AS r FROM conversations")
def t2(s, d):
    text = F.concat(F.lit("Sure. \n```python\nx = "), F.col("conv_id").cast("string"), F.lit("\n```\nDone"))
    return talk(s, d).select("conv_id", "turn", T.code_answer(text).alias("r"))


@query("t03_literal_answer", "SELECT p_partkey AS id, p_partkey::VARCHAR AS data, 'int' AS metadata FROM part")
def t3(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), T.literal_answer(F.concat(F.lit("("), F.col("p_partkey").cast("string"), F.lit(", 'x')"))).alias("v")).select("id", "v.data", "v.metadata")


@query("t05_json_answer", "SELECT event_id, (props::JSON ->> 'k') AS answer FROM events")
def t5(s, d):
    text = F.concat(F.lit("```json\n"), F.replace("props", F.lit('"k"'), F.lit('"answer"')), F.lit("\n```"))
    return table(s, d, "events").select("event_id", T.json_answer(text)["answer"].alias("answer"))


@query("t06_fence_parts", f"SELECT conv_id, turn, {_FENCED} IS NULL AS two FROM conversations")
def t6(s, d):
    text = F.concat(F.lit("Sure. \n```python\nx = "), F.col("conv_id").cast("string"), F.lit("\n```\nDone"))
    return talk(s, d).select("conv_id", "turn", T.fence_parts(text).isNotNull().alias("two"))


@query("t07_example_parts", "SELECT conv_id, turn, text AS before, role AS examples FROM conversations WHERE NOT regexp_matches(text, 'Examples?:')")
def t7(s, d):
    own = talk(s, d).filter(~F.col("text").rlike("Examples?:"))
    return own.withColumn("p", T.example_parts(F.concat("text", F.lit("Example:"), "role"))).select("conv_id", "turn", "p.before", "p.examples")


def _renamed(text: str, old: str, new: str) -> str:
    # a word with what stands beside it; twice, since one space may be beside two words
    own = f"'(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){old}($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])', '\\1{new}\\2', 'g'"
    return f"regexp_replace(regexp_replace({text}, {own}), {own})"


@query("t12_renamed_words", f"SELECT doc_id, {_renamed(_renamed('text', 'the', 'var1'), 'of', 'var2')} AS r FROM documents")
def t12(s, d):
    own = table(s, d, "documents")
    return own.select("doc_id", T.renamed_words(F.col("text"), {"the": "var1", "of": "var2"}).alias("r"))


@query("t13_filled", "SELECT p_partkey AS id, concat(p_name, ' ', p_size, ' ', p_name, '0') AS r FROM part")
def t13(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), T.filled(F.lit("$0 $1 $00"), F.array("p_name", F.col("p_size").cast("string"))).alias("r"))


@query("t14_named", "SELECT p_partkey AS id, concat('call ', p_brand, ' with ', p_brand) AS r FROM part")
def t14(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), T.named(F.lit("call $1 with $23"), F.col("p_brand")).alias("r"))


@query("t15_without_import", "SELECT p_partkey AS id, concat('import os', chr(10), 'x = 1') AS r FROM part")
def t15(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), T.without_import(F.concat(F.lit("import os\nfrom Q"), F.col("p_size").cast("string"), F.lit(" import f\nx = 1")), "from Q").alias("r"))


@query("t16_quoted_name", "SELECT p_partkey AS id, p_name AS r FROM part")
def t16(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), T.quoted_name(F.concat(F.lit("Write a function '"), "p_name", F.lit("' that 'x'"))).alias("r"))


@query("t17_given", "SELECT p_partkey AS id, concat('You are given a function ', p_name) AS r FROM part")
def t17(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), T.given(F.concat(F.lit(" Write a  function\n"), "p_name", F.lit(" "))).alias("r"))


@query("t18_choices_text", "SELECT p_partkey AS id, concat('A: ', chr(10), p_name, chr(10), chr(10), 'B: ', chr(10), p_type, chr(10), chr(10)) AS r FROM part")
def t18(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), T.choices_text(F.create_map(F.lit("B"), "p_type", F.lit("A"), "p_name")).alias("r"))


@query("t19_even_indent", "SELECT p_partkey AS id, concat('def f():', chr(10), '    x = 1', chr(10), '        y') AS r FROM part")
def t19(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), T.even_indent(F.lit("def f():\n  x = 1\n    y")).alias("r"))


@query("t20_split_at_def", "SELECT p_partkey AS id, concat('import ', p_name) AS header, concat('def f():', chr(10), '  pass') AS rest FROM part")
def t20(s, d):
    return table(s, d, "part").withColumn("p", T.split_at_def(F.concat(F.lit("import "), "p_name", F.lit("\ndef f():\n  pass")))).select(F.col("p_partkey").alias("id"), "p.header", "p.rest")


@query("t21_shifted_answer", "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE 'C' END AS r FROM part")
def t21(s, d):
    answer = F.chr((F.col("p_size") % 4 + 65).cast("bigint"))
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), T.shifted_answer(answer, F.when(F.col("p_size") % 4 == 0, F.array(F.lit("B"))).otherwise(F.array(F.lit("A")))).alias("r"))


@query("t22_few_shot", "SELECT p_partkey AS id, concat('>>> f(1)', chr(10), p_size, chr(10), '>>> f(2)', chr(10), p_name) AS r FROM part")
def t22(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), T.few_shot(F.create_map(F.lit("f(2)"), "p_name", F.lit("f(1)"), F.col("p_size").cast("string"))).alias("r"))


@query("t23_rendered", "SELECT p_partkey AS id, concat('What does this program return for ', p_size, '?', chr(10), p_name) AS r FROM part")
def t23(s, d):
    prompt = T.prompt_for(F.lit("output_prediction"), F.lit("zero_shot"))
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), T.rendered(prompt, input=F.col("p_size").cast("string"), program=F.col("p_name")).alias("r"))


@query("t25_only_function", "SELECT p_partkey AS id, concat('def f(x):', chr(10), '  return ', p_size) AS r FROM part")
def t25(s, d):
    text = F.concat(F.lit("Here is python code\ndef f(x):\n  return "), F.col("p_size").cast("string"), F.lit("\nprint(f(1))\ndef g():\n  return 2"))
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), T.only_function(text).alias("r"))


@query("t26_defined", "SELECT p_partkey AS id, concat('f', p_size, ',g') AS r FROM part")
def t26(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(T.defined(F.concat(F.lit("def f"), F.col("p_size").cast("string"), F.lit("(x):\n  pass\ndef  g():"))), ",").alias("r"))


@query("t27_model_name", "SELECT p_partkey AS id, concat(p_name, '_4_b_', p_size) AS r FROM part")
def t27(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), T.model_name(F.concat("p_name", F.lit("-4.b:"), F.col("p_size").cast("string"))).alias("r"))


@query("t29_boolean_token", "SELECT l_returnflag AS f, CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN false END AS b, count(*) AS n FROM lineitem GROUP BY 1")
def t29(s, d):
    token = F.when(F.col("f") == "A", "TRUE").when(F.col("f") == "N", "FALSE").otherwise("x")
    return table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("f")).agg(F.count("*").alias("n")).select("f", T.boolean_token(token).alias("b"), "n")


@query("t30_hashed_name", "SELECT p_partkey AS id, substr(translate(sha256('1234:' || p_name), '0123456789', 'ghijklmnop'), 5, 5 + ('0x' || substr(sha256('1234:' || p_name), 1, 4))::INT % 10) AS r FROM part")
def t30(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), T.hashed_name(F.col("p_name")).alias("r"))
