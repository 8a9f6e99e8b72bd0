"""Queries over outcome logs: predicates, alignment, verdicts, metrics, windows and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veriscope.functions import outcome as O
from veriscope.operators import align as A
from veriscope.operators import metrics as M
from veriscope.plans.base import ALIGNED, COUNTS, LOG, ORDER, correct, first, invalid, log, table, wrong

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def aligned(s, d):
    own = log(s, d)
    keep = ["task", "failure", "output", "conf", *ORDER]
    return A.align(own.filter("variant = 'O'").select(*keep), own.filter("variant = 'F'").select(*keep), ["task"], ORDER)


# predicates and projections


@query("p1_common_keys", "SELECT l_partkey AS task, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 7) GROUP BY 1")
def p1(s, d):
    own = table(s, d, "lineitem")
    return own.join(own.filter("l_linenumber = 7").select("l_partkey"), "l_partkey", "left_semi").groupBy(F.col("l_partkey").alias("task")).agg(F.count("*").alias("n"))


@query("p2_template_rows", "SELECT regexp_extract(c_name, '^[A-Za-z]+#0*([0-9]+?)[0-9]$', 1) AS template, count(*) AS n FROM customer WHERE regexp_matches(c_name, '^Customer#') GROUP BY 1")
def p2(s, d):
    return table(s, d, "customer").filter(F.col("c_name").rlike("^Customer#")).groupBy(F.regexp_extract("c_name", "^[A-Za-z]+#0*([0-9]+?)[0-9]$", 1).alias("template")).agg(F.count("*").alias("n"))


@query("p3_both_assertions", ALIGNED + "SELECT count(*) AS pairs, count(*) FILTER (NOT (coalesce(contains(f1, 'AssertionError'), false) AND coalesce(contains(f2, 'AssertionError'), false))) AS kept FROM al")
def p3(s, d):
    return aligned(s, d).agg(F.count("*").alias("pairs"), M.count(~O.both_assertion(F.col("failure_1"), F.col("failure_2"))).alias("kept"))


@query("p4_prefix_filters", "SELECT p_brand, count(*) AS n FROM part WHERE regexp_matches(p_type, 'BRASS|STEEL') OR p_name LIKE 'a%' OR p_name LIKE 'b%' GROUP BY 1")
def p4(s, d):
    return table(s, d, "part").filter(F.col("p_type").rlike("BRASS|STEEL") | F.col("p_name").startswith("a") | F.col("p_name").startswith("b")).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("p5_not_null", f"WITH {LOG} SELECT model, count(failure) AS failed, count(*) FILTER (coalesce(failure, '') = '') AS blank FROM log GROUP BY 1")
def p5(s, d):
    return log(s, d).groupBy("model").agg(F.count("failure").alias("failed"), M.count(F.coalesce("failure", F.lit("")) == "").alias("blank"))


@query("p9_prefix", "SELECT split_part(p_type, ' ', 1) AS prefix, count(*) AS n FROM part GROUP BY 1")
def p9(s, d):
    return table(s, d, "part").groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("prefix")).agg(F.count("*").alias("n"))


@query("p10_fixed_order", "SELECT o.ord, o.label, n FROM (VALUES (1, 'purchase'), (2, 'refund'), (3, 'view')) o(ord, label) LEFT JOIN (SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1) USING (label)")
def p10(s, d):
    order = s.createDataFrame([(1, "purchase"), (2, "refund"), (3, "view")], "ord int, label string")
    found = table(s, d, "events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("n"))
    return order.join(found, "label", "left").select("ord", "label", "n")


THRESHOLDS = [0.0, 0.02, 0.04, 0.06, 0.08, 0.09, 0.1]
_SCORED = "(failure IS NULL OR (contains(failure, 'AssertionError') AND NOT contains(failure, 'Mutation')))"


@query("p11_threshold_column", f"WITH {LOG}, t AS (SELECT unnest([0.0, 0.02, 0.04, 0.06, 0.08, 0.09, 0.1]::DOUBLE[]) AS threshold) SELECT threshold, CASE WHEN {_SCORED} AND NOT (conf >= threshold) THEN 'Confidence_lower_than_threshold' ELSE failure END AS f, count(*) AS n FROM log, t GROUP BY 1, 2")
def p11(s, d):
    rows = log(s, d).withColumn("threshold", F.explode(F.array(*map(F.lit, THRESHOLDS))))
    return rows.groupBy("threshold", O.at_threshold(F.col("failure"), F.col("conf"), F.col("threshold")).alias("f")).agg(F.count("*").alias("n"))


@query("p12_classify", f"WITH {LOG} SELECT failure, {correct('failure')} AS correct, {wrong('failure')} AS wrong, {invalid('failure')} AS invalid, count(*) AS n FROM log GROUP BY 1")
def p12(s, d):
    f = F.col("failure")
    return log(s, d).groupBy("failure").agg(F.count("*").alias("n")).select("failure", O.correct(f).alias("correct"), O.wrong(f).alias("wrong"), O.invalid(f).alias("invalid"), "n")


@query("p13_answered", f"WITH {LOG} SELECT model, count(*) FILTER ({correct('failure')} OR {wrong('failure')}) AS answered FROM log GROUP BY 1")
def p13(s, d):
    return log(s, d).groupBy("model").agg(M.count(O.answered(F.col("failure"))).alias("answered"))


@query("p14_skip_list", "SELECT count(*) AS n FROM customer WHERE c_name <> 'BigCodeBencho471'")
def p14(s, d):
    return table(s, d, "customer").filter(O.usable(F.col("c_name"))).agg(F.count("*").alias("n"))


_NAMES = ["random", "sequential", "literal_format", "for2while", "for2enumerate", "demorgan", "boolean_literal", "commutative_reorder", "constant_unfold", "constant_unfold_add", "constant_unfold_mult"]
_LIST = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"
_GROUP = {n: g for g in O.CONFLICT_GROUPS for n in O.CONFLICT_GROUPS[g]}
_GROUPS = "[" + ", ".join(f"'{_GROUP[n]}'" for n in _NAMES) + "]"


@query("p16_mutation_conflicts", f"SELECT l_orderkey AS id, count(DISTINCT {_LIST}[(l_partkey % 11 + 1)::INT]) = count(DISTINCT {_GROUPS}[(l_partkey % 11 + 1)::INT]) AS legal FROM lineitem GROUP BY 1")
def p16(s, d):
    name = F.array(*map(F.lit, _NAMES))[(F.col("l_partkey") % 11).cast("int")]
    return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(O.legal(F.collect_set(name)).alias("legal"))


def _log_name():
    return F.concat(F.lit("m_zero_shot_"), F.array(*map(F.lit, [*_NAMES, "no_mutation", "for2while_demorgan"]))[(F.col("l_partkey") % 13).cast("int")])


_LOG_NAME = f"concat('m_zero_shot_', list_concat({_LIST}, ['no_mutation', 'for2while_demorgan'])[(l_partkey % 13 + 1)::INT])"


@query("p17_category", f"SELECT CASE WHEN regexp_matches(n, 'random|sequential|literal_format') THEN 'Lexical' WHEN regexp_matches(n, 'for2while|for2enumerate') THEN 'Syntactic' WHEN regexp_matches(n, 'demorgan|boolean_literal|commutative_reorder|constant_unfold') THEN 'Logical' END AS category, count(*) AS k FROM (SELECT {_LOG_NAME} AS n FROM lineitem) GROUP BY 1")
def p17(s, d):
    return table(s, d, "lineitem").groupBy(O.category(_log_name()).alias("category")).agg(F.count("*").alias("k"))


@query("p18_order_class", f"SELECT CASE WHEN n LIKE '%for2while_demorgan' THEN 'Second Order' ELSE 'Atomic' END AS order_class, count(*) AS k FROM (SELECT {_LOG_NAME} AS n FROM lineitem) GROUP BY 1")
def p18(s, d):
    return table(s, d, "lineitem").groupBy(O.order_class(_log_name()).alias("order_class")).agg(F.count("*").alias("k"))


@query("p19_display_name", f"SELECT DISTINCT n AS log, array_to_string(list_transform(string_split(split_part(n, 'shot_', 2), '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name FROM (SELECT {_LOG_NAME} AS n FROM lineitem)")
def p19(s, d):
    return table(s, d, "lineitem").select(_log_name().alias("log")).distinct().withColumn("name", O.display_name(F.col("log")))


@query("p20_range_spec", "SELECT o_orderkey AS id, unnest(range(o_orderkey % 5, o_orderkey % 5 + o_orderkey % 3 + 1)) AS value FROM orders")
def p20(s, d):
    spec = F.concat_ws("-", F.col("o_orderkey") % 5, F.col("o_orderkey") % 5 + F.col("o_orderkey") % 3)
    own = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.explode(F.split(spec, ",")).alias("x"))
    lo = F.split_part("x", F.lit("-"), F.lit(1)).cast("bigint")
    hi = F.coalesce(F.nullif(F.split_part("x", F.lit("-"), F.lit(2)), F.lit("")).cast("bigint"), lo)
    return own.select("id", F.explode(F.sequence(lo, hi)).alias("value"))


@query("p21_rank_bucket", "SELECT CASE WHEN p_size BETWEEN 1 AND 5 THEN 'A' WHEN p_size BETWEEN 6 AND 10 THEN 'B' WHEN p_size BETWEEN 11 AND 20 THEN 'C' WHEN p_size BETWEEN 21 AND 30 THEN 'D' WHEN p_size BETWEEN 31 AND 40 THEN 'E' ELSE 'F' END AS bucket, count(*) AS n FROM part GROUP BY 1")
def p21(s, d):
    return table(s, d, "part").groupBy(O.rank_bucket(F.col("p_size")).alias("bucket")).agg(F.count("*").alias("n"))


# joins


@query("j1_align", ALIGNED + "SELECT task, f1, f2, o1, o2 FROM al")
def j1(s, d):
    return aligned(s, d).select("task", F.col("failure_1").alias("f1"), F.col("failure_2").alias("f2"), F.col("output_1").alias("o1"), F.col("output_2").alias("o2"))


@query("j2_guarded_lookup", f"WITH {LOG}, one AS (SELECT task, min(output) AS o2 FROM log WHERE variant = 'F' AND mutation = 3 GROUP BY 1 HAVING count(*) = 1) SELECT a.task, a.output AS o1, o2 FROM {first('log', 'task', chr(118) + 'ariant = ' + chr(39) + 'O' + chr(39))} a JOIN one USING (task)")
def j2(s, d):
    own = log(s, d)
    right = own.filter("variant = 'F' and mutation = 3").select("task", "output")
    got = A.guarded(own.filter("variant = 'O'").select("task", "output", *ORDER), right, ["task"], ORDER)
    return got.select("task", F.col("output_1").alias("o1"), F.col("output_2").alias("o2"))


@query(
    "j3_cumulative_alignment",
    f"""WITH {LOG}, t AS (SELECT DISTINCT task FROM log WHERE variant = 'O'), k AS (SELECT DISTINCT task, mutation FROM log WHERE variant = 'F' AND task IN (SELECT task FROM t)),
    n AS (SELECT mutation, dense_rank() OVER (ORDER BY mutation) AS n FROM (SELECT DISTINCT mutation FROM log WHERE variant = 'F')),
    c AS (SELECT task, n, row_number() OVER (PARTITION BY task ORDER BY n) AS r, mutation FROM k JOIN n USING (mutation))
    SELECT mutation, count(*) AS tasks FROM c WHERE n = r GROUP BY 1""",
)
def j3(s, d):
    own = log(s, d)
    kept = A.cumulative(own.filter("variant = 'O'"), own.filter("variant = 'F'").select("task", "mutation").distinct(), ["task"], "mutation")
    return kept.groupBy("mutation").agg(F.count("*").alias("tasks"))


@query("j4_pairs_in_template", f"WITH {LOG}, x AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY l_orderkey, mutation, model, price, day) AS o FROM log) SELECT a.task, count(*) AS pairs, count(*) FILTER (a.output = b.output) AS same FROM x a JOIN x b ON a.task = b.task AND a.o < b.o GROUP BY 1")
def j4(s, d):
    own = log(s, d).select("task", "output", F.row_number().over(Window.partitionBy("task").orderBy(*ORDER)).alias("o"))
    return A.pairs(own, ["task"], "o").groupBy("task").agg(F.count("*").alias("pairs"), M.count(F.coalesce(F.col("output") == F.col("output_2"), F.lit(False))).alias("same"))


@query("j5_failed_with_correct", f"WITH {LOG} SELECT a.task, count(*) AS n FROM (SELECT * FROM log WHERE {wrong('failure')} AND output IS NOT NULL) a JOIN (SELECT * FROM log WHERE failure IS NULL AND output IS NOT NULL) b USING (task) GROUP BY 1")
def j5(s, d):
    own = log(s, d).filter("output is not null")
    bad = own.filter(O.wrong(F.col("failure"))).groupBy("task").agg(F.count("*").alias("a"))
    good = own.filter("failure is null").groupBy("task").agg(F.count("*").alias("b"))
    return bad.join(good, "task").select("task", (F.col("a") * F.col("b")).alias("n"))  # counts multiply, so no pair is made


@query("j6_side_by_side", "SELECT coalesce(a.m, b.m) AS m, x, y FROM (SELECT l_suppkey AS m, count(*) AS x FROM lineitem WHERE l_linestatus = 'O' AND l_tax > 0.07 GROUP BY 1) a FULL JOIN (SELECT l_suppkey AS m, count(*) AS y FROM lineitem WHERE l_linestatus = 'F' AND l_tax > 0.07 GROUP BY 1) b ON a.m = b.m")
def j6(s, d):
    own = table(s, d, "lineitem").filter("l_tax > 0.07")
    a, b = (own.filter(F.col("l_linestatus") == v).groupBy(F.col("l_suppkey").alias("m")).agg(F.count("*").alias(n)) for v, n in (("O", "x"), ("F", "y")))
    return a.join(b, "m", "full_outer")


@query("j7_merge_counts", "SELECT l_suppkey AS m, l_returnflag AS k, count(*) AS n FROM lineitem GROUP BY 1, 2")
def j7(s, d):
    own = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("m"), "l_linestatus", "l_returnflag").agg(F.count("*").alias("n"))
    maps = own.groupBy("m").agg(*[F.map_from_entries(F.collect_list(F.when(F.col("l_linestatus") == v, F.struct("l_returnflag", "n")))).alias(v) for v in "OF"])
    return maps.select("m", F.explode(A.merge_counts(F.col("O"), F.col("F"))).alias("k", "n"))


@query("j8_nested_merge", "SELECT o_orderpriority AS k1, l_returnflag AS metric, sum(l_quantity::BIGINT)::BIGINT AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def j8(s, d):
    return table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderpriority").alias("k1"), F.col("l_returnflag").alias("metric")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("total"))


@query(
    "j9_log_matrix",
    f"""WITH {LOG}, x AS (SELECT task, mutation, bool_or(failure IS NULL) AS ok FROM log GROUP BY 1, 2),
    y AS (SELECT a.mutation AS log, b.mutation AS other, a.ok <> b.ok AS differ FROM x a JOIN x b ON a.task = b.task AND a.mutation < b.mutation)
    SELECT log, {", ".join(f"count(*) FILTER (other = {k} AND differ) AS with_{k}" for k in range(2, 8))} FROM y GROUP BY 1""",
)
def j9(s, d):
    """Every two logs side by side: the tasks that one of them has a right answer to and the other has not."""
    x = log(s, d).groupBy("task", "mutation").agg(F.bool_or(F.col("failure").isNull()).alias("ok"))
    y = A.pairs(x, ["task"], "mutation")
    differ = [M.count((F.col("mutation_2") == k) & (F.col("ok") != F.col("ok_2"))).alias(f"with_{k}") for k in range(2, 8)]
    return y.groupBy(F.col("mutation").alias("log")).agg(*differ)


@query("j10_positional", "WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier), b AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) SELECT s_suppkey, n_name FROM a JOIN b USING (i)")
def j10(s, d):
    # the shorter table bounds the result; its rows are numbered, and so many first ones of the other
    b = table(s, d, "nation")
    n = b.count()
    first_n = table(s, d, "supplier").select("s_suppkey").orderBy("s_suppkey").limit(n)
    number = lambda df, by: df.withColumn("i", F.row_number().over(Window.orderBy(by)))
    return number(first_n, "s_suppkey").join(number(b.select("n_name", "n_nationkey"), "n_nationkey"), "i").select("s_suppkey", "n_name")


@query("j11_lookup_default", "SELECT d.doc_id, coalesce(l.quality = 1, false) AS passed FROM documents d LEFT JOIN labels l USING (doc_id)")
def j11(s, d):
    right = table(s, d, "labels").select("doc_id", (F.col("quality") == 1).alias("passed"))
    return A.lookup(table(s, d, "documents").select("doc_id"), right, ["doc_id"], {"passed": False})


@query("j12_decode", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j12(s, d):
    dims = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(s, d, "customer").join(dims, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("j13_expand_templates", "SELECT p_partkey AS template, l_suppkey AS parameter, concat(p_name, ' with ', l_suppkey, '0') AS text FROM part JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON p_partkey = l_partkey")
def j13(s, d):
    """Each template with each of its parameters: the suppliers that the log has with the part."""
    t = table(s, d, "part").select(F.col("p_partkey").alias("template"), F.concat("p_name", F.lit(" with $00")).alias("tpl"))
    p = table(s, d, "lineitem").select(F.col("l_partkey").alias("template"), F.col("l_suppkey").alias("parameter")).distinct()
    return t.join(p, "template").select("template", "parameter", F.replace("tpl", F.lit("$0"), F.col("parameter").cast("string")).alias("text"))


@query("j14_choices", "SELECT l_orderkey AS id, chr((64 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey))::INT) AS letter, l_partkey AS choice FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem)")
def j14(s, d):
    own = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.struct("l_partkey", "l_suppkey"))).alias("c"))
    return own.select(F.col("l_orderkey").alias("id"), F.posexplode("c").alias("i", "x")).select("id", F.chr(F.col("i") + 65).alias("letter"), F.col("x.l_partkey").alias("choice"))


# metrics


@query("g1_compare_logs", ALIGNED + f", p AS (SELECT v.*, o_orderpriority AS priority FROM v JOIN orders ON k1 = o_orderkey) SELECT priority, {COUNTS} FROM p GROUP BY 1")
def g1(s, d):
    """The flagship: two logs aligned, every pair judged, and counted by the priority of the original."""
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey_1"), F.col("o_orderpriority").alias("priority"))
    return M.comparison(aligned(s, d).join(orders, "l_orderkey_1"), ["priority"], "failure_1", "failure_2", "output_1", "output_2")


@query("g7_ratio", f"WITH {LOG}, x AS (SELECT model, count(*) FILTER (failure IS NULL) AS n, count(*) AS d FROM log GROUP BY 1) SELECT model, n, d, round_even(n * 100.0::DOUBLE / d, 2) AS pct FROM x")
def g7(s, d):
    x = log(s, d).groupBy("model").agg(M.count(O.correct(F.col("failure"))).alias("n"), F.count("*").alias("d"))
    return x.withColumn("pct", O.percent(F.col("n"), F.col("d")))


def _by_category(s, d):
    names = F.array(*map(F.lit, _NAMES[:7]))[F.col("mutation") - 1]
    return log(s, d).withColumn("category", O.category(names)).withColumn("bad", ~O.correct(F.col("failure")))


_CATEGORY = f"WITH {LOG}, c AS (SELECT *, CASE WHEN mutation <= 3 THEN 'Lexical' WHEN mutation <= 5 THEN 'Syntactic' ELSE 'Logical' END AS category, failure IS NOT NULL AS bad FROM log) "


@query("g8_category_rollup", _CATEGORY + "SELECT model, category, count(*) FILTER (bad) AS n, count(*) AS d FROM c GROUP BY 1, 2")
def g8(s, d):
    return _by_category(s, d).groupBy("model", "category").agg(M.count(F.col("bad")).alias("n"), F.count("*").alias("d"))


@query("g9_two_denominators", _CATEGORY + f"SELECT category, round(count(*) FILTER (bad) / count(*) FILTER ({correct('failure')} OR {wrong('failure')})::DOUBLE, 6) AS by_answered, round(count(*) FILTER (bad) / count(*)::DOUBLE, 6) AS by_questions FROM c GROUP BY 1")
def g9(s, d):
    n = M.count(F.col("bad")).cast("double")
    return _by_category(s, d).groupBy("category").agg(F.round(F.try_divide(n, M.count(O.answered(F.col("failure")))), 6).alias("by_answered"), F.round(n / F.count("*"), 6).alias("by_questions"))


@query("g10_baseline_seed", f"WITH {LOG} SELECT model, count(*) FILTER (variant = 'F' AND failure IS NULL) + count(*) FILTER (variant = 'O' AND failure IS NULL) AS success FROM log GROUP BY 1")
def g10(s, d):
    f = O.correct(F.col("failure"))
    return log(s, d).groupBy("model").agg((M.count(f & (F.col("variant") == "F")) + M.count(f & (F.col("variant") == "O"))).alias("success"))


@query("g13_subtotals", _CATEGORY + "SELECT category, variant, grouping(category) AS all_categories, grouping(variant) AS all_variants, count(*) FILTER (bad) AS n, count(*) AS d FROM c GROUP BY ROLLUP (category, variant)")
def g13(s, d):
    return _by_category(s, d).rollup("category", "variant").agg(F.grouping("category").cast("bigint").alias("all_categories"), F.grouping("variant").cast("bigint").alias("all_variants"), M.count(F.col("bad")).alias("n"), F.count("*").alias("d"))


@query("g15_model_cube", _CATEGORY + "SELECT model, category, count(*) FILTER (bad) AS n FROM c GROUP BY CUBE (model, category)")
def g15(s, d):
    return _by_category(s, d).cube("model", "category").agg(M.count(F.col("bad")).alias("n"))


@query("g17_type_share", ALIGNED + "SELECT CASE WHEN I1 OR I2 THEN 'Invalid Inconsistency' WHEN W1 AND W2 THEN 'Incorrectness Inconsistency' ELSE 'Correctness Inconsistency' END AS kind, count(*) AS n, round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS pct FROM v WHERE inc GROUP BY 1")
def g17(s, d):
    v = aligned(s, d).withColumn("v", O.verdict(F.col("failure_1"), F.col("failure_2"), O.differs(F.col("output_1"), F.col("output_2"))))
    n = v.filter("v.inconsistent").groupBy(F.col("v.kind").alias("kind")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", O.percent(F.col("n"), F.sum("n").over(Window.partitionBy())))  # three rows


@query("g18_direction_winner", ALIGNED + ", p AS (SELECT o_orderstatus AS status, count(*) FILTER (inc AND W1) AS og, count(*) FILTER (inc AND W2) AS mut FROM v JOIN orders ON k1 = o_orderkey GROUP BY 1) SELECT status, og, mut, CASE WHEN mut > og THEN 'Mut' ELSE 'OG' END AS winner FROM p")
def g18(s, d):
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey_1"), F.col("o_orderstatus").alias("status"))
    c = M.comparison(aligned(s, d).join(orders, "l_orderkey_1"), ["status"], "failure_1", "failure_2", "output_1", "output_2")
    return c.select("status", F.col("incorrect_original").alias("og"), F.col("incorrect_mutated").alias("mut"), F.when(F.col("incorrect_mutated") > F.col("incorrect_original"), "Mut").otherwise("OG").alias("winner"))


@query("g19_mean_distance", f"WITH {LOG}, x AS (SELECT model, mutation, sum(output)::DOUBLE AS t, count(*) AS n FROM log GROUP BY GROUPING SETS ((model, mutation), (model))) SELECT model, mutation, round(t / n, 6) AS mean FROM x")
def g19(s, d):
    own = log(s, d).select("model", "mutation", "output")
    x = own.groupingSets([("model", "mutation"), ("model",)], "model", "mutation").agg(F.sum("output").alias("t"), F.count("*").alias("n"))
    return x.select("model", "mutation", F.round(F.col("t") / F.col("n"), 6).alias("mean"))


@query("g20_inverse_weights", "WITH x AS (SELECT event_type AS k, 1.0::DOUBLE / count(*) AS w FROM events GROUP BY 1) SELECT k, round(w / sum(w) OVER (), 6) AS weight FROM x")
def g20(s, d):
    x = table(s, d, "events").groupBy(F.col("event_type").alias("k")).agg((F.lit(1.0) / F.count("*")).alias("w"))
    return x.select("k", F.round(F.col("w") / F.sum("w").over(Window.partitionBy()), 6).alias("weight"))


@query("g21_top_prefixes", "SELECT substr(text, 1, 40) AS prefix, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 ORDER BY n DESC, prefix LIMIT 10")
def g21(s, d):
    return table(s, d, "documents").filter("text is not null").groupBy(F.substring("text", 1, 40).alias("prefix")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prefix").limit(10)


@query("g22_fold_counts", f"WITH {LOG} SELECT model, count(*) FILTER ({correct('failure')}) AS correct, count(*) FILTER (coalesce(contains(failure, 'AssertionError'), false)) AS assertion, count(*) FILTER ({invalid('failure')}) AS invalid, count(*) FILTER ({correct('failure')}) + count(*) FILTER (coalesce(contains(failure, 'AssertionError'), false)) + count(*) FILTER ({invalid('failure')}) AS num_tasks FROM log GROUP BY 1")
def g22(s, d):
    f = F.col("failure")
    x = log(s, d).groupBy("model").agg(M.count(O.correct(f)).alias("correct"), M.count(O.has(f, "AssertionError")).alias("assertion"), M.count(O.invalid(f)).alias("invalid"))
    return x.withColumn("num_tasks", F.expr("correct + assertion + invalid"))


@query("g23_improvement", f"WITH {LOG}, x AS (SELECT model, count(*) FILTER (variant = 'O' AND failure IS NOT NULL) AS t, count(*) FILTER (variant = 'F' AND failure IS NOT NULL) AS m FROM log GROUP BY 1) SELECT model, t, m, round((m - t) * 100.0::DOUBLE / nullif(t, 0), 4) AS improvement FROM x")
def g23(s, d):
    bad = F.col("failure").isNotNull()
    x = log(s, d).groupBy("model").agg(M.count(bad & (F.col("variant") == "O")).alias("t"), M.count(bad & (F.col("variant") == "F")).alias("m"))
    return x.withColumn("improvement", F.round(F.try_divide((F.col("m") - F.col("t")) * F.lit(100.0), F.col("t")), 4))


@query("g24_operator_totals", f"WITH {LOG} SELECT mutation::VARCHAR AS mutation, count(*) FILTER (failure IS NOT NULL) AS inconsistencies, count(*) AS questions FROM log WHERE variant = 'F' GROUP BY 1 UNION ALL SELECT 'no_mutation', 0, 1")
def g24(s, d):
    x = log(s, d).filter("variant = 'F'").groupBy(F.col("mutation").cast("string").alias("mutation")).agg(M.count(F.col("failure").isNotNull()).alias("inconsistencies"), F.count("*").alias("questions"))
    return x.unionByName(s.createDataFrame([("no_mutation", 0, 1)], "mutation string, inconsistencies bigint, questions bigint"))


_LOW = "'Confidence_lower_than_threshold'"


@query(
    "g26_confidence_sweep",
    ALIGNED
    + f""", t AS (SELECT unnest([0.0, 0.02, 0.04, 0.06, 0.08, 0.09, 0.1]::DOUBLE[]) AS threshold),
    x AS (SELECT threshold, o1, o2, CASE WHEN {_SCORED.replace("failure", "f1")} AND NOT (c1 >= threshold) THEN {_LOW} ELSE f1 END AS a, CASE WHEN {_SCORED.replace("failure", "f2")} AND NOT (c2 >= threshold) THEN {_LOW} ELSE f2 END AS b FROM al, t),
    y AS (SELECT threshold, coalesce(o1 <> o2, true) AS df, {correct("a")} AS CA, {correct("b")} AS CB, {wrong("a")} AS WA, {wrong("b")} AS WB, {invalid("a")} OR coalesce(a = {_LOW}, false) AS GA, {invalid("b")} OR coalesce(b = {_LOW}, false) AS GB FROM x)
    SELECT threshold, count(*) FILTER ((CA OR WA OR GA) AND (CB OR WB OR GB)) AS compared, count(*) FILTER ((CA AND (WB OR GB)) OR ((WA OR GA) AND CB) OR (WA AND GB) OR (GA AND WB) OR (WA AND WB AND df)) AS inconsistent,
    count(*) FILTER (CB OR WB) AS answered, count(*) FILTER (CA AND CB) AS correct FROM y GROUP BY 1""",
)
def g26(s, d):
    return M.confidence_sweep(aligned(s, d), THRESHOLDS, "failure_1", "failure_2", "conf_1", "conf_2", "output_1", "output_2", [])


@query(
    "g28_neighbourhood_score",
    f"""WITH {LOG}, x AS (SELECT task, {correct("failure")} AS C, {wrong("failure")} AS W, {invalid("failure")} AS I, output, row_number() OVER (PARTITION BY task ORDER BY l_orderkey, mutation, model, price, day) AS o FROM log),
    p AS (SELECT a.task, (a.C OR a.W OR a.I) AND (b.C OR b.W OR b.I) AS compared, (a.C AND (b.W OR b.I)) OR (b.C AND (a.W OR a.I)) OR (a.W AND b.I) OR (a.I AND b.W) OR (a.W AND b.W AND coalesce(a.output <> b.output, true)) AS inc FROM x a JOIN x b ON a.task = b.task AND a.o < b.o)
    SELECT t.task, coalesce(compared, 0) AS compared, coalesce(inconsistent, 0) AS inconsistent FROM (SELECT DISTINCT task FROM log) t LEFT JOIN (SELECT task, count(*) FILTER (compared) AS compared, count(*) FILTER (inc) AS inconsistent FROM p GROUP BY 1) USING (task)""",
)
def g28(s, d):
    return M.neighbourhood(log(s, d), ["task"], "failure", "output").select("task", "compared", "inconsistent")


@query("g29_inconsistent_templates", f"WITH {LOG} SELECT task, bool_or({_SCORED}) AS valid, count(DISTINCT coalesce(trim(failure), 'nan')) > 1 AS inconsistent FROM log GROUP BY 1")
def g29(s, d):
    return M.inconsistent_templates(log(s, d), "task", "failure")


@query("g30_correctness_score", "WITH x AS (SELECT l_suppkey AS m, count(*) FILTER (l_returnflag = 'A') AS s, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT *, s::DOUBLE / n AS p FROM x) SELECT m, s, round(p, 6) AS p, round(sqrt(n * p * (1 - p)), 6) AS sd, round(sqrt(p * (1 - p) / n), 6) AS se FROM p")
def g30(s, d):
    rows = table(s, d, "lineitem")
    trials = rows.groupBy(F.col("l_suppkey").alias("m")).agg(F.count("*").alias("n"))
    own = rows.select(F.col("l_suppkey").alias("m"), (F.col("l_returnflag") == "A").alias("ok")).join(trials, "m")
    return M.correctness_score(own, ["m"], "ok", "n").select("m", "s", *[F.round(c, 6).alias(c) for c in ("p", "sd", "se")])


@query("g31_deviation", "SELECT l_suppkey AS m, round(stddev_pop(l_quantity), 6) AS sd FROM lineitem GROUP BY 1")
def g31(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("m")).agg(F.round(F.stddev_pop("l_quantity"), 6).alias("sd"))


@query("g32_geometric_mean", "SELECT l_orderkey AS id, round(exp(avg(-l_tax - 0.01)), 6) AS p FROM lineitem GROUP BY 1")
def g32(s, d):
    logs = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(-F.col("l_tax") - 0.01).alias("x"))
    return logs.select("id", F.round(M.geometric_mean(F.col("x")), 6).alias("p"))


@query("g33_outcome_fold", "SELECT l_orderkey AS id, l_linenumber AS test, CASE WHEN bool_or(l_returnflag = 'R') THEN 'failed' ELSE 'passed' END AS outcome FROM lineitem GROUP BY 1, 2")
def g33(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("test")).agg(F.when(F.bool_or(F.col("l_returnflag") == "R"), "failed").otherwise("passed").alias("outcome"))


@query("g35_row_totals", "WITH x AS (SELECT l_suppkey AS m, count(*) FILTER (l_returnflag = 'A') AS a_accuracy, count(*) FILTER (l_returnflag = 'N') AS b_inconsistency, count(*) FILTER (l_returnflag = 'R') AS mcq_inconsistency FROM lineitem GROUP BY 1) SELECT m, b_inconsistency AS inconsistency, a_accuracy + mcq_inconsistency AS accuracy FROM x")
def g35(s, d):
    flag = F.col("l_returnflag")
    x = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("m")).agg(M.count(flag == "A").alias("a_accuracy"), M.count(flag == "N").alias("b_inconsistency"), M.count(flag == "R").alias("mcq_inconsistency"))
    long = x.unpivot("m", ["a_accuracy", "b_inconsistency", "mcq_inconsistency"], "column", "value")
    inc = F.col("column").endswith("inconsistency") & ~F.col("column").startswith("mcq")
    return long.groupBy("m").agg(F.sum(F.when(inc, F.col("value")).otherwise(0)).alias("inconsistency"), F.sum(F.when(inc, 0).otherwise(F.col("value"))).alias("accuracy"))


@query("g36_merged_cells", "SELECT l_suppkey AS m, max(c) FILTER (v = 'O') AS original, max(c) FILTER (v = 'F') AS mutated FROM (SELECT l_suppkey, l_linestatus AS v, concat(count(*) FILTER (l_returnflag = 'N'), ' (', count(*) FILTER (l_returnflag = 'A'), ')') AS c FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def g36(s, d):
    flag = F.col("l_returnflag")
    x = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("m"), "l_linestatus").agg(F.format_string("%d (%d)", M.count(flag == "N"), M.count(flag == "A")).alias("c"))
    return x.groupBy("m").pivot("l_linestatus", ["O", "F"]).agg(F.first("c")).withColumnsRenamed({"O": "original", "F": "mutated"})


@query("g37_longest_answer", "SELECT lang, max(length(text)) AS longest, greatest(2, pow(2, ceil(log2(max(length(text))))))::BIGINT AS bound FROM documents GROUP BY 1")
def g37(s, d):
    x = table(s, d, "documents").groupBy("lang").agg(F.max(F.length("text")).cast("bigint").alias("longest"))
    return x.withColumn("bound", F.greatest(F.lit(2.0), F.pow(F.lit(2.0), F.ceil(F.log2("longest")))).cast("bigint"))


@query("g39_distinct", "SELECT DISTINCT l_partkey AS task FROM lineitem")
def g39(s, d):
    return table(s, d, "lineitem").select(F.col("l_partkey").alias("task")).distinct()


# verdicts


@query("c1_verdicts", ALIGNED + "SELECT task, compared, inc AS inconsistent FROM v")
def c1(s, d):
    v = O.verdict(F.col("failure_1"), F.col("failure_2"), O.differs(F.col("output_1"), F.col("output_2")))
    return aligned(s, d).withColumn("v", v).select("task", "v.compared", "v.inconsistent")


@query("c2_outputs_differ", ALIGNED + "SELECT task, df AS differs FROM fl")
def c2(s, d):
    return aligned(s, d).select("task", O.differs(F.col("output_1"), F.col("output_2")).alias("differs"))


@query(
    "c3_vector_distance",
    """WITH x AS (SELECT l_partkey AS task, l_linestatus AS v, l_linenumber AS t, bool_or(l_returnflag = 'A') AS ok FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2, 3),
    a AS (SELECT * FROM x WHERE v = 'O'), b AS (SELECT * FROM x WHERE v = 'F'), s AS (SELECT task, count(*) FILTER (v = 'O') AS n, count(*) FILTER (v = 'F') AS m FROM x GROUP BY 1),
    d AS (SELECT a.task, count(*) FILTER (a.ok <> coalesce(b.ok, false)) AS changed FROM a LEFT JOIN b ON a.task = b.task AND a.t = b.t GROUP BY 1)
    SELECT s.task, CASE WHEN n = 0 OR m = 0 THEN 0 ELSE round(changed / greatest(changed, n)::DOUBLE, 6) END AS distance FROM s LEFT JOIN d USING (task)""",
)
def c3(s, d):
    x = table(s, d, "lineitem").filter("l_linenumber <= 4").groupBy(F.col("l_partkey").alias("task"), "l_linestatus", F.col("l_linenumber").cast("string").alias("t")).agg(F.bool_or(F.col("l_returnflag") == "A").alias("ok"))
    maps = x.groupBy("task").agg(*[F.map_from_entries(F.collect_list(F.when(F.col("l_linestatus") == v, F.struct("t", "ok")))).alias(v) for v in "OF"])
    return maps.select("task", F.round(O.vector_distance(F.col("O"), F.col("F")), 6).alias("distance"))


@query("c5_kinds", ALIGNED + "SELECT task, CASE WHEN I1 OR I2 THEN 'Invalid Inconsistency' WHEN W1 AND W2 THEN 'Incorrectness Inconsistency' ELSE 'Correctness Inconsistency' END AS kind FROM fl")
def c5(s, d):
    return aligned(s, d).select("task", O.kind_of(F.col("failure_1"), F.col("failure_2")).alias("kind"))


@query("c6_neighbour_verdicts", ALIGNED + "SELECT task, compared, inc AND NOT (I1 AND I2) AS inconsistent FROM v")
def c6(s, d):
    v = O.neighbours(F.col("failure_1"), F.col("failure_2"), O.differs(F.col("output_1"), F.col("output_2")))
    return aligned(s, d).withColumn("v", v).select("task", "v.compared", "v.inconsistent")


# windows, order and sets


@query("w1_share_of_total", "SELECT event_type, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS share FROM events GROUP BY 1")
def w1(s, d):
    n = table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") * F.lit(100.0) / F.sum("n").over(Window.partitionBy()), 4))


@query("w2_keep_first", f"WITH {LOG} SELECT task, l_orderkey, model FROM {first('log', 'task')}")
def w2(s, d):
    return A.keep_first(log(s, d), ["task"], ORDER).select("task", "l_orderkey", "model")


@query("w3_first_in_group", f"WITH {LOG}, x AS (SELECT task, failure, first_value(coalesce(failure, 'nan')) OVER (PARTITION BY task ORDER BY l_orderkey, mutation, model, price, day) AS f FROM log) SELECT task, count(*) FILTER (coalesce(failure, 'nan') <> f) AS unlike FROM x GROUP BY 1")
def w3(s, d):
    own = log(s, d).withColumn("f", F.coalesce("failure", F.lit("nan")))
    head = A.keep_first(own, ["task"], ORDER).select("task", F.col("f").alias("h"))
    return own.join(head, "task").groupBy("task").agg(M.count(F.col("f") != F.col("h")).alias("unlike"))


@query("w4_systematic_sample", "WITH x AS (SELECT l_partkey AS task, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS i FROM lineitem) SELECT task, i, l_orderkey FROM x WHERE (i - 1) % 5 = 0 AND (i - 1) // 5 < 4")
def w4(s, d):
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    x = table(s, d, "lineitem").withColumn("i", F.row_number().over(w))
    return x.filter("(i - 1) % 5 = 0 and floor((i - 1) / 5) < 4").select(F.col("l_partkey").alias("task"), "i", "l_orderkey")


@query("w5_renumber", "SELECT l_orderkey AS g, l_linenumber AS was, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id FROM lineitem WHERE l_returnflag <> 'R'")
def w5(s, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(s, d, "lineitem").filter("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("was"), F.row_number().over(w).alias("id"))


@query("w6_running_offset", "WITH x AS (SELECT o_custkey AS g, o_orderkey AS k, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) SELECT g, k, (sum(n) OVER (PARTITION BY g ORDER BY k) - n)::BIGINT AS start FROM x")
def w6(s, d):
    n = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    x = table(s, d, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("k")).join(n, "k", "left").na.fill(0, ["n"])
    return x.select("g", "k", (F.sum("n").over(Window.partitionBy("g").orderBy("k")) - F.col("n")).alias("start"))


@query("w7_last_of_sorted", "SELECT c_nationkey AS n, max(c_name) AS last FROM customer GROUP BY 1")
def w7(s, d):
    return table(s, d, "customer").groupBy(F.col("c_nationkey").alias("n")).agg(F.max("c_name").alias("last"))


@query("o3_sort_descending", "SELECT r_name, row_number() OVER (ORDER BY r_regionkey DESC) AS i FROM region")
def o3(s, d):
    return table(s, d, "region").select("r_name", F.row_number().over(Window.orderBy(F.desc("r_regionkey"))).alias("i"))  # five rows


@query("o5_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def o5(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("o6_resume", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 ORDER BY o_orderkey LIMIT 50")
def o6(s, d):
    return table(s, d, "orders").filter("o_orderkey >= 100").select("o_orderkey").orderBy("o_orderkey").limit(50)


@query("o8_intersection", "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def o8(s, d):
    side = lambda f: table(s, d, "lineitem").filter(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k"))
    return side("A").intersect(side("R"))


@query("o9_ordered_union", "SELECT 0 AS part, c_custkey AS k FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 1, s_suppkey FROM supplier WHERE s_acctbal < 0")
def o9(s, d):
    a = table(s, d, "customer").filter("c_acctbal < 0").select(F.lit(0).alias("part"), F.col("c_custkey").alias("k"))
    return a.unionByName(table(s, d, "supplier").filter("s_acctbal < 0").select(F.lit(1).alias("part"), F.col("s_suppkey").alias("k")))


@query("o10_right_wins", "SELECT coalesce(b.k, a.k) AS k, coalesce(b.v, a.v) AS v FROM (SELECT l_partkey AS k, min(l_quantity) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) a FULL JOIN (SELECT l_partkey AS k, max(l_quantity) AS v FROM lineitem WHERE l_linestatus = 'F' AND l_tax > 0.05 GROUP BY 1) b ON a.k = b.k")
def o10(s, d):
    own = table(s, d, "lineitem")
    a = own.filter("l_linestatus = 'O'").groupBy(F.col("l_partkey").alias("k")).agg(F.min("l_quantity").alias("v"))
    b = own.filter("l_linestatus = 'F' and l_tax > 0.05").groupBy(F.col("l_partkey").alias("k")).agg(F.max("l_quantity").alias("w"))
    return a.join(b, "k", "full_outer").select("k", F.coalesce("w", "v").alias("v"))


@query("o11_ordered_distinct", "SELECT l_orderkey AS id, array_to_string(list_transform(list_sort(list({f: f, k: k})), lambda x: x.k), ',') AS ks FROM (SELECT l_orderkey, l_suppkey % 5 AS k, min(l_linenumber * 1000000 + l_partkey) AS f FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def o11(s, d):
    own = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct((F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("f"), (F.col("l_suppkey") % 5).alias("k")))).alias("x"))
    return own.select("id", F.array_join(F.array_distinct(F.transform("x", lambda e: e["k"].cast("string"))), ",").alias("ks"))


@query("o12_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def o12(s, d):
    return table(s, d, "documents").select("doc_id").join(table(s, d, "labels"), "doc_id", "left_anti").distinct()


# sampling


@query("m1_draw_with_replacement", "WITH x AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part), w AS (SELECT i AS draw, ('0x' || substr(md5('1234:' || i), 1, 15))::BIGINT % n AS i FROM x) SELECT draw, p_partkey, p_name FROM w JOIN x USING (i)")
def m1(s, d):
    """As many draws as rows: draw i takes the row whose number a seeded hash of i names."""
    own = table(s, d, "part").select("p_partkey", "p_name")
    n = own.count()
    h = F.substring(F.md5(F.concat(F.lit("1234:"), F.col("id").cast("string")).cast("binary")), 1, 15)
    draws = s.range(n).select(F.col("id").alias("draw"), (F.conv(h, 16, 10).cast("bigint") % max(n, 1)).alias("i"))
    return draws.join(A.numbered(own, "p_partkey", "i"), "i").select("draw", "p_partkey", "p_name")


@query("m2_systematic_templates", "WITH x AS (SELECT p_brand AS template, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part) SELECT template, p_partkey FROM x WHERE (i - 1) % 7 = 0 AND (i - 1) // 7 < 10")
def m2(s, d):
    x = table(s, d, "part").withColumn("i", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")))
    return x.filter("(i - 1) % 7 = 0 and floor((i - 1) / 7) < 10").select(F.col("p_brand").alias("template"), "p_partkey")


@query("m3_shuffled_prefix", "SELECT p_partkey FROM part ORDER BY md5('1234:' || p_partkey), p_partkey LIMIT 100")
def m3(s, d):
    return table(s, d, "part").select("p_partkey").orderBy(F.md5(F.concat(F.lit("1234:"), F.col("p_partkey").cast("string")).cast("binary")), "p_partkey").limit(100)
