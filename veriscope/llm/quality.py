"""Quality rules as weak supervision, by DataFrame functions alone.

Rules vote good or bad on a text or abstain.  How the votes fall together over the whole corpus (at
most 3 to the power of the number of rules combinations, counted by partial aggregates) is enough
for expectation-maximisation to estimate each rule's accuracy and the share of good texts.  A text
stays if its posterior probability of being good reaches ``KEEP``; no single rule decides, but for
the base limits (fewer than ten words, or a fifth of the words in repeated windows), which do.

Everything about a text is computed in its row, so no text is shuffled; what the rules need is
written once with the columns asked for.  Windows are told apart by 64-bit hashes.

Defined results: a null, empty or blank text has no words and fails the base; repeated rows count
and are judged each; a null doc_id is judged like any other; an empty table gives an empty result;
columns that are not asked for are not read.  Names that clash with the result's raise an error.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope import scratch
from veriscope.llm.texts import SPACES, documents, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
#: A text of n words is expected to have at least half of them distinct, or, if it is long, the root of so many times n.
VARIETY = 500
KEEP = 0.5
ROUNDS = 25
#: The first six know one fault each: they vote bad where they see it and abstain elsewhere, for its
#: absence says nothing about other faults.  The last three know what prose looks like as a whole.
RULES = ("symbols", "shouts", "capitals", "lines", "repeats", "variety", "plain", "sentences", "fluent")
ODD = "#*$%&|<>!@^_~`\\{}[]"
BAD, ABSTAIN, GOOD = 0, 1, 2
#: Chances of a bad, abstaining and good vote that the estimation starts from, for bad and good texts.
START = {"bad": (0.25, 0.35, 0.4), "good": (0.01, 0.34, 0.65)}
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good", "votes")


def _bind(value: Column, body) -> Column:
    """``body`` of ``value``, computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _less(text: Column, chars: str) -> Column:
    """How many code points of a text are among ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more in an array of words."""

    def covered(places: Column) -> Column:
        following = F.concat(F.slice(places, F.lit(2), F.size(places)), F.array(F.lit(None).cast("int")))
        each = F.zip_with(places, following, lambda a, b: F.least(F.lit(window), b - a).cast("long"))
        return F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + x)

    def twins(s: Column) -> Column:
        same = F.filter(s, lambda e, i: F.coalesce(e["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(s, i + 1)["h"], F.lit(False)))
        return _bind(F.array_sort(F.transform(same, lambda e: e["i"])), covered)

    def among(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_bind(ordered, twins))

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(window))))
    return F.when(F.size(w) <= window, F.lit(0).cast("long")).otherwise(_bind(hashes, among))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def facts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep``, the base quantities and the votes (an integer, three values a digit)."""
    if {*keep} & {*RESULT}:
        raise ValueError(f"columns {sorted({*keep} & {*RESULT})} would appear twice")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    read = docs.select(F.struct(*[F.col(f"`{k}`") for k in keep]).alias("kept_"), text.alias("t_"), words(F.col(f"`{text_col}`")).alias("w_"))
    t, w = F.col("t_"), F.col("w_")
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = read.select(
        "kept_",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        _less(t, SYMBOLS).alias("n_symbols"),
        _bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines_"),
        repeated_words(w).alias("n_repeat_words"),
        F.size(F.array_distinct(w)).cast("long").alias("distinct_"),
        _less(t, "!").alias("shouts_"),
        _less(t, ".").alias("stops_"),
        _less(t, ODD).alias("odd_"),
        _less(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("capitals_"),
    )
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    dup, every = F.col("lines_.dup"), F.greatest(F.col("lines_.all"), F.lit(1))
    never, caps = F.lit(False), F.col("capitals_")
    votes = (
        _vote(never, F.col("n_symbols") * 8 > n),
        _vote(never, F.col("shouts_") * 5 > n),
        _vote(never, caps * 3 > chars),
        _vote(never, dup * 3 > every),
        _vote(never, F.col("n_repeat_words") * 5 > n),
        _vote(never, (F.col("distinct_") * 2 < n) & (F.col("distinct_") * F.col("distinct_") < VARIETY * n)),
        _vote(F.col("odd_") * 100 < chars, F.col("odd_") * 10 > chars),
        _vote(((F.col("stops_") * 40 > n) | (n < 40)) & (F.col("stops_") * 3 <= n) & (caps * 8 < chars), never),
        _vote((F.col("distinct_") * 2 >= n) & (F.col("n_repeat_words") * 20 < n) & (F.col("n_words") > 20), never),
    )
    code = sum((v * 3**i for i, v in enumerate(votes[1:], 1)), start=votes[0])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return counted.select(*[F.col(f"kept_.`{k}`") for k in keep], "n_words", "word_chars", "n_symbols", dup.alias("n_dup_lines"), "n_repeat_words", failed.alias("base_failed"), code.cast("int").alias("votes"))


def estimate(counts: DataFrame, rules: int = len(RULES), rounds: int = ROUNDS) -> DataFrame:
    """One row: prior, and good and bad (arrays of each rule's chances of each vote).

    ``counts`` has votes and count for each combination of votes.  The rounds of expectation and
    maximisation are a fold over the collected combinations, whose number the rules bound.
    """
    digits = ", ".join(f"cast(floor(votes / {3**r}) % 3 as int)" for r in range(rules))
    first = {k: ", ".join(f"{x}D" for _ in range(rules) for x in v) for k, v in START.items()}

    def logs(theta: str) -> str:
        return f"aggregate(sequence(0, {rules - 1}), 0D, (a, r) -> a + ln({theta}[3 * r + x.v[r]]))"

    # two pseudo-votes for each vote keep every chance above zero and every rule's meaning
    def chances(weight: str, start: str) -> str:
        sums = f"transform(sequence(0, {3 * rules - 1}), k -> aggregate(e, 20 * array({first[start]})[k], (a, x) -> a + if(x.v[cast(k div 3 as int)] = k % 3, x.n * {weight}, 0D)))"
        return f"transform(array({sums}), m -> transform(m, (c, k) -> c / (m[3 * cast(k div 3 as int)] + m[3 * cast(k div 3 as int) + 1] + m[3 * cast(k div 3 as int) + 2])))[0]"

    expected = f"""transform(rows, x -> named_struct('v', x.v, 'n', x.n,
        'p', 1 / (1 + exp(least(700D, greatest(-700D, ln(1 - s.prior) + {logs("s.bad")} - ln(s.prior) - {logs("s.good")}))))))"""
    step = f"""transform(array({expected}), e -> named_struct(
        'prior', greatest(0.001D, least(0.999D, aggregate(e, 1D, (a, x) -> a + x.n * x.p) / aggregate(e, 2D, (a, x) -> a + x.n))),
        'good', {chances("x.p", "good")}, 'bad', {chances("(1 - x.p)", "bad")}))[0]"""
    rows = counts.selectExpr(f"named_struct('v', array({digits}), 'n', cast(count as double)) as x").agg(F.sort_array(F.collect_list("x")).alias("rows"))
    start = f"named_struct('prior', 0.5D, 'good', array({first['good']}), 'bad', array({first['bad']}))"
    return rows.selectExpr(f"aggregate(sequence(1, {rounds}), {start}, (s, i) -> {step}) as s").select("s.*")


def quality(docs: DataFrame, *, keep: list[str] | None = None, text_col: str = "text", at_least: float = KEEP) -> DataFrame:
    """The columns ``keep``, the base quantities, base_failed, kept, p_good and votes of each row."""
    keep = ["doc_id"] if keep is None else keep
    seen = scratch.table(facts(docs, keep, text_col), "quality")
    model = estimate(seen.groupBy("votes").count()).first()  # one row of 1 + 6 times the rules
    ratio = [log(b) - log(g) for g, b in zip(model["good"], model["bad"])]
    logit = F.lit(log(1 - model["prior"]) - log(model["prior"]))
    for r in range(len(RULES)):
        v = F.floor(F.col("votes") / 3**r) % 3
        logit = logit + F.when(v == BAD, ratio[3 * r]).when(v == ABSTAIN, ratio[3 * r + 1]).otherwise(ratio[3 * r + 2])
    p = 1 / (1 + F.exp(logit))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return seen.select(*[f"`{k}`" for k in keep], *base, (~F.col("base_failed") & (p >= at_least)).alias("kept"), p.alias("p_good"), "votes")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir)).withColumn("p_good", F.round("p_good", 6))


def _sql() -> str:
    """The same in DuckDB's SQL, the rounds of estimation as a recursion over one row."""
    n, spaces = len(RULES), r"[\x20\x09-\x0D]+"
    first = {k: "[" + ", ".join(f"{x}::DOUBLE" for _ in range(n) for x in v) + "]" for k, v in START.items()}
    powers = "[" + ", ".join(str(3**r) for r in range(n)) + "]"

    def less(chars: str) -> str:
        return f"(length(t) - length(translate(t, '{chars}', '')))"

    def logs(theta: str, v: str = "x.v") -> str:
        return f"list_sum(list_transform(range(0, {n}), lambda r: ln({theta}[3 * r + {v}[r + 1] + 1])))"

    def sums(weight: str, start: str) -> str:
        return f"list_transform(range(0, {3 * n}), lambda k: 20 * {first[start]}[k + 1] + coalesce(list_sum(list_transform(list_filter(e, lambda x: x.v[k // 3 + 1] = k % 3), lambda x: x.n * {weight})), 0))"

    def shares(m: str) -> str:
        return f"list_transform(range(0, {3 * n}), lambda k: {m}[k + 1] / ({m}[3 * (k // 3) + 1] + {m}[3 * (k // 3) + 2] + {m}[3 * (k // 3) + 3]))"

    def p(v: str) -> str:
        return f"1 / (1 + exp(ln(1 - prior) + {logs('bad', v)} - ln(prior) - {logs('good', v)}))"

    return f"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{spaces}'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
g AS (SELECT list(struct_pack(r := row, i := i)) AS at FROM (SELECT row, i, array_slice(w, i, i + {WINDOW - 1}) AS g FROM w, unnest(range(1, len(w) - {WINDOW - 2})) u(i)) GROUP BY row, g HAVING count(*) > 1),
c AS (SELECT r, count(DISTINCT p) AS again FROM (SELECT a.r AS r, unnest(range(a.i, a.i + {WINDOW})) AS p FROM (SELECT unnest("at") AS a FROM g)) GROUP BY r),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{spaces}', '', 'g'))::BIGINT AS word_chars, {less(SYMBOLS)}::BIGINT AS n_symbols, len(l)::BIGINT AS lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(again, 0)::BIGINT AS n_repeat_words, len(list_distinct(w)) AS variety, {less('!')} AS shouts, {less('.')} AS stops, {less(ODD)} AS odd,
  {less('ABCDEFGHIJKLMNOPQRSTUVWXYZ')} AS caps, greatest(len(w), 1) AS n, greatest(length(regexp_replace(t, '{spaces}', '', 'g')), 1) AS chars FROM w LEFT JOIN c ON r = row),
v AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, [
  CASE WHEN n_symbols * 8 > n THEN 0 ELSE 1 END, CASE WHEN shouts * 5 > n THEN 0 ELSE 1 END, CASE WHEN caps * 3 > chars THEN 0 ELSE 1 END,
  CASE WHEN n_dup_lines * 3 > greatest(lines, 1) THEN 0 ELSE 1 END, CASE WHEN n_repeat_words * 5 > n THEN 0 ELSE 1 END, CASE WHEN variety * 2 < n AND variety * variety < {VARIETY} * n THEN 0 ELSE 1 END,
  CASE WHEN odd * 10 > chars THEN 0 WHEN odd * 100 < chars THEN 2 ELSE 1 END, CASE WHEN (stops * 40 > n OR n < 40) AND stops * 3 <= n AND caps * 8 < chars THEN 2 ELSE 1 END,
  CASE WHEN variety * 2 >= n AND n_repeat_words * 20 < n AND n_words > 20 THEN 2 ELSE 1 END] AS v FROM f),
k AS (SELECT list(struct_pack(v := v, n := n) ORDER BY v) AS rows FROM (SELECT v, count(*)::DOUBLE AS n FROM v GROUP BY v)),
em AS (SELECT 0 AS it, 0.5::DOUBLE AS prior, {first["good"]} AS good, {first["bad"]} AS bad
  UNION ALL SELECT it, greatest(0.001::DOUBLE, least(0.999::DOUBLE, (1 + list_sum(list_transform(e, lambda x: x.n * x.p))) / (2 + list_sum(list_transform(e, lambda x: x.n))))), {shares("g")}, {shares("b")}
  FROM (SELECT it, e, {sums("x.p", "good")} AS g, {sums("(1 - x.p)", "bad")} AS b
    FROM (SELECT it + 1 AS it, list_transform(rows, lambda x: struct_pack(v := x.v, n := x.n, p := {p("x.v")})) AS e FROM em, k WHERE it < {ROUNDS}))),
s AS (SELECT v.*, {p("v")} AS p FROM v, em WHERE it = {ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= {KEEP} AS kept, round(p, 6) AS p_good,
  list_sum(list_transform(range(0, {n}), lambda r: v[r + 1] * {powers}[r + 1]))::INT AS votes FROM s
"""


OP1_SQL = _sql()
