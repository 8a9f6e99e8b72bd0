"""Secret scans with multipart credential linking, by DataFrame functions alone.

Exact patterns find the base spans, which always stay.  Weaker parts (identifiers of access, values
that could be secrets, endpoints) mean nothing alone: they are reported when complementary parts
stand in one scope, within ``SCOPE`` code points.  That is an interval join of each text's parts
with themselves, done as range frames over the starts and ends of parts, so no pairs are made; its input
are the parts of the texts that have one, and a text without takes no part in it.

A pattern's matches and the gaps between them give their places: a gap is what splitting by the
pattern leaves.  Running sums over them, and the rebuilding of a text, go by runs of ``RUN`` spans, so a
text that is nothing but matches takes time in proportion to its length.  Texts are read once; their
spans and parts are written, with a number for each row.

Defined results: null and empty texts have no spans; offsets count code points, ends are exclusive;
parts never overlap base spans, but for matches of the base patterns that failed their
check; two parts confirm each other only if they are disjoint; repeated rows are returned each; a null doc_id is a row like any
other; an empty table gives an empty result; columns that are not asked for are not read.  Names that
clash with the result's raise an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriscope import scratch
from veriscope.llm.texts import documents, small

KINDS = ("assign", "access", "hex")
#: Kinds of spans beyond the base ones.
PARTS = ("part_secret", "part_ident", "part_endpoint")
#: Code points between parts that belong together.
SCOPE = 200
SHORTEST = 8
#: Spans that are folded together.
RUN = 512
RESULT = ("row", "base", "parts", "added")

_NAME, _SIGN = r"(?i:password|passwd|secret|token|api_?key)", r"[\"']?\x20*[:=]\x20*[\"']?"
_VALUE = r"[A-Za-z0-9+/_.=-]"
ASSIGN = f"{_NAME}{_SIGN}({_VALUE}+)"
#: Runs are whole: a start inside a run would see fewer characters, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

IDENT = rf"(?i:user(?:_?name|_?id)?|login|account(?:_?id)?|client_?id|access_?key_?id|key_?id|tenant(?:_?id)?){_SIGN}[A-Za-z0-9+/_.@=-]{{3,}}"
ENDPOINT = rf"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*+://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{{4,}}|(?i:host(?:_?name)?|endpoint|server|url|bucket){_SIGN}[A-Za-z0-9][A-Za-z0-9._:/-]{{3,}}"
#: A value that could be a secret: long and of mixed letters and digits, or a shorter hexadecimal run.
LOOSE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[a-z0-9+/_=-]*+[A-Z])(?=[A-Z0-9+/_=-]*+[a-z])[A-Za-z0-9+/_=-]{20,}|(?<![A-Za-z0-9])(?=[a-f]*+[0-9])(?=[0-9]*+[a-f])[0-9a-f]{16,31}(?![A-Za-z0-9])"
#: All that the base patterns match.  They overlap only where a run of the last two ends in the name of an assignment.
_AFTER = rf"(?:(?<=(?i:password|passwd|secret|token|apikey)){_SIGN}{_VALUE}+|(?<=(?i:api))_(?i:key){_SIGN}{_VALUE}+)"
TAKEN = rf"{ACCESS}{_AFTER}?|{HEX}(?:(?<=a)(?i:pi_?key){_SIGN}{_VALUE}+)?|{_NAME}{_SIGN}{_VALUE}+"

_SPAN = "array<struct<start: bigint, end: bigint, kind: string, good: boolean>>"


def _bind(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _before(values: Column, plus) -> Column:
    """For each of an array's numbers (zero at least) what ``plus``, a sum or a maximum, makes of all before it."""

    def fold(items: Column, of) -> Column:
        begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(items, begin, lambda s, x: F.struct(plus(s["at"], of(x)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))

    last = F.floor((F.size(values) - 1) / RUN).cast("int")
    runs = F.transform(F.sequence(F.lit(0), last), lambda c: fold(F.slice(values, c * RUN + 1, F.lit(RUN)), lambda x: x))
    every = _bind(runs, lambda r: F.flatten(F.zip_with(r, fold(r, lambda x: x["at"])["out"], lambda x, h: F.transform(x["out"], lambda y: plus(h, y)))))
    return F.when(F.size(values) > 0, every).otherwise(F.array().cast("array<bigint>"))


def _matched(text: Column, pattern: str, of) -> Column:
    """``of`` (match, gap before it) for all leftmost matches that do not overlap."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    return F.zip_with(found, F.slice(gaps, F.lit(1), F.greatest(F.size(gaps) - 1, F.lit(0))), of)


def spans(text: Column, pattern: str, kind: str, good=None) -> Column:
    """All leftmost matches that do not overlap: start, end, kind and whether ``good`` holds of the match."""
    ok = good or (lambda m: F.lit(True))
    sizes = _matched(text, pattern, lambda m, g: F.struct(F.length(g).cast("bigint").alias("g"), F.length(m).cast("bigint").alias("m"), ok(m).alias("good")))

    def placed(found: Column) -> Column:
        before = _before(F.transform(found, lambda x: x["g"] + x["m"]), lambda a, b: a + b)
        return F.zip_with(found, before, lambda x, b: F.struct((b + x["g"]).alias("start"), (b + x["g"] + x["m"]).alias("end"), F.lit(kind).alias("kind"), x["good"].alias("good")))

    return F.when(text.rlike(pattern), _bind(sizes, placed)).otherwise(F.array().cast(_SPAN))


def masked(text: Column) -> Column:
    """The text with everything that base patterns match blanked."""
    pieces = _matched(text, TAKEN, lambda m, g: F.concat(g, F.repeat(F.lit(" "), F.length(m))))
    rest = F.element_at(F.split(text, TAKEN), -1)
    return F.when(text.rlike(TAKEN), F.concat(F.array_join(pieces, ""), rest)).otherwise(text)


def parts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep``, base (the good matches of the base patterns) and parts (weaker ones)."""
    if {*keep} & {*RESULT}:
        raise ValueError(f"columns {sorted({*keep} & {*RESULT})} would appear twice")
    kept = F.struct(*[F.col(f"`{k}`") for k in keep]).alias("kept_")
    read = docs.select(kept, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t_"))
    t = F.col("t_")
    long = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= SHORTEST
    first = read.select("kept_", "t_", F.concat(spans(t, ASSIGN, "assign", long), spans(t, ACCESS, "access"), spans(t, HEX, "hex")).alias("all_"))
    # a base pattern that failed its check is a weak secret
    good, weak = F.filter("all_", lambda s: s["good"]), F.transform(F.filter("all_", lambda s: ~s["good"]), lambda s: s.withField("kind", F.lit("part_secret")))
    second = first.select("kept_", good.alias("base"), weak.alias("weak_"), masked(t).alias("t_"))
    rest = F.concat("weak_", spans(t, LOOSE, "part_secret"), spans(t, IDENT, "part_ident"), spans(t, ENDPOINT, "part_endpoint"))
    third = second.select("kept_", "base", rest.alias("parts"))
    return third.select(*[F.col(f"kept_.`{k}`") for k in keep], "base", "parts")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """row and added: each row's parts that complementary parts stand by, from row, base and parts.

    A secret needs an identifier or an endpoint in its scope, an identifier needs a secret, an
    endpoint needs both.  Base spans count as secrets, access keys as identifiers too.  The distance
    is that of the gap: what ends at most ``scope`` before the own start or starts at most ``scope`` after the
    own end is near; what overlaps is not, so a value does not confirm the assignment that holds it.
    """
    some = found.filter(F.size("parts") > 0).select("row", F.explode(F.concat("base", "parts")).alias("s")).select("row", "s.start", "s.end", "s.kind")
    secret = F.col("kind").isin("assign", "hex", "access", "part_secret")
    ident = F.col("kind").isin("access", "part_ident")
    endpoint = F.col("kind") == "part_endpoint"
    # two events a part: its start looks back at ends, its end looks forward at starts
    events = some.select("*", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(True).alias("first")), F.struct(F.col("end").alias("at"), F.lit(False).alias("first")))).alias("e_"))
    own = Window.partitionBy("row").orderBy("e_.at")
    first = F.col("e_.first")

    def near(kind: Column) -> Column:
        back = F.max(kind & ~first).over(own.rangeBetween(-scope, Window.currentRow))
        ahead = F.max(kind & first).over(own.rangeBetween(Window.currentRow, scope))
        return F.coalesce(F.when(first, back).otherwise(ahead), F.lit(False))

    flags = {"has_secret": secret, "has_ident": ident, "has_endpoint": endpoint}
    seen = events.select("*", *[near(c).alias(n) for n, c in flags.items()]).groupBy("row", "start", "end", "kind").agg(*[F.max(n).alias(n) for n in flags])
    need = F.when(F.col("kind") == "part_secret", F.col("has_ident") | F.col("has_endpoint")).when(F.col("kind") == "part_ident", F.col("has_secret")).when(endpoint, F.col("has_secret") & F.col("has_ident")).otherwise(False)
    return seen.filter(need).groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end", "kind"))).alias("added"))


def secrets(docs: DataFrame, *, keep: list[str] | None = None, text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """The columns ``keep``, base and added: arrays of start, end, kind in the order of places."""
    keep = ["doc_id"] if keep is None else keep
    found = scratch.table(parts(docs, keep, text_col).withColumn("row", F.monotonically_increasing_id()), "parts")
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    none = F.array().cast("array<struct<start: bigint, end: bigint, kind: string>>")
    near = scratch.table(linked(found, scope), "linked")
    near = small(near, near.agg(F.sum(F.size("added") + 1)).first()[0] or 0)
    return found.join(near, "row", "left").select(*[F.col(f"`{k}`") for k in keep], plain.alias("base"), F.coalesce("added", none).alias("added"))


def redacted(text: Column, *taken: Column) -> Column:
    """The text with every span of the arrays blanked out by asterisks of the same length.

    Four bytes a code point make every place of a text one step away.
    """
    ordered = F.array_sort(F.transform(F.concat(*taken), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    mark = F.unhex(F.lit("0000FEFF"))  # a byte order mark that decoding takes away, so that it takes no other

    def piece(raw: Column, start: Column, n: Column) -> Column:
        return F.decode(F.concat(mark, F.substring(raw, (start * 4 + 1).cast("int"), (n * 4).cast("int"))), "UTF-32")

    def rebuilt(x: Column) -> Column:
        before = _before(F.transform(x["s"], lambda s: s["end"]), F.greatest)

        def of(s: Column, b: Column) -> Column:
            start = F.greatest(s["start"], b)
            return F.concat(piece(x["raw"], b, start - b), F.repeat(F.lit("*"), (F.greatest(s["end"], b) - start).cast("int")))

        last = F.array_max(F.transform(x["s"], lambda s: s["end"]))
        return F.concat(F.array_join(F.zip_with(x["s"], before, of), ""), piece(x["raw"], last, F.length(x["raw"]) / 4 - last))

    full = _bind(F.struct(ordered.alias("s"), F.encode(text, "UTF-32").alias("raw")), rebuilt)
    return F.when(text.isNull() | (F.size(F.concat(*taken)) == 0), text).otherwise(full)


def joined(found: Column) -> Column:
    kinds = F.array(*map(F.lit, [*KINDS, *PARTS]))
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"], F.array_position(kinds, s["kind"]), s["end"], s["kind"].alias("kind"), s["end"].alias("to"), s["start"].alias("from"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["from"], s["to"])), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(documents(spark, sf_dir))

    def of(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(of, KINDS), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
