"""Personal data by weak supervision: labelers vote on spans, their reliabilities are learned, and a
span classifier trained on the outcome decides.

Exact patterns find the base spans, which always stay.  Looser patterns propose further candidates:
telephone numbers in other notations, digit groups of identity, card and account numbers, addresses
of mail written out.  Regular-expression, gazetteer and context labelers each vote for, against or
abstain on every candidate.  Vote vectors are counted over the whole corpus (at most 3 to the power
of the number of labelers), expectation-maximisation fits each labeler's accuracy and the share of
personal data, and the posterior of each vote vector is the soft label on which a logistic span
classifier is trained by its counts of features, again over the whole corpus.  A candidate that the
classifier gives at least ``THRESHOLD`` and that overlaps no base span is added.

Defined results: null and empty texts have no spans; offsets count code points, ends are exclusive;
overlapping base spans of different kinds all stay; repeated rows are returned each; doc_id may be
null; other columns are not read.  Every scan is linear in the text, whatever it holds.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope import scratch
from veriscope.llm.texts import documents, map_texts

KINDS = ("email", "ip", "card", "phone")
#: Kinds of candidates beyond the base kinds.
MORE = ("mailto", "local", "iban", "ident")
THRESHOLD = 0.9
ROUNDS = 60
#: Code points before a candidate in which a context word counts.
CONTEXT = 48

# A run of [A-Za-z0-9._%+-] is looked for backwards from its @, so a long run is read once.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only start where a run of digits starts.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by kind, then start."""
    out, last = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = at = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append(("email", start, m.end()))
                last = m.end()
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


_DOT = re.compile(r"(?i)\bdot\b")
_LOOSE = {
    "mailto": re.compile(r"(?<![\w.+-])\w[\w.+-]*+ ?[\[(]? ?(?:@|\bat\b) ?[\])]? ?\w[\w-]*+(?: ?[\[(]? ?(?:\.|\bdot\b) ?[\])]? ?\w[\w-]*+)+", re.ASCII | re.IGNORECASE),
    "local": re.compile(r"(?<![0-9.+-])(?:00[1-9][0-9]{0,2}[ .-]?)?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-][0-9]{4}(?![0-9])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ident": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}
#: Words that announce personal data, in the four languages of the corpus and their usual forms.
ANNOUNCE = frozenset("account address anruf call card carte cell correo contact courriel email e-mail fax iban id karte konto mail mobile name number numéro nummer passport phone ssn tarjeta tel telefon teléfono téléphone tlf whatsapp".split())
#: Words beside numbers that are no personal data.
OTHER = frozenset("chapter figure isbn issn page section seite table version vol volume".split())
#: Last labels of mail domains, and the country letters of account numbers.
TOP = frozenset("com org net edu gov info io de fr es uk it nl eu".split())
COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT SE".split())
_LETTERS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _context(text: str, start: int, words: frozenset) -> bool:
    return any(w in words for w in _LETTERS.findall(text[max(0, start - CONTEXT) : start].lower())[-4:])


#: Each labeler votes 1 (personal), -1 (not) or 0 (abstains) on (kind, span's text, whole text, start).
def _by_base(kind, s, text, start):
    return 1 if kind in KINDS else 0


def _by_check(kind, s, text, start):
    if kind == "iban":
        return 1 if iban_valid(s) else -1
    if kind == "card":
        return 1
    if kind == "ident":
        return 1 if s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000" else -1
    return 0


def _by_gazetteer(kind, s, text, start):
    if kind in ("email", "mailto"):
        return 1 if re.split(r"[^a-z0-9]+", s.lower().rstrip(")] "))[-1] in TOP else -1
    if kind == "iban":
        return 1 if s[:2] in COUNTRIES else -1
    return 0


def _by_announcement(kind, s, text, start):
    return 1 if _context(text, start, ANNOUNCE) else 0 if kind in KINDS else -1


def _by_other_use(kind, s, text, start):
    return -1 if _context(text, start, OTHER) else 0


def _by_notation(kind, s, text, start):
    if kind in ("phone", "local"):
        return 1 if s[0] in "(+0" else 0
    if kind == "mailto":
        return 1 if re.search(r"[\[(]|@|\bdot\b", s, re.IGNORECASE) else -1
    return 0


def _by_repetition(kind, s, text, start):
    d = _NOT_DIGIT.sub("", s)
    return -1 if len(d) >= 6 and len(set(d)) <= 2 else 0


LABELERS = (_by_base, _by_check, _by_gazetteer, _by_announcement, _by_other_use, _by_notation, _by_repetition)


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str, str]]:
    """Base and further candidates: kind, start, end, votes and features as short strings."""
    spans, taken = list(base), []  # taken: disjoint, in order
    for s, e in sorted((s, e) for _, s, e in base):
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    number = _DIGIT.search(text)
    for kind in MORE:
        if not number if kind != "mailto" else "@" not in text and not _DOT.search(text):
            continue
        for m in _LOOSE[kind].finditer(text):
            i = bisect_left(taken, m.span())
            if (i == 0 or taken[i - 1][1] <= m.start()) and (i == len(taken) or m.end() <= taken[i][0]):
                spans.append((kind, *m.span()))
                taken.insert(i, m.span())
    out = []
    for kind, s, e in spans:
        word = text[s:e]
        votes = "".join("-0+"[f(kind, word, text, s) + 1] for f in LABELERS)
        digits = sum(map(str.isdigit, word))
        shape = (f"k={kind}", f"d={min(digits, 20) // 4}", f"g={min(4, len(re.findall('[0-9]+', word)))}", f"a={_context(text, s, ANNOUNCE):d}", f"o={_context(text, s, OTHER):d}", f"p={'9' if word[0].isdigit() else 'L' if word[0].isalpha() else word[0]}", f"n={text[e : e + 1].isalnum():d}", f"b={text[s - 1 : s].isalnum():d}" if s else "b=0")
        out.append((kind, s, e, votes, "\x1f".join(shape)))
    return out


@dataclass(frozen=True)
class Reliability:
    """The share of personal data and each labeler's probabilities of its votes under each class."""

    prior: float
    vote: np.ndarray  # class, labeler, vote -1 0 1

    def posterior(self, votes: str) -> float:
        v = ["-0+".index(c) for c in votes]
        log = np.log([1 - self.prior, self.prior]) + np.log(self.vote[:, np.arange(len(v)), v]).sum(1)
        return float(1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50))))


def learn(counts: dict[str, int], rounds: int = ROUNDS) -> Reliability:
    """Expectation-maximisation over the counts of vote vectors; starts from labelers right 4 times in 5."""
    start = np.array([[0.3, 0.6, 0.1], [0.1, 0.6, 0.3]])
    vote, prior = np.repeat(start[:, None, :], len(LABELERS), axis=1), 0.5
    if not counts:
        return Reliability(prior, vote)
    keys = sorted(counts)
    at = np.array([["-0+".index(c) for c in k] for k in keys])
    n = np.array([counts[k] for k in keys], float)
    for _ in range(rounds):
        log = np.log([[1 - prior], [prior]]) + np.log(vote[:, np.arange(len(LABELERS)), at]).sum(2)
        p = np.exp(log - log.max(0))
        p = p / p.sum(0) * n
        prior = float(np.clip((p[1].sum() + 1) / (n.sum() + 2), 0.01, 0.99))
        for v in range(3):
            vote[:, :, v] = (p @ (at == v)) + 4 * start[:, v : v + 1]  # four pseudo-votes keep each labeler's meaning
        vote = vote / vote.sum(2, keepdims=True)
    return Reliability(prior, vote)


def train(rows: list[tuple[str, float, float]], rounds: int = 300, decay: float = 1e-3) -> dict[str, float]:
    """Weights of a logistic classifier from (features, mass of personal data, mass of other)."""
    names = sorted({f for x, _, _ in rows for f in x.split("\x1f")} | {"1"})
    index = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for r, (fs, _, _) in enumerate(rows):
        x[r, [index["1"], *(index[f] for f in fs.split("\x1f"))]] = 1
    yes, no = (np.array([r[k] for r in rows], float) for k in (1, 2))
    total = max(1.0, (yes + no).sum())
    w = np.zeros(len(names))
    for _ in range(rounds):  # Newton with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ ((yes + no) * p - yes) / total + decay * w
        if np.abs(g).max() < 1e-9:
            break
        h = (x * ((yes + no) * p * (1 - p) / total)[:, None]).T @ x + decay * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return dict(zip(names, w.tolist()))


def classify(features: str, weights: dict[str, float]) -> float:
    z = weights.get("1", 0.0) + sum(weights.get(f, 0.0) for f in features.split("\x1f"))
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def pii(docs: DataFrame, *, keep: list[str] | None = None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep``, base (array of kind, start, end) and added (the same with probability).

    One pass over the texts writes spans and candidates; the models are fitted on counts of vote
    vectors and features, whose number the labelers and shapes bound; a second pass over the
    written spans decides.
    """
    keep = ["doc_id"] if keep is None else keep
    span = "kind: string, start: bigint, `end`: bigint"
    found_kind = f"base array<struct<{span}>>, found array<struct<{span}, votes: string, features: string>>"

    def make():
        def run(texts):
            base = [base_spans(t) for t in texts]
            name = ("kind", "start", "end", "votes", "features")
            return [[[dict(zip(name, s)) for s in b] for b in base], [[dict(zip(name, c)) for c in candidates(t, b)] for t, b in zip(texts, base)]]

        return run

    found = scratch.table(map_texts(docs, make, found_kind, keep=keep, text_col=text_col), "spans")
    each = found.select(F.explode("found").alias("c")).groupBy("c.votes", "c.features").count()
    seen = [(r["votes"], r["features"], r["count"]) for r in each.collect()]  # vote vectors times shapes
    votes: Counter = Counter()
    for v, _, n in seen:
        votes[v] += n
    model = learn(votes)
    mass: dict[str, list[float]] = {}
    for v, f, n in seen:
        p = model.posterior(v)
        m = mass.setdefault(f, [0.0, 0.0])
        m[0] += n * p
        m[1] += n * (1 - p)
    weights = train([(f, *m) for f, m in sorted(mass.items())])
    # base spans stay whatever their score
    score = {f: classify(f, weights) for f in mass if f.split("\x1f")[0][2:] in MORE}

    more = F.filter("found", lambda c: c["kind"].isin(*MORE))
    return found.select(*keep, "base", more.alias("more")).transform(lambda d: _scored(d, keep, score, threshold, span))


def _scored(found: DataFrame, keep: list[str], score: dict[str, float], threshold: float, span: str) -> DataFrame:
    good = {f: p for f, p in score.items() if p >= threshold}
    table = F.create_map(*[F.lit(x) for f, p in sorted(good.items()) for x in (f, p)]) if good else F.from_json(F.lit("{}"), "map<string, double>")
    added = F.filter(
        F.transform("more", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), table[c["features"]].alias("p"))),
        lambda c: c["p"].isNotNull(),
    )
    return found.select(*keep, "base", added.alias("added"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, [*KINDS, *MORE]))

    def text(spans):
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(kinds, s["kind"]), s["start"], s["end"], s["kind"])))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    found = pii(documents(spark, sf_dir))
    plain = F.transform("added", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    def of(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(of, KINDS), F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"), text(F.concat("base", plain)).alias("spans"), F.size("added").cast("long").alias("n_added"))
