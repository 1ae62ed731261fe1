"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose spans. Labelers of three sorts (stricter regular expressions, gazetteers, words of the context) vote
on each: yes, no or abstain. Expectation-maximisation over the counts of vote patterns estimates how reliable each
labeler is for each kind; a logistic classifier on the votes and the span's length is then trained on the posteriors
and decides. There are at most kinds x 3^labelers x lengths patterns, so what reaches the driver does not grow with the corpus.

The four base kinds (email, ip, card, phone) are kept by their rules alone, whatever the classifier says; it adds spans
of the other kinds. Spans are in code points, end exclusive. Null texts are empty; whole texts are searched, in linear
time for each pattern. Copies get equal spans; an empty table gives an empty result. A column named like the added one
is replaced.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "iban", "ssn")
LABELERS = ("strict", "gazetteer", "context", "edges", "variety")
CONTEXT = 40
#: Spans that are listed in one fold; more are taken in chunks.
CHUNK = 128

#: Patterns of the base kinds, with the same matches as their plain forms; a run is entered at its start only, so no start is tried twice.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?:(?i:password|passwd|pwd|secret|token|api[_-]?key)[=:])?+(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])[A-Za-z0-9_]{16,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What a text must hold for a kind, cheap to test.
HINTS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"(?:[0-9][\x20-]?+){16}"),
    "phone": lambda t: t.contains("+"),
    "secret": lambda t: t.rlike(r"[A-Za-z_][0-9]|[0-9][A-Za-z_]"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"),
    "ssn": lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-"),
}
#: Stricter shapes.
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+(?<![._%+-])@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,24}$",
    "ip": r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
    "card": r"^(?:[0-9]{16,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4,7})$",
    "phone": r"^\+[1-9][0-9]{0,2}[ (.-]",
    "secret": r"^(?:.*[=:])?(?:[A-Z0-9]{16,}|[0-9a-f]{16,}|(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9_]{16,})$",
    "iban": r"^[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4})++(?: [A-Z0-9]{1,3})?$|^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
}
#: Beginnings, domains and codes that each kind is known by.
GAZETTEER = {
    "email": r"@(?:mail|gmail|yahoo|hotmail|outlook|web|gmx|icloud|proton|aol|live)[0-9]*\.|\.(?:com|org|net|edu|gov|de|fr|es|uk|it|io)$",
    "ip": r"^(?!0\.|127\.|22[4-9]\.|23[0-9]\.|24[0-9]\.|25[0-5]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "phone": r"^\+(?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])(?![0-9]{10})",
    "secret": r"(?:^|[=:])(?:AKIA|ASIA|ghp_|gho_|sk_|pk_|xox|AIza|glpat)|^(?i:password|passwd|pwd|secret|token|api[_-]?key)[=:]",
    "iban": r"^(?:AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK)",
    "ssn": r"^[0-8]",
}
#: Words before a span that speak for its kind.
CUES = {
    "email": "mail contact write",
    "ip": "ip address server host client login",
    "card": "card visa mastercard credit payment",
    "phone": "phone call tel mobile fax dial",
    "secret": "password passwd secret token key credential login aws",
    "iban": "iban account bank transfer",
    "ssn": "ssn social security",
}
#: Words before a span that speak against personal data.
AGAINST = r"(?i)\b(?:version|release|isbn|issn|doi|page|section|figure|table|order|item|part|model|build)\s*#?[:.]?\s*$"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn test."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, place: Column) -> Column:
        digit = F.substring(F.reverse(digits), place, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(place % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """The rule a match must pass to be a span of its kind."""
    digits = _digits(value)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: F.regexp_replace(part, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "secret":
        return value.rlike("[A-Za-z]")
    return F.lit(True)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it stands in it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chunks(parts: Column) -> Column:
    return F.sequence(F.lit(0), F.floor((F.greatest(F.size(parts), F.lit(1)) - 1) / CHUNK).cast("int"))


def _found(kind: str, text: Column) -> Column:
    """Spans of a kind with their values and what stands around them, in order of start."""
    shape = "array<struct<kind:int,start:int,end:int,value:string,left:string,right:string>>"
    pattern = F.lit(PATTERNS[kind])
    values = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)
    numbered = F.arrays_zip(gaps.alias("gap"), values.alias("value"), F.array_append(F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(1))), F.lit("")).alias("after"))
    first = F.struct(F.lit(0).alias("at"), F.array().cast(shape).alias("spans"))

    def step(held: Column, part: Column) -> Column:
        gap, value, after = part["gap"], part["value"], part["after"]
        start = held["at"] + F.length(gap)
        end = start + F.length(F.coalesce(value, F.lit("")))
        one = F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), end.alias("end"), value.alias("value"), F.right(gap, F.lit(CONTEXT)).alias("left"), F.left(after, F.lit(2)).alias("right"))
        return F.struct(end.alias("at"), F.when(value.isNotNull(), F.array_append(held["spans"], one)).otherwise(held["spans"]).alias("spans"))

    def chunk(parts: Column) -> Column:
        def add(held: Column, k: Column) -> Column:
            own = F.aggregate(F.slice(parts, k * CHUNK + 1, F.lit(CHUNK)), F.struct(held["at"].alias("at"), F.array().cast(shape).alias("spans")), step)
            return _bound(own, lambda o: F.struct(o["at"].alias("at"), F.array_append(held["spans"], o["spans"]).alias("spans")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{shape}>").alias("spans"))
        return F.flatten(F.aggregate(_chunks(parts), start, add)["spans"])

    # Few matches are listed in one fold, many in chunks: appending to a list copies it.
    spans = _bound(numbered, lambda parts: F.when(F.size(parts) <= CHUNK, F.aggregate(parts, first, step)["spans"]).otherwise(chunk(parts)))
    kept = F.filter(spans, lambda s: _holds(kind, s["value"]))
    return F.when(HINTS[kind](text), F.when(F.size(values) > 0, kept).otherwise(F.array().cast(shape))).otherwise(F.array().cast(shape))


def _ballot(kind: str, span: Column) -> list[Column]:
    """The labelers' votes on a span: 1 yes, -1 no, 0 abstains."""
    value, left, right = span["value"], span["left"], span["right"]
    yes_no = lambda test: F.when(test, 1).otherwise(-1)
    cue = r"(?i)\b(?:" + "|".join(CUES[kind].split()) + r")"
    body = F.regexp_replace(value, "^.*[=:]", "") if kind == "secret" else value
    variety = F.size(F.array_distinct(F.split(F.regexp_replace(body, "[^A-Za-z0-9]", ""), "")))
    return [
        yes_no(value.rlike(STRICT[kind])),
        F.when(value.rlike(GAZETTEER[kind]), 1).otherwise(0),
        F.when(left.rlike(cue), 1).when(left.rlike(AGAINST), -1).otherwise(0),
        yes_no(~left.rlike(r"[A-Za-z0-9_.@-]$") & ~right.rlike(r"^[A-Za-z0-9_@]|^[.-][A-Za-z0-9]")),
        F.when(variety <= 3, -1).when(variety >= (8 if kind == "secret" else 5), 1).otherwise(0),
    ]


def _judged(kind: str, text: Column) -> Column:
    """Spans with their votes, without their values."""

    def bare(span: Column) -> Column:
        votes = _ballot(kind, span)
        length = F.least(F.floor(F.log2((span["end"] - span["start"]).cast("double"))).cast("int"), F.lit(7))
        return F.struct(span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end"), F.array(*votes).alias("votes"), length.alias("size"))

    return F.transform(_found(kind, text), bare)


def proposed(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Adds all proposed spans: kind (number), start, end, votes, size (power of two of the length)."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(out, F.flatten(F.array(*[_judged(k, body) for k in KINDS])))


def _posteriors(counts: dict[tuple[int, ...], int], rounds: int = 100) -> dict[tuple[int, ...], float]:
    """EM for one kind: the posterior of each vote pattern. Each labeler's accuracy starts from ten votes of prior weight."""
    share, right = 0.8, [[0.8, 0.8] for _ in LABELERS]  # [of yes votes given yes, of no votes given no]
    post: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for votes in counts:
            score = math.log(share / (1 - share))
            for vote, (yes, no) in zip(votes, right, strict=True):
                if vote:
                    score += math.log(yes / (1 - no)) if vote > 0 else math.log((1 - yes) / no)
            post[votes] = 1 / (1 + math.exp(-max(-50.0, min(50.0, score))))
        total = sum(counts.values())
        share = (sum(n * post[v] for v, n in counts.items()) + 8) / (total + 10)
        for j in range(len(LABELERS)):
            hits = [8.0, 10.0, 8.0, 10.0]
            for votes, n in counts.items():
                if votes[j]:
                    hits[0] += n * post[votes] * (votes[j] > 0)
                    hits[1] += n * post[votes]
                    hits[2] += n * (1 - post[votes]) * (votes[j] < 0)
                    hits[3] += n * (1 - post[votes])
            right[j] = [min(0.999, hits[0] / hits[1]), min(0.999, max(0.5, hits[2] / hits[3]))]
    return post


class Classifier:
    """A logistic model over kind, votes for each kind, and length."""

    def __init__(self, kind: list[float], vote: list[list[float]], size: list[float]):
        self.kind, self.vote, self.size = kind, vote, size

    @classmethod
    def train(cls, rows: list[tuple[int, tuple[int, ...], int, int]], rounds: int = 150, rate: float = 0.5) -> Classifier:
        """rows: (kind, votes, size, count). Posteriors are the targets; the rows are patterns, not documents."""
        by_kind: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
        for kind, votes, _, n in rows:
            by_kind[kind][votes] += n
        target = {kind: _posteriors(dict(counts)) for kind, counts in by_kind.items()}
        model = cls([0.0] * len(KINDS), [[0.5] * len(LABELERS) for _ in KINDS], [0.0] * 8)
        weight = {kind: sum(c.values()) for kind, c in by_kind.items()}
        for _ in range(rounds):
            kinds, votes_g, sizes = [0.0] * len(KINDS), [[0.0] * len(LABELERS) for _ in KINDS], [0.0] * 8
            for kind, votes, size, n in rows:
                error = (target[kind][votes] - model.chance(kind, votes, size)) * n / weight[kind]
                kinds[kind] += error
                sizes[size] += error / len(by_kind)
                for j, vote in enumerate(votes):
                    votes_g[kind][j] += error * vote
            for kind in by_kind:
                model.kind[kind] += rate * kinds[kind]
                model.vote[kind] = [w + rate * g for w, g in zip(model.vote[kind], votes_g[kind], strict=True)]
            model.size = [w + rate * (g - 0.01 * w) for w, g in zip(model.size, sizes, strict=True)]
        return model

    def chance(self, kind: int, votes: tuple[int, ...], size: int) -> float:
        score = self.kind[kind] + self.size[size] + sum(w * v for w, v in zip(self.vote[kind], votes, strict=True))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, score))))

    def expression(self, span: Column) -> Column:
        """The same chance as a column."""
        numbers = lambda values: F.array(*[F.lit(float(v)) for v in values])
        score = F.get(numbers(self.kind), span["kind"]) + F.get(numbers(self.size), span["size"])
        for j in range(len(LABELERS)):
            score = score + F.get(numbers([w[j] for w in self.vote]), span["kind"]) * F.get(span["votes"], F.lit(j))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def fit(docs: DataFrame, text: str = "text") -> Classifier:
    """The classifier for a corpus, from the counts of all its proposed spans by pattern."""
    spans = proposed(docs.select(text), text).select(F.explode("spans").alias("s"))
    rows = spans.groupBy("s.kind", "s.votes", "s.size").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "votes", "size").collect()
    return Classifier.train([(r["kind"], tuple(r["votes"]), r["size"], r["n"]) for r in rows])


def find(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Adds `spans`: array of (kind, start, end, chance), by kind as in KINDS, then start."""
    model = fit(docs, text)
    names = F.array(*[F.lit(k) for k in KINDS])
    scored = F.transform("spans", lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), model.expression(s).alias("chance")))
    base = F.array(*[F.lit(k) for k in BASE])
    kept = F.filter(scored, lambda s: F.array_contains(base, s["kind"]) | (s["chance"] >= threshold))
    return proposed(docs.drop(*[c for c in docs.columns if c.lower() == "spans"]), text).withColumn("spans", kept)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces every span by its kind in brackets; overlapping spans fall under the one that starts first."""
    found = find(docs, text)
    ordered = F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))

    def cover(text: Column, spans: Column, start: Column) -> Column:
        """(at, out): the text from `start` to the end of the last span, spans replaced; the text begins at `start`."""

        def step(held: Column, s: Column) -> Column:
            inside = s["start"] < held["at"]
            between = F.substring(text, held["at"] - start + 1, s["start"] - held["at"])
            out = F.when(inside, held["out"]).otherwise(F.concat(held["out"], between, F.lit("["), F.upper(s["kind"]), F.lit("]")))
            return F.struct(F.greatest(held["at"], s["end"]).alias("at"), out.alias("out"))

        return F.aggregate(spans, F.struct(start.alias("at"), F.lit("").alias("out")), step)

    def whole(held: Column) -> Column:
        body, spans = held["text"], held["spans"]

        def add(state: Column, k: Column) -> Column:
            def use(some: Column) -> Column:
                stop = F.greatest(state["at"], F.array_max(F.transform(some, lambda s: s["end"])))
                part = F.substring(body, state["at"] + 1, stop - state["at"])
                done = _bound(part, lambda text: cover(text, some, state["at"]))
                return _bound(done, lambda d: F.struct(d["at"].alias("at"), F.array_append(state["out"], d["out"]).alias("out")))

            return _bound(F.slice(spans, k * CHUNK + 1, F.lit(CHUNK)), use)

        done = F.aggregate(_chunks(spans), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), add)
        return _bound(done, lambda d: F.concat(F.array_join(d["out"], ""), F.substring(body, d["at"] + 1, F.length(body))))

    hidden = _bound(F.struct(F.col(text).alias("text"), ordered.alias("spans")), whole)
    return found.withColumn(text, F.when(F.size("spans") > 0, hidden).otherwise(F.col(text))).drop("spans")


def digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of the base kinds, the hash of the base spans, and all spans."""
    found = find(docs.select("doc_id", "text"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.array(*[F.lit(k) for k in BASE])
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    count = {f"n_{k}": of(k) for k in BASE}
    return found.select(
        "doc_id", *[c.alias(n) for n, c in count.items()],
        F.sha2(listed(F.filter("spans", lambda s: F.array_contains(base, s["kind"]))), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
