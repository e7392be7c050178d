"""Personal data by weak supervision, in DataFrame operations only.

Patterns propose spans. Labelers (a strict pattern, a gazetteer, the context before, and a
check of the value) vote on each; expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is, without any truth; and a span classifier is trained
on the posteriors. Spans of the four base kinds always stay; the others stay if the
classifier's probability is at least one half.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.cluster import cut

#: Given names that are no common words (fixed values).
GIVEN_NAMES = (
    "Abigail Adele Agnes Ahmed Aisha Albert Alejandro Alexander Alice Amelia Amina Andrea Andrew Angela Anna Anne Antonio Barbara "
    "Ben Benjamin Bernd Camille Carlos Carmen Caroline Catherine Charlotte Chloe Christine Christopher Claire Claudia Daniel David Deborah Diego "
    "Dieter Dmitri Dorothy Edward Elena Elizabeth Emily Emma Eric Fatima Felix Fernando Francisco Friedrich Gabriel George Giovanni Giulia "
    "Hannah Hans Heinrich Helen Henri Hiroshi Ibrahim Ines Ingrid Isabel Ivan Jacob Jacques James Javier Jennifer Jessica Johann John Jonathan "
    "Jorge Joseph Juan Julia Karen Katharina Kevin Klaus Laura Lena Linda Lucia Luis Manuel Margaret Maria Marie Martin Mary Matthew Michael "
    "Miguel Mohammed Nathalie Nicolas Olga Oliver Pablo Patricia Paul Pedro Peter Philippe Rachel Rebecca Ricardo Richard Robert Samuel Sandra "
    "Sarah Sebastian Sophie Stefan Stephen Susan Thomas Valentina Vincent Walter Wilhelm William Yuki Yusuf"
).split()
#: Patterns of the base kinds, in their order (fixed values). They match what the plain
#: forms match, but with possessive groups and starts at the edge of a run, so that long
#: runs take linear time and no deep recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further kinds that the method may add.
ADDED = {
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "person": r"(?<!\p{L})(?=\p{Lu})(?:(?:Mr|Mrs|Ms|Dr|Prof)\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?|(?:" + "|".join(GIVEN_NAMES) + r") \p{Lu}\p{Ll}+)",
}
KINDS = [*BASE, *ADDED]
#: Words that announce a kind when they come shortly before (fixed values).
CUES = {
    "email": "mail|e-mail|contact|write", "ip": "ip|address|host|server", "card": "card|visa|credit|payment",
    "phone": "phone|tel|call|mobile|fax", "secret": "token|secret|key|password|passwd|bearer", "ssn": "ssn|social security", "person": "by|from|dear|contact",
}
#: Gazetteers: what values of a kind usually hold (fixed values).
GAZETTEER = {
    "email": r"[@.](?:example|gmail|yahoo|outlook|hotmail|mail[0-9]*)\.", "ip": r"^(?:10|127|169|172|192)\.", "card": r"^(?:3[47]|4|5[1-5]|6)",
    "phone": r"^\+(?:1|33|34|44|49)[^0-9]", "secret": r"^(?:sk|pk|ghp|AKIA|xox)|^[0-9A-Fa-f]+$", "ssn": r"^(?!000|666|9)",
    "person": r"(?:^| )(?:" + "|".join(GIVEN_NAMES) + r")\b",
}
#: Strict patterns (fixed values).
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$", "ip": r"^(?:[1-9][0-9]{0,2})(?:\.[0-9]{1,3}){3}$", "card": r"^(?:[0-9]{15,16}|[0-9]{4}(?:[ -][0-9]{4}){3})$",
    "phone": r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]", "secret": r"^(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64})$", "ssn": r"^[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "person": r"^(?:(?:Mr|Mrs|Ms|Dr|Prof)\.? )?\p{Lu}\p{Ll}{2,} \p{Lu}\p{Ll}+$",
}
LABELERS = ["strict", "gazetteer", "context", "value"]
CONTEXT = 24


#: Matches are walked in blocks, as an array that grows costs the square of its size.
BLOCK = 256
#: Texts are looked up in pieces of so many code points, as finding a place costs its distance from the start.
PIECE = 1024
_FOUND = "array<struct<start:int,stop:int,value:string>>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(text: Column, pattern: str) -> Column:
    """The leftmost matches that don't overlap, as structs (start, stop, value), in code points; in time that grows with their number."""
    none = F.array().cast(_FOUND)

    def size(pair: Column) -> Column:
        return F.length(pair["gap"]) + F.coalesce(F.length(pair["value"]), F.lit(0))

    def step(state: Column, pair: Column) -> Column:
        start, stop = state["at"] + F.length(pair["gap"]), state["at"] + size(pair)
        found = F.struct(start.alias("start"), stop.alias("stop"), pair["value"].alias("value"))
        return F.struct(stop.alias("at"), F.when(pair["value"].isNull(), state["found"]).otherwise(F.array_append(state["found"], found)).alias("found"))

    def walked(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda n, pair: n + size(pair)))
        starts = F.aggregate(sizes, F.array(F.lit(0)), lambda known, n: F.array_append(known, F.element_at(known, -1) + n))
        each = F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), lambda block, at: F.aggregate(block, F.struct(at.alias("at"), none.alias("found")), step, lambda state: state["found"]))
        return F.flatten(each)

    def in_blocks(pairs: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int"))
        return _once(F.transform(numbers, lambda k: F.slice(pairs, k * BLOCK + 1, F.lit(BLOCK))), walked)

    def between(gaps: Column) -> Column:
        pairs = F.zip_with(gaps, F.regexp_extract_all(text, F.lit(pattern), 0), lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
        return F.when(F.size(gaps) > 1, _once(pairs, in_blocks)).otherwise(none)

    return _once(F.split(text, pattern, -1), between)


def _pieces(text: Column) -> Column:
    """A text in pieces of ``PIECE`` code points, a short one whole."""
    return F.when(F.length(text) <= 4 * PIECE, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), 0))


def _before(pieces: Column, start: Column) -> Column:
    """The ``CONTEXT`` code points before a place, or as many as there are."""
    first = F.greatest(start - CONTEXT, F.lit(0))
    piece = F.when(F.size(pieces) > 1, F.floor(first / PIECE).cast("int")).otherwise(F.lit(0))
    near = F.concat(F.get(pieces, piece), F.coalesce(F.get(pieces, piece + 1), F.lit("")))
    return F.substring(near, first - piece * PIECE + 1, F.least(start, F.lit(CONTEXT)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn check."""
    from_right = F.filter(F.split(F.reverse(_digits(value)), ""), lambda d: d != "")

    def weigh(d: Column, at: Column) -> Column:
        twice = d.cast("int") * F.when(at % 2 == 1, 2).otherwise(1)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(from_right, weigh), F.lit(0), lambda total, d: total + d) % 10 == 0


def _small_number(part: Column) -> Column:
    return F.regexp_replace(part, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")


def _valid(kind: str, value: Column) -> Column:
    """What a match must pass: for base kinds fixed checks, for a secret letters as well as digits."""
    if kind == "secret":
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _small_number)
    if kind == "card":
        return F.length(_digits(value)).between(12, 19) & _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _value_check(kind: str, value: Column) -> Column:
    """A labeler's view of the value alone."""
    if kind == "secret":  # letters and digits mixed, as in random strings
        return value.rlike("^[^0-9]*+[0-9]++[^0-9]++[0-9]++[^0-9]++[0-9]") & (F.length(_digits(value)) * 6 >= F.length(value))
    if kind == "ssn":
        return value.rlike("^(?!000|666|9)") & ~value.rlike("-00-|-0000$")
    if kind == "person":
        return F.length(value) <= 40
    if kind == "email":
        return F.length(value) <= 80
    return _valid(kind, value)


def _label(pieces: Column, rank: int, s: Column) -> Column:
    """A span with the labelers' votes."""
    kind = KINDS[rank]
    before = F.lower(_before(pieces, s["start"]))
    votes = [
        s["value"].rlike(STRICT[kind]), s["value"].rlike(GAZETTEER[kind]),
        before.rlike(r"(?:^|[^\p{L}])(?:" + CUES[kind] + r")[^\p{L}]*$"), _value_check(kind, s["value"]),
    ]
    return F.struct(
        s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"),
        *[v.cast("int").alias(name) for name, v in zip(LABELERS, votes, strict=True)],
        F.least(F.floor(F.log2(F.length(s["value"]))), F.lit(7)).cast("int").alias("size"),
    )


def _proposed(text: Column, pieces: Column, rank: int) -> Column:
    """The spans of one kind that pass its check, labelled."""
    kind = KINDS[rank]
    spans = _spans(text, BASE.get(kind) or ADDED[kind])
    return F.transform(F.filter(spans, lambda s: _valid(kind, s["value"])), lambda s: _label(pieces, rank, s))


def _candidates(text: Column) -> Column:
    """All proposed spans of a text as structs (start, rank, stop, votes, size), in this order."""
    return F.array_sort(_once(_pieces(text), lambda pieces: F.concat(*(_proposed(text, pieces, rank) for rank in range(len(KINDS))))))


def of_kind(spans: Column, rank: int) -> Column:
    return F.filter(spans, lambda s: s["rank"] == rank)


@dataclass(frozen=True)
class Reliability:
    """For each kind the share of true spans, and for each labeler how often it says yes to a true and to a false one."""

    prior: dict[int, float]
    yes_true: dict[str, float]
    yes_false: dict[str, float]

    def posterior(self, rank: int, votes: tuple[int, ...]) -> float:
        good, bad = self.prior[rank], 1 - self.prior[rank]
        for name, vote in zip(LABELERS, votes, strict=True):
            good *= self.yes_true[name] if vote else 1 - self.yes_true[name]
            bad *= self.yes_false[name] if vote else 1 - self.yes_false[name]
        return good / (good + bad)


def estimate(counts: dict[tuple[int, tuple[int, ...]], int], rounds: int = 30) -> Reliability:
    """Expectation-maximisation over counts of (kind, votes), at most 7 x 16 patterns.

    It starts from labelers that are right more often than not; one smoothing count each
    keeps shares off 0 and 1.
    """
    found = Reliability({rank: 0.5 for rank in range(len(KINDS))}, dict.fromkeys(LABELERS, 0.8), dict.fromkeys(LABELERS, 0.3))
    for _ in range(rounds):
        shares = {key: found.posterior(*key) for key in counts}
        prior, yes_true, yes_false = {}, {}, {}
        for rank in range(len(KINDS)):
            own = [(shares[k], n) for k, n in counts.items() if k[0] == rank]
            prior[rank] = (sum(p * n for p, n in own) + 1) / (sum(n for _, n in own) + 2)
        for at, name in enumerate(LABELERS):
            for side, out in ((lambda p: p, yes_true), (lambda p: 1 - p, yes_false)):
                total = sum(side(shares[k]) * n for k, n in counts.items())
                yes = sum(side(shares[k]) * n for k, n in counts.items() if k[1][at])
                out[name] = (yes + 1) / (total + 2)
        found = Reliability(prior, yes_true, yes_false)
    return found


def train(counts: dict[tuple[int, tuple[int, ...], int], int], rounds: int = 400) -> dict[str, float]:
    """Weights of a logistic span classifier over kind, votes and length class, fitted to the
    posteriors of the vote patterns, each weighed by its count's logarithm."""
    by_votes: dict[tuple[int, tuple[int, ...]], int] = {}
    for (rank, votes, _), n in counts.items():
        by_votes[rank, votes] = by_votes.get((rank, votes), 0) + n
    reliability = estimate(by_votes)
    rows = [([f"kind {rank}", f"size {size}", *(name for name, v in zip(LABELERS, votes, strict=True) if v)], reliability.posterior(rank, votes), math.log1p(n)) for (rank, votes, size), n in sorted(counts.items())]
    weights = {"bias": 0.0} | {name: 0.0 for features, _, _ in rows for name in features}
    total = sum(n for _, _, n in rows) or 1.0
    for _ in range(rounds):
        slope = dict.fromkeys(weights, 0.0)
        for features, target, n in rows:
            z = weights["bias"] + sum(weights[f] for f in features)
            error = (target - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) * n
            for f in ("bias", *features):
                slope[f] += error
        for f in weights:
            weights[f] += 2.0 * slope[f] / total - 1e-4 * weights[f]
    return weights


def _probability(weights: dict[str, float], s: Column) -> Column:
    z = F.lit(weights["bias"])
    for rank in range(len(KINDS)):
        z = z + F.when(s["rank"] == rank, weights.get(f"kind {rank}", 0.0)).otherwise(0.0)
    for size in range(8):
        z = z + F.when(s["size"] == size, weights.get(f"size {size}", 0.0)).otherwise(0.0)
    for name in LABELERS:
        z = z + s[name] * weights.get(name, 0.0)
    return 1 / (1 + F.exp(-z))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as (doc_id, spans): an array of structs (start, rank, stop,
    votes of each labeler, size), sorted by start and kind, whose rank points into KINDS.

    Places are code points, ends exclusive. Matches of one kind don't overlap; those of
    different kinds may. A null or empty text has no spans. Rows are judged one by one,
    repeated or not; other columns are ignored; no rows give no rows. A text of any length is searched whole, in time that
    grows with its length and its number of matches. Training reads counts of at most
    7 x 16 x 8 patterns, gathered over all rows.
    """
    found = cut(docs.select("doc_id", _candidates(F.coalesce("text", F.lit(""))).alias("spans")))
    s = F.col("s")
    tally = found.select(F.explode("spans").alias("s")).groupBy(s["rank"].alias("rank"), s["size"].alias("size"), *[s[n].alias(n) for n in LABELERS]).count()
    counts = {(r["rank"], tuple(r[n] for n in LABELERS), r["size"]): r["count"] for r in tally.collect()}
    weights = train(counts)
    return found.select("doc_id", F.filter("spans", lambda s: (s["rank"] < len(BASE)) | (_probability(weights, s) >= 0.5)).alias("spans"))


def named(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
