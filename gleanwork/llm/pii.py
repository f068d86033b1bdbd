"""Personal data by patterns, and further spans by weak supervision.

Patterns find the base kinds with places in code points. For names, identity numbers and
local phone numbers a pattern only proposes candidates: three labelers (shape, gazetteer,
context) vote on each, expectation-maximisation over the counts of their votes estimates how
reliable each is, and the resulting soft labels train a classifier over votes and features
of the span. Counts cover all candidates; at most a few hundred combinations exist, so the
counts, not the spans, reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.llm.common import staged

# A match starts after the previous one or where its first run starts, so that failing runs
# are scanned once, and runs that cannot give back are possessive. Longer runs of digits
# than a card's are left out by the bounds around them.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
CANDIDATES = {
    "name": r"(?<![A-Za-z])[A-Z][a-z]+ [A-Z][a-z]+(?![A-Za-z])",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+.-])[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}(?![0-9])",
}
SHAPES = {
    "name": r"^([A-Z][a-z]{1,11}) (?!\1$)[A-Z][a-z]{1,14}$",
    "id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "local_phone": r"^[2-9][0-9]{2}([-. ])[2-9][0-9]{2}\1",
}
FIRST_NAMES = """Alice Anna Anne Antonio Barbara Carlos Charles Christopher Claire Daniel David Diego
Elena Elizabeth Emily Emma Eva Hannah Hans Helen Ivan James Jane Jean Jennifer Jessica John Jose Joseph
Juan Julia Karen Kevin Laura Linda Lisa Lucas Luis Maria Marie Mark Martin Mary Michael Nancy Nicolas
Olivia Patricia Paul Peter Pierre Richard Robert Sandra Sarah Sofia Sophie Susan Thomas William""".split()
PLACEHOLDERS = ["123-45-6789", "078-05-1120", "219-09-9999", "123-456-7890"]
CUES = (
    r"(?i)(?<![a-z])(?:name|contact|call|phone|tel|mobile|ssn|social security|dear|mr|mrs|ms|dr|signed|regards)"
    r"(?: is| no| number)?[ .,:#\n-]{0,4}$"
)
LABELERS = ["shape", "gazetteer", "context"]
THRESHOLD = 0.9
ROUNDS = 50
_SPAN = "array<struct<start:int,end:int,found:string,before:string>>"


def spans(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap: start, end, the match, and 40 code points before it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    pairs = F.zip_with(gaps, found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("found"), F.right(gap, F.lit(40)).alias("before")))

    def add(state: Column, pair: Column) -> Column:
        start = state.at + pair.gap
        end = start + F.length(pair.found)
        span = F.struct(start.alias("start"), end.alias("end"), pair.found.alias("found"), pair.before.alias("before"))
        return F.struct(end.alias("at"), F.concat(state.out, F.array(span)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    # texts without a match are the most; they need no walk
    return F.when(F.size(found) > 0, F.aggregate(pairs, zero, add, lambda state: state.out)).otherwise(F.array().cast(_SPAN))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(place: Column) -> Column:
        digit = F.substring(F.reverse(digits), place, F.lit(1)).cast("int")
        doubled = digit * F.when(place % 2 == 0, 2).otherwise(1)
        return doubled - F.when(doubled > 9, 9).otherwise(0)

    places = F.sequence(F.lit(1), F.length(digits))
    return F.aggregate(places, F.lit(0), lambda total, place: total + value(place)) % 10 == 0


def _holds(kind: str, found: Column) -> Column:
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return found.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return _luhn(_digits(found))
    if kind == "phone":
        return F.length(_digits(found)).between(8, 15)
    return F.lit(True)


def _votes(kind: str, span: Column) -> list[Column]:
    known = F.split_part(span.found, F.lit(" "), F.lit(1)).isin(FIRST_NAMES) if kind == "name" else ~span.found.isin(PLACEHOLDERS)
    return [span.found.rlike(SHAPES[kind]), known, span.before.rlike(CUES)]


def _key(kind: str, span: Column) -> Column:
    """What the classifier knows of a candidate: kind, votes, length, and what stands before it."""
    votes = [F.when(vote, "1").otherwise("0") for vote in _votes(kind, span)]
    length = F.when(F.length(span.found) <= 10, "short").when(F.length(span.found) <= 18, "middle").otherwise("long")
    last = F.right(span.before, F.lit(2))
    place = F.when(last == "", "start").when(last.rlike(r"[.!?\n]\s?$"), "sentence").when(last.rlike(r"[a-z] $"), "word").otherwise("other")
    return F.concat_ws("|", F.lit(kind), *votes, length, place)


def _base_spans(kind: str) -> Column:
    good = F.filter(kind, lambda s: _holds(kind, s.found))
    return F.transform(good, lambda s: F.struct(F.lit(kind).alias("kind"), s.start.alias("start"), s.end.alias("end")))


def _candidate_spans(kind: str) -> Column:
    return F.transform(
        kind, lambda s: F.struct(F.lit(kind).alias("kind"), s.start.alias("start"), s.end.alias("end"), _key(kind, s).alias("key"))
    )


def count_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")


def found_in(docs: DataFrame) -> DataFrame:
    """``doc_id, base, candidates`` of each row; places are code points, ends exclusive."""
    df = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.select("doc_id", *[spans(F.col("text"), p).alias(kind) for kind, p in {**BASE, **CANDIDATES}.items()])
    base = [_base_spans(kind) for kind in BASE]
    more = [_candidate_spans(kind) for kind in CANDIDATES]
    df = df.select("doc_id", F.concat(*base).alias("base"), F.concat(*more).alias("more"))
    apart = lambda c: ~F.exists("base", lambda b: (b.start < c.end) & (c.start < b.end))
    return df.select("doc_id", "base", F.filter("more", apart).alias("candidates"))


def accepted(counts: dict[str, int]) -> dict[str, float]:
    """Probability of each key, from how often each occurs.

    Beta priors keep a labeler from turning round: hits start at 8 of 10, false alarms at 1
    of 10, personal data at 1 candidate of 10.
    """
    rows = [(key.split("|"), n) for key, n in counts.items()]
    size = len(LABELERS)
    hit, alarm, share = [0.8] * size, [0.1] * size, 0.1
    soft: list[float] = []
    for _ in range(ROUNDS):
        soft = []
        for parts, _n in rows:
            yes, no = share, 1 - share
            for j, vote in enumerate(parts[1 : 1 + size]):
                yes *= hit[j] if vote == "1" else 1 - hit[j]
                no *= alarm[j] if vote == "1" else 1 - alarm[j]
            soft.append(yes / (yes + no))
        ones = sum(n * p for (_, n), p in zip(rows, soft))
        zeros = sum(n for _, n in rows) - ones
        share = (1 + ones) / (10 + ones + zeros)
        for j in range(size):
            voted = [(n, p) for (parts, n), p in zip(rows, soft) if parts[1 + j] == "1"]
            hit[j] = (8 + sum(n * p for n, p in voted)) / (10 + ones)
            alarm[j] = (1 + sum(n * (1 - p) for n, p in voted)) / (10 + zeros)

    def weight(place: int, value: str) -> float:
        at = [(n, p) for (parts, n), p in zip(rows, soft) if parts[place] == value]
        yes = (sum(n * p for n, p in at) + 1) / (ones + 4)
        no = (sum(n * (1 - p) for n, p in at) + 1) / (zeros + 4)
        return max(-2.0, min(2.0, math.log(yes / no)))

    scores = {}
    for (parts, _n), p in zip(rows, soft):
        p = min(max(p, 1e-12), 1 - 1e-12)
        logit = math.log(p / (1 - p)) + sum(weight(place, parts[place]) for place in (1 + size, 2 + size))
        scores["|".join(parts)] = 1 / (1 + math.exp(-logit))
    return scores


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, base, added`` with arrays of ``kind, start, end`` for every row of ``docs(doc_id, text)``.

    Null and empty texts have no spans; repeated rows each keep their own. Added spans are
    candidates with a probability of at least ``THRESHOLD`` that overlap no base span. An
    empty table trains nothing and gives no rows.
    """
    rows = staged(found_in(docs), "pii")
    keys = rows.select(F.explode("candidates.key").alias("key")).groupBy("key").count()
    scores = accepted({row["key"]: row["count"] for row in keys.collect()})  # bounded by the kinds of keys
    chosen = sorted(key for key, p in scores.items() if p >= THRESHOLD)
    good = F.filter("candidates", lambda c: c.key.isin(chosen) if chosen else F.lit(False))
    added = F.transform(good, lambda c: F.struct(c.kind.alias("kind"), c.start.alias("start"), c.end.alias("end")))
    return rows.select("doc_id", "base", added.alias("added"))


def written(found: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
