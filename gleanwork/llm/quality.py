"""Quality rules as a ledger of failure bits.

Each rule is evaluated once per document. The ledger stores the measurements and one bit
per failed rule; a policy is a mask over these bits with a version name, so changing a
policy or asking what a rule costs needs no second look at the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.llm.common import packed, unpacked, words

SYMBOLS = "[#*$%&|<>]+"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` is true; its bit is its place in ``RULES``."""

    name: str
    fails: str


RULES = [
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("many_symbols", "100 * n_symbols > 20 * n_words"),
    Rule("shouting", "100 * n_upper > 50 * word_chars"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("stutter", "100 * n_stutter > 30 * n_words"),
    Rule("odd_word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
]
BITS = {rule.name: 1 << place for place, rule in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BITS[name] for name in names)


# Versions stay as they are once used; a change of mind is a new version.
POLICIES = {
    "base": mask("few_words", "repeated_words"),
    "v1": mask("few_words", "repeated_words", "many_symbols", "shouting"),
    "v2": mask(*BITS),
}
MEASURES = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_stutter",
]


def _head(name: str, less: int) -> Column:
    """An array without its last ``less`` elements."""
    return F.slice(name, 1, F.greatest(F.size(name) - less, F.lit(0)))


def _tail(name: str, less: int) -> Column:
    """An array without its first ``less`` elements."""
    return F.slice(name, less + 1, F.greatest(F.size(name) - less, F.lit(0)))


def _repeat_words(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words covered by windows of five found twice or more in the row.

    ``g`` has the words' hashes.

    Everything stays inside the row. Most rows have only distinct windows and end after a
    hash set; for the others the windows are sorted by hash, and the positions of equal
    neighbours are merged.
    """
    # each hash takes two that cover neighbouring words: 1 + 1, 2 + 2, 4 + 1
    df = df.withColumn("h2", F.zip_with(_head("g", 1), _tail("g", 1), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("h4", F.zip_with(_head("h2", 2), _tail("h2", 2), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("h", F.zip_with(_head("h4", 1), _tail("g", 4), lambda a, b: F.xxhash64(a, b)))
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    placed = F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("s", F.when(repeats, F.sort_array(placed)))
    same = lambda x, i: F.coalesce(x["h"] == F.get(F.col("s"), i - 1)["h"], F.lit(False)) | F.coalesce(
        x["h"] == F.get(F.col("s"), i + 1)["h"], F.lit(False)
    )
    df = df.withColumn("p", F.sort_array(F.transform(F.filter("s", same), lambda x: x["i"])))
    step = lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("p"), i + 1) - x, F.lit(WINDOW)))
    covered = F.aggregate(F.transform("p", step), F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint"))


def ledger(docs: DataFrame) -> DataFrame:
    """``doc`` (the row), the measurements, and ``failed_rules`` (one bit per failed rule).

    A null text counts as empty: all measurements are 0 and ``few_words`` fails. Rows are
    judged one by one, so repeated rows get equal results and null keys do no harm.
    """
    text = F.coalesce(F.col("doc").getField("text"), F.lit(""))
    df = packed(docs).withColumn("text", text).withColumn("w", words(F.col("text")))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    df = _repeat_words(df.withColumn("g", F.transform("w", lambda x: F.xxhash64(x))))
    again = F.zip_with(_head("g", 1), _tail("g", 1), lambda a, b: a == b)
    df = df.select(
        "doc",
        F.size("w").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", "\\p{Lu}+", ""))).cast("bigint").alias("n_upper"),
        F.size(F.array_remove(again, False)).cast("bigint").alias("n_stutter"),
    )
    failed = F.lit(0).cast("bigint")
    for rule in RULES:
        failed = failed.bitwiseOR(F.when(F.expr(rule.fails), F.lit(BITS[rule.name])).otherwise(F.lit(0)))
    return df.withColumn("failed_rules", failed)


def passes(policy: str = "v2") -> Column:
    """True where a ledger row breaks no rule of the policy."""
    return F.col("failed_rules").bitwiseAND(F.lit(POLICIES[policy])) == 0


def keep_good(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The documents that the policy keeps, with their columns as given.

    The bits pass through a generator, which a filter is never pushed below: put under the
    ledger's projections, it would write the measurements out again in each condition.
    """
    rows = ledger(docs).select("doc", F.inline(F.array(F.struct("failed_rules"))))
    return unpacked(rows.filter(passes(policy)), docs.columns)


def ablation(rows: DataFrame) -> DataFrame:
    """What each rule costs under each policy: ``policy, rule, n_failed, n_only, n_rejected``.

    ``n_failed`` documents break the rule, ``n_only`` would be kept without it. Counts are
    taken per bit pattern first (at most two to the number of rules), then by masks.
    """
    patterns = rows.groupBy("failed_rules").agg(F.count(F.lit(1)).alias("n"))
    cases = [
        F.struct(F.lit(policy).alias("policy"), F.lit(name).alias("rule"), F.lit(BITS[name]).alias("bit"), F.lit(m).alias("mask"))
        for policy, m in POLICIES.items()
        for name in BITS
        if BITS[name] & m
    ]
    df = patterns.select("n", "failed_rules", F.explode(F.array(*cases)).alias("c")).select("n", "failed_rules", "c.*")
    hit = F.col("failed_rules").bitwiseAND(F.col("mask"))
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0)))
    return df.groupBy("policy", "rule").agg(
        total(hit.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(hit == F.col("bit")).alias("n_only"),
        total(hit != 0).alias("n_rejected"),
    )
