"""Quality rules judged for documents and, with shrunken failure rates, for their hosts.

A document fails the base rules by itself. Besides, the failures of every rule are added up
by host. The spread of the hosts' rates gives a beta prior (method of moments), each host's
rate is shrunk towards the mean by it, and a host with a shrunken rate above the rule's limit in any
rule loses all its documents. A rule's limit lies ``TAIL`` standard deviations of the prior above its
mean, but not below ``FLOOR``: a host of which more than three quarters pass stays, so that its good
documents do; and not above ``limit``: with few hosts the prior is so wide that no rate would exceed it.

NULL and empty texts have no words and fail the base rules. A NULL host is a host of its own.
Repeated rows are judged each. An empty table gives an empty result. Other columns are not
read. Two different 8-word windows of one text are taken as equal if their 64-bit hashes are.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landtrace.llm.common import BLANKS, blank_words, let, outer_id, packed, row_id, settle

SYMBOLS = "#*$%&|<>"
WINDOW = 8
LIMIT = 0.5
FLOOR = 0.25
TAIL = 3.0
SALTS = 32
RULES = ("short", "repeated", "symbols", "dup_lines")


def _covered(hashes: Column) -> Column:
    """Words below windows whose hash comes more than once; ``hashes`` is in text order."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        return F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))

    def words(at: Column) -> Column:
        steps = F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    places = let(ordered, lambda s: F.transform(twice(s), lambda x: x["i"]))
    return let(F.array_sort(places), words)


def _repeat_words(words: Column) -> Column:
    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return F.when(F.size(w) > WINDOW, let(hashes, lambda h: F.when(
            F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(F.lit(0).cast("long"))
        )).otherwise(F.lit(0).cast("long"))

    return let(words, of)


def text_features(text: Column) -> list[Column]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words."""
    words = blank_words(text)
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    counts = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    both = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("rep")))
    return [
        both.alias("_words"), counts.alias("_lines"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    ]


def _features(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    host = F.col(host_col).cast("string")
    rows = docs.select(
        row_id(id_col).alias("_id"), F.xxhash64(text).alias("_v"), F.coalesce(host, F.lit("")).alias("_host"),
        host.isNull().alias("_hostless"), *text_features(text),
    ).select(
        "_id", "_v", "_host", "_hostless", F.col("_words.n").alias("n_words"), "word_chars", "n_symbols",
        F.col("_lines.n").alias("n_lines"), F.col("_lines.dup").alias("n_dup_lines"),
        F.col("_words.rep").alias("n_repeat_words"),
    )
    return rows.select(
        "*",
        (F.col("n_words") < 20).alias("short"),
        (100 * F.col("n_repeat_words") > 30 * F.col("n_words")).alias("repeated"),
        (10 * F.col("n_symbols") > F.col("word_chars")).alias("symbols"),
        (100 * F.col("n_dup_lines") > 30 * F.col("n_lines")).alias("dup_lines"),
    )


def host_rates(features: DataFrame, limit: float = LIMIT) -> DataFrame:
    """One row per host: its documents, its shrunken rate by rule, and whether it is ``bad``.

    ``limit`` is the most that a rule's limit can be.
    """
    hosts = features.groupBy("_host", "_hostless").agg(
        F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES])
    hosts = settle(hosts)
    # one row: the moments of the hosts' rates
    sums = hosts.agg(
        F.count("*").alias("hosts"), F.sum("n").alias("n"), *[F.sum(r).alias(r) for r in RULES],
        *[F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_squares") for r in RULES],
    ).first()

    def prior(rule: str) -> tuple[float, float]:
        mean = (sums[rule] or 0) / (sums["n"] or 1)
        return mean, prior_strength(mean, sums[f"{rule}_squares"] or 0.0, sums["n"] or 1, sums["hosts"] or 1)

    priors = {r: prior(r) for r in RULES}
    rates = hosts.select("_host", "_hostless", "n", *[
        ((F.col(r) + F.lit(strength * mean)) / (F.col("n") + F.lit(strength))).alias(r)
        for r, (mean, strength) in priors.items()])
    return rates.withColumn("bad", reduce(or_, [F.col(r) > rule_limit(*priors[r], limit) for r in RULES]))


def rule_limit(mean: float, strength: float, limit: float = LIMIT) -> float:
    """The rate that a host may not exceed, from the prior's mean and strength."""
    spread = math.sqrt(max(mean * (1 - mean), 0.0) / (strength + 1))
    return min(limit, max(FLOOR, mean + TAIL * spread))


def prior_strength(mean: float, squares: float, n: float, hosts: float) -> float:
    """alpha + beta of the prior: the documents that the mean rate counts for."""
    inside = mean * (1 - mean)
    if inside <= 0 or hosts < 2:
        return 0.0
    each = n / hosts
    if each <= 1:
        return 1.0
    share = (squares / n - mean * mean - inside / each) / (inside * (1 - 1 / each))
    share = min(max(share, 1e-6), 1.0)
    return (1 - share) / share


def _judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, limit: float) -> DataFrame:
    features = settle(_features(docs, id_col, text_col, host_col))
    bad = host_rates(features, limit).filter("bad").select("_host", "_hostless", F.lit(True).alias("_bad"))
    # a host may hold a third of all rows, so each verdict is dealt to SALTS places
    bad = bad.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = features.withColumn("_salt", F.pmod(F.xxhash64("_id", "_v"), F.lit(SALTS)).cast("int"))
    failed = F.col("short") | F.col("repeated")
    return rows.join(bad, ["_host", "_hostless", "_salt"], "left").withColumn("base_failed", failed).withColumn(
        "kept", ~failed & F.col("_bad").isNull())


def host_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = LIMIT,
) -> DataFrame:
    """Features and verdict of every document."""
    return _judged(docs, id_col, text_col, host_col, limit).select(
        outer_id().alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def keep_good(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = LIMIT,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep."""
    kept = _judged(docs, id_col, text_col, host_col, limit).filter("kept").select("_id", "_v").distinct()
    return packed(docs, id_col, text_col).join(kept, ["_id", "_v"], "left_semi").select("_row.*")


