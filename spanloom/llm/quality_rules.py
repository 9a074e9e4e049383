"""Quality rules with host verdicts, in DataFrame functions only.

Each text gets counts (words, symbols, repeated lines and word windows) and
from them rule failures. Failures are summed by host; a host's failure rate is
shrunk by a beta prior whose two numbers are fitted to all hosts by moments, so
a host with few documents is judged by its peers. The shrunken rate is then the
prior of each of the host's documents: its odds times the likelihood ratio of
what the document's own rules say (``RATIOS``) are the odds that the document is
bad, and it is kept while they are below one. A document that misses a hard
limit is thus kept only on a host that hardly ever fails, one that misses
a strict limit only on a host of ordinary rate, and one that passes all limits
unless nearly all else on its host fails.

Defined results: null text counts as empty (all counts 0, base_failed); a null
host is a host of its own; repeated rows are judged one by one; an empty table
gives an empty table; extra columns don't take part (``judged_documents`` keeps
them, and takes names that aren't in the table for its own columns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, stored, text_or_empty

#: Limits of the rules: (hard, strict). Shares of words, lines and letters.
LIMITS = {
    "symbols": (0.3, 0.15),
    "dup_lines": (0.5, 0.3),
    "word_length": (20.0, 14.0),
}
#: How much likelier a bad document is than a good one to miss a hard limit, a strict one only, and none.
RATIOS = (40.0, 3.0, 0.2)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _in_repeated_windows(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Windows are compared by a 64-bit hash. The hashes are sorted with their
    positions; equal neighbours are repeats; their positions and the two after
    each are counted once. Cost n log n in one row, memory one text.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))

    def repeats(h: Column) -> Column:
        tagged = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(
            tagged,
            lambda s: F.size(
                F.array_distinct(
                    F.flatten(
                        F.transform(
                            F.filter(
                                F.transform(
                                    s,
                                    lambda x, k: F.struct(
                                        ((F.get(s, k - 1)["h"] == x["h"]).eqNullSafe(True) | (F.get(s, k + 1)["h"] == x["h"]).eqNullSafe(True)).alias("twice"),
                                        x["i"].alias("i"),
                                    ),
                                ),
                                lambda x: x["twice"],
                            ),
                            lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2),
                        )
                    )
                )
            ),
        )

    found = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeats(h)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(found).cast("long")


def text_counts(text: Column) -> Column:
    """A struct of the five counts and n_lines (lines with a word) of a non-null text."""
    squeezed = F.regexp_replace(text, SPACE, " ")

    def with_words(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
        pair = _let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("distinct")))
        return _let(
            pair,
            lambda p: F.struct(
                F.size(words).cast("long").alias("n_words"),
                (F.length(squeezed) - F.regexp_count(squeezed, F.lit(" "))).cast("long").alias("word_chars"),
                (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
                (p["all"] - p["distinct"]).cast("long").alias("n_dup_lines"),
                _in_repeated_windows(words).alias("n_repeat_words"),
                p["all"].cast("long").alias("n_lines"),
            ),
        )

    return _let(F.filter(F.split(squeezed, " "), lambda w: w != ""), with_words)


BASE, HARD, STRICT = 1, 2, 4


def failure_code(c: Column) -> Column:
    """Bits of a struct of counts: BASE, HARD (any hard limit missed), STRICT (any strict limit missed)."""
    words, lines = F.greatest(c["n_words"], F.lit(1)), F.greatest(c["n_lines"], F.lit(1))
    base = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])

    def missed(k: int) -> Column:
        return (c["n_symbols"] / words > LIMITS["symbols"][k]) | (c["n_dup_lines"] / lines > LIMITS["dup_lines"][k]) | (c["word_chars"] / words > LIMITS["word_length"][k])

    return F.when(base, BASE).otherwise(0) + F.when(missed(0), HARD).otherwise(0) + F.when(missed(1), STRICT).otherwise(0)


def text_code(text: Column) -> Column:
    """Failure bits of a non-null text, as one number: fields of a struct would be taken out, and counted, one by one.
    It can't be null, so no filter for nulls, which would count the text once more, is inferred from its use."""
    return F.coalesce(_let(text_counts(text), failure_code), F.lit(0))


def host_rates(failures: DataFrame) -> DataFrame:
    """(host, n, failed, rate) from rows (host, failed boolean), the rate shrunk.

    The prior's mean m is the share of failures over all hosts' rows and its
    strength comes from the variance of the hosts' rates around m, less what
    sampling alone explains. One row of totals is joined to all hosts.
    """
    # read twice below, and made from whole texts
    hosts = stored(failures.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("int")).alias("failed")), "quality-hosts")
    raw = F.col("failed") / F.col("n")
    totals = hosts.agg(
        (F.sum("failed") / F.sum("n")).alias("_m"),
        F.sum(F.col("n") * raw * raw).alias("_s2"),
        F.sum("n").alias("_n"),
        F.count("*").alias("_k"),
    )
    m = F.col("_m")
    spread = F.col("_s2") / F.col("_n") - m * m
    sampling = m * (1 - m) * F.col("_k") / F.col("_n")
    between = F.greatest(spread - sampling, F.lit(1e-6))
    strength = F.greatest(F.lit(2.0), F.least(F.lit(1e4), m * (1 - m) / between - 1))
    a = F.col("failed") + m * F.col("_strength")
    b = F.col("n") - F.col("failed") + (1 - m) * F.col("_strength")
    return hosts.crossJoin(F.broadcast(totals.withColumn("_strength", strength))).select("host", "n", "failed", (a / (a + b)).alias("rate"))


def _with_rate(df: DataFrame, hosts: DataFrame, host: str) -> DataFrame:
    """Joins the rates on ``host`` (null equals null); Spark broadcasts them if small, else splits skewed hosts."""
    side = hosts.select(F.col("host").alias("_host_key"), F.col("rate").alias("_rate"))
    return df.join(side, F.col(host).eqNullSafe(F.col("_host_key")), "left").drop("_host_key")


def _kept(code: Column) -> Column:
    """Odds below one: rate / (1 - rate) * ratio < 1. One comparison rather than a conjunction, whose parts
    Catalyst would push below the join, each with the counts computed anew."""
    hard, strict, none = RATIOS
    ratio = F.when(code.bitwiseAND(HARD) != 0, hard).when(code.bitwiseAND(STRICT) != 0, strict).otherwise(none)
    return F.coalesce(F.when(code.bitwiseAND(BASE) != 0, 1.0).otherwise(F.col("_rate") * (1 + ratio)), F.lit(1.0)) < 1


def quality_report(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row a document: doc_id, the counts, base_failed, kept, host, host_rate."""
    counted = docs.select("doc_id", F.col(host).alias("host"), text_or_empty().alias("_text")).select("doc_id", "host", text_counts(F.col("_text")).alias("_counts"))
    rows = stored(counted, "quality-counts").withColumn("_code", failure_code(F.col("_counts")))
    hosts = host_rates(rows.select("host", (F.col("_code").bitwiseAND(BASE | HARD) != 0).alias("failed")))
    return _with_rate(rows, hosts, "host").select(
        "doc_id", *[F.col(f"_counts.{c}").alias(c) for c in COUNTS], (F.col("_code").bitwiseAND(BASE) != 0).alias("base_failed"), _kept(F.col("_code")).alias("kept"), "host", F.col("_rate").alias("host_rate")
    )


def judged_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    Texts are counted twice, once for the hosts and once for the rows, rather
    than shuffled or written a second time.
    """
    clash = {c: f"_own{c}" for c in docs.columns if c in ("_code", "_rate", "_host_key")}
    counted = docs.withColumnsRenamed(clash).withColumn("_code", text_code(text_or_empty()))
    failed = counted.select(F.col(host).alias("host"), (F.col("_code").bitwiseAND(BASE | HARD) != 0).alias("failed"))
    kept = _with_rate(counted, host_rates(failed), host).where(_kept(F.col("_code"))).drop("_code", "_rate")
    return kept.withColumnsRenamed({v: k for k, v in clash.items()}).select(*docs.columns)
