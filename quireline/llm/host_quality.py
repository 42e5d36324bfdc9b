"""Host-level quality rules, in DataFrame functions only.

Each document gets word statistics and fails or passes each of five rules (``RULES``). Failures are
counted by host and rule. For each rule a beta prior is fitted to all hosts: its mean is the share of
all documents that fail, its strength follows from how much more the hosts' rates differ than
sampling alone would have them differ, hosts weighing by their documents. Each host's rate is shrunk
toward it, and a host with a shrunk rate above one half for any rule is rejected with all its documents.

Defined results: a null text has no words (``base_failed``); a text of any length is read whole, as one
row's arrays; a shrunk rate of exactly one half passes; rows with a null host form one host; repeated
rows count, and come back, once each; an empty table gives an empty result. Carried columns come back
inside one struct, so their names clash with nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireline.llm.scratch import cut, small

#: Fixed values of the rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: A host goes when more than this share of its documents is expected to fail.
MAX_HOST_RATE = 0.5
#: Hosts up to which their verdicts are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 100_000
#: Pseudo-documents of the prior where hosts differ no more than sampling has them differ.
FALLBACK_STRENGTH = 100.0
#: The rules: SQL over ``BASE`` that is true for a document which fails. The first two make up ``base_failed``.
RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "5 * n_dup_lines > n_words",
    "word_length": "word_chars < 3 * n_words OR word_chars > 12 * n_words",
}

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(windows: Column) -> Column:
    """Words inside 3-word windows that occur twice or more; ``windows``: a hash for each window."""

    def covered(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        repeated = F.filter(
            pairs,
            lambda p, k: ((k > 0) & (F.element_at(pairs, F.greatest(k, F.lit(1))).h == p.h))
            | ((k < last) & (F.element_at(pairs, F.least(k + 2, last + 1)).h == p.h)),
        )
        starts = F.sort_array(F.transform(repeated, lambda p: p.i))

        def summed(s: Column) -> Column:
            added = F.transform(s, lambda x, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), x - F.element_at(s, F.greatest(k, F.lit(1))))))
            return F.aggregate(added, F.lit(0), lambda a, x: a + x)

        return _let(starts, summed)

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_let(pairs, covered))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``BASE`` (long) and ``base_failed``; 3-word windows are compared by XXH64."""
    t = F.coalesce(F.col(text), F.lit(""))
    white = r"[\x20\x09-\x0D]+"
    df = docs.withColumn("_words", F.regexp_extract_all(t, F.lit(r"[^\x20\x09-\x0D]+"), 0))
    n = F.size("_words")
    w = F.col("_words")
    df = df.withColumn(
        "_windows",
        F.when(
            n >= 3,
            F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    df = df.withColumn("_lines", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.regexp_replace(t, white, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": _repeat_words(F.col("_windows")).cast("long"),
        }
    ).drop("_words", "_windows", "_lines").withColumn("base_failed", F.expr(RULES["short"]) | F.expr(RULES["repeats"]))


def host_verdicts(judged: DataFrame, host: str = "_host", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row for each host: its documents, the shrunk rate of each rule, ``host_rate`` (the highest) and ``host_failed``."""
    fails = [F.count_if(F.expr(rule)).alias(f"_{name}") for name, rule in RULES.items()]
    hosts = cut(judged.groupBy(host).agg(F.count(F.lit(1)).alias("_docs"), *fails), "hosts")
    sums = [F.sum(x).alias(n) for name in RULES for n, x in ((f"f_{name}", F.col(f"_{name}")), (f"q_{name}", F.col(f"_{name}") * F.col(f"_{name}") / F.col("_docs")))]
    all_ = hosts.agg(F.count(F.lit(1)).alias("h"), F.sum("_docs").alias("n"), F.sum(F.col("_docs") * F.col("_docs")).cast("double").alias("nn"), *sums).first()  # a few numbers, however many hosts there are
    rates = {}
    for name in RULES:
        mean, strength = prior(all_["h"], all_["n"] or 0, all_["nn"] or 0.0, all_[f"f_{name}"] or 0, all_[f"q_{name}"] or 0.0)
        rates[f"rate_{name}"] = (F.col(f"_{name}") + F.lit(mean * strength)) / (F.col("_docs") + F.lit(strength))
    out = hosts.withColumns(rates).withColumn("host_rate", F.greatest(*rates))
    return out.withColumn("host_failed", F.col("host_rate") > max_rate)


def prior(hosts: int, docs: int, squares: float, fails: int, weighted: float) -> tuple[float, float]:
    """Mean and strength of the beta prior by weighted moments.

    ``squares`` is the sum over hosts of documents squared, ``weighted`` that of failures squared by
    documents. Of the weighted squares of the rates around their mean, what sampling gives is taken
    off; what is left is the variance between hosts.
    """
    if not docs:
        return 0.0, FALLBACK_STRENGTH
    mean = fails / docs
    spread = weighted - fails * fails / docs
    room = docs - squares / docs
    between = (spread - (hosts - 1) * mean * (1 - mean)) / (room - (hosts - 1)) if room > hosts - 1 else 0.0
    strength = mean * (1 - mean) / between - 1 if between > 0 else 0.0
    return mean, strength if strength > 0 else FALLBACK_STRENGTH


def host_quality(docs: DataFrame, carry: Sequence[str], text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``doc`` (a struct of the carried columns of ``docs``) beside ``BASE``, ``base_failed``, ``kept`` and ``host_rate``.

    The measured rows are written once, so the costly text functions run once though hosts are
    counted before their verdicts are joined.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), F.col(text).alias("_text"), F.col(host).alias("_host"))
    judged = cut(measured(rows, "_text").drop("_text"), "quality")
    verdicts = cut(host_verdicts(judged, max_rate=max_rate).select(F.col("_host").alias("_h"), "host_rate", "host_failed"), "hosts")
    joined = judged.join(small(verdicts, MAX_BROADCAST), F.col("_host").eqNullSafe(F.col("_h")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")).select("doc", *BASE, "base_failed", "kept", "host_rate")
