"""Quality rules with risk-controlled thresholds, with DataFrame functions only.

Each rule rejects a text whose value lies beyond a cutoff. The cutoffs are not
set by hand: each stratum has a fixed sequence of joint vectors, from the
loosest cutoff of every rule to the strictest of every rule, and each vector is
tested on the labelled holdout. With k of the n good holdout texts rejected by
any of its rules, the exact binomial tail P(X <= k | n, alpha) is the p-value of
"these cutoffs together reject more than alpha of the good texts". The vectors
are tested in order, each at the Bonferroni level delta / strata, up to the
first that fails; the last one before it is used.

Why that holds: what a vector rejects, every later one rejects as well, so the
true shares of rejected good texts rise along the sequence. A stratum gets a
vector of a share over alpha only if the first such vector passes its test,
which happens with probability delta / strata at most. So the vectors need no
further share of delta, nor the rules one of alpha, and with probability
1 - delta no stratum loses more than alpha of its good texts to the rules. A
vector can be certified from ``least_holdout()`` good texts in a stratum on.

The strata are bands of text length, the holdout is the labelled rows that pass
the fixed base rules. Counts per (stratum, vector) form a table of some twenty rows
whatever the input; the cutoffs, a row a stratum, are broadcast.
"""

from __future__ import annotations

from itertools import pairwise
from math import ceil, log, log1p

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum.llm.common import SPACE_CLASS, scratch

ALPHA = 0.02
DELTA = 0.05
#: Lower ends of the bands of words that are the strata.
BANDS = (0, 200, 800)
#: Rule -> (its value of the base columns, cutoffs from strict to loose, equally many); a text above the cutoff is rejected.
RULES = {
    "symbols": ("n_symbols / n_words", (0.02, 0.05, 0.1, 0.2, 0.4, 0.8, 1.6)),
    "dup_lines": ("n_dup_lines / n_words", (0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.16)),
    "repeats": ("n_repeat_words / n_words", (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4)),
    "long_words": ("word_chars / n_words", (5.0, 5.5, 6.0, 7.0, 8.0, 10.0, 14.0)),
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the five counts and base_failed; a null text has no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    carried = [c for c in docs.columns if c not in (*BASE, "base_failed", "kept")]
    rows = docs.select(*carried, text.alias("_text")) \
        .withColumn("_words", F.array_remove(F.split("_text", SPACE_CLASS), "")) \
        .withColumn("n_words", F.size("_words").cast("long"))
    # a hash for each window of three words; equal windows of a text are found by sorting (hash, place)
    rows = rows.withColumn("_wins", F.expr(
        "case when n_words > 3 then transform(sequence(0, cast(n_words as int) - 3), "
        "i -> xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2))) else array() end"))
    rows = rows.withColumn("_sorted", F.expr(
        "case when size(array_distinct(_wins)) < size(_wins) then "
        "sort_array(arrays_zip(_wins, sequence(0, size(_wins) - 1))) else null end"))
    rows = rows.withColumn("_again", F.expr(
        "case when _sorted is null then array() else "
        "sort_array(transform(filter(sequence(0, size(_sorted) - 1), i -> "
        "coalesce(get(_sorted, i)._wins = get(_sorted, i - 1)._wins, false) or "
        "coalesce(get(_sorted, i)._wins = get(_sorted, i + 1)._wins, false)), "
        "i -> get(_sorted, i)['1'])) end"))
    # each repeated window covers three words, less those that the next one covers as well
    covered = ("case when size(_again) = 0 then 0L else cast(3 + aggregate(sequence(0, size(_again) - 1), 0L, "
               "(a, i) -> a + if(i = 0, 0, least(3, get(_again, i) - get(_again, i - 1)))) as long) end")
    lines = "filter(split(_text, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    rows = rows.withColumn("n_repeat_words", F.expr(covered)) \
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long")) \
        .withColumn("n_symbols", F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long")) \
        .withColumn("_lines", F.expr(lines)) \
        .withColumn("n_dup_lines", F.expr("cast(size(_lines) - size(array_distinct(_lines)) as long)"))
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return rows.select(*carried, *BASE, failed.alias("base_failed"))


def stratum() -> Column:
    """The index of the text's band of words."""
    return F.expr(" + ".join(f"cast(n_words >= {low} as int)" for low in BANDS[1:]) or "0")


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 8, carried back."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - 1 / (1680 * y ** 7)
    down = F.lit(0.0)
    for k in range(8):
        down = down + F.log(x + k)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - down


def binomial_tail(k: str, n: str, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), from the term at k downwards.

    Below the mean the terms fall without end; those more than 40 standard
    deviations under it are smaller than any double and left out, so the length
    of the sum grows with the square root of n.
    """
    c, m = F.col(k).cast("double"), F.col(n).cast("double")
    at = log_gamma(m + 1) - log_gamma(c + 1) - log_gamma(m - c + 1) + c * F.log(F.lit(p)) + (m - c) * F.log(F.lit(1 - p))
    steps = (f"sequence(0L, greatest(0L, cast({k} - greatest(0, {n} * {p!r} - 40 * sqrt({n} * {p!r}) - 50) as long)))")
    odds = (1 - p) / p
    total = F.expr(f"aggregate({steps}, named_struct('t', 1D, 's', 0D), (a, i) -> named_struct("
                   f"'t', a.t * greatest(0D, cast({k} - i as double)) / ({n} - {k} + i + 1) * {odds!r}D, 's', a.s + a.t), "
                   "a -> a.s)")
    tail = F.least(F.lit(1.0), F.exp(at) * total)
    # above the mean the tail is no evidence at all
    return F.when(c >= m * p, F.lit(1.0)).otherwise(tail)


def least_holdout(alpha: float = ALPHA, delta: float = DELTA) -> int:
    """The fewest good labelled texts of a stratum that certify cutoffs which reject none of them."""
    return ceil(log(delta / len(BANDS)) / log1p(-alpha))


def certify(holdout: DataFrame, spark: SparkSession, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, step, k, n, p_value, a cutoff for each rule): the strictest vector of each stratum up to which all pass.

    ``holdout``: base counts of good labelled texts. Step 0 is the loosest
    vector. A stratum without enough of them, or whose loosest vector fails,
    gets no row, and the rules reject nothing there.
    """
    steps = len(next(iter(RULES.values()))[1])

    def beyond(step: int) -> str:
        return " or ".join(f"{value} > {cuts[-1 - step]}" for value, cuts in RULES.values())

    counted = holdout.withColumn("stratum", stratum()).groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(F.expr(f"cast({beyond(i)} as long)")).alias(f"k{i}") for i in range(steps)))
    cells = ", ".join(f"named_struct('step', {i}, 'k', k{i}, "
                      + ", ".join(f"'{rule}', {cuts[-1 - i]}D" for rule, (_, cuts) in RULES.items()) + ")" for i in range(steps))
    tested = counted.select("stratum", "n", F.expr(f"inline(array({cells}))")).withColumn("p_value", binomial_tail("k", "n", alpha))
    vector = F.struct("step", "k", "n", "p_value", *RULES)
    failed = F.coalesce(F.min(F.when(F.col("p_value") > delta / len(BANDS), F.col("step"))), F.lit(steps))
    best = F.get(F.filter("cells", lambda c: c["step"] == F.col("failed") - 1), F.lit(0))
    return tested.groupBy("stratum").agg(F.collect_list(vector).alias("cells"), failed.alias("failed")) \
        .select("stratum", best.alias("best")).filter("best is not null").select("stratum", "best.*")


def judge(counts: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``counts`` with kept: the base rules pass and no certified cutoff of the text's stratum is exceeded."""
    wide = cutoffs.select("stratum", *(F.col(rule).alias(f"_cut_{rule}") for rule in RULES))
    rows = counts.withColumn("stratum", stratum()).join(F.broadcast(wide), "stratum", "left")
    beyond = F.lit(False)
    for rule, (value, _) in RULES.items():
        beyond = beyond | F.coalesce(F.expr(f"n_words > 0 and {value} > _cut_{rule}"), F.lit(False))
    return rows.withColumn("kept", ~(F.col("base_failed") | beyond)) \
        .drop("stratum", *(f"_cut_{rule}" for rule in RULES))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(id, the base counts, base_failed, kept) of every row.

    The holdout is every labelled row with label 1 that passes the base rules.
    Defined cases: a null text has no words and fails; labels that are null, or
    of unknown documents, don't count; an id that ``labels`` repeats counts
    once; without labels only the base rules reject.
    """
    counts = scratch(base_counts(docs.select(id_col, text_col), text_col).drop(text_col), "rules-base")
    good = labels.filter(F.col(label_col) == 1).select(id_col).dropDuplicates()
    holdout = counts.filter(~F.col("base_failed")).join(good, id_col, "left_semi")
    return judge(counts, certify(holdout, docs.sparkSession, alpha, delta))
