"""URL filters by association rules.

URLs are cut into tokens (scheme, host and its parents, parts of the host name,
folders and file ending of the path, query names). Tokens of the same labelled
URLs are one item, so that the many tokens of one site or one long path don't
multiply. Spark's FP-growth mines the combinations of items; a combination
becomes a blocking rule if enough bad URLs have it (support, as a share and as
a count), if the lower confidence bound of its share of bad URLs is high
enough, by itself and as odds against those of all labelled URLs, and if no
shorter rule is part of it. A URL meets a rule if it has all tokens of its
items. Rules are matched by an inverted index: each rule is posted under its
rarest item, and only URLs with that token test the whole rule.

Given host and path rules come first: a rule fits its host and all subdomains
if the URL's path starts with the rule's, and the longest one decides.

The posted rules are joined without a hint, so Spark picks the join by their
size; tokens that are common to very many URLs are rarely anyone's rarest.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import scratch

MIN_SUPPORT = 0.002    # of the labelled URLs: bad ones with the rule's tokens
MIN_COUNT = 20         # the same as a number, whatever the share
MIN_CONFIDENCE = 0.6   # lower bound of the share of bad URLs among those with the rule's tokens
MIN_ODDS = 2.0         # lower bound of that share's odds over the odds of all labelled URLs
Z = 3.0                # standard deviations of the bound: 1 in 700 chance rules pass it
BAD = "label=bad"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, UPPER.lower())
    return F.coalesce(host, F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL. Numbers count as one token, so page numbers make no combinations of their own."""
    def tag(kind: str, items: Column) -> Column:
        return F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(f"{kind}="), x))

    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    folders = F.transform(F.split(F.lower(path), "/"), lambda x: F.regexp_replace(F.regexp_replace(x, r"\.[a-z0-9]+$", ""), "[0-9]+", "0"))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    names = F.transform(F.split(F.lower(query), "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1))
    return F.array_distinct(F.concat(
        tag("host", parents), tag("word", F.split(host, r"[.\-0-9]+")), tag("path", folders), tag("query", names),
        tag("scheme", F.array(F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)))),
        tag("ending", F.array(F.regexp_extract(F.lower(path), r"\.([a-z0-9]+)$", 1)))))


def lower_bound(hits: Column, n: Column, z: float = Z) -> Column:
    """Wilson's lower confidence bound of a share of ``hits`` in ``n``."""
    share = hits / n
    spread = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return (share + z * z / (2 * n) - spread) / (1 + z * z / n)


def items_of(labelled: DataFrame, least: int) -> DataFrame:
    """(token, item) of the tokens of at least ``least`` (tokens, bad) rows; an item is the least token of the same rows.

    Rows are told apart by two hashes of all their tokens, whose sums identify a
    token's set of rows: rows of equal tokens are in the same sets anyhow.
    """
    row = [F.xxhash64("tokens").cast("decimal(38,0)"), F.xxhash64(F.lit(1), "tokens").cast("decimal(38,0)")]
    sets = labelled.select(F.explode("tokens").alias("token"), row[0].alias("_a"), row[1].alias("_b")) \
        .groupBy("token").agg(F.count(F.lit(1)).alias("_n"), F.sum("_a").alias("_a"), F.sum("_b").alias("_b")) \
        .filter(F.col("_n") >= least)
    least_token = sets.groupBy("_n", "_a", "_b").agg(F.min("token").alias("item"))
    return sets.join(least_token, ["_n", "_a", "_b"]).select("token", "item")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
         min_odds: float = MIN_ODDS, min_count: int = MIN_COUNT, z: float = Z) -> DataFrame:
    """(rule_id, tokens, anchor, confidence, n_bad, n_urls) of the blocking rules of (tokens, bad) rows.

    Defined cases: without rows, with fewer than ``min_count`` bad rows, or when
    nothing passes the pruning there are no rules.
    """
    labelled = scratch(labelled.select("tokens", "bad").withColumn("_row", F.monotonically_increasing_id()), "url-labelled")
    n, n_bad = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    least = max(min_count, ceil(min_support * n), 1)
    if n_bad < least:
        return labelled.sparkSession.createDataFrame(
            [], "tokens array<string>, confidence double, n_bad long, n_urls long, anchor string, rule_id long")
    items = scratch(items_of(labelled, least), "url-items")
    per_row = labelled.select("_row", F.explode("tokens").alias("token")).join(items, "token") \
        .groupBy("_row").agg(F.collect_set("item").alias("items"))
    baskets = labelled.select("_row", "bad").join(per_row, "_row", "left").select(F.concat(
        F.coalesce("items", F.array().cast("array<string>")),
        F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    # half a row under the least count, so that rounding can't raise it
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=min_confidence).fit(scratch(baskets, "url-baskets"))
    hits = F.round(F.col("support") * n)
    low = lower_bound(hits, F.round(hits / F.col("confidence")), z)
    odds = F.when(low < 1, low / (1 - low)).otherwise(float("inf"))
    rules = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD))) \
        .filter((low >= min_confidence) & (odds * (n - n_bad) >= min_odds * n_bad)) \
        .select(F.array_sort("antecedent").alias("items"), "confidence", hits.cast("long").alias("n_bad"),
                F.round(hits / F.col("confidence")).cast("long").alias("n_urls"))
    rules = scratch(rules, "url-rules")
    # a rule that holds a shorter rule says nothing new; each rule is looked for under its first item
    shorter = rules.select(F.col("items").alias("_part"), F.col("items")[0].alias("item"))
    covered = rules.select("items", F.explode("items").alias("item")).join(shorter, "item") \
        .filter((F.size("_part") < F.size("items")) & (F.size(F.array_except("_part", "items")) == 0)).select("items")
    kept = rules.join(covered, "items", "left_anti")
    freq = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("item"), "freq")
    tokens = items.groupBy("item").agg(F.collect_list("token").alias("_tokens"))
    index = kept.withColumn("item", F.explode("items")).join(freq, "item").join(tokens, "item") \
        .groupBy("items", "confidence", "n_bad", "n_urls").agg(
            F.array_sort(F.flatten(F.collect_list("_tokens"))).alias("tokens"),
            F.min_by("item", F.struct("freq", "item")).alias("anchor"))
    return scratch(index.drop("items").withColumn("rule_id", F.xxhash64("tokens")), "url-index")


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting (host, path, verdict) rule as struct(rule, verdict), null if none fits.

    ``rules`` is a short fixed list, so it becomes one expression. Rule hosts
    fit themselves and their subdomains.
    """
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id",
          url_col: str = "url", label_id: str = "doc_id") -> DataFrame:
    """(id, host, path, rule, verdict) of every URL.

    ``labels`` gives (label_id, quality, toxic) for some ids; a URL is bad if
    its quality is 0 or toxic is 1. Defined cases: a null URL or one without
    ``://`` has empty host and path, no tokens, and is allowed; null labels
    teach nothing; with fewer than ``MIN_COUNT`` bad URLs only the given rules
    block; ids that repeat are judged row by row; an id with several labels is
    bad if any is.
    """
    rows = pages.select(F.col(id_col), F.col(url_col).alias("_url"), host_of(F.col(url_col)).alias("host"),
                        path_of(F.col(url_col)).alias("path"))
    given = longest_rule(F.col("host"), F.col("path"), rules)
    tokens = F.when(F.col("_url").contains("://"), tokens_of(F.col("_url"), F.col("host"), F.col("path"))) \
        .otherwise(F.array().cast("array<string>"))
    known = labels.filter(F.col(label_id).isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull())) \
        .groupBy(F.col(label_id).alias(id_col)).agg(
            F.max((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).alias("bad"))
    index = mine(rows.withColumn("tokens", tokens).join(known, id_col).select("tokens", "bad"))

    # every distinct URL is matched once; hosts and paths that many rows share cost one row each
    urls = rows.select("_url", "host", "path").filter("_url is not null").dropDuplicates(["_url"]) \
        .withColumn("tokens", tokens)
    hits = urls.select("_url", F.col("tokens").alias("_own"), F.explode("tokens").alias("anchor")).join(index, "anchor") \
        .filter(F.size(F.array_except("tokens", "_own")) == 0) \
        .groupBy("_url").agg(F.max("confidence").alias("_confidence"))
    return rows.join(hits, "_url", "left").withColumn("_given", given).select(
        id_col, "host", "path", F.col("_given.rule").alias("rule"),
        F.coalesce(F.col("_given.verdict"), F.when(F.col("_confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"))
