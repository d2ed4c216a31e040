"""Decision combination: rule resolution, score picking, model-kind test,
threshold application and the combined runs (B7-B10, J3, J4, P19, P20).

Inputs are normalised tables, not in-memory arrays:
  predictions(model_name, kind, id, score)   kind in {'oof', 'Full', ...}
  labels(id, label)
All rules of a call are evaluated in ONE projection over one wide frame
(``scores_by_id`` with explicit model names), then unpivoted and counted in one
aggregate. Per-model facts (kind, 0/1 test) are tiny tables broadcast with a
bound equal to the number of models.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorum.config import DEFAULT_RULE_THRESHOLD, KFOLD_PREFIX, Costs
from quorum.functions import metrics as M
from quorum.functions.rules import canonical_logic, combine
from quorum.operators.evaluation import confusion_counts, decision_results


@dataclass
class Rule:
    name: str
    columns: list[str]
    logic: str = "OR"
    enabled: bool = True


def run_names_of(column: str) -> tuple[str, ...]:
    """The run names that a rule column may mean, best first: itself, then its k-fold average."""
    return column, f"{KFOLD_PREFIX}{column}"


def run_index(runs: Sequence[str]) -> dict[str, str]:
    """Run by full and by short name; of runs that share a name the later one has it."""
    return {name: run for run in runs for name in (run, run.replace(KFOLD_PREFIX, ""))}


def resolve_columns(rules: Sequence[Rule], run_names: Sequence[str]) -> dict[str, str]:
    """Rule column -> run name, the first of ``run_names_of`` that the run index knows."""
    index = run_index(run_names)
    out = {c: next((index[n] for n in run_names_of(c) if n in index), None) for r in rules for c in r.columns}
    unknown = sorted(c for c, run in out.items() if run is None)
    if unknown:
        raise ValueError(f"no run is named {', '.join(unknown)}; there are {', '.join(sorted(index))}")
    return out


def validate_rules(rules: Sequence[Rule], available: Sequence[str]) -> list[Rule]:
    """The enabled rules; no columns, unknown logic, unknown run or a repeated rule name -> ValueError."""
    enabled = [r for r in rules if r.enabled]
    names = [r.name for r in enabled]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"several rules are named {', '.join(repeated)}")
    empty = [r.name for r in enabled if not r.columns]
    if empty:
        raise ValueError(f"rules without columns: {', '.join(empty)}")
    for r in enabled:
        canonical_logic(r.logic)
    resolve_columns(enabled, available)
    return enabled


def resolved_columns(rule_columns: DataFrame, runs: DataFrame) -> DataFrame:
    """J4 as a join: (rule_name, column_name, run) of the rule columns that name a run."""
    run = F.col("model_name")
    index = runs.select(run).distinct().select(F.explode(F.array(run, F.regexp_replace(run, KFOLD_PREFIX, ""))).alias("key"),
                                               run.alias("run"))
    names = rule_columns.withColumn("key", F.explode(F.array("column_name", F.concat(F.lit(KFOLD_PREFIX), "column_name"))))
    # both sides are as small as the rules and the runs
    return names.join(F.broadcast(index), "key").groupBy("rule_name", "column_name").agg(F.max("run").alias("run"))


def unresolved_columns(rule_columns: DataFrame, runs: DataFrame) -> DataFrame:
    """Rule columns (rule_name, column_name) with no matching run (left anti)."""
    return rule_columns.join(resolved_columns(rule_columns, runs), ["rule_name", "column_name"], "left_anti")


def pick_scores(predictions: DataFrame) -> DataFrame:
    """Per model keep one kind: 'oof', else 'Full', else the longest series."""
    sizes = predictions.groupBy("model_name", "kind").agg(F.count(F.lit(1)).alias("n"))
    pref = F.when(F.col("kind") == "oof", 0).when(F.col("kind") == "Full", 1).otherwise(2)
    w = Window.partitionBy("model_name").orderBy(pref, F.col("n").desc(), F.col("kind"))
    return sizes.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("model_name", "kind", "n")


def classify_models(predictions: DataFrame) -> DataFrame:
    """P20: model_kind 'decision' if every non-null score is 0 or 1, else 'meta' (no data -> meta)."""
    s = M.nan_to_null("score")
    in01 = F.coalesce(s.isin(0.0, 1.0), F.lit(True))
    has_data = F.count(s) > 0
    return predictions.groupBy("model_name").agg(
        F.when(has_data & F.bool_and(in01), F.lit("decision")).otherwise(F.lit("meta")).alias("model_kind"))


def scores_by_id(predictions: DataFrame, models: Sequence[str], flag: str | None = None) -> DataFrame:
    """One row per id with the score of every model, under the model's name; of several, one that isn't null.

    ``flag`` names a boolean or number of the rows, whose largest value per model comes along as ``{m}__{flag}``.
    One aggregate by id: rows of an id that meet in a task are merged there, and the shuffle
    carries one row an id and task, not a row a model.
    """
    of = {m: F.col("model_name") == m for m in models}
    cells = [F.first(F.when(is_of, F.col("score")), ignorenulls=True).alias(m) for m, is_of in of.items()]
    if flag:
        cells += [F.max(F.when(is_of, F.col(flag))).alias(f"{m}__{flag}") for m, is_of in of.items()]
    return predictions.groupBy("id").agg(*cells)


def rule_inputs(predictions: DataFrame, models: Sequence[str]) -> DataFrame:
    """J3 + P19 + P20: one wide row per id with, per model, its picked score
    (``{m}__score``) and whether the model is a decision model (``{m}__dec``)."""
    chosen = pick_scores(predictions.filter(F.col("model_name").isin(list(models)))).select("model_name", "kind")
    picked = predictions.join(F.broadcast(chosen), ["model_name", "kind"])
    kinds = classify_models(picked)
    long = picked.join(F.broadcast(kinds), "model_name").select(
        "id", "model_name", M.nan_to_null("score").alias("score"),
        (F.col("model_kind") == "decision").alias("dec"))
    wide = scores_by_id(long, models, "dec")
    return wide.select("id", *[F.col(f"`{n}`").alias(f"{m}__{a}") for m in models
                               for n, a in ((m, "score"), (f"{m}__dec", "dec"))])


def decision_of(model: str, threshold: float) -> Column:
    """Decision models pass through, score models use ``score >= threshold``; missing -> 0."""
    s = F.col(f"{model}__score")
    return F.when(F.coalesce(F.col(f"{model}__dec"), F.lit(False)), F.coalesce(s.cast("int"), F.lit(0))) \
        .otherwise(M.apply_threshold(s, threshold))


def model_facts(predictions: DataFrame) -> dict[str, dict]:
    """P19 + P20 in one small aggregate over the predictions: per model the picked kind
    ('oof', else 'Full', else the longest series) and whether it is a decision model.
    The result has one entry per (model, kind) — bounded by the number of models."""
    s = M.nan_to_null("score")
    rows = predictions.groupBy("model_name", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.count(s).alias("n_scored"),
        F.coalesce(F.bool_and(F.coalesce(s.isin(0.0, 1.0), F.lit(True))), F.lit(True)).alias("all01")).collect()
    pref = {"oof": 0, "Full": 1}
    out: dict[str, dict] = {}
    for r in sorted(rows, key=lambda r: (r["model_name"], pref.get(r["kind"], 2), -r["n"], r["kind"])):
        if r["model_name"] not in out:
            out[r["model_name"]] = {"kind": r["kind"], "decision": r["n_scored"] > 0 and r["all01"]}
    return out


def ruled_ids(predictions: DataFrame, labels: DataFrame, rules: Sequence[Rule],
              model_thresholds: dict[str, float] | None = None, facts: dict[str, dict] | None = None) -> DataFrame:
    """B9 on long predictions: (id, label, a column per enabled rule with its 0 / 1 decision, NULL where none of its runs
    covers the id). The job fails if a rule combines runs that don't cover the same ids."""
    facts = model_facts(predictions) if facts is None else facts
    rules = validate_rules(rules, list(facts))
    mapping = resolve_columns(rules, list(facts))
    models = list(dict.fromkeys(mapping[c] for r in rules for c in r.columns))
    thresholds = model_thresholds or {}
    picked = reduce(lambda a, b: a | b, [(F.col("model_name") == m) & (F.col("kind") == facts[m]["kind"])
                                         for m in models])
    wide = scores_by_id(predictions.filter(picked).select("id", "model_name", M.nan_to_null("score").alias("score"),
                                                          F.lit(1).alias("has")), models, "has")

    def ruled_by(r: Rule) -> Column:
        """The rule's decision; NULL for ids that none of its runs covers, an error where only some do."""
        has = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"`{mapping[c]}__has`"), F.lit(0)) for c in r.columns])
        return F.when(has == len(r.columns), combine(r.logic, [decision(c) for c in r.columns])).when(
            has > 0, F.raise_error(F.lit(f"rule {r.name}: its runs cover different ids")).cast("int"))

    def decision(c: str) -> Column:
        m = mapping[c]
        if facts[m]["decision"]:
            return F.coalesce(F.col(f"`{m}`").cast("int"), F.lit(0))
        return M.apply_threshold(F.col(f"`{m}`"), thresholds.get(c, DEFAULT_RULE_THRESHOLD))

    combos = [ruled_by(r).alias(r.name) for r in rules]
    return wide.join(labels.select("id", "label"), "id").select("id", "label", *combos)


def ruled_long(ruled: DataFrame, names: Sequence[str]) -> DataFrame:
    """(id, label, model_name, pred) of the rules' decisions."""
    return ruled.select("id", "label", *[F.col(f"`{n}`") for n in names]) \
        .unpivot(["id", "label"], [F.col(f"`{n}`") for n in names], "model_name", "pred").filter("pred is not null")


def ruled_predictions(long: DataFrame) -> DataFrame:
    """The rules' decisions as predictions (model_name, kind='Full', id, score)."""
    return long.select("model_name", F.lit("Full").alias("kind"), "id", F.col("pred").cast("double").alias("score"))


def combined_runs(predictions: DataFrame, labels: DataFrame, rules: Sequence[Rule], costs: Costs,
                  n_splits: int, model_thresholds: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """B9 on long predictions: (results rows, combined predictions) for every enabled rule.

    Two passes over the predictions: one small aggregate for the per-model facts
    (P19/P20, also the list of runs), then one aggregate by id with explicit model
    names feeding a single projection of all rules, an unpivot and one count. The job
    fails if a rule combines runs that don't cover the same ids.
    Results: split 'Full', threshold_type 'combined', threshold NULL,
    cost / n_splits, is_base_model True. Predictions: (model_name, kind='Full', id, score).
    """
    facts = model_facts(predictions)
    rules = validate_rules(rules, list(facts))
    if not rules:
        empty_schema = ("model_name string, split string, threshold_type string, threshold double, "
                        "precision double, recall double, f1_score double, accuracy double, cost double, "
                        "tp long, fp long, tn long, fn long, is_base_model boolean, cost_total double")
        spark = predictions.sparkSession
        return (spark.createDataFrame([], empty_schema),
                spark.createDataFrame([], "model_name string, kind string, id string, score double"))
    long = ruled_long(ruled_ids(predictions, labels, rules, model_thresholds, facts), [r.name for r in rules])
    counts = confusion_counts(long, ["model_name"], "label", "pred")
    return decision_results(counts, costs, n_splits, "combined"), ruled_predictions(long)


def wide_model_kinds(wide: DataFrame, model_cols: dict[str, str]) -> dict[str, bool]:
    """P20 on a wide frame: one 1-row aggregate telling, per model column, whether every
    non-null value is 0 or 1 (a decision model)."""
    row = wide.agg(*[
        (F.count(M.nan_to_null(c)) > 0)
        & F.coalesce(F.bool_and(F.coalesce(M.nan_to_null(c).isin(0.0, 1.0), F.lit(True))), F.lit(True))
        for c in model_cols.values()]).collect()[0]
    return {m: bool(row[i]) for i, m in enumerate(model_cols)}


def decisions_wide(wide: DataFrame, model_cols: dict[str, str], thresholds: dict[str, float] | None = None,
                   id_col: str = "id") -> DataFrame:
    """B7 on a wide frame: decision models pass through, score models become
    ``score >= threshold`` (default 0.5), missing -> 0; one projection, no shuffle."""
    is_dec = wide_model_kinds(wide, model_cols)
    thresholds = thresholds or {}

    def decision(m: str) -> Column:
        s = M.nan_to_null(model_cols[m])
        if is_dec[m]:
            return F.coalesce(s.cast("int"), F.lit(0))
        return M.apply_threshold(s, thresholds.get(m, DEFAULT_RULE_THRESHOLD))

    return wide.select(F.col(id_col).alias("id"), *[decision(m).alias(m) for m in model_cols])


def combined_runs_wide(wide: DataFrame, label_col: str, model_cols: dict[str, str], rules: Sequence[Rule],
                       costs: Costs, n_splits: int, model_thresholds: dict[str, float] | None = None,
                       id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """B9 over a wide frame (one column per model, e.g. the scored table itself).

    Same semantics as ``combined_runs`` without the long -> wide pivot: the
    model-kind test (P20) is one small aggregate, then all rules are one
    projection, one unpivot and one count — no shuffle of rows at all.
    ``model_cols`` maps run name -> column of ``wide`` holding its 0/1 or score series.
    """
    run_names = list(model_cols)
    rules = validate_rules(rules, run_names)
    mapping = resolve_columns(rules, run_names)
    models = list(dict.fromkeys(mapping[c] for r in rules for c in r.columns))
    is_dec = wide_model_kinds(wide, {m: model_cols[m] for m in models})
    thresholds = model_thresholds or {}

    def decision(c: str) -> Column:
        m = mapping[c]
        s = M.nan_to_null(model_cols[m])
        if is_dec[m]:
            return F.coalesce(s.cast("int"), F.lit(0))
        return M.apply_threshold(s, thresholds.get(c, DEFAULT_RULE_THRESHOLD))

    combos = [combine(r.logic, [decision(c) for c in r.columns]).alias(r.name) for r in rules]
    ruled = wide.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), *combos)
    long = ruled.unpivot(["id", "label"], [r.name for r in rules], "model_name", "pred")
    counts = confusion_counts(long, ["model_name"], "label", "pred")
    results = decision_results(counts, costs, n_splits, "combined")
    preds = long.select("model_name", F.lit("Full").alias("kind"), "id", F.col("pred").cast("double").alias("score"))
    return results, preds


_MASK_BITS = 62  # runs in one number of a mask


def rule_problems(predictions: DataFrame, rule_columns: DataFrame) -> DataFrame:
    """B8 as data: (rule_name, problem, detail) for rules that cannot be evaluated.

    'unknown_model': a rule column resolves to no run (J4 anti join);
    'unequal_ids': some ids are covered by a part of the rule's runs only; detail is
    their number. Config-level errors (empty columns, unknown logic, duplicate
    names) are raised by ``validate_rules`` before any job runs.
    """
    unknown = unresolved_columns(rule_columns, predictions).select(
        "rule_name", F.lit("unknown_model").alias("problem"), F.col("column_name").alias("detail"))
    facts = model_facts(predictions)
    spark = predictions.sparkSession
    kinds = spark.createDataFrame([(m, f["kind"], *divmod(i, _MASK_BITS)) for i, (m, f) in enumerate(sorted(facts.items()))],
                                  "model_name string, kind string, word int, bit int")
    # the runs that cover an id are bits of a few numbers, so its rows merge into one whatever the number of rules
    words = range(max(1, -(-len(facts) // _MASK_BITS)))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    masks = [F.coalesce(F.bit_or(F.when(F.col("word") == w, bit)), F.lit(0).cast("long")) for w in words]
    runs = resolved_columns(rule_columns, kinds).select("rule_name", F.col("run").alias("model_name")).distinct()
    wanted = runs.join(F.broadcast(kinds), "model_name").groupBy("rule_name").agg(*[m.alias(f"want{w}") for w, m in zip(words, masks)])
    covered = predictions.join(F.broadcast(kinds), ["model_name", "kind"]) \
        .groupBy("id").agg(*[m.alias(f"has{w}") for w, m in zip(words, masks)]) \
        .groupBy(*[f"has{w}" for w in words]).agg(F.count(F.lit(1)).alias("n"))  # one row a set of runs that some id has
    has, all_of = (reduce(lambda a, b: a + b, cols, F.lit(0)) for cols in (
        [F.bit_count(F.col(f"has{w}").bitwiseAND(F.col(f"want{w}"))) for w in words], [F.bit_count(f"want{w}") for w in words]))
    uneven = covered.crossJoin(F.broadcast(wanted)).filter((has > 0) & (has < all_of)).groupBy("rule_name").agg(
        F.lit("unequal_ids").alias("problem"), F.sum("n").cast("string").alias("detail"))
    return unknown.unionByName(uneven)
