"""SQL twins of the evaluation plans, used as independent oracles.

They state each computation the brute-force way (e.g. rows x thresholds
cross join for the sweep) so they check the bucketed Spark plans rather than
restate them. Literals are typed explicitly (``::DOUBLE``) because decimal
literals would change result types.
"""

from __future__ import annotations

from collections.abc import Sequence

from quorum.config import EvalConfig
from quorum.plans.views import SCORED_SQL


def precision(tp="tp", fp="fp") -> str:
    return f"CASE WHEN {tp} + {fp} > 0 THEN 100 * {tp} / ({tp} + {fp}) ELSE 0.0::DOUBLE END"


def recall(tp="tp", fn="fn") -> str:
    return f"CASE WHEN {tp} + {fn} > 0 THEN 100 * {tp} / ({tp} + {fn}) ELSE 0.0::DOUBLE END"


def f1(tp="tp", fp="fp", fn="fn") -> str:
    p = f"(CASE WHEN {tp} + {fp} > 0 THEN {tp} / ({tp} + {fp}) ELSE 0.0::DOUBLE END)"
    r = f"(CASE WHEN {tp} + {fn} > 0 THEN {tp} / ({tp} + {fn}) ELSE 0.0::DOUBLE END)"
    return f"CASE WHEN {p} + {r} > 0 THEN 100 * (2 * {p} * {r}) / ({p} + {r}) ELSE 0.0::DOUBLE END"


def accuracy(tp="tp", fp="fp", tn="tn", fn="fn") -> str:
    return (f"CASE WHEN {tp} + {tn} + {fp} + {fn} > 0 THEN 100 * ({tp} + {tn}) / ({tp} + {tn} + {fp} + {fn}) "
            f"ELSE 0.0::DOUBLE END")


def cost(cfg: EvalConfig, fp="fp", fn="fn") -> str:
    return f"({float(cfg.costs.c_fp)!r}::DOUBLE * {fp} + {float(cfg.costs.c_fn)!r}::DOUBLE * {fn})"


def metrics(cfg: EvalConfig) -> str:
    return (f"{precision()} AS precision, {recall()} AS recall, {f1()} AS f1_score, "
            f"{accuracy()} AS accuracy")


def grid_values(cfg: EvalConfig) -> str:
    g = sorted(set(float(t) for t in cfg.grid))
    return ", ".join(f"({t!r}::DOUBLE)" for t in g)


def folds_cte(cfg: EvalConfig, source: str = "scored", name: str = "folds") -> str:
    return f"""{name} AS (
  SELECT *, CAST(((row_number() OVER (PARTITION BY label
                   ORDER BY md5(concat_ws(':', id, '{cfg.seed}')), id) - 1) % {cfg.n_splits}) + 1 AS INTEGER) AS fold
  FROM {source})"""


def long_cte(score_cols: Sequence[str], source: str = "folds", name: str = "long") -> str:
    parts = [f"SELECT id, label, fold, '{c}' AS model_name, CAST({c} AS DOUBLE) AS score FROM {source}"
             for c in score_cols]
    return f"{name} AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


def sweep_cte(cfg: EvalConfig, source: str = "long", name: str = "sweep",
              keys: Sequence[str] = ("model_name", "fold")) -> str:
    """Brute force: every row against every threshold."""
    k = ", ".join(f"l.{c}" for c in keys)
    kk = ", ".join(keys)
    return f"""grid(threshold) AS (VALUES {grid_values(cfg)}),
{name}_counts AS (
  SELECT {k}, g.threshold,
         CAST(count(*) FILTER (WHERE l.label = 1 AND coalesce(l.s >= g.threshold, false)) AS BIGINT) AS tp,
         CAST(count(*) FILTER (WHERE l.label = 0 AND coalesce(l.s >= g.threshold, false)) AS BIGINT) AS fp,
         CAST(count(*) FILTER (WHERE l.label = 0 AND NOT coalesce(l.s >= g.threshold, false)) AS BIGINT) AS tn,
         CAST(count(*) FILTER (WHERE l.label = 1 AND NOT coalesce(l.s >= g.threshold, false)) AS BIGINT) AS fn
  FROM (SELECT *, CASE WHEN isnan(score) THEN NULL ELSE score END AS s FROM {source}) l CROSS JOIN grid g
  GROUP BY {k}, g.threshold),
{name} AS (
  SELECT {kk}, threshold, tp, fp, tn, fn, {cost(cfg)} AS cost, fp + fn AS total_mistakes, {metrics(cfg)}
  FROM {name}_counts)"""


def best_cte(source: str = "sweep", name: str = "best", keys: Sequence[str] = ("model_name", "fold")) -> str:
    kk = ", ".join(keys)
    return f"""{name}_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {kk} ORDER BY cost, threshold) AS rc,
            row_number() OVER (PARTITION BY {kk} ORDER BY tp + tn DESC, threshold) AS ra
  FROM {source}),
{name} AS (
  SELECT *, 'cost' AS threshold_type FROM {name}_ranked WHERE rc = 1
  UNION ALL
  SELECT *, 'accuracy' AS threshold_type FROM {name}_ranked WHERE ra = 1)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def score_eval_sql(cfg: EvalConfig, score_cols: Sequence[str]) -> str:
    """M7 oracle."""
    body = f"""SELECT 'kfold_avg_' || model_name AS model_name, 'Full' AS split, threshold_type,
       list_reduce(_l, lambda a, x: a + x) / k AS threshold,
       {precision()} AS precision, {recall()} AS recall, {f1()} AS f1_score, {accuracy()} AS accuracy,
       cost, tp, fp, tn, fn, false AS is_base_model, cost AS cost_total
FROM (SELECT model_name, threshold_type, list(threshold ORDER BY fold) AS _l,
             CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp,
             CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fn) AS BIGINT) AS fn,
             sum(cost) AS cost, count(*) AS k
      FROM best GROUP BY model_name, threshold_type) s"""
    return with_(SCORED_SQL, folds_cte(cfg), long_cte(score_cols), sweep_cte(cfg), best_cte()) + body


def decision_long_cte(cfg: EvalConfig, decision_cols: Sequence[str], source: str = "scored",
                      name: str = "dlong") -> str:
    parts = [f"SELECT id, label, '{c}' AS model_name, CASE WHEN {c} = '{cfg.bad_tag}' THEN 1 ELSE 0 END AS pred "
             f"FROM {source}" for c in decision_cols]
    return f"{name} AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


def counts_cte(source: str, name: str = "counts", keys: Sequence[str] = ("model_name",)) -> str:
    kk = ", ".join(keys)
    return f"""{name} AS (
  SELECT {kk},
         CAST(count(*) FILTER (WHERE label = 1 AND pred = 1) AS BIGINT) AS tp,
         CAST(count(*) FILTER (WHERE label = 0 AND pred = 1) AS BIGINT) AS fp,
         CAST(count(*) FILTER (WHERE label = 0 AND pred = 0) AS BIGINT) AS tn,
         CAST(count(*) FILTER (WHERE label = 1 AND pred = 0) AS BIGINT) AS fn
  FROM {source} GROUP BY {kk})"""


def decision_results_select(cfg: EvalConfig, threshold_type: str, source: str = "counts") -> str:
    return f"""SELECT model_name, 'Full' AS split, '{threshold_type}' AS threshold_type, CAST(NULL AS DOUBLE) AS threshold,
       {metrics(cfg)}, {cost(cfg)} / {int(cfg.n_splits)} AS cost, tp, fp, tn, fn,
       true AS is_base_model, {cost(cfg)} AS cost_total
FROM {source}"""


def threshold_decision(expr: str, threshold: float) -> str:
    s = f"(CASE WHEN isnan({expr}) THEN NULL ELSE {expr} END)"
    return f"CASE WHEN coalesce({s} >= {float(threshold)!r}::DOUBLE, false) THEN 1 ELSE 0 END"
