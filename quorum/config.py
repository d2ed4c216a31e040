"""Driver-side configuration (small, not data)."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values that must equal the evaluated pipeline's defaults.
DEFAULT_GOOD_TAG = "Good"
DEFAULT_BAD_TAG = "Bad"
DEFAULT_C_FP = 1.0
DEFAULT_C_FN = 30.0
DEFAULT_N_SPLITS = 5
DEFAULT_SEED = 42
DEFAULT_TEST_SIZE = 0.2
DEFAULT_RULE_THRESHOLD = 0.5
KFOLD_PREFIX = "kfold_avg_"
# 21-point grid 0.0, 0.05, ..., 1.0 computed as i * 0.05 in double precision.
DEFAULT_GRID_STEPS = 20


def default_grid() -> list[float]:
    """Threshold grid ``[i * 0.05 for i in 0..20]`` as exact doubles.

    ``i * 0.05`` reproduces ``linspace(0, 1, 21)`` bit for bit, including
    values such as 0.15000000000000002, which matter at grid boundaries.
    """
    return [i * 0.05 for i in range(DEFAULT_GRID_STEPS + 1)]


@dataclass(frozen=True)
class Costs:
    c_fp: float = DEFAULT_C_FP
    c_fn: float = DEFAULT_C_FN


@dataclass
class EvalConfig:
    costs: Costs = field(default_factory=Costs)
    n_splits: int = DEFAULT_N_SPLITS
    seed: int = DEFAULT_SEED
    test_size: float = DEFAULT_TEST_SIZE
    good_tag: str = DEFAULT_GOOD_TAG
    bad_tag: str = DEFAULT_BAD_TAG
    grid: list[float] = field(default_factory=default_grid)
    # Hex digits of the md5 prefix that splits fold ranking into independent
    # slices (see operators.folds); None = chosen from the row count.
    fold_bucket_hex: int | None = None
    # 'exact' (per-class sizes within one, one sort) or 'hash' (no shuffle, balance in expectation)
    fold_mode: str = "exact"
